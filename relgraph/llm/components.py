"""Connected components of a link table of long ids: the library's, which never gathers links in one place."""

from __future__ import annotations

from relgraph.functions.components import connected as connected_components  # noqa: F401
