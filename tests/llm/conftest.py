from odd_rows import clashing, documents, empty, labels  # noqa: F401
