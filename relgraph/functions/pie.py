"""Programs of a first evaluation and incremental ones: run until nothing changes.

``first(graph)`` returns a state (id, ..., changed boolean); ``next_(graph, state, changed)`` gets the state and its changed rows and
returns the new state. Between rounds the state is written to the shared folder. Steps may use any DataFrame operation,
``applyInPandas`` and Pandas UDFs included.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from relgraph.operators.graph import SimpleGraph, key_set
from relgraph.runtime import cut, done_with


def run_pie(graph: SimpleGraph, first: Callable[[SimpleGraph], DataFrame], next_: Callable[[SimpleGraph, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The state, without ``changed``, when no row changes."""
    g = SimpleGraph(graph.vertices, cut(graph.edges), graph.undirected)
    state = cut(first(g))
    while not (changed := state.filter("changed")).isEmpty():
        state, old = cut(next_(g, state, changed.drop("changed"))), state
        done_with(old)
    return state.drop("changed")


def vectorised(compute: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A vertex program over batches of state rows with their messages, as pandas frames in and out."""

    def run(df: DataFrame) -> DataFrame:
        return df.mapInPandas(lambda frames: map(compute, frames), schema)

    return run


def messages(g: SimpleGraph, changed: DataFrame, value: str, message, combine) -> DataFrame:
    """(id, msg): what changed vertices send along their out-edges, combined by receiver; message is a Column over the
    sender's ``value`` and the edge's columns. Edges that leave no changed vertex are dropped before the join, unshuffled."""
    leaving = key_set(changed.select(F.col("id").alias("oid")))(g.directed(), "src")
    sent = changed.select(F.col("id").alias("src"), value).join(leaving, "src")
    return sent.select(F.col("dst").alias("id"), message.alias("msg")).groupBy("id").agg(combine(F.col("msg")).alias("msg"))
