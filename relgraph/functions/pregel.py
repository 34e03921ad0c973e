"""Vertex programs as DataFrame steps.

State is a table by vertex id; a superstep joins the senders' state to their out-edges, combines the messages by
receiver (partial aggregation combines at the sender), and evaluates the compute expressions over state and message.
A vertex halts when its halt expression holds and wakes when a message comes.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.operators.graph import SimpleGraph
from relgraph.runtime import cut, held

#: Global aggregators by name; each takes a Column.
AGGREGATORS: dict[str, Callable[[Column], Column]] = {
    "and": F.bool_and,
    "or": F.bool_or,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "product": F.product,
    # The value of the largest of those set, as rows have no order: what "the last one" means must not depend on tasks.
    "overwrite": F.max,
    "append": lambda c: F.array_join(F.array_sort(F.collect_list(c)), ""),
}


@dataclass
class Pregel:
    """init: column -> expression over the vertex; send: expression over ``src`` state, ``dst`` id and edge columns (null:
    no message); combine: aggregate of ``msg``; compute: column -> expression over state and ``msg``; halt: expression over the new
    state. In every expression ``step`` is the superstep, and ``agg`` a function from the name of an aggregator to its last value."""

    graph: SimpleGraph
    init: dict[str, Column]
    send: Callable[[Pregel], Column]
    combine: Callable[[Column], Column]
    compute: Callable[[Pregel], dict[str, Column]]
    halt: Callable[[Pregel], Column] | None = None
    aggregators: dict[str, tuple[str, Column]] = field(default_factory=dict)
    step: int = 0
    values: dict[str, object] = field(default_factory=dict)

    def agg(self, name: str) -> Column:
        return F.lit(self.values.get(name))

    def run(self, steps: int | None = None) -> DataFrame:
        """(id, state columns) when all vertices have halted and no message is left, or after ``steps`` supersteps if they are given.

        A program without a halt expression needs ``steps``."""
        if steps is None and self.halt is None:
            raise ValueError("a program that never halts needs a number of steps")
        names = list(self.init)
        state = cut(self.graph.vertices.select("id", *[e.alias(c) for c, e in self.init.items()], F.lit(True).alias("active")))
        self._aggregate(state)
        with held(self.graph.directed(), "src") as (_, join):
            for self.step in itertools.count(1) if steps is None else range(1, steps + 1):
                state = cut(self._superstep(state, join, names))
                self._aggregate(state)
                if self.halt and state.filter("active").isEmpty():
                    break
        return state.select("id", *names)

    def _superstep(self, state: DataFrame, join: Callable[[DataFrame], DataFrame], names: list[str]) -> DataFrame:
        senders = state.filter("active").withColumnRenamed("id", "src").drop("active")
        messages = join(senders).select(F.col("dst").alias("id"), self.send(self).alias("msg")).filter("msg is not null")
        inbox = messages.groupBy("id").agg(self.combine(F.col("msg")).alias("msg"))
        awake = F.col("active") | F.col("msg").isNotNull()
        new = {c: F.when(awake, e).otherwise(F.col(c)) for c, e in self.compute(self).items()}
        both = state.join(inbox, "id", "left").select("id", *[new.get(c, F.col(c)).alias(c) for c in names], awake.alias("awake"), *[F.col(c).alias(f"old_{c}") for c in names])
        active = F.col("awake") & ~self.halt(self) if self.halt else F.col("awake")
        return both.withColumn("active", F.coalesce(active, F.lit(False))).select("id", *names, "active")

    def _aggregate(self, state: DataFrame) -> None:
        if self.aggregators:
            row = state.agg(*[AGGREGATORS[kind](e).alias(k) for k, (kind, e) in self.aggregators.items()]).first()
            self.values = row.asDict()
