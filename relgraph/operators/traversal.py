"""A fluent traversal over a property graph: each step is a join, a filter or a projection.

The state is a bag of traversers (label, oid, tagged positions). A vertex table is only joined where a
property is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.operators.graph import PropertyGraph, union


def oid_of(graph: PropertyGraph, column: str) -> Column:
    """An id column as traversers carry it: as it is if all labels have ids of one type (numbers join faster), else as text."""
    kinds = {v.schema["oid"].dataType.simpleString() for v in graph.vertices.values()}
    return F.col(column) if len(kinds) == 1 else F.col(column).cast("string")


@dataclass(frozen=True)
class Traversal:
    graph: PropertyGraph
    df: DataFrame  # label, oid, tag columns ``t_x`` (struct label, oid), and the path once it is asked for
    tags: tuple[str, ...] = ()
    simple: bool = False

    @staticmethod
    def of(graph: PropertyGraph, *labels: str) -> Traversal:
        """All vertices, of the labels if any are named."""
        v = union([graph.vertices[k].select(F.lit(k).alias("label"), oid_of(graph, "oid").alias("oid")) for k in labels or graph.vertices])
        return Traversal(graph, v)

    def _with(self, df: DataFrame) -> Traversal:
        return replace(self, df=df)

    def where(self, condition: Column) -> Traversal:
        return self._with(self.df.filter(condition))

    def has(self, label: str, prop: str, value) -> Traversal:
        """Traversers at vertices of a label with a property equal to a value (or satisfying a function of its column)."""
        v = self.graph.vertices[label]
        condition = value(F.col(prop)) if callable(value) else F.col(prop) == value
        keys = v.filter(condition).select(F.lit(label).alias("label"), oid_of(self.graph, "oid").alias("oid"))
        return self._with(self.df.join(keys, ["label", "oid"], "left_semi").select(self.df.columns))

    def simple_paths(self) -> Traversal:
        """From here on, no vertex twice on a path; only now are paths carried along."""
        df = self.df if "path" in self.df.columns else self.df.withColumn("path", F.array(F.concat_ws(":", "label", "oid")))
        return replace(self, df=df, simple=True)

    def _step(self, direction: str, labels: tuple[str, ...]) -> DataFrame:
        adj = self.graph.adjacency(direction, list(labels) or None)
        adj = adj.select("label", oid_of(self.graph, "oid").alias("oid"), "nbr_label", oid_of(self.graph, "nbr").alias("nbr"))
        rest = [c for c in self.df.columns if c not in ("label", "oid", "path")]
        node = F.concat_ws(":", "nbr_label", "nbr")
        moved = self.df.join(adj, ["label", "oid"])
        if not self.simple:
            return moved.select(F.col("nbr_label").alias("label"), F.col("nbr").alias("oid"), *rest)
        moved = moved.filter(~F.array_contains("path", node))
        return moved.select(F.col("nbr_label").alias("label"), F.col("nbr").alias("oid"), F.array_append("path", node).alias("path"), *rest)

    def hop(self, direction: str, *labels: str, times: tuple[int, int] = (1, 2)) -> Traversal:
        """``times`` = (first, end) hops, first included and end not, along edges of the labels; all lengths in one bag."""
        here, out = self, [self.df] if times[0] == 0 else []
        for n in range(1, times[1]):
            here = here._with(here._step(direction, labels))
            if n >= times[0]:
                out.append(here.df)
        return self._with(union(out))

    def out(self, *labels: str, times: tuple[int, int] = (1, 2)) -> Traversal:
        return self.hop("out", *labels, times=times)

    def in_(self, *labels: str, times: tuple[int, int] = (1, 2)) -> Traversal:
        return self.hop("in", *labels, times=times)

    def both(self, *labels: str, times: tuple[int, int] = (1, 2)) -> Traversal:
        return self.hop("both", *labels, times=times)

    def as_(self, tag: str) -> Traversal:
        return replace(self, df=self.df.withColumn(f"t_{tag}", F.struct("label", "oid")), tags=(*self.tags, tag))

    def tagged(self, name: str, value: Column) -> Traversal:
        """Traversers with a value of their own, kept along the way."""
        return self._with(self.df.withColumn(name, value))

    def at(self, tag: str) -> Traversal:
        """Move back to a tagged position."""
        return self._with(self.df.withColumns({"label": F.col(f"t_{tag}.label"), "oid": F.col(f"t_{tag}.oid")}))

    def same_as(self, tag: str) -> Traversal:
        return self.where((F.col("label") == F.col(f"t_{tag}.label")) & (F.col("oid") == F.col(f"t_{tag}.oid")))

    def union(self, *others) -> Traversal:
        """The bag of several continuations of this traversal."""
        return self._with(union([f(self).df.select(self.df.columns) for f in others]))

    def dedup(self, tag: str | None = None) -> Traversal:
        return self._with(self.df.dropDuplicates(["label", "oid"] if tag is None else [f"t_{tag}"]))

    def limit(self, n: int) -> Traversal:
        return self._with(self.df.orderBy("label", "oid").limit(n))

    def counted(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def group_count(self, tag: str | None = None, distinct: bool = False) -> DataFrame:
        """(label, oid, n) by the tagged or the current position; distinct counts current vertices once."""
        key = F.struct("label", "oid") if tag is None else F.col(f"t_{tag}")
        n = F.count_distinct(F.struct("label", "oid")) if distinct else F.count(F.lit(1))
        return self.df.groupBy(key.alias("k")).agg(n.alias("n")).select("k.label", "k.oid", "n")

    def values(self, label: str, *props: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """Properties at the current positions of one label, with tagged oids as columns named by their tags."""
        v = self.graph.vertices[label].select(oid_of(self.graph, "oid").alias("oid"), *props)
        tagged = [F.col(f"t_{t}.oid").cast("long").alias(t) for t in keep]
        return self.df.filter(F.col("label") == label).select("oid", *tagged).join(v, "oid").select(F.col("oid").cast("long").alias("oid"), *keep, *props)
