"""A storage-reader facade: the access paths that engines expect of a graph store, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relgraph.operators.graph import PropertyGraph
from relgraph.types import graph_type


class GraphReader:
    """Labels and properties go by name or by position; lists are DataFrames; a vertex is (label, oid)."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    # Traits.

    def is_directed(self) -> bool:
        return not all(t.undirected for t in self.graph.types.values())

    def is_multigraph(self) -> bool:
        return True

    # Types.

    def vertex_labels(self) -> list[str]:
        return list(self.graph.vertices)

    def edge_labels(self) -> list[str]:
        return list(self.graph.edges)

    def label_id(self, label: str) -> int:
        """Vertex labels count from 0, edge labels on from there."""
        return [*self.graph.vertices, *self.graph.edges].index(label)

    def label_name(self, number: int) -> str:
        return [*self.graph.vertices, *self.graph.edges][number]

    def ends(self, edge_label: str) -> tuple[str, str]:
        t = self.graph.types[edge_label]
        return t.src_label, t.dst_label

    def edge_labels_between(self, src: str, dst: str) -> list[str]:
        return self.graph.edge_types_between(src, dst)

    # Properties.

    def _table(self, label: str) -> DataFrame:
        return self.graph.vertices[label] if label in self.graph.vertices else self.graph.edges[label]

    def properties(self, label: str) -> list[tuple[int, str, str]]:
        """(id, name, type) of a label's properties."""
        kept = [f for f in self._table(label).schema.fields if f.name not in ("oid", "src", "dst")]
        return [(i, f.name, graph_type(f.dataType)) for i, f in enumerate(kept)]

    def property_id(self, label: str, name: str) -> int:
        return next(i for i, n, _ in self.properties(label) if n == name)

    # Vertices.

    def vertices(self, label: str) -> DataFrame:
        return self.graph.vertices[label]

    def vertex_count(self, label: str | None = None) -> int:
        return (self.graph.all_vertices() if label is None else self.graph.vertices[label]).count()

    def vertex(self, label: str, oid) -> dict | None:
        """A vertex's row, or nothing if there is none."""
        row = self.graph.vertices[label].filter(F.col("oid") == F.lit(oid)).first()
        return row.asDict() if row else None

    def value(self, label: str, oid, prop: str):
        row = self.vertex(label, oid)
        if row is None:
            raise KeyError((label, oid))
        return row[prop]

    def reference(self, label: str, oid) -> str:
        """A vertex as text, for another process to resolve."""
        return f"{self.label_id(label)}:{oid}"

    def resolve(self, reference: str) -> tuple[str, str]:
        number, oid = reference.split(":", 1)
        return self.label_name(int(number)), oid

    # Edges.

    def edges(self, label: str) -> DataFrame:
        return self.graph.edges[label]

    def edge_count(self, label: str | None = None) -> int:
        """Edges; an undirected one counts twice, as it stands in the lists of both its ends."""
        chosen = [label] if label else list(self.graph.edges)
        return sum(self.graph.edges[k].count() * (1 + self.graph.types[k].undirected) for k in chosen)

    def adjacent(self, label: str, oid, direction: str = "out", edge_label: str | None = None) -> DataFrame:
        """(elabel, nbr_label, nbr) of one vertex."""
        adj = self.graph.adjacency(direction, [edge_label] if edge_label else None)
        return adj.filter((F.col("label") == label) & (F.col("oid") == F.lit(oid))).select("elabel", "nbr_label", "nbr")

    def degree(self, direction: str = "out") -> DataFrame:
        return self.graph.degrees(direction)

    # Partitions.

    def partitions(self, label: str) -> DataFrame:
        """(partition, n): how Spark has laid a label out."""
        return self.graph.vertices[label].groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))
