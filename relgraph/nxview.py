"""A NetworkX-shaped view of a property graph: nodes are (label, oid), directed, parallel edges collapse in mappings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.operators.graph import EdgeType, PropertyGraph, SimpleGraph, union

Node = tuple[str, object]


@dataclass(frozen=True)
class DiGraphView:
    graph: PropertyGraph

    @staticmethod
    def of_simple(g: SimpleGraph, label: str = "node", elabel: str = "link") -> DiGraphView:
        return DiGraphView(PropertyGraph({label: g.vertices.withColumnRenamed("id", "oid")}, {elabel: g.edges}, {elabel: EdgeType(elabel, label, label)}))

    # Nodes.

    def nodes(self, data: bool | str = False, default=None) -> DataFrame:
        """(label, oid), with all attributes as JSON (data=True) or one of them (data=name, default where it is missing)."""
        parts = []
        for k, v in self.graph.vertices.items():
            parts.append(v.select(F.lit(k).alias("label"), F.col("oid").cast("string").alias("oid"), *self._data(v, data, default, ("oid",))))
        return union(parts)

    def _data(self, df: DataFrame, data: bool | str, default, keys: tuple[str, ...]) -> list[Column]:
        if data is False:
            return []
        rest = [c for c in df.columns if c not in keys]
        if data is True:
            return [(F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("data")]
        value = F.col(data).cast("string") if data in rest else F.lit(None).cast("string")
        return [F.coalesce(value, F.lit(default).cast("string")).alias(data)]

    def number_of_nodes(self) -> int:
        return self.nodes().count()

    order = __len__ = number_of_nodes

    def has_node(self, node: Node) -> bool:
        v = self.graph.vertices.get(node[0])
        return v is not None and not v.filter(F.col("oid") == F.lit(node[1])).isEmpty()

    __contains__ = has_node

    def node_data(self, node: Node) -> dict:
        row = self.graph.vertices[node[0]].filter(F.col("oid") == F.lit(node[1])).first()
        if row is None:
            raise KeyError(node)
        return {k: v for k, v in row.asDict().items() if k != "oid"}

    def nbunch(self, nodes: DataFrame) -> DataFrame:
        """Those of nodes (label, oid) that exist."""
        return nodes.join(self.nodes(), ["label", "oid"], "left_semi")

    # Edges.

    def edges(self, nbunch: DataFrame | None = None, data: bool | str = False, default=None, direction: str = "out") -> DataFrame:
        """(src_label, src, dst_label, dst[, data]); of the nodes (label, oid) in nbunch, if given, at their out- or in-end."""
        parts = []
        for k, e in self.graph.edges.items():
            t = self.graph.types[k]
            one = e.select(
                F.lit(t.src_label).alias("src_label"), F.col("src").cast("string").alias("src"), F.lit(t.dst_label).alias("dst_label"), F.col("dst").cast("string").alias("dst"),
                *self._data(e, data, default, ("src", "dst")),
            )
            parts.append(one)
        out = union(parts)
        if nbunch is not None:
            end = "src" if direction == "out" else "dst"
            out = out.join(nbunch.select(F.col("label").alias(f"{end}_label"), F.col("oid").alias(end)), [f"{end}_label", end], "left_semi")
        return out

    def out_edges(self, nbunch=None, data=False, default=None) -> DataFrame:
        return self.edges(nbunch, data, default, "out")

    def in_edges(self, nbunch=None, data=False, default=None) -> DataFrame:
        return self.edges(nbunch, data, default, "in")

    def _between(self, u: Node, v: Node | None, end: str = "src") -> DataFrame:
        other = "dst" if end == "src" else "src"
        out = self.edges(data=True).filter((F.col(f"{end}_label") == u[0]) & (F.col(end) == str(u[1])))
        return out if v is None else out.filter((F.col(f"{other}_label") == v[0]) & (F.col(other) == str(v[1])))

    def number_of_edges(self, u: Node | None = None, v: Node | None = None) -> int:
        return (self.edges() if u is None else self._between(u, v)).count()

    def has_edge(self, u: Node, v: Node) -> bool:
        return not self._between(u, v).isEmpty()

    def have_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs (src_label, src, dst_label, dst), once each, with ``present``: ``has_edge`` for many at once."""
        ends = ["src_label", "src", "dst_label", "dst"]
        there = self.edges().select(*ends).distinct().withColumn("__there", F.lit(True))
        return pairs.select(*ends).distinct().join(there, ends, "left").select(*ends, F.coalesce("__there", F.lit(False)).alias("present"))

    has_successor = has_edge

    def has_predecessor(self, u: Node, v: Node) -> bool:
        return self.has_edge(v, u)

    def successors(self, u: Node) -> DataFrame:
        """(label, oid) that u points to, once each."""
        return self._between(u, None).select(F.col("dst_label").alias("label"), F.col("dst").alias("oid")).distinct()

    neighbors = successors

    def predecessors(self, u: Node) -> DataFrame:
        return self._between(u, None, "dst").select(F.col("src_label").alias("label"), F.col("src").alias("oid")).distinct()

    def get_edge_data(self, u: Node, v: Node, default=None):
        """The attributes (JSON) of an edge, of parallel ones the largest, or the default."""
        row = self._between(u, v).orderBy(F.desc("data")).first()
        return default if row is None else row.data

    def edge_data(self) -> DataFrame:
        """(src_label, src, dst_label, dst, data): ``get_edge_data`` of every pair; of parallel edges the largest JSON stays."""
        return self.edges(data=True).groupBy("src_label", "src", "dst_label", "dst").agg(F.max("data").alias("data"))

    def adjacency(self, direction: str = "out") -> DataFrame:
        """(label, oid, adj): neighbours (struct label, oid) to attributes (JSON); of parallel edges the largest JSON stays.
        A row is as large as its vertex's degree: for one hub's neighbours as rows, use edges()."""
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        one = self.edge_data()
        entry = F.struct(F.struct(F.col(f"{b}_label").alias("label"), F.col(b).alias("oid")).alias("key"), F.col("data").alias("value"))
        return one.groupBy(F.col(f"{a}_label").alias("label"), F.col(a).alias("oid")).agg(F.map_from_entries(F.collect_list(entry)).alias("adj")).withColumn("oid", F.col("oid").cast("long"))

    def degree(self, direction: str = "both", weight: str | None = None) -> DataFrame:
        """(label, oid, degree): edges at each node, or their weights in sum (1 where an edge has none)."""
        parts = []
        ends = {"out": ("src",), "in": ("dst",), "both": ("src", "dst")}[direction]
        for k, e in self.graph.edges.items():
            t = self.graph.types[k]
            w = F.lit(1) if weight is None or weight not in e.columns else F.coalesce(F.col(weight), F.lit(1))
            parts += [e.select(F.lit(t.src_label if c == "src" else t.dst_label).alias("label"), F.col(c).cast("string").alias("oid"), w.cast("double").alias("w")) for c in ends]
        found = union(parts).groupBy("label", "oid").agg(F.sum("w").alias("degree"))
        return self.nodes().join(found, ["label", "oid"], "left").select("label", "oid", F.coalesce("degree", F.lit(0.0)).alias("degree"))

    def in_degree(self, weight: str | None = None) -> DataFrame:
        return self.degree("in", weight)

    def out_degree(self, weight: str | None = None) -> DataFrame:
        return self.degree("out", weight)

    def size(self, weight: str | None = None) -> float:
        """Edges, or their weights in sum."""
        return float(self.degree("out", weight).agg(F.sum("degree")).first()[0] or 0)

    def self_loops(self) -> int:
        return self.edges().filter("src_label = dst_label and src = dst").count()
