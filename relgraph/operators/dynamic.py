"""A schemaless graph: attributes are maps, and edges bring their endpoints with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

NODES = "id string, attrs map<string,string>"
EDGES = "src string, dst string, attrs map<string,string>"


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and new (with ``seq``) as one row a key: later attributes win, others stay."""
    both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.select(*keys, "attrs", F.col("seq").cast("long")))
    pieces = both.select(*keys, "seq", F.explode_outer("attrs").alias("k", "v"))
    last = pieces.groupBy(*keys, "k").agg(F.max_by("v", "seq").alias("v"))
    entries = F.filter(F.collect_list(F.struct("k", "v")), lambda x: x["k"].isNotNull())
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias("attrs"))


@dataclass(frozen=True)
class DynamicGraph:
    """nodes (id, attrs), edges (src, dst, attrs); no parallel edges."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> DynamicGraph:
        return DynamicGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    def add_nodes(self, new: DataFrame, common: dict[str, str] | None = None) -> DynamicGraph:
        """Add or update nodes (id[, attrs][, seq]); an item's attributes win over the common ones."""
        return DynamicGraph(merged(self.nodes, prepared(new, ["id"], common), ["id"]), self.edges)

    def add_edges(self, new: DataFrame, common: dict[str, str] | None = None) -> DynamicGraph:
        """Add edges (src, dst[, attrs][, seq]); one that exists takes the new attributes; missing endpoints are added."""
        rows = prepared(new, ["src", "dst"], common)
        ends = rows.select(F.col("src").alias("id")).unionByName(rows.select(F.col("dst").alias("id"))).distinct()
        missing = ends.join(self.nodes, "id", "left_anti").select("id", F.create_map().cast("map<string,string>").alias("attrs"))
        return DynamicGraph(self.nodes.unionByName(missing), merged(self.edges, rows, ["src", "dst"]))

    def update_nodes(self, new: DataFrame, common: dict[str, str] | None = None) -> DynamicGraph:
        """Like add_nodes, for nodes that exist."""
        return self.add_nodes(new.join(self.nodes.select("id"), "id", "left_semi"), common)

    def update_edges(self, new: DataFrame, common: dict[str, str] | None = None) -> DynamicGraph:
        return self.add_edges(new.join(self.edges.select("src", "dst"), ["src", "dst"], "left_semi"), common)

    def remove_nodes(self, ids: DataFrame) -> DynamicGraph:
        """Drop nodes (id) and the edges at them."""
        gone = ids.select("id").distinct()
        edges = self.edges
        for c in ("src", "dst"):
            edges = edges.join(gone.select(F.col("id").alias(c)), c, "left_anti")
        return DynamicGraph(self.nodes.join(gone, "id", "left_anti"), edges.select("src", "dst", "attrs"))

    def remove_edges(self, pairs: DataFrame) -> DynamicGraph:
        return DynamicGraph(self.nodes, self.edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))

    def clear(self) -> DynamicGraph:
        return DynamicGraph(self.nodes.limit(0), self.edges.limit(0))

    def clear_edges(self) -> DynamicGraph:
        return DynamicGraph(self.nodes, self.edges.limit(0))

    def to_columns(self, node_props: dict[str, str], edge_props: dict[str, str]):
        """A columnar SimpleGraph with the named attributes, cast to the given types."""
        from relgraph.operators.graph import SimpleGraph

        take = lambda props: [F.col("attrs")[k].try_cast(t).alias(k) for k, t in props.items()]
        return SimpleGraph(self.nodes.select("id", *take(node_props)), self.edges.select("src", "dst", *take(edge_props)))

    @staticmethod
    def from_columns(g) -> DynamicGraph:
        """Every other column of a SimpleGraph becomes an attribute; nulls are left out."""

        def pack(df: DataFrame, keys: list[str]) -> DataFrame:
            rest = [c for c in df.columns if c not in keys]
            pairs = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rest]
            attrs = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
            return df.select(*[F.col(k).cast("string").alias(k) for k in keys], attrs.alias("attrs"))

        return DynamicGraph(pack(g.vertices, ["id"]), pack(g.edges, ["src", "dst"]))


def prepared(new: DataFrame, keys: list[str], common: dict[str, str] | None) -> DataFrame:
    """new with attrs over the common ones, and a seq by which later rows win (0 if it has none)."""
    attrs = F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>")) if "attrs" in new.columns else F.create_map().cast("map<string,string>")
    if common:
        base = F.create_map(*[F.lit(x) for kv in common.items() for x in kv])
        attrs = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(attrs), k)), attrs)
    return new.select(*keys, attrs.alias("attrs"), (F.col("seq") if "seq" in new.columns else F.lit(0)).cast("long").alias("seq"))
