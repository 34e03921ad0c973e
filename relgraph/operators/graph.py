"""Property graphs as label -> DataFrame, their access paths and their transformations."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relgraph.plans.mapping import EdgeMapping, GraphMapping, edge_plan, vertex_plan
from relgraph.runtime import SET_ROWS, cut


@dataclass(frozen=True)
class EdgeType:
    label: str
    src_label: str
    dst_label: str
    undirected: bool = False


@dataclass(frozen=True)
class PropertyGraph:
    """vertices: label -> (oid, properties); edges: label -> (src, dst, properties); parallel edges are kept."""

    vertices: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    types: dict[str, EdgeType]

    @staticmethod
    def from_mapping(mapping: GraphMapping, tables: dict[str, DataFrame], live_endpoints: bool = True) -> PropertyGraph:
        """Compile a mapping over tables. With live_endpoints, edges to vertices that do not exist are dropped."""
        mapped = {v.label: v for v in mapping.vertices if v.table in tables}
        vertices = {k: vertex_plan(v, tables[v.table]) for k, v in mapped.items()}
        edges, types, known = EdgePlans(), {}, {}

        def compiled(e: EdgeMapping) -> DataFrame:
            plan = edge_plan(e, tables[e.table])
            for end, column, label in (("src", e.src, e.src_label), ("dst", e.dst, e.dst_label)) if live_endpoints else ():
                if (e.table, column) == (mapped[label].table, mapped[label].key):
                    continue  # the row of the edge is that of the vertex
                if label not in known:
                    known[label] = key_set(vertices[label])
                plan = known[label](plan, end)
            return plan

        for e in mapping.edges:
            if e.table in tables and {e.src_label, e.dst_label} <= vertices.keys():
                edges[e.label], types[e.label] = partial(compiled, e), EdgeType(e.label, e.src_label, e.dst_label, e.undirected)
        return PropertyGraph(vertices, edges, types)

    # Access.

    def label_index(self) -> dict[str, int]:
        return {x: i for i, x in enumerate(self.vertices)}

    def all_vertices(self) -> DataFrame:
        """(label, oid) of every vertex."""
        return union([v.select(F.lit(k).alias("label"), F.col("oid")) for k, v in self.vertices.items()])

    def adjacency(self, direction: str = "out", labels: list[str] | None = None) -> DataFrame:
        """(label, oid, elabel, nbr_label, nbr): out-, in- or both-neighbours, once for each edge.

        Undirected labels are traversed from either end."""
        parts = []
        for k in labels or list(self.edges):
            t, e = self.types[k], self.edges[k]
            ends = [("src", "dst", t.src_label, t.dst_label), ("dst", "src", t.dst_label, t.src_label)]
            chosen = ends if t.undirected or direction == "both" else ends[:1] if direction == "out" else ends[1:]
            parts += [
                e.select(F.lit(x).alias("label"), F.col(a).alias("oid"), F.lit(k).alias("elabel"), F.lit(y).alias("nbr_label"), F.col(b).alias("nbr"))
                for a, b, x, y in chosen
            ]
        return union(parts)

    def degrees(self, direction: str = "out") -> DataFrame:
        """(label, oid, degree) of every vertex, 0 where it has no edge."""
        return self.degrees_of(degree=direction)

    def degrees_of(self, **directions: str) -> DataFrame:
        """(label, oid, a number for each named direction) of every vertex, 0 where it has no edge: vertices and edge ends are
        counted together, in one shuffle, under the number of their label."""
        labels, names = self.label_index(), list(directions)
        parts = [v.select(F.lit(labels[k]).alias("l"), "oid", F.lit(1).alias("own"), *[F.lit(0).alias(n) for n in names]) for k, v in self.vertices.items()]
        for k, e in self.edges.items():
            t = self.types[k]
            for column, label, way in (("src", t.src_label, "out"), ("dst", t.dst_label, "in")):
                ones = [F.lit(int(t.undirected or d in ("both", way))).alias(n) for n, d in directions.items()]
                parts.append(e.select(F.lit(labels[label]).alias("l"), F.col(column).alias("oid"), F.lit(0).alias("own"), *ones))
        counted = union(parts).groupBy("l", "oid").agg(F.sum("own").alias("own"), *[F.sum(n).alias(n) for n in names]).filter("own > 0")
        # A vertex that its table repeats is repeated.
        every = counted.withColumn("own", F.explode(F.array_repeat(F.lit(1), F.col("own").cast("int"))))
        return every.select(F.element_at(F.array(*[F.lit(k) for k in labels]), F.col("l") + 1).alias("label"), "oid", *names)

    def counts(self) -> DataFrame:
        """(kind, label, n) with a row of n by label, by kind (label null) and in all (both null)."""
        rows = [("vertex", k, v) for k, v in self.vertices.items()] + [("edge", k, e) for k, e in self.edges.items()]
        parts = [x.groupBy(F.lit(kind).alias("kind"), F.lit(k).alias("label")).agg(F.count(F.lit(1)).alias("n")) for kind, k, x in rows]
        return union(parts).rollup("kind", "label").agg(F.sum("n").alias("n"))

    def edge_types_between(self, src_label: str, dst_label: str) -> list[str]:
        return [k for k, t in self.types.items() if (t.src_label, t.dst_label) == (src_label, dst_label)]

    # Transformations; all lazy.

    def project(self, vertices: dict[str, list[str]], edges: dict[str, list[str]]) -> PropertyGraph:
        """Keep the named labels with the named properties."""
        return PropertyGraph(
            {k: self.vertices[k].select("oid", *p) for k, p in vertices.items()},
            {k: self.edges[k].select("src", "dst", *p) for k, p in edges.items()},
            {k: self.types[k] for k in edges},
        )

    def project_simple(self, vlabel: str, elabel: str, vprop: str | None = None, eprop: str | None = None) -> SimpleGraph:
        """One vertex label and one edge label of it, with at most one property each."""
        v = self.vertices[vlabel].select(F.col("oid").alias("id"), *([F.col(vprop).alias("data")] if vprop else []))
        e = self.edges[elabel].select("src", "dst", *([F.col(eprop).alias("weight")] if eprop else []))
        return SimpleGraph(v, e, self.types[elabel].undirected)

    def gid(self, label: str, oid: Column | str) -> Column:
        """An id over all labels: seven label bits above 56 bits of a whole-number oid, or ``label:oid`` for text."""
        c = F.col(oid) if isinstance(oid, str) else oid
        if any(v.schema["oid"].dataType.simpleString() == "string" for v in self.vertices.values()):
            return F.concat(F.lit(f"{label}:"), c.cast("string"))
        return F.lit(self.label_index()[label] << 56) + c.cast("long")

    def flatten(self, vertices: list[str] | None = None, edges: list[str] | None = None, weight: str | None = None) -> SimpleGraph:
        """All labels as one: (id, label, oid) and (src, dst[, weight]); an edge label without the weight property counts 1."""
        v = union([self.vertices[k].select(self.gid(k, "oid").alias("id"), F.lit(k).alias("label"), "oid") for k in vertices or self.vertices])
        parts = []
        for k in edges or self.edges:
            t, e = self.types[k], self.edges[k]
            w = [] if weight is None else [(F.col(weight) if weight in e.columns else F.lit(1)).cast("double").alias("weight")]
            one = e.select(self.gid(t.src_label, "src").alias("src"), self.gid(t.dst_label, "dst").alias("dst"), *w)
            parts += [one, swapped(one)] if t.undirected else [one]
        return SimpleGraph(v, union(parts))

    def flatten_properties(self) -> DataFrame:
        """(label, oid, every property of every label): properties that a label lacks are null."""
        parts = [v.withColumn("label", F.lit(k)) for k, v in self.vertices.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def add_column(self, label: str, values: DataFrame, name: str) -> PropertyGraph:
        """The graph with the column ``name`` of values (oid, name) as a property of a vertex label."""
        v = self.vertices[label].drop(name).join(values.select("oid", name), "oid", "left")
        return replace(self, vertices=self.vertices | {label: v})

    def add_labels(self, other: PropertyGraph) -> PropertyGraph:
        return PropertyGraph(self.vertices | other.vertices, self.edges | other.edges, self.types | other.types)

    def reverse(self) -> PropertyGraph:
        types = {k: EdgeType(k, t.dst_label, t.src_label, t.undirected) for k, t in self.types.items()}
        return PropertyGraph(self.vertices, {k: swapped(e) for k, e in self.edges.items()}, types)

    def to_directed(self) -> PropertyGraph:
        """Each undirected edge becomes one either way; a loop stays one."""
        edges = {k: e.unionByName(swapped(e.filter("src != dst"))) if self.types[k].undirected else e for k, e in self.edges.items()}
        return PropertyGraph(self.vertices, edges, {k: replace(t, undirected=False) for k, t in self.types.items()})

    def induced(self, nodes: DataFrame) -> PropertyGraph:
        """The subgraph of the vertices in nodes (label, oid)."""
        vertices = {k: v.join(nodes.filter(F.col("label") == k).select("oid"), "oid", "left_semi") for k, v in self.vertices.items()}
        edges = {k: with_live_endpoints(e, vertices[self.types[k].src_label], vertices[self.types[k].dst_label]) for k, e in self.edges.items()}
        return PropertyGraph(vertices, edges, self.types)

    def edge_subgraph(self, pairs: dict[str, DataFrame]) -> PropertyGraph:
        """The edges whose (src, dst) is listed for their label, and the vertices at their ends."""
        edges = {k: self.edges[k].join(p.select("src", "dst").distinct(), ["src", "dst"], "left_semi") for k, p in pairs.items()}
        vertices = {}
        for label, v in self.vertices.items():
            ends = [e.select(F.col(c).alias("oid")) for k, e in edges.items() for c, own in (("src", self.types[k].src_label), ("dst", self.types[k].dst_label)) if own == label]
            if ends:
                vertices[label] = v.join(union(ends).distinct(), "oid", "left_semi")
        return PropertyGraph(vertices, edges, {k: self.types[k] for k in edges})

    def self_loops(self) -> DataFrame:
        """(elabel, n): edges from a vertex to itself."""
        loops = [e.filter("src = dst").select(F.lit(k).alias("elabel")) for k, e in self.edges.items() if self.types[k].src_label == self.types[k].dst_label]
        return union(loops).groupBy("elabel").agg(F.count(F.lit(1)).alias("n"))


class EdgePlans(dict):
    """label -> edges, each compiled when it is first asked for: to know the keys of its ends takes a job."""

    def __getitem__(self, label):
        found = super().__getitem__(label)
        if isinstance(found, partial):
            self[label] = found = found()
        return found

    def get(self, label, default=None):
        return self[label] if label in self else default

    def values(self):
        return [self[k] for k in self]

    def items(self):
        return [(k, self[k]) for k in self]

    def __or__(self, other):
        return dict(self.items()) | dict(other.items())

    def __ror__(self, other):
        return dict(other.items()) | dict(self.items())


@dataclass(frozen=True)
class SimpleGraph:
    """One kind of vertex (id, ...) and of edge (src, dst[, weight]): what algorithms run on.

    ``simple`` promises that no two edges join the same two vertices, whichever way: then nothing need be made distinct."""

    vertices: DataFrame
    edges: DataFrame
    undirected: bool = False
    extra: dict = field(default_factory=dict)
    simple: bool = False

    def pairs(self) -> DataFrame:
        """(a, b): every two vertices that edges join, once, without loops."""
        if self.simple:
            return self.edges.filter("src != dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return self.edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def both(self) -> DataFrame:
        """Distinct (src, dst) either way, without loops. A pair is shuffled once, not once a way."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
        return self.pairs().select(ends.alias("e")).select("e.*")

    def directed(self) -> DataFrame:
        """Each undirected edge as one either way; a loop stays one."""
        return self.edges.unionByName(swapped(self.edges.filter("src != dst"))) if self.undirected else self.edges

    def to_undirected(self) -> DataFrame:
        """(src, dst, n, every other column) with src <= dst: one row a pair, edges counted, of each attribute the largest value kept."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        more = [F.max(c).alias(c) for c in rest]
        ends = self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *rest)
        return ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *more).withColumnsRenamed({"a": "src", "b": "dst"})


def swapped(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def key_set(vertices: DataFrame):
    """A function of (rows, column) that keeps the rows whose column is an oid of vertices, none twice.

    Whole numbers become bits, 4096 keys a row, and are broadcast if these rows are at most SET_ROWS (40 MB): then the rows of edges need
    no shuffle. Text, streams, and keys too many or too sparse for that are met by a semi-join."""
    oid = F.col("oid")

    def met(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(vertices.select(oid.alias(column)), column, "left_semi").select(rows.columns)

    if vertices.isStreaming or vertices.schema["oid"].dataType.simpleString() != "bigint":
        return met
    words = vertices.groupBy(F.shiftright(oid, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(oid & 63 as int))")).alias("bits"))
    spread = F.map_from_entries(F.collect_list(F.struct(F.col("w").bitwiseAND(F.lit(63)).cast("int").alias("i"), "bits")))
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    chunks = cut(words.groupBy(F.shiftright("w", 6).alias("__chunk")).agg(spread.alias("m")).select("__chunk", every.alias("__words")), "keys")
    if chunks.count() > SET_ROWS:
        return met

    def tested(rows: DataFrame, column: str) -> DataFrame:
        if rows.schema[column].dataType.simpleString() != "bigint":
            return met(rows, column)
        key = F.col(column)
        near = rows.withColumn("__c", F.shiftright(key, 12)).join(F.broadcast(chunks), F.col("__c") == F.col("__chunk"))
        word = F.element_at("__words", (F.shiftright(key, 6).bitwiseAND(F.lit(63)) + 1).cast("int"))
        return near.filter(F.call_function("getbit", word, key.bitwiseAND(F.lit(63)).cast("int")) == 1).select(rows.columns)

    return tested


def with_live_endpoints(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """edges whose two ends exist; semi-joins, so no edge is repeated."""
    out = edges.join(src.select(F.col("oid").alias("src")), "src", "left_semi").join(dst.select(F.col("oid").alias("dst")), "dst", "left_semi")
    return out.select(edges.columns)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# The mapping of the sample tables.

def tpch_mapping() -> GraphMapping:
    from relgraph.plans.pgq import parse

    return parse(
        """
        CREATE PROPERTY GRAPH tpch
        VERTEX TABLES (
          region KEY (r_regionkey) LABEL region PROPERTIES (r_name AS name),
          nation KEY (n_nationkey) LABEL nation PROPERTIES (n_name AS name),
          customer KEY (c_custkey) LABEL customer PROPERTIES (c_name AS name, c_acctbal AS balance, c_mktsegment AS segment),
          supplier KEY (s_suppkey) LABEL supplier PROPERTIES (s_name AS name, s_acctbal AS balance),
          part KEY (p_partkey) LABEL part PROPERTIES (p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS price),
          orders KEY (o_orderkey) LABEL orders PROPERTIES (o_orderstatus AS status, o_totalprice AS total, o_orderdate AS day)
        )
        EDGE TABLES (
          nation SOURCE KEY (n_nationkey) REFERENCES nation DESTINATION KEY (n_regionkey) REFERENCES region LABEL in_region NO PROPERTIES,
          customer SOURCE KEY (c_custkey) REFERENCES customer DESTINATION KEY (c_nationkey) REFERENCES nation LABEL cust_nation NO PROPERTIES,
          supplier SOURCE KEY (s_suppkey) REFERENCES supplier DESTINATION KEY (s_nationkey) REFERENCES nation LABEL supp_nation NO PROPERTIES,
          orders SOURCE KEY (o_custkey) REFERENCES customer DESTINATION KEY (o_orderkey) REFERENCES orders LABEL placed PROPERTIES (o_totalprice AS total),
          lineitem SOURCE KEY (l_orderkey) REFERENCES orders DESTINATION KEY (l_partkey) REFERENCES part LABEL contains PROPERTIES (l_quantity AS quantity, l_extendedprice AS price),
          lineitem SOURCE KEY (l_orderkey) REFERENCES orders DESTINATION KEY (l_suppkey) REFERENCES supplier LABEL supplied_by NO PROPERTIES
        )
        """
    )


def tpch_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}


def tpch_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.from_mapping(tpch_mapping(), tpch_tables(spark, sf_dir))
