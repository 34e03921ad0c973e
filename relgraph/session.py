"""One graph under versions: define it, load or ingest it, choose a version, run algorithms by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from relgraph.functions import algorithms as A
from relgraph.nxview import DiGraphView
from relgraph.operators import log as L
from relgraph.operators.graph import EdgeType, PropertyGraph, SimpleGraph
from relgraph.plans import mapping as M, pgq
from relgraph.sources.cdc import ends_of
from relgraph.streaming import ingest


def scalar(name: str, f: Callable) -> Callable:
    def run(g: SimpleGraph, **args: Any) -> DataFrame:
        return g.vertices.sparkSession.createDataFrame([(f(g, **args),)], f"{name} {'boolean' if name == 'has_path' else 'double'}")

    return run


#: Algorithms by name; each takes a SimpleGraph and keyword arguments.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "pagerank": A.pagerank,
    "sssp": A.sssp,
    "sssp_path": A.path_edges,
    "sssp_has_path": scalar("has_path", A.has_path),
    "sssp_average_length": scalar("average_length", A.average_length),
    "bfs": A.bfs,
    "dfs": lambda g, **a: g.vertices.sparkSession.createDataFrame(list(enumerate(A.dfs(g, **a))), f"position int, id {g.vertices.schema['id'].dataType.simpleString()}"),
    "wcc": A.wcc,
    "cdlp": A.cdlp,
    "lcc": A.lcc,
    "clustering": A.clustering,
    "avg_clustering": A.average_clustering,
    "transitivity": A.transitivity,
    "triangles": A.triangles,
    "kcore": A.kcore,
    "kshell": A.kshell,
    "hits": A.hits,
    "katz": A.katz,
    "eigenvector": A.eigenvector,
    "degree_centrality": A.degree_centrality,
    "voterank": A.voterank,
    "lpa": A.propagate_labels,
}


def register(name: str, f: Callable[..., DataFrame]) -> None:
    """Add an algorithm, or a stored query, to the registry."""
    REGISTRY[name] = f


class Session:
    """Reads are as of ``epoch``: the newest closed one unless another is chosen."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.mapping: M.GraphMapping | None = None
        self.log: DataFrame | None = None
        self._static: PropertyGraph | None = None
        self._epoch: int | None = None
        self._query = None

    # Definition.

    def define_graph(self, mapping: M.GraphMapping) -> Session:
        problems = M.check(mapping)
        if problems:
            raise ValueError("; ".join(problems))
        self.mapping = M.folded(mapping)
        return self

    def define_graph_by_yaml(self, text: str) -> Session:
        return self.define_graph(M.from_yaml(text))

    def define_graph_by_sql(self, text: str) -> Session:
        return self.define_graph(pgq.parse(text))

    def define_graph_by_json(self, text: str) -> Session:
        return self.define_graph(M.from_json(text))

    # Data.

    def load_tables(self, tables: dict[str, DataFrame]) -> Session:
        """A graph straight from tables, without versions."""
        self._static = PropertyGraph.from_mapping(self.mapping, tables)
        return self

    def load_log(self, log: DataFrame) -> Session:
        """A graph from a unified log (op, label, epoch, seq, oid, src, dst, props, ts)."""
        self.log, self._epoch = log, None
        return self

    def start(self, stream: DataFrame, path: str, per_epoch: int = 10_000, available_now: bool = True):
        """Begin, or resume, ingestion of change events into ``path``."""
        self._query, self._path = ingest.ingest(stream, self.mapping, path, per_epoch, available_now), path
        return self._query

    def pause(self) -> None:
        if self._query is not None:
            self._query.stop()

    def refresh(self) -> Session:
        """Read what ingestion has written so far."""
        log = ingest.read_log(self.spark, self._path).withColumn("ts", F.timestamp_millis("ts_ms"))
        return self.load_log(log)

    # Versions.

    def versions(self) -> DataFrame:
        return L.versions(self.log)

    def latest_epoch(self) -> int | None:
        """The newest closed epoch; none while the first is still open."""
        return self.versions().agg(F.max("epoch")).first()[0]

    @property
    def epoch(self) -> int | None:
        return self._epoch if self._epoch is not None else self.latest_epoch()

    def change_epoch(self, epoch: int) -> Session:
        latest = self.latest_epoch()
        if latest is None or not 0 <= epoch <= latest:
            raise ValueError(f"epoch {epoch} is not readable; the latest is {latest}")
        self._epoch = epoch
        return self

    def version_at(self, ts) -> dict:
        row = L.version_at(self.versions(), ts).first()
        return row.asDict() if row else {}

    # Reads.

    def graph(self, epoch: int | None = None) -> PropertyGraph:
        """The graph as of an epoch, with typed properties from the mapping's JSON texts."""
        if self.log is None:
            return self._static
        e = epoch if epoch is not None else self.epoch
        if e is None:
            raise ValueError("no epoch is closed yet")

        def typed(df: DataFrame, m) -> DataFrame:
            keep = ["oid"] if isinstance(m, M.VertexMapping) else ["src", "dst"]
            return df.select(*keep, *[F.get_json_object("props", f"$.{p}").alias(p) for p in m.props.values()])

        live = L.edge_asof(self.log, e, ends_of(self.mapping))
        vertices = {v.label: typed(L.vertex_asof(self.log, e, v.label), v) for v in self.mapping.vertices}
        edges = {x.label: typed(live.filter(F.col("label") == x.label), x) for x in self.mapping.edges}
        return PropertyGraph(vertices, edges, {x.label: EdgeType(x.label, x.src_label, x.dst_label, x.undirected) for x in self.mapping.edges})

    def view(self, epoch: int | None = None) -> DiGraphView:
        return DiGraphView(self.graph(epoch))

    def schema(self, tables: dict[str, DataFrame], style: str = "native") -> dict:
        return M.schema_json(self.mapping, tables, style)

    # Work.

    def run(self, algorithm: str, epoch: int | None = None, vertex_label: str | None = None, edge_label: str | None = None, weight: str | None = None, **args: Any) -> DataFrame:
        """An algorithm on all labels as one graph, or on one vertex and edge label."""
        if algorithm not in REGISTRY:
            raise KeyError(f"no algorithm {algorithm}; there are {', '.join(sorted(REGISTRY))}")
        g = self.graph(epoch)
        simple = g.project_simple(vertex_label, edge_label, None, weight) if edge_label else g.flatten(weight=weight)
        if weight and algorithm in ("sssp", "sssp_path"):
            args["weight"] = "weight"
        out = REGISTRY[algorithm](simple, **args)
        if not edge_label and "id" in out.columns:
            out = simple.vertices.join(out, "id", "right")
        return out

    def register_view(self, algorithm: str, name: str | None = None, **args: Any) -> str:
        """A result as a temporary view, for SQL to join; its name."""
        name = name or f"relgraph_{algorithm}"
        self.run(algorithm, **args).createOrReplaceTempView(name)
        return name
