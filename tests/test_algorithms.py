"""Algorithms on small graphs whose answers are known."""

import pytest
from pyspark.sql import functions as F

from relgraph.functions import algorithms as A, selectors
from relgraph.functions.pregel import Pregel
from relgraph.nxview import DiGraphView
from relgraph.operators.dynamic import DynamicGraph
from relgraph.operators.graph import EdgeType, PropertyGraph, SimpleGraph
from relgraph.operators.traversal import Traversal
from relgraph.reader import GraphReader


def graph(spark, n, edges, undirected=False):
    rows = [(s, d, w) for s, d, w in ((*e, 1)[:3] for e in edges)]
    return SimpleGraph(spark.range(n), spark.createDataFrame(rows, "src long, dst long, weight int"), undirected)


def found(df, value):
    return {r["id"]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def diamond(spark):
    """0 to 3 by two ways, a tail to 4, 5 alone with a loop, a parallel edge."""
    return graph(spark, 6, [(0, 1, 1), (0, 2, 4), (1, 3, 6), (2, 3, 1), (3, 4, 1), (5, 5, 1), (0, 1, 3)])


def test_paths(diamond):
    assert found(A.sssp(diamond, 0, "weight"), "distance") == {0: 0, 1: 1, 2: 4, 3: 5, 4: 6}
    assert found(A.bfs(diamond, 0), "depth") == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3} and found(A.bfs(diamond, 0, 1), "depth") == {0: 0, 1: 1, 2: 1}
    assert found(A.bfs(diamond, 0), "pred") == {0: None, 1: 0, 2: 0, 3: 1, 4: 3}
    assert A.has_path(diamond, 0, 4) and not A.has_path(diamond, 4, 0) and A.sssp(diamond, 99).count() == 0
    assert A.dfs(diamond, 0) == [0, 1, 3, 4, 2] and A.average_length(graph(diamond.vertices.sparkSession, 3, [(0, 1), (1, 2)])) == pytest.approx(4 / 6)


def test_negative_weight(spark):
    with pytest.raises(ValueError):
        A.sssp(graph(spark, 2, [(0, 1, -1)]), 0, "weight")


def test_components_and_cores(spark, diamond):
    assert found(A.wcc(diamond), "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}
    chain = graph(spark, 300, [(i, i + 1) for i in range(0, 298) if i % 100 != 99])
    assert set(found(A.wcc(chain), "component").values()) == {0, 100, 200, 299}
    k4 = graph(spark, 6, [(a, b) for a in range(4) for b in range(a)] + [(4, 0), (5, 4)])
    assert {r.id for r in A.kcore(k4, 3).collect()} == {0, 1, 2, 3} and {r.id for r in A.kshell(k4, 1).collect()} == {4, 5} and A.kcore(k4, 4).count() == 0


def test_triangles(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (2, 0), (2, 3), (1, 0)])
    assert found(A.triangles(g), "triangles") == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0}
    assert found(A.clustering(g), "coefficient") == pytest.approx({0: 1, 1: 1, 2: 1 / 3, 3: 0, 4: 0})
    assert A.transitivity(g).first().value == pytest.approx(3 / 5) and A.average_clustering(g).first().value == pytest.approx((2 + 1 / 3) / 5)
    assert found(A.lcc(g), "coefficient") == pytest.approx({0: 1 / 2, 1: 1 / 2, 2: 2 / 6, 3: 0, 4: 0})


def test_pagerank(spark):
    cycle = graph(spark, 4, [(i, (i + 1) % 4) for i in range(4)])
    assert found(A.pagerank(cycle, rounds=20), "rank") == pytest.approx(dict.fromkeys(range(4), 0.25))
    star = graph(spark, 3, [(1, 0), (2, 0)])
    assert sum(found(A.pagerank(star, rounds=30), "rank").values()) == pytest.approx(1)
    assert A.pagerank(graph(spark, 0, [(9, 9)])).count() == 0


def test_centralities(spark):
    star = graph(spark, 4, [(1, 0), (2, 0), (3, 0)])
    assert found(A.degree_centrality(star), "centrality") == pytest.approx({0: 1, 1: 1 / 3, 2: 1 / 3, 3: 1 / 3})
    assert found(A.hits(star), "authority") == pytest.approx({0: 1, 1: 0, 2: 0, 3: 0})
    k = found(A.katz(star, normalized=False), "centrality")
    assert k == pytest.approx({0: 1.3, 1: 1, 2: 1, 3: 1})
    both = graph(spark, 4, [(0, 1), (0, 2), (0, 3)], True)
    e = found(A.eigenvector(both, tolerance=1e-9, max_rounds=200), "centrality")
    assert e[0] == pytest.approx(2**-0.5, abs=1e-4)
    assert [r.id for r in A.voterank(both, 1).collect()] == [0]
    labels = A.propagate_labels(graph(spark, 3, [(0, 2), (1, 2)]), spark.createDataFrame([(0, "a"), (1, "b")], "id long, label string"), 1)
    assert found(labels, "labels")[2] == {"a": 0.5, "b": 0.5}
    assert found(A.cdlp(graph(spark, 4, [(0, 1), (1, 2), (0, 2)], True), 5), "label") == {0: 0, 1: 0, 2: 0, 3: 3}


def test_pregel_shortest_paths(diamond):
    inf = 1 << 40
    p = Pregel(
        diamond,
        init={"d": F.when(F.col("id") == 0, 0).otherwise(inf)},
        send=lambda p: F.when(F.col("d") < inf, F.col("d") + F.col("weight")),
        combine=F.min,
        compute=lambda p: {"d": F.least("d", F.coalesce("msg", F.lit(inf)))},
        halt=lambda p: F.col("d") == F.col("old_d"),
        aggregators={"reached": ("sum", (F.col("d") < inf).cast("long")), "low": ("min", F.col("d")), "any": ("or", F.col("d") > 4)},
    )
    assert found(p.run(), "d") == {0: 0, 1: 1, 2: 4, 3: 5, 4: 6, 5: inf}
    assert p.values == {"reached": 5, "low": 0, "any": True}


@pytest.fixture(scope="module")
def people(spark):
    v = {"person": spark.createDataFrame([(1, "ann", 30), (2, "bob", None), (3, "cy", 50)], "oid long, name string, age int"), "city": spark.createDataFrame([(1, "x")], "oid long, name string")}
    e = {"knows": spark.createDataFrame([(1, 2, 5.0), (1, 2, 7.0), (2, 3, 1.0), (3, 3, 2.0)], "src long, dst long, w double"), "lives": spark.createDataFrame([(1, 1), (2, 1)], "src long, dst long")}
    return PropertyGraph(v, e, {"knows": EdgeType("knows", "person", "person"), "lives": EdgeType("lives", "person", "city")})


def test_nx_view(people, spark):
    g = DiGraphView(people)
    assert len(g.nodes().collect()) == 4 and g.number_of_edges() == 6 and g.number_of_edges(("person", 1), ("person", 2)) == 2
    assert g.has_node(("city", 1)) and not g.has_node(("city", 9)) and ("nowhere", 1) not in g
    assert g.has_edge(("person", 1), ("city", 1)) and not g.has_edge(("city", 1), ("person", 1)) and g.has_predecessor(("city", 1), ("person", 1))
    assert {tuple(r) for r in g.successors(("person", 1)).collect()} == {("person", "2"), ("city", "1")}
    assert {tuple(r) for r in g.predecessors(("person", 3)).collect()} == {("person", "2"), ("person", "3")}
    assert g.get_edge_data(("person", 2), ("person", 3)) == '{"w":1.0}' and g.get_edge_data(("city", 1), ("person", 3), "none") == "none"
    assert {(r.oid, r.age) for r in g.nodes("age", -1).filter("label = 'person'").collect()} == {("1", "30"), ("2", "-1"), ("3", "50")}
    assert {(r.label, r.oid): r.degree for r in g.degree("in", "w").collect()}["person", "2"] == 12 and g.size() == 6 and g.self_loops() == 1
    assert g.node_data(("person", 2)) == {"name": "bob", "age": None}
    row = {r.oid: r.adj for r in g.adjacency().filter("label = 'person'").collect()}[1]
    assert len(row) == 2


def test_transformations(people, spark):
    assert people.reverse().edges["lives"].orderBy("dst").collect()[0][:2] == (1, 1) and people.reverse().types["lives"].src_label == "city"
    sub = people.induced(spark.createDataFrame([("person", 1), ("person", 2)], "label string, oid long"))
    assert sub.edges["knows"].count() == 2 and sub.edges["lives"].count() == 0 and sub.vertices["city"].count() == 0
    pairs = people.edge_subgraph({"knows": spark.createDataFrame([(2, 3)], "src long, dst long")})
    assert {r.oid for r in pairs.vertices["person"].collect()} == {2, 3} and "city" not in pairs.vertices
    assert people.edge_types_between("person", "city") == ["lives"] and people.flatten().vertices.count() == 4
    assert {(r.label, r.oid): r.degree for r in people.degrees("both").collect()}["person", 3] == 3


def test_reader(people):
    r = GraphReader(people)
    assert r.vertex_labels() == ["person", "city"] and r.label_id("lives") == 3 and r.label_name(2) == "knows" and r.ends("lives") == ("person", "city")
    assert r.properties("person") == [(0, "name", "STRING"), (1, "age", "INT")] and r.property_id("knows", "w") == 0
    assert r.vertex("person", 9) is None and r.value("person", 1, "name") == "ann" and r.vertex_count() == 4 and r.edge_count() == 6
    assert r.resolve(r.reference("city", 1)) == ("city", "1") and r.adjacent("person", 1).count() == 3 and r.is_directed()


def test_selectors(people):
    s = selectors.select(people, None, '{"a": "v:person.id", "b": "v:label0.age"}'.replace("label0", "person"), (2, None))
    assert sorted(tuple(r) for r in s.collect()) == [(2, None), (3, 50)]
    g = people.project_simple("person", "knows", "age", "w")
    rank = A.pagerank(g)
    assert selectors.select(g, rank, {"id": "v.id", "r": "r", "d": "v.data"}).count() == 3 and selectors.select(g, None, {"w": "e.data"}).count() == 4
    assert selectors.context_value(rank, 1)["id"] == 1 and selectors.tensor(rank, "rank").shape == (3,)
    for bad in ({"a": "x.y"}, {"a": "v.id", "b": "e.src"}, {"a": "v:person.id", "b": "v:city.id"}):
        with pytest.raises(ValueError):
            selectors.select(people, None, bad)


def test_traversal_steps(people):
    t = Traversal.of(people, "person").has("person", "name", "ann").as_("a").out("knows").out("knows", "lives")
    assert sorted((r.label, r.oid) for r in t.df.collect()) == [("city", 1), ("city", 1), ("person", 3), ("person", 3)]
    assert t.dedup().df.count() == 2 and t.at("a").same_as("a").df.count() == 4 and t.counted().first().n == 4
    u = Traversal.of(people, "person").union(lambda x: x.out("lives"), lambda x: x.in_("knows"))
    assert u.df.count() == 6 and u.limit(2).df.count() == 2
    assert sorted(r.name for r in Traversal.of(people, "city").in_("lives").values("person", "name").collect()) == ["ann", "bob"]
    assert Traversal.of(people, "person").simple_paths().both("knows", times=(0, 3)).df.filter("oid = 1 and size(path) = 3").count() == 2


def test_dynamic_graph(spark):
    g = DynamicGraph.empty(spark).add_edges(spark.createDataFrame([("a", "b", {"k": "1"}), ("b", "c", {})], "src string, dst string, attrs map<string,string>"), {"w": "9", "k": "0"})
    assert g.nodes.count() == 3 and {(r.src, r.dst): r.attrs for r in g.edges.collect()} == {("a", "b"): {"k": "1", "w": "9"}, ("b", "c"): {"k": "0", "w": "9"}}
    g = g.add_edges(spark.createDataFrame([("a", "b", {"k": "2"})], "src string, dst string, attrs map<string,string>"))
    assert g.edges.filter("src = 'a'").first().attrs == {"k": "2", "w": "9"}
    g = g.update_nodes(spark.createDataFrame([("a", {"n": "5"}), ("zz", {"n": "6"})], "id string, attrs map<string,string>"))
    assert g.nodes.count() == 3 and g.to_columns({"n": "int"}, {"w": "double"}).vertices.filter("id = 'a'").first().n == 5
    back = DynamicGraph.from_columns(g.to_columns({"n": "int"}, {}))
    assert back.nodes.filter("id = 'a'").first().attrs == {"n": "5"} and back.nodes.filter("id = 'b'").first().attrs == {}
    g = g.remove_nodes(spark.createDataFrame([("b",)], "id string"))
    assert g.edges.count() == 0 and g.nodes.count() == 2 and g.clear().nodes.count() == 0


def test_vectorised_program(spark, diamond):
    import pandas as pd

    from relgraph.functions.pie import run_pie, vectorised

    def double(frame: pd.DataFrame) -> pd.DataFrame:
        frame["x"] = frame["x"] * 2
        return frame.assign(changed=frame["x"] < 8)

    step = vectorised(double, "id long, x long, changed boolean")
    out = run_pie(diamond, lambda g: g.vertices.selectExpr("id", "1L as x", "true as changed"), lambda g, s, c: step(s.drop("changed")))
    assert set(found(out, "x").values()) == {8}


def test_hubs_are_joined_by_broadcast(spark, monkeypatch):
    from relgraph.functions import components

    monkeypatch.setattr(components, "HEAVY_ROWS", 5)
    pairs = [(0, i) for i in range(1, 40)] + [(50, i) for i in range(51, 80)] + [(39, 100), (100, 101), (79, 200), (300, 301)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(40), 100, 101], 0), **dict.fromkeys([*range(50, 80), 200], 50), 300: 300, 301: 300}


def test_live_ends_without_a_shuffle(spark, monkeypatch):
    from relgraph.operators import graph as G
    from relgraph.plans.mapping import EdgeMapping, GraphMapping, VertexMapping

    ids = [0, 1, 63, 64, 65, 4095, 4096, -1, -64, -65, 1 << 40, (1 << 62) + 5, 7, 7]
    asked = [*ids, 2, 62, 66, 4097, -2, -66, (1 << 40) + 1, 1 << 62, None]
    t = {"a": spark.createDataFrame([(x,) for x in [*ids, None]], "k long"), "b": spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "k long, a long")}
    m = GraphMapping("g", (VertexMapping("a", "a", "k", {}), VertexMapping("b", "b", "k", {})), (EdgeMapping("of", "b", "b", "a", "k", "a"),))
    expected = [(i, x) for i, x in enumerate(asked) if x in ids and x is not None]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = PropertyGraph.from_mapping(m, t)
        assert sorted(tuple(r) for r in g.edges["of"].collect()) == expected
        assert "hashpartitioning" not in g.edges["of"]._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(G, "SET_ROWS", 1)
        assert sorted(tuple(r) for r in PropertyGraph.from_mapping(m, t).edges["of"].collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    both = {(r.label, r.oid, r.o, r.i) for r in g.degrees_of(o="out", i="in").collect()}
    assert ("a", 64, 0, 1) in both and ("b", 14, 0, 0) in both and g.degrees_of(o="out").filter("label = 'a' and oid = 7").count() == 2
    assert {(r.kind, r.label): r.n for r in g.counts().collect()} == {("vertex", "a"): 14, ("vertex", "b"): 23, ("edge", "of"): 14, ("vertex", None): 37, ("edge", None): len(expected), (None, None): 37 + len(expected)}


def test_triangles_of_any_graph(spark):
    """Against brute force, with loops, repeated edges and edges both ways; what is met is one row an edge, not its wedges."""
    import itertools
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(150)] + [(30, i) for i in range(25)] + [(None, 3), (4, None)]
    pairs = {(s, d) for s, d in edges if s != d and None not in (s, d)}
    near = {v: {d for s, d in pairs if s == v} | {s for s, d in pairs if d == v} for v in range(31)}
    for undirected, simple in ((False, False), (True, False), (False, True)):
        used = edges if not simple else sorted({(min(p), max(p)) for p in pairs}) + [(None, 3)]
        g = SimpleGraph(spark.range(31), spark.createDataFrame(used, "src long, dst long"), undirected, simple=simple)
        both = {(a, b) for a in near for b in near[a]}
        ways = both if undirected else pairs if not simple else {p for p in used if None not in p}
        t = {v: sum(b in near[a] for a, b in itertools.combinations(near[v], 2)) for v in near}
        assert found(A.triangles(g), "triangles") == t and A.triangle_list(g).count() == sum(t.values()) // 3
        d = {v: max(len(n) * (len(n) - 1), 1) for v, n in near.items()}
        assert found(A.clustering(g), "coefficient") == pytest.approx({v: 2 * t[v] / d[v] for v in near})
        assert found(A.lcc(g), "coefficient") == pytest.approx({v: sum((a, b) in ways for a in near[v] for b in near[v]) / d[v] for v in near})
        assert A.transitivity(g).first().value == pytest.approx(sum(t.values()) / (sum(len(n) * (len(n) - 1) for n in near.values()) / 2))
        assert A.closed(A.upward(g)).groupBy("a", "b").count().filter("count > 1").isEmpty() and g.both().count() == len(both)


def test_cores_and_components_move_less_than_the_edges(spark, monkeypatch):
    import random

    rng = random.Random(7)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(160)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (200, 200)]
    g = graph(spark, 201, edges)
    near = {v: set() for v in range(201)}
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b), near[b].add(a)

    def core(k):
        kept = {v for v in near if near[v]}
        while gone := {v for v in kept if len(near[v] & kept) < k}:
            kept -= gone
        return kept

    for k in (2, 5):
        assert {r.id for r in A.kcore(g, k).collect()} == core(k) and {r.id for r in A.kshell(g, k).collect()} == core(k) - core(k + 1)
    pairs = g.pairs().localCheckpoint()
    written = []
    monkeypatch.setattr(A, "cut", lambda df, *more: written.append(df.columns) or df.localCheckpoint())
    assert {r.id for r in A.peeled(pairs, A.degrees(pairs), 5).collect()} == core(5) and ["a", "b"] not in written and ["src", "dst"] not in written
    met = []
    connected = A.connected
    monkeypatch.setattr(A, "connected", lambda links: met.append(links.count()) or connected(links))
    label = found(A.wcc(g), "component")
    assert met[0] < len(edges) // 2 + 10 and label == {v: 0 if v < 40 and label[v] == 0 else 100 if 100 <= v <= 130 else v for v in range(201)} and all(label[a] == label[b] for a in near for b in near[a])
    monkeypatch.setattr(A, "HEAVY_ROWS", 3)
    assert found(A.wcc(g), "component") == label


def test_walks_from_one_vertex_meet_its_edges_only(spark):
    g = graph(spark, 12, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (2, 0), (7, 8), (6, 1), (9, 9)])
    assert {(r.src, r.dst) for r in A.edges_near(g, 0, 2).collect()} == {(0, 1), (1, 2)} and {(r.src, r.dst) for r in A.edges_near(g, 0, 4).collect()} == {(0, 1), (1, 2), (2, 3), (2, 0), (3, 4)}
    assert {(r.src, r.dst) for r in A.edges_near(g, 0, 2, both=True).collect()} == {(0, 1), (1, 2), (2, 0), (6, 1), (2, 3)} and A.edges_near(g, 99, 3).count() == 0
    assert A.has_paths(g, 0, [0, 5, 6, 8, 77]) == {0: True, 5: True, 6: False, 8: False, 77: False} and A.has_paths(g, 99, [99, 0]) == {99: False, 0: False}
    chain = graph(spark, 12, [(i, i + 1) for i in range(11)])
    assert A.has_paths(chain, 0, [11]) == {11: True} and A.has_paths(chain, 1, [0]) == {0: False}


def test_messages_leave_changed_vertices_only(spark):
    from relgraph.functions import pie

    g = graph(spark, 5, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (1, 0)])
    sent = pie.messages(g, spark.createDataFrame([(1, 7)], "id long, d long"), "d", F.col("d") + 1, F.min)
    assert {tuple(r) for r in sent.collect()} == {(0, 8), (3, 8)} and "__words" in sent._jdf.queryExecution().optimizedPlan().toString()
