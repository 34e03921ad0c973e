"""Graph algorithms on a SimpleGraph, as loops of joins and aggregations.

Each round is written to the shared folder, so plans do not grow. Edges are written once, by their source, and only
what a round computes is shuffled. Scalars that decide whether to stop are the only things that reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from relgraph.functions.components import connected, to_least
from relgraph.operators.graph import SimpleGraph, key_set, swapped, union
from relgraph.runtime import HEAVY_ROWS, cut, done_with, held


def pagerank(g: SimpleGraph, delta: float = 0.85, rounds: int = 5, dangling: str = "exact") -> DataFrame:
    """(id, rank) after the rounds, without a tolerance. Out-degrees count parallel edges.

    ``dangling``: ``exact`` spreads what vertices without out-edges hold; ``uniform`` takes them to hold the base rank of the
    round, which is exact only where they have no in-edges. What sinks hold is observed while a round is written: no job of its own."""
    e = g.directed().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    degrees = g.directed().groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    e = e.join(degrees, "src").select("src", "dst", (F.col("k") / F.col("deg")).alias("share"))
    sources = degrees.select(F.col("src").alias("id"), F.lit(False).alias("sink"))
    v = cut(g.vertices.select("id").join(sources, "id", "left").select("id", F.coalesce("sink", F.lit(True)).alias("sink")))
    n, n_sinks = v.agg(F.count(F.lit(1)), F.count_if("sink")).first()
    if not n:
        return v.select("id", F.lit(0.0).alias("rank"))
    rank, lost = v.withColumn("rank", F.lit(1.0 / n)), n_sinks / n
    with held(e, "src") as (_, join):
        for k in range(rounds):
            base = (1 - delta) / n + delta * lost / n
            flow = join(rank.select(F.col("id").alias("src"), "rank")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
            new = v.join(flow, "id", "left").select("id", "sink", (F.lit(base) + delta * F.coalesce("flow", F.lit(0.0))).alias("rank"))
            seen, before = Observation(), rank
            rank = cut(new.observe(seen, F.sum(F.when(F.col("sink"), F.col("rank"))).alias("lost")))
            done_with(before)
            lost = base * n_sinks if dangling == "uniform" else seen.get["lost"] or 0.0
    return rank.select("id", "rank")


#: Tables of one round each that a search keeps before it puts them together.
TABLES = 6


def sssp(
    g: SimpleGraph, source, weight: str | None = None, depth_limit: int | None = None, null_weight: float = 1.0, cutoff: float | None = None, target=None
) -> DataFrame:
    """(id, distance, pred) of every vertex that the source reaches; a source that does not exist reaches nothing.

    ``source`` may be a list of ids: the distance is then from the nearest. Vertices beyond ``cutoff``, or more than ``depth_limit``
    edges away, are left out. With ``target`` the search ends as soon as no shorter path to it can follow. Otherwise it ends when no
    distance falls any more, however deep the graph. Only vertices whose distance fell in a round send in the next, and a round writes only what it changed. Weights must not
    be negative; pred is the smallest predecessor on a shortest path (null for a source)."""
    cost = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(null_weight))
    edges = g.directed().select("src", "dst", cost.alias("cost"))
    kind = g.vertices.schema["id"].dataType
    sources = list(source) if isinstance(source, (list, tuple, set)) else [source]
    front = cut(g.vertices.filter(F.col("id").isin(sources)).select("id").distinct().select("id", F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("pred"), F.lit(True).alias("moved")))
    tables, depth = [front], 0

    def known() -> DataFrame:
        return union(tables).groupBy("id").agg(F.min(F.struct("distance", "pred")).alias("old"))

    with held(edges, "src") as (e, join):
        if weight is not None and not e.filter("cost < 0").isEmpty():
            raise ValueError("negative weight")
        while depth_limit is None or depth < depth_limit:
            depth += 1
            reached = join(front.filter("moved").select(F.col("id").alias("src"), "distance")).select(F.col("dst").alias("id"), (F.col("distance") + F.col("cost")).alias("d"), F.col("src").alias("p"))
            if cutoff is not None:
                reached = reached.filter(F.col("d") <= cutoff)
            reached = reached.groupBy("id").agg(F.min(F.struct("d", "p")).alias("new"))
            nearer = F.col("old").isNull() | (F.col("new.d") < F.col("old.distance"))
            # As near by a smaller predecessor: the vertex need not send again.
            tied = (F.col("new.d") == F.col("old.distance")) & F.col("old.pred").isNotNull() & (F.col("new.p") < F.col("old.pred"))
            changed = reached.join(known(), "id", "left").filter(nearer | tied).select("id", F.col("new.d").alias("distance"), F.col("new.p").alias("pred"), nearer.alias("moved"))
            seen = Observation()
            front = cut(changed.observe(seen, F.min(F.when(F.col("moved"), F.col("distance"))).alias("least"), *([F.max(F.col("id") == F.lit(target)).alias("hit")] if target is not None else [])))
            tables.append(front)
            least = seen.get["least"]
            if least is None:
                break
            if target is not None and (weight is None and seen.get["hit"] or weight is not None and _settled(tables, target, least)):
                break
            if len(tables) > TABLES:
                merged = cut(known().select("id", "old.*"))
                done_with(*tables[:-1])
                tables = [merged.withColumn("moved", F.lit(False)), front]
    return cut(known().select("id", "old.*"))


def _settled(tables: list[DataFrame], target, least: float) -> bool:
    """Whether the target's distance is no more than any that may still spread."""
    best = union(tables).filter(F.col("id") == F.lit(target)).agg(F.min("distance")).first()[0]
    return best is not None and best <= least


def bfs(g: SimpleGraph, source, depth_limit: int | None = None) -> DataFrame:
    """(id, depth, pred): levels from the source along out-edges, pred the smallest vertex of the level before."""
    return sssp(g, source, depth_limit=depth_limit).select("id", F.col("distance").cast("long").alias("depth"), "pred")


def has_path(g: SimpleGraph, source, target) -> bool:
    """Whether the target is reached; the search goes no deeper than it."""
    return not sssp(g, source, target=target).filter(F.col("id") == F.lit(target)).isEmpty()


def outward(e: DataFrame, start: DataFrame):
    """Breadth-first from start (oid) along the edges e (src, dst): yields (oid of a level, the edges that leave it) until no new vertex comes.

    The level is broadcast as bits, where it fits: edges are read and tested each time, and never shuffled."""
    front, seen = cut(start.distinct()), []
    while not front.isEmpty():
        step = cut(key_set(front)(e, "src"))
        yield front, step
        seen.append(front)
        if len(seen) > TABLES:
            old, seen = seen, [cut(union(seen))]
            done_with(*old[:-1])
        front = cut(step.select(F.col("dst").alias("oid")).distinct().join(union(seen), "oid", "left_anti"))


def edges_near(g: SimpleGraph, source, hops: int, both: bool = False) -> DataFrame:
    """(src, dst): the edges, parallel ones too, that walks of up to ``hops`` edges from the source may take; with both, those at either end."""
    e = cut(g.directed().select("src", "dst")).withColumn("turned", F.lit(False))
    way = e.unionByName(swapped(e.filter("src != dst")).withColumn("turned", F.lit(True))) if both else e
    steps = []
    for _, step in outward(way, g.vertices.filter(F.col("id") == F.lit(source)).select(F.col("id").alias("oid"))):
        steps.append(step)
        if len(steps) == hops:
            break
    found = union(steps) if steps else e.limit(0)
    if not both:
        return found.select("src", "dst")
    # Each end that was left gave the edge; of two the source's is kept.
    turned = found.filter("turned").join(found.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    return found.filter("not turned").select("src", "dst").unionByName(swapped(turned).select("src", "dst"))


def has_paths(g: SimpleGraph, source, targets: list) -> dict:
    """target -> whether it is reached: ``has_path`` for some, by one search that ends where the last of them is found."""
    e, left = cut(g.directed().select("src", "dst")), set(targets)
    for front, _ in outward(e, g.vertices.filter(F.col("id") == F.lit(source)).select(F.col("id").alias("oid"))):
        left -= {r.oid for r in front.filter(F.col("oid").isin(list(left))).collect()}
        if not left:
            break
    return {t: t not in left for t in targets}


def reached(g: SimpleGraph, source, targets: DataFrame) -> DataFrame:
    """(target, reached) for each id in targets: ``has_path`` for many at once, by one search."""
    near = sssp(g, source).select("id", F.lit(True).alias("reached"))
    return targets.select("id").join(near, "id", "left").select(F.col("id").alias("target"), F.coalesce("reached", F.lit(False)).alias("reached"))


def shortest_paths(g: SimpleGraph, source, weight: str | None = None, cutoff: float | None = None) -> DataFrame:
    """(id, distance, path): one shortest path from the (nearest) source to each vertex that is reached, as an array of ids."""
    tree = sssp(g, source, weight, cutoff=cutoff)
    front = cut(tree.filter("pred is null").select("id", "distance", F.array("id").alias("path")))
    done = []
    while not front.isEmpty():
        done.append(front)
        near = front.select(F.col("id").alias("pred"), "path")
        front = cut(tree.join(near, "pred").select("id", "distance", F.array_append("path", F.col("id")).alias("path")))
    return union(done) if done else front


def path_edges(g: SimpleGraph, source, weight: str | None = None) -> DataFrame:
    """(src, dst): the tree of shortest paths."""
    return sssp(g, source, weight).filter("pred is not null").select(F.col("pred").alias("src"), F.col("id").alias("dst"))


def all_distances(g: SimpleGraph, depth_limit: int | None = None) -> DataFrame:
    """(source, id, distance) of every reachable pair, or of those up to ``depth_limit`` edges apart: for graphs whose reachable
    pairs are few enough to store."""
    e = cut(g.directed().select("src", "dst").distinct())
    front = cut(g.vertices.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("distance")))
    levels = [front]
    while depth_limit is None or len(levels) <= depth_limit:
        step = front.select("source", F.col("id").alias("src")).join(e, "src").select("source", F.col("dst").alias("id")).distinct()
        front = cut(step.join(union(levels), ["source", "id"], "left_anti").withColumn("distance", F.lit(len(levels)).cast("long")))
        if front.isEmpty():
            break
        levels.append(front)
    return union(levels)


def average_length(g: SimpleGraph) -> float:
    """The mean distance over all ordered pairs of vertices; pairs without a path count 0."""
    total, n = all_distances(g).agg(F.sum("distance"), F.count_distinct("source")).first()
    return (total or 0) / (n * (n - 1)) if n and n > 1 else 0.0


def wcc(g: SimpleGraph) -> DataFrame:
    """(id, component): the smallest id that undirected edges connect.

    First each vertex is taken for the smallest of itself and its neighbours, which joins most of what is dense; alternating large- and
    small-star steps then connect what is left, however long its chains."""
    links = g.pairs().select(F.col("a").alias("u"), F.col("b").alias("v"))
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = cut(links.select(ends.alias("e")).select("e.*").groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
    most = least.agg(F.max("n"), F.sum("n")).first()
    hubs = (most[0] or 0) > max(HEAVY_ROWS, (most[1] or 0) / 64)
    if hubs:
        links = cut(links)
    half = to_least(links, least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if hubs:
        half = cut(half)
    roots = connected(to_least(half, least, hubs).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
    # A vertex is as its smallest neighbour; so many may share one that the rows of these meet it by a broadcast.
    shared = least.select(F.col("m").alias("u"), F.col("u").alias("id"))
    sizes = shared.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(roots.select(F.col("node").alias("u"), F.col("root").alias("m")), "u", "left")
    sizes = cut(sizes.select("u", F.coalesce("m", "u").alias("m"), "n"))
    found = to_least(shared, sizes, not sizes.filter(F.col("n") > HEAVY_ROWS).isEmpty()).select("id", F.col("m").alias("root"))
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def cdlp(g: SimpleGraph, rounds: int = 10) -> DataFrame:
    """(id, label): synchronous label propagation; the commonest label among neighbours, the smallest of equals.

    A directed graph's edges count once for each direction that exists."""
    e = g.edges.filter("src != dst").select("src", "dst")
    labels = cut(g.vertices.select("id", F.col("id").alias("label")))
    with held(e.unionByName(swapped(e)), "dst") as (_, join):
        for _ in range(rounds):
            votes = join(labels.withColumnRenamed("id", "dst")).groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
            chosen = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("best")).select("id", F.col("best.label").alias("new"))
            labels = cut(labels.join(chosen, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return labels


def upward(g: SimpleGraph) -> DataFrame:
    """(id, d, up, twice): each vertex that has an edge with its degree, its neighbours of larger (degree, id), of which none has more than
    the square root of twice the edges, and those of them that edges join both ways."""
    if g.undirected or g.simple:
        p = g.pairs().withColumn("w", F.lit(False))
    else:
        ends = g.edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("ab"))
        p = ends.groupBy("a", "b").agg((F.min("ab") != F.max("ab")).alias("w"))
    degree = p.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    e = p.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    rises = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    e = e.select(F.when(rises, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(rises, F.col("b")).otherwise(F.col("a")).alias("hi"), F.lit(None).cast("long").alias("d"), "w")
    e = e.unionByName(degree.select("id", F.lit(None).cast(e.schema["hi"].dataType).alias("hi"), "d", F.lit(False).alias("w")))
    return cut(e.groupBy("id").agg(F.max("d").alias("d"), F.collect_list("hi").alias("up"), F.collect_list(F.when(F.col("w"), F.col("hi"))).alias("twice")))


def closed(lists: DataFrame) -> DataFrame:
    """(a, b, cs, na, nb, nc) by ``upward``: each edge (a, b) that closes triangles (a, b, c), once each, with the c of these. na, nb: the
    edges between the other two corners, either way by itself, in sum over these triangles; nc: those between a and b.

    What meets at b is a's list, one row an edge, not its wedges; only where b has larger neighbours of its own."""
    has = key_set(lists.filter(F.size("up") > 0).select(F.col("id").alias("oid")))
    asks = lists.filter(F.size("up") > 1).select(F.col("id").alias("a"), "up", "twice", F.explode("up").alias("b"))
    own = lists.filter(F.size("up") > 0).select(F.col("id").alias("b"), F.col("up").alias("up_b"), F.col("twice").alias("twice_b"))
    met = has(asks, "b").join(own, "b").withColumn("cs", F.array_intersect("up", "up_b")).filter(F.size("cs") > 0)
    more = lambda list_: F.when(F.size(list_) > 0, F.size(F.array_intersect("cs", list_))).otherwise(0)
    return met.select("a", "b", "cs", (F.size("cs") + more("twice_b")).alias("na"), (F.size("cs") + more("twice")).alias("nb"), F.when(F.array_contains("twice", F.col("b")), 2).otherwise(1).alias("nc"))


def triangle_list(g: SimpleGraph) -> DataFrame:
    """(a, b, c): every triangle once."""
    return closed(upward(g)).select("a", "b", F.explode("cs").alias("c"))


def at_corners(met: DataFrame, weighed: bool = False) -> DataFrame:
    """(id, n): triangles of ``closed`` at each vertex that has some, or the edges between the other two corners of these."""
    own = [F.struct(F.col(v).alias("id"), (F.col(f"n{v}") if weighed else F.size("cs")).cast("long").alias("n")) for v in "ab"]
    third = F.transform("cs", lambda c: F.struct(c.alias("id"), (F.col("nc") if weighed else F.lit(1)).cast("long").alias("n")))
    return met.select(F.explode(F.concat(F.array(*own), third)).alias("x")).groupBy("x.id").agg(F.sum("x.n").alias("n"))


def triangles(g: SimpleGraph) -> DataFrame:
    """(id, triangles) of every vertex."""
    t = at_corners(closed(upward(g)))
    return g.vertices.select("id").join(t, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("triangles"))


def share_closed(g: SimpleGraph, weighed: bool) -> DataFrame:
    lists = upward(g)
    found = at_corners(closed(lists), weighed).join(lists.select("id", "d"), "id")
    joined = g.vertices.select("id").join(found, "id", "left")
    return joined.select("id", F.coalesce((1 if weighed else 2) * F.col("n") / (F.col("d") * (F.col("d") - 1)), F.lit(0.0)).alias("coefficient"))


def clustering(g: SimpleGraph) -> DataFrame:
    """(id, coefficient): closed wedges at a vertex over all wedges at it, undirected; 0 for fewer than two neighbours."""
    return share_closed(g, False)


def lcc(g: SimpleGraph) -> DataFrame:
    """(id, coefficient): edges among the neighbours (either direction counts by itself) over all ordered pairs of them."""
    return share_closed(g, not g.undirected)


def average_clustering(g: SimpleGraph) -> DataFrame:
    return clustering(g).agg(F.avg("coefficient").alias("value"))


def transitivity(g: SimpleGraph) -> DataFrame:
    """Three times the triangles over the wedges."""
    lists = upward(g)
    wedges = lists.select((F.col("d") * (F.col("d") - 1) / 2).alias("w"), F.lit(0).alias("t"))
    sums = wedges.unionByName(closed(lists).select(F.lit(0.0).alias("w"), (3 * F.size("cs")).alias("t"))).agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    return sums.select(F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0).alias("value"))


def degrees(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))


def peeled(pairs: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """state (id, d) without vertices of fewer than k neighbours, then without those that have fewer by their loss, and so on.

    Pairs are never written again: a round counts what the vertices that it takes were to others, and only these counts are shuffled."""
    while True:
        gone = state.filter(F.col("d") < k).select(F.col("id").alias("oid"))
        if gone.isEmpty():
            return state
        gone = cut(gone)
        has = key_set(gone)
        lost = union([has(pairs.select(F.col(x).alias("x"), F.col(y).alias("id")), "x").select("id") for x, y in (("a", "b"), ("b", "a"))]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        state, old = cut(state.filter(F.col("d") >= k).join(lost, "id", "left").select("id", (F.col("d") - F.coalesce("n", F.lit(0))).alias("d"))), state
        done_with(old, gone)


def kcore(g: SimpleGraph, k: int = 3) -> DataFrame:
    """(id): the largest subgraph in which every vertex has k neighbours or more."""
    pairs = cut(g.pairs())
    return peeled(pairs, cut(degrees(pairs)), k).select("id")


def kshell(g: SimpleGraph, k: int = 3) -> DataFrame:
    """(id): in the k-core and not in the next, which is peeled from it."""
    pairs = cut(g.pairs())
    core = peeled(pairs, cut(degrees(pairs)), k)
    kept = cut(core.select("id"))
    return kept.join(peeled(pairs, core, k + 1).select("id"), "id", "left_anti")


def hits(g: SimpleGraph, tolerance: float = 0.001, max_rounds: int = 100, normalized: bool = True) -> DataFrame:
    """(id, hub, authority); each round authorities from hubs, hubs from authorities, both over their maximum; stops when
    the hubs move by less than the tolerance in sum. Normalized scores sum to 1."""
    e = cut(g.directed().select("src", "dst"))
    v = cut(g.vertices.select("id"))
    n = v.count()
    hub = v.withColumn("hub", F.lit(1.0 / max(n, 1)))
    scores = v.withColumns({"hub": F.lit(1.0 / max(n, 1)), "authority": F.lit(0.0)})
    for _ in range(max_rounds if n else 0):
        auth = e.join(hub.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        auth = cut(auth)
        top_a = auth.agg(F.max("a")).first()[0] or 1.0
        new = e.join(auth.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        joined = cut(hub.join(new, "id", "left").join(auth, "id", "left").select("id", F.col("hub").alias("old"), F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a")))
        top_h = joined.agg(F.max("h")).first()[0] or 1.0
        scores = joined.select("id", (F.col("h") / top_h).alias("hub"), (F.col("a") / top_a).alias("authority"))
        moved = joined.agg(F.sum(F.abs(F.col("h") / top_h - F.col("old")))).first()[0] or 0.0
        hub = cut(scores.select("id", "hub"))
        if moved < tolerance:
            break
    if normalized:
        sums = scores.agg(F.sum("hub").alias("h"), F.sum("authority").alias("a")).first()
        scores = scores.select("id", (F.col("hub") / (sums.h or 1.0)).alias("hub"), (F.col("authority") / (sums.a or 1.0)).alias("authority"))
    return scores


def power(g: SimpleGraph, alpha: float, beta: float, keep: bool, tolerance: float, max_rounds: int, normalize_each: bool) -> DataFrame:
    v = cut(g.vertices.select("id"))
    n = v.count()
    x = v.withColumn("x", F.lit(1.0 / max(n, 1) if normalize_each else 0.0))
    with held(g.directed().select("src", "dst"), "src") as (_, join):
        for _ in range(max_rounds if n else 0):
            flow = join(x.withColumnRenamed("id", "src")).groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("f"))
            own = F.col("x") if keep else F.lit(0.0)
            y = cut(x.join(flow, "id", "left").select("id", F.col("x").alias("old"), (own + alpha * F.coalesce("f", F.lit(0.0)) + beta).alias("y")))
            norm = (y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0) if normalize_each else 1.0
            moved = y.agg(F.sum(F.abs(F.col("y") / norm - F.col("old")))).first()[0]
            x = y.select("id", (F.col("y") / norm).alias("x"))
            if moved < n * tolerance:
                break
    return x


def katz(g: SimpleGraph, alpha: float = 0.1, beta: float = 1.0, tolerance: float = 1e-6, max_rounds: int = 100, normalized: bool = True) -> DataFrame:
    """(id, centrality): x = alpha A'x + beta from 0 on; normalized to length 1."""
    x = power(g, alpha, beta, False, tolerance, max_rounds, False)
    norm = (x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0) if normalized else 1.0
    return x.select("id", (F.col("x") / norm).alias("centrality"))


def eigenvector(g: SimpleGraph, tolerance: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """(id, centrality): power iteration on A' + I, of length 1 each round."""
    return power(g, 1.0, 0.0, True, tolerance, max_rounds, True).select("id", F.col("x").alias("centrality"))


def degree_centrality(g: SimpleGraph, kind: str = "both") -> DataFrame:
    """(id, centrality): in-, out- or all edges at a vertex over the number of other vertices."""
    e = g.directed()
    ends = [e.select(F.col(c).alias("id")) for c in {"out": ("src",), "in": ("dst",), "both": ("src", "dst")}[kind]]
    counted = (ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    n = g.vertices.count()
    return g.vertices.select("id").join(counted, "id", "left").select("id", (F.coalesce("d", F.lit(0)) / float(max(n - 1, 1))).alias("centrality"))


def voterank(g: SimpleGraph, number: int = 0) -> DataFrame:
    """(rank, id): seeds in the order elected (all that win votes if number is 0). A vertex votes for its out-neighbours'
    targets with its ability; an elected one loses its vote, and its voters lose one over the mean degree of ability."""
    e = cut(g.both() if g.undirected else g.edges.filter("src != dst").select("src", "dst").distinct())
    v = g.vertices.select("id")
    n, m = v.count(), e.count()
    spark, seeds = v.sparkSession, []
    loss = n / m if m else 0.0
    state = cut(v.select("id", F.lit(1.0).alias("ability"), F.lit(False).alias("chosen")))
    while m and (not number or len(seeds) < number) and len(seeds) < n:
        votes = e.join(state.select(F.col("id").alias("src"), "ability"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("ability").alias("votes"))
        top = votes.join(state.filter("not chosen"), "id").filter("votes > 1e-12").orderBy(F.desc(F.round("votes", 9)), "id").limit(1).collect()
        if not top:
            break
        seeds.append(top[0].id)
        voters = e.filter(F.col("dst") == F.lit(top[0].id)).select(F.col("src").alias("id"), F.lit(1).alias("near"))
        ability = F.when(F.col("id") == F.lit(top[0].id), 0.0).when(F.col("near").isNotNull(), F.greatest(F.lit(0.0), F.col("ability") - loss)).otherwise(F.col("ability"))
        state = cut(state.join(voters, "id", "left").select("id", ability.alias("ability"), (F.col("chosen") | (F.col("id") == F.lit(top[0].id))).alias("chosen")))
    kind = g.vertices.schema["id"].dataType.simpleString()
    return spark.createDataFrame(list(enumerate(seeds, 1)), f"rank int, id {kind}")


def propagate_labels(g: SimpleGraph, seeds: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, labels map): from seeds (id, label), each round a vertex without a seed takes the mean of its in-neighbours' label
    distributions; seeds keep theirs."""
    fixed = cut(seeds.select("id", "label", F.lit(1.0).alias("p")))
    e = cut(g.directed().select("src", "dst"))
    degree = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    state = fixed
    for _ in range(rounds):
        flow = e.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.sum("p").alias("s"))
        new = flow.join(degree, "id").select("id", "label", (F.col("s") / F.col("d")).alias("p")).join(fixed.select("id"), "id", "left_anti")
        state = cut(fixed.unionByName(new))
    return state.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "p")))).alias("labels"))


def sampled_paths(steps: list[DataFrame], start: DataFrame, seed: int = 0) -> DataFrame:
    """(path): one random walk from each id in start, along one edge table (src, dst) a step; walks that cannot go on end."""
    walk = start.select(F.array("id").alias("path"), F.col("id").alias("at"))
    for i, e in enumerate(steps):
        choice = F.xxhash64(F.lit(seed + i), F.element_at("path", 1), "dst")
        moved = walk.join(e.select(F.col("src").alias("at"), "dst").distinct(), "at")
        walk = moved.groupBy("path").agg(F.min_by("dst", choice).alias("at")).select(F.array_append("path", F.col("at")).alias("path"), "at")
    return walk.select("path")


def dfs(g: SimpleGraph, source, max_edges: int = 1_000_000) -> list:
    """Vertices in depth-first order, smaller neighbours first. Sequential by nature: refuses graphs above max_edges."""
    e = g.directed().select("src", "dst").distinct()
    rows = e.limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"depth-first order is for graphs of up to {max_edges} edges")
    after: dict = {}
    for r in rows:
        after.setdefault(r.src, []).append(r.dst)
    if g.vertices.filter(F.col("id") == F.lit(source)).isEmpty():
        return []
    seen, order, stack = set(), [], [source]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            order.append(x)
            stack += sorted(after.get(x, []), reverse=True)
    return order


