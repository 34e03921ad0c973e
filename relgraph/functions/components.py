"""Connected components of a link table, without ever gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relgraph.runtime import BROADCAST_KEYS, HEAVY_ROWS, cut, done_with


def to_least(links: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """links (u, v) with the m of their u in least (u, m, n). The rows of heavy u, if there are hubs, meet their m by a broadcast
    of bounded size."""
    if hubs:
        heavy = least.filter(F.col("n") > HEAVY_ROWS).select("u", "m")
        if heavy.count() <= BROADCAST_KEYS:  # more hubs than that spread over all tasks by themselves
            light = links.join(F.broadcast(heavy.select("u")), "u", "left_anti").join(least.filter(F.col("n") <= HEAVY_ROWS).select("u", "m"), "u")
            return links.join(F.broadcast(heavy), "u").unionByName(light)
    return links.join(least.select("u", "m"), "u")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps, each written to the shared folder: a hub's
    neighbours are never listed in one row, only joined to its minimum. Self-loops, repeated and
    reversed links do no harm; links with a null end are ignored; no links, no rows."""
    links = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = not least.filter(F.col("n") > HEAVY_ROWS).isEmpty()
        if hubs:
            least = cut(least, "least")
        large = to_least(both, least, hubs).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if hubs:
            large = cut(large, "large")
        nearest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = to_least(large, nearest, hubs).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, old = cut(moved.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct(), "links"), links
        done_with(old, least, large)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
