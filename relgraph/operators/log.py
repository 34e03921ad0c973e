"""The unified log: vertex and edge operations with an epoch and a sequence number, and reads as of an epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from relgraph.operators.epochs import BUCKET

ADD_VERTEX, UPDATE_VERTEX, DELETE_VERTEX, ADD_EDGE, DELETE_EDGE = "add_vertex", "update_vertex", "del_vertex", "add_edge", "del_edge"
#: Columns of the log; props is a JSON text of the label's properties.
LOG_SCHEMA = "op string, label string, epoch long, seq long, oid long, src long, dst long, props string"


def vertex_asof(log: DataFrame, epoch: int, label: str | None = None) -> DataFrame:
    """(label, oid, props, seq): vertices whose last operation up to the epoch is no delete, with that operation's properties."""
    ops = log.filter(F.col("op").isin(ADD_VERTEX, UPDATE_VERTEX, DELETE_VERTEX) & (F.col("epoch") <= epoch))
    if label is not None:
        ops = ops.filter(F.col("label") == label)
    last = ops.groupBy("label", "oid").agg(F.max_by(F.struct("op", "props", "seq"), "seq").alias("last"))
    return last.filter(F.col("last.op") != DELETE_VERTEX).select("label", "oid", "last.props", "last.seq")


def edge_asof(log: DataFrame, epoch: int, ends: dict[str, tuple[str, str]]) -> DataFrame:
    """(label, src, dst, props, seq): the multiset of live edges. ends: edge label -> (src label, dst label).

    A delete takes the newest live parallel edge; one that finds none does nothing. So with s the running sum of
    +1 and -1 of a key and b = s reflected at its running minimum below 0 (the number alive), an add survives iff
    b never again falls below its own value. Deleting a vertex deletes the edges at it that were added before."""
    ops = log.filter(F.col("op").isin(ADD_EDGE, DELETE_EDGE) & (F.col("epoch") <= epoch))
    key = Window.partitionBy("label", "src", "dst").orderBy("seq")
    upto = key.rowsBetween(Window.unboundedPreceding, 0)
    ops = ops.withColumns({"s": F.sum(F.when(F.col("op") == ADD_EDGE, 1).otherwise(-1)).over(upto), "n": F.row_number().over(key)})
    ops = ops.withColumn("b", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    # The rest of the key, from its end: a frame up to unbounded following is computed anew for each row.
    ops = ops.withColumn("low", F.min("b").over(Window.partitionBy("label", "src", "dst").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    alive = ops.filter((F.col("op") == ADD_EDGE) & (F.col("low") >= F.col("b"))).select("label", "src", "dst", "props", "seq")
    return without_deleted_ends(alive, deleted(log, epoch), ends)


def deleted(log: DataFrame, epoch: int) -> DataFrame:
    """(label, oid, gone): the last delete of each vertex that has one."""
    ops = log.filter((F.col("op") == DELETE_VERTEX) & (F.col("epoch") <= epoch))
    return ops.groupBy("label", "oid").agg(F.max("seq").alias("gone"))


def without_deleted_ends(edges: DataFrame, tombstones: DataFrame, ends: dict[str, tuple[str, str]]) -> DataFrame:
    """edges without those older than a delete of either end."""
    out = edges
    for i, c in enumerate(("src", "dst")):
        own = F.create_map(*[F.lit(x) for k, v in ends.items() for x in (k, v[i])])
        t = tombstones.select(F.col("label").alias("__l"), F.col("oid").alias("__o"), "gone")
        out = out.join(t, (F.element_at(own, F.col("label")) == F.col("__l")) & (F.col(c) == F.col("__o")) & (F.col("gone") > F.col("seq")), "left_anti")
    return out


def with_known_endpoints(log: DataFrame, ends: dict[str, tuple[str, str]]) -> DataFrame:
    """The log without edge operations on a vertex that no earlier operation added."""
    born = log.filter(F.col("op") == ADD_VERTEX).groupBy(F.col("label").alias("__l"), F.col("oid").alias("__o")).agg(F.min("seq").alias("__born"))
    out = log.filter(F.col("op").isin(ADD_EDGE, DELETE_EDGE))
    for i, c in enumerate(("src", "dst")):
        own = F.create_map(*[F.lit(x) for k, v in ends.items() for x in (k, v[i])])
        out = out.join(born, (F.element_at(own, F.col("label")) == F.col("__l")) & (F.col(c) == F.col("__o")) & (F.col("__born") < F.col("seq")), "left_semi")
    return log.filter(~F.col("op").isin(ADD_EDGE, DELETE_EDGE)).unionByName(out)


def versions(log: DataFrame, ts: str = "ts") -> DataFrame:
    """(epoch, begin_ts, end_ts) of every closed epoch: all but the last, which may still grow.

    begin is the end of the epoch before, null for the first."""
    order = Window.orderBy("epoch")  # a row for each epoch
    each = log.groupBy("epoch").agg(F.max(ts).alias("end_ts"))
    out = each.select("epoch", F.lag("end_ts").over(order).alias("begin_ts"), "end_ts", F.lead("epoch").over(order).alias("__next"))
    return out.filter("__next is not null").drop("__next")


def edge_lifetimes(log: DataFrame, ends: dict[str, tuple[str, str]]) -> DataFrame:
    """(label, src, dst, from_epoch, until_epoch): the epochs [from, until) in which each added edge is read; until is null for what still stands.

    An add dies by the delete that takes it, the first by which fewer are alive than it made, or by the first later delete of an end."""
    ops = log.filter(F.col("op").isin(ADD_EDGE, DELETE_EDGE))
    key = Window.partitionBy("label", "src", "dst").orderBy("seq")
    upto = key.rowsBetween(Window.unboundedPreceding, 0)
    ops = ops.withColumn("s", F.sum(F.when(F.col("op") == ADD_EDGE, 1).otherwise(-1)).over(upto))
    ops = ops.withColumn("b", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    # An add that makes the b-th and the next delete that leaves b - 1: brackets of one depth alternate.
    level = F.when(F.col("op") == ADD_EDGE, F.col("b")).otherwise(F.col("b") + 1)
    real = ops.withColumns({"level": level, "had": F.coalesce(F.lag("b").over(key), F.lit(0))}).filter((F.col("op") == ADD_EDGE) | (F.col("had") > 0))
    bracket = Window.partitionBy("label", "src", "dst", "level").orderBy("seq")
    adds = real.withColumns({"d": F.lead("epoch").over(bracket)}).filter(F.col("op") == ADD_EDGE).select("label", "src", "dst", "epoch", "seq", "d")
    gone = log.filter(F.col("op") == DELETE_VERTEX).select(F.col("label").alias("__l"), F.col("oid").alias("__o"), F.col("seq").alias("__s"), F.col("epoch").alias("__e"))
    out = adds
    for i, c in enumerate(("src", "dst")):
        own = F.create_map(*[F.lit(x) for k, v in ends.items() for x in (k, v[i])])
        both = out.select(F.element_at(own, F.col("label")).alias("__l"), F.col(c).alias("__o"), F.col("seq").alias("__s"), F.struct(*out.columns).alias("x")).unionByName(gone, allowMissingColumns=True)
        out = with_next_delete(both).filter("x is not null").select("x.label", "x.src", "x.dst", "x.epoch", "x.seq", F.least("x.d", "g").alias("d"))
    return out.select("label", "src", "dst", F.col("epoch").alias("from_epoch"), F.col("d").alias("until_epoch")).filter("until_epoch is null or until_epoch > from_epoch")


def with_next_delete(both: DataFrame) -> DataFrame:
    """both (__l, __o, __s, __e, ...), where __e is the epoch of a delete and null elsewhere, with ``g``: that of the first delete of (__l, __o) from __s on.

    Within a bucket of __s by a window, run from its end; what later buckets hold comes from a row for each bucket of a vertex. So no
    task reads all of a hub's rows, and each row is read once."""
    slot = ["__l", "__o", "__b"]
    both = both.withColumn("__b", F.floor(F.col("__s") / BUCKET))
    found = both.withColumn("__in", F.last("__e", ignorenulls=True).over(Window.partitionBy(*slot).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)))
    deletes = both.filter("__e is not null").groupBy(*slot).agg(F.min_by("__e", "__s").alias("__f"))
    slots = both.select(*slot).distinct().join(deletes, slot, "left")
    later = Window.partitionBy("__l", "__o").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*slot, F.last("__f", ignorenulls=True).over(later).alias("__then")).filter("__then is not null")
    return found.join(slots, slot, "left").withColumn("g", F.coalesce("__in", "__then")).drop("__b", "__in", "__then")


def counted_versions(log: DataFrame, ends: dict[str, tuple[str, str]], ts: str = "ts") -> DataFrame:
    """``versions`` with n_vertices and n_edges: how many a read as of the epoch gives. Cascaded edges, deletes that hit nothing and
    repeated adds count as the read has them."""
    order = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    out = versions(log, ts)
    for name, lives in (("n_vertices", vertex_validity(log)), ("n_edges", edge_lifetimes(log, ends))):
        change = lives.select(F.col("from_epoch").alias("epoch"), F.lit(1).alias("c")).unionByName(lives.filter("until_epoch is not null").select(F.col("until_epoch").alias("epoch"), F.lit(-1).alias("c")))
        change = change.groupBy("epoch").agg(F.sum("c").alias("c"))
        every = log.select("epoch").distinct().join(change, "epoch", "left").select("epoch", F.sum(F.coalesce("c", F.lit(0))).over(order).cast("long").alias(name))
        out = out.join(every, "epoch")
    return out


def version_at(versions_: DataFrame, ts) -> DataFrame:
    """The newest version that ended by ts; no row if there is none."""
    return versions_.filter(F.col("end_ts") <= F.lit(ts)).orderBy(F.desc("epoch")).limit(1)


def versions_at(versions_: DataFrame, times: DataFrame, ts: str = "ts") -> DataFrame:
    """As-of join: times with the epoch of the newest version that ended by each, null if there is none.

    Within a day by a window; what the days before leave over comes from a row for each day."""
    both = times.select(F.col(ts).alias("__ts"), F.lit(1).alias("__q"), F.lit(None).cast("long").alias("__e")).unionByName(
        versions_.select(F.col("end_ts").alias("__ts"), F.lit(0).alias("__q"), F.col("epoch").alias("__e"))
    )
    both = both.withColumn("__day", F.date_trunc("day", "__ts"))
    days = both.groupBy("__day").agg(F.max("__e").alias("__m"))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("__day").alias("__d"), F.max("__m").over(before).alias("__left"))
    order = Window.partitionBy("__day").orderBy("__ts", "__q").rowsBetween(Window.unboundedPreceding, 0)
    out = both.join(days, F.col("__day").eqNullSafe(F.col("__d"))).withColumn("epoch", F.coalesce(F.max("__e").over(order), "__left"))
    return out.filter("__q = 1").select(F.col("__ts").alias(ts), "epoch")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, ...): rows of two versions of one label that one has and the other lacks, as multisets."""
    added = new.exceptAll(old).withColumn("change", F.lit("added"))
    return added.unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def compacted(log: DataFrame, epoch: int, ends: dict[str, tuple[str, str]]) -> DataFrame:
    """A log with the same reads from ``epoch`` on: what is alive then, as adds, and all later operations."""
    v = vertex_asof(log, epoch).select(F.lit(ADD_VERTEX).alias("op"), "label", F.lit(epoch).cast("long").alias("epoch"), "seq", "oid", "props")
    e = edge_asof(log, epoch, ends).select(F.lit(ADD_EDGE).alias("op"), "label", F.lit(epoch).cast("long").alias("epoch"), "seq", "src", "dst", "props")
    return log.filter(F.col("epoch") > epoch).unionByName(v, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)


def vertex_validity(log: DataFrame) -> DataFrame:
    """(label, oid, props, from_epoch, until_epoch): each state of a vertex and the epochs [from, until) in which it
    is read; until is null for what still stands. States that their own epoch overwrites are left out."""
    ops = log.filter(F.col("op").isin(ADD_VERTEX, UPDATE_VERTEX, DELETE_VERTEX))
    last = ops.groupBy("label", "oid", "epoch").agg(F.max_by(F.struct("op", "props"), "seq").alias("x"))
    order = Window.partitionBy("label", "oid").orderBy("epoch")
    out = last.withColumn("until_epoch", F.lead("epoch").over(order)).filter(F.col("x.op") != DELETE_VERTEX)
    return out.select("label", "oid", "x.props", F.col("epoch").alias("from_epoch"), "until_epoch")


def valid_at(validity: DataFrame, times: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Interval join: times (with label, oid, epoch) with the state of their vertex in that epoch."""
    v = validity.withColumnsRenamed({"label": "__l", "oid": "__o"})
    on = (F.col("label") == F.col("__l")) & (F.col("oid") == F.col("__o")) & (F.col(epoch) >= F.col("from_epoch")) & (F.col("until_epoch").isNull() | (F.col(epoch) < F.col("until_epoch")))
    return times.join(v, on).select(*times.columns, "props", "from_epoch", "until_epoch")
