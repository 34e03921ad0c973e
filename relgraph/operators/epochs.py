"""Epoch assignment: by number of source events, by time, or aligned with transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relgraph.runtime import cut

#: Rows of seq in a bucket of the distributed row number.
BUCKET = 1 << 16


def summed_before(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows before each, by ``order`` (whole numbers; rows of one number in any order).

    Many tasks do it: the running sum within a bucket of ``order``, plus the sums of the buckets before, of which there
    is one row for BUCKET numbers."""
    df = df.withColumns({"__b": F.floor(F.col(order) / BUCKET), "__v": value})
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("__b").agg(F.sum("__v").alias("__s"))
    sums = sums.select(F.col("__b").alias("__c"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inner = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, F.col("__b").eqNullSafe(F.col("__c")))
    return out.withColumn(name, F.coalesce(F.sum("__v").over(inner), F.lit(0)) + F.col("__o")).drop("__b", "__v", "__c", "__o")


def numbered(df: DataFrame, seq: str = "seq", name: str = "k") -> DataFrame:
    """df with its 0-based rank by seq."""
    return summed_before(df, seq, F.lit(1), name)


def by_count(events: DataFrame, per_epoch: int = 10_000, seq: str = "seq", first: int = 0) -> DataFrame:
    """epoch = first + floor(rank / per_epoch)."""
    return numbered(events, seq, "__k").withColumn("epoch", (F.floor(F.col("__k") / per_epoch) + first).cast("long")).drop("__k")


def by_time(events: DataFrame, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """epoch = whole intervals of ``seconds`` since 1970."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("epoch", F.floor(micros / (seconds * 1_000_000)).cast("long"))


def by_transaction(events: DataFrame, per_epoch: int = 10_000, tx: str = "tx", first: int = 0, carried: int = 0) -> DataFrame:
    """Transactions in order of their id, never split: an epoch ends with the transaction by which per_epoch events or more have
    come since the epoch began, and counting begins anew. ``carried`` events of epoch ``first`` came before these.

    Which transactions begin an epoch is found by doubling: each knows the one that would end its epoch, then the second, the
    fourth and so on, so the rounds are the logarithm of the number of epochs and no task reads all transactions."""
    sizes = events.groupBy(F.col(tx).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    starts = cut(summed_before(sizes, "__t", F.col("__n"), "__k").select("__t", "__k"))
    # The first transaction of a later epoch, were this one the first of its own.
    need = F.greatest(F.col("__k") + 1, F.col("__k") + per_epoch - F.when(F.col("__k") == 0, carried).otherwise(0))
    values = starts.select(F.col("__k").alias("at"), F.col("__k").alias("value"))
    both = values.unionByName(starts.select(need.alias("at"), F.col("__k").alias("k")), allowMissingColumns=True).withColumn("b", F.floor(F.col("at") / per_epoch))
    later = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each epoch's worth of events
    ends = both.groupBy("b").agg(F.min("value").alias("e")).select(F.col("b").alias("c"), F.last("e", ignorenulls=True).over(later).alias("e"))
    inner = Window.partitionBy("b").orderBy(F.desc("at"), F.col("value").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    step = both.withColumn("to", F.last("value", ignorenulls=True).over(inner)).filter("k is not null").join(ends, F.col("b") == F.col("c")).select("k", F.coalesce("to", "e").alias("to"))
    jumps = [cut(step.filter("to is not null"))]
    while not jumps[-1].isEmpty():
        j = jumps[-1]
        jumps.append(cut(j.join(j.select(F.col("k").alias("to"), F.col("to").alias("beyond")), "to").select("k", F.col("beyond").alias("to"))))
    begun = starts.filter("__k = 0").select(F.col("__k").alias("k"), F.lit(first).cast("long").alias("epoch"))
    for i, j in reversed(list(enumerate(jumps[:-1]))):
        begun = cut(begun.unionByName(begun.join(j, "k").select(F.col("to").alias("k"), (F.col("epoch") + (1 << i)).alias("epoch"))))
    # Each transaction is of the last epoch begun by then.
    marked = starts.join(begun, F.col("__k") == F.col("k"), "left").withColumn("b", F.floor(F.col("__k") / per_epoch))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    left = marked.groupBy("b").agg(F.max("epoch").alias("m")).select(F.col("b").alias("c"), F.max("m").over(upto).alias("m"))
    inside = Window.partitionBy("b").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    epochs = marked.withColumn("x", F.max("epoch").over(inside)).join(left, F.col("b") == F.col("c")).select("__t", F.coalesce("x", "m").alias("epoch"))
    return events.join(epochs, F.col(tx).eqNullSafe(F.col("__t"))).drop("__t")


def transaction_id(tx_id: Column, gtid: Column) -> Column:
    """A PostgreSQL transaction id, else the number after the last colon of a MySQL GTID."""
    return F.coalesce(tx_id.cast("long"), F.substring_index(gtid, ":", -1).try_cast("long"))
