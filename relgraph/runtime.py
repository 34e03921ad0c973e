"""Tables in the folder that driver and executors share: they cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key with more rows than this is heavy: its rows are joined by a broadcast, so that one task need not read them all.
HEAVY_ROWS = 1024
#: Up to so many keys (two numbers each) are broadcast.
BROADCAST_KEYS = 100_000
#: Up to so many rows of 4096 bits are broadcast: 40 MB, or 300 million keys that are dense.
SET_ROWS = 73_000
#: What ``dealt`` puts in a part, of files as the planner sizes them, and how many parts it makes at most.
PART_BYTES, MOST_PARTS = 8 << 20, 4000
#: Parts that the rows of one key are dealt over while a loop holds them.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it; a temporary folder only for a local session without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="relgraph-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables that this process wrote to the shared folder.
WRITTEN: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder for a table, which ``sweep`` will delete."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> int:
    """Delete those tables, once the results that read them are written elsewhere; how many there were."""
    n = len(WRITTEN)
    while WRITTEN:
        delete(spark, WRITTEN.pop())
    return n


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """df, written and read back: later plans start here, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._relgraph_path = path
    return out


def done_with(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and no later plan reads: what a loop's earlier rounds leave behind."""
    for t in tables:
        path = getattr(t, "_relgraph_path", None)
        if path in WRITTEN:
            WRITTEN.remove(path)
            delete(t.sparkSession, path)


def dealt(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """df by keys, in more parts than spark.sql.shuffle.partitions where its files are large: a part's rows then take a bounded memory.

    Sizes are those that the planner knows of files; they decide nothing else."""
    if parts is None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, MOST_PARTS))
    return df.repartition(parts, *keys)


def salt_of(other: str | Column) -> Column:
    """Which of its key's SALTS parts a row is in, by another column."""
    return F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")


def salted(df: DataFrame) -> DataFrame:
    """df once for each part, to meet rows that ``held`` dealt."""
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


@contextmanager
def held(df: DataFrame, key: str, hubs: bool | None = None):
    """df, kept by executors and dealt by a column while a loop joins on it: a round then only shuffles what it computes.

    Yields (table, join): ``join(rows)`` joins rows to it on the key. If any key is heavy its rows are dealt over SALTS parts by
    the other columns, and what joins them is repeated as often, so no task holds all of a hub.
    What a lost executor held is read again from the written table below it."""
    written = cut(df, "held")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hubs is None:
        most = written.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        hubs = (most[0] or 0) > max(HEAVY_ROWS, 2 * (most[1] or 0) / max(parts, 8))
    rest = [c for c in df.columns if c != key]
    if hubs:
        out = written.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
        out = out.repartition(parts, key, "__salt").persist(StorageLevel.MEMORY_AND_DISK)
        join = lambda rows: out.join(salted(rows), [key, "__salt"]).drop("__salt")
    else:
        out = written.repartition(parts, key).persist(StorageLevel.MEMORY_AND_DISK)
        join = lambda rows: out.join(rows, key)
    try:
        yield out.drop("__salt"), join
    finally:
        out.unpersist()
        done_with(written)
