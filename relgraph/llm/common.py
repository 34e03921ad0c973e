"""What the training-data operators share: tables, the shared folder, text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relgraph.runtime import done_with, new_path, sweep  # noqa: F401

#: The words of every operator: runs of anything but space and the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(c, UPPER, LOWER)


def materialise(df: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, gives the
    optimiser exact sizes, and lets several later plans read one result."""
    spark = df.sparkSession
    path = new_path(spark, what)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_._relgraph_path = path
    return table_


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans no longer referenced: once for what Python
    holds, once more for what only that held."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def trim_memory() -> None:
    """Give a worker's freed memory back to the system: a worker lives through many tasks, and two share an executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
