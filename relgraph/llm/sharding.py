"""Two-pass external shuffle into shards.

Pass one scatters whole records uniformly into buckets that fit in memory, by a
seeded hash, permutes each bucket by Fisher-Yates swaps and writes the buckets to the
shared folder. Pass two reads them back, and a prefix sum over the bucket counts turns
(bucket, position) into a place in one global random permutation, dealt round-robin to
the shards. So every shard is a uniform sample in random order and shard sizes differ by
one row at most. The draws of a bucket are hashes of the seed, the bucket and the step:
the result depends on the rows and the seed alone, not on files, partitions or fetch order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialise, table, text_or_empty

#: Bounds of a bucket at the mean: bytes of text, and rows (a swap copies the bucket's row numbers).
BUCKET_BYTES, BUCKET_ROWS = 32 << 20, 4096
#: Bytes in a task of either pass, at the mean, and buckets whose counts one row of the prefix sum holds.
TASK_BYTES, RANGE = 128 << 20, 4096
#: Up to so many repeated rows' hashes (16 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000


def record_bytes(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 8 for the id."""
    return (F.octet_length(text_or_empty(text)) + 8).cast("long")


def row_hash(df: DataFrame, seed: int) -> Column:
    """A seeded hash of all that can be hashed of a row; nulls count."""
    plain = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *[x for c in plain for x in (F.col(c), F.col(c).isNull())])


def fisher_yates(n: Column, seed: Column) -> Column:
    """The numbers 0 to n-1 permuted: from the last place down, each is swapped with a drawn one at or below it."""

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(seed, i), i.cast("long")).cast("int")  # a place below i, from 0
        x, y = F.get(a, i - 1), F.get(a, j)
        swapped = F.concat(F.slice(a, F.lit(1), j), F.array(x), F.slice(a, j + 2, i - 2 - j), F.array(y), F.slice(a, i + 1, n - i))
        return F.when(j == i - 1, a).otherwise(swapped)

    places = F.when(n > 1, F.sequence(n, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), swap)


def two_pass_shuffle(
    df: DataFrame, shards: int = 24, seed: int = 20240601, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, text: str = "text"
) -> DataFrame:
    """df in a seeded random order, with ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Any columns pass through whole; nulls and empty texts are values like any other. The scatter hash is of the whole
    row, so equal texts under different ids are dealt apart. Rows that repeat in full beyond ``bucket_rows`` times are
    spread by their number in the scan as well, so that no bucket holds a hot group; only then does the place of a row
    depend on how the input is read. An empty table gives no rows. Columns of df named ``shard`` or ``slot`` are replaced."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    hashed = df.select(row_hash(df, seed).alias("h"), record_bytes(text).alias("s"))
    sizes = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
    total, rows, most = sizes.agg(F.sum("s"), F.sum("n"), F.max("n")).first()
    total, rows = total or 0, rows or 0
    buckets = max(1, math.ceil(total / bucket_bytes), math.ceil(rows / bucket_rows))
    tasks = max(min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), math.ceil(total / TASK_BYTES))
    # Pass one: scatter, permute each bucket, write.
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    scattered = df.select(row_hash(df, seed).alias("__h"), record.alias("__r"))
    if (most or 0) > bucket_rows:
        hot = materialise(sizes.filter(F.col("n") > bucket_rows).select(F.col("h").alias("__h"), F.lit(True).alias("__hot")), "repeated-rows")
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
        spread = F.when(F.col("__hot"), F.xxhash64("__h", F.monotonically_increasing_id())).otherwise(F.col("__h"))
        scattered = scattered.join(hot, "__h", "left").select(spread.alias("__h"), "__r")
    scattered = scattered.withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("long")).repartition(tasks, "__b")
    grouped = scattered.groupBy("__b").agg(F.collect_list(F.struct("__h", "__r")).alias("__a"))
    # A canonical order before the permutation: fetch order must not decide the result.
    grouped = grouped.withColumn("__a", F.array_sort("__a", lambda x, y: F.when(x["__h"] < y["__h"], -1).when(x["__h"] > y["__h"], 1).otherwise(0)))
    grouped = grouped.withColumn("__o", fisher_yates(F.size("__a"), F.xxhash64(F.lit(seed), "__b")))
    placed = grouped.select("__b", "__a", F.posexplode("__o").alias("__p", "__i"))
    written = materialise(placed.select("__b", "__p", F.get("__a", F.col("__i"))["__r"].alias("__r")), "buckets")
    # Pass two: a bucket's first place is the number of records in the buckets before it.
    counts = written.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # One row a bucket; written, so that its real size decides how it is joined.
    offsets = materialise(prefix_sums(counts), "offsets")
    place = F.col("__o") + F.col("__p")
    return written.join(offsets, "__b").select(
        "__r.*",
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / F.lit(shards)).cast("long").alias("slot"),
    )


def prefix_sums(counts: DataFrame) -> DataFrame:
    """(__b, __o) from (__b, __n): the sum over smaller __b; within ranges of RANGE buckets, plus what the ranges before hold."""
    ranged = counts.withColumn("__g", F.floor(F.col("__b") / RANGE))
    before = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)  # a row for each RANGE buckets
    ranges = ranged.groupBy("__g").agg(F.sum("__n").alias("__s")).select("__g", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__f"))
    inner = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("__i", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    return own.join(ranges, "__g").select("__b", (F.col("__i") + F.col("__f")).alias("__o"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write each shard in slot order under ``path/shard=k``; ranges of slots split large shards over tasks."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23; law ``rows``: counts at most one apart."""
    out = two_pass_shuffle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        record_bytes().alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
