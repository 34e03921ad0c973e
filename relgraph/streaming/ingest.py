"""Structured Streaming: change events in, an epoch-stamped log and its versions out.

A micro-batch is parsed, numbered after all batches before it, stamped with epochs by the number of events, and
appended under its batch id; a batch that runs again after a failure overwrites its own folder, so that every event
counts once. The state that crosses batches (how many events came before) is read from the versions written so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relgraph.operators import epochs
from relgraph.plans.mapping import GraphMapping
from relgraph.sources.cdc import parse_events, unified_log


def event_stream(spark: SparkSession, source: str, kafka: dict[str, str] | None = None, files_at_once: int = 1) -> DataFrame:
    """(value, seq): from Kafka (seq is the offset of its one partition), or from text files of ``seq<tab>event`` lines."""
    if kafka:
        read = spark.readStream.format("kafka").options(**{"startingOffsets": "earliest"} | kafka)
        return read.load().select(F.col("value").cast("string").alias("value"), F.col("offset").alias("seq"))
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(source)
    return lines.select(F.substring_index("value", "\t", 1).cast("long").alias("seq"), F.expr("substring(value, locate('\t', value) + 1)").alias("value"))


class LogWriter:
    """Writes micro-batches to ``path/log`` and ``path/versions``."""

    def __init__(self, mapping: GraphMapping, path: str, per_epoch: int = 10_000):
        self.mapping, self.path, self.per_epoch = mapping, path, per_epoch

    def before(self, spark: SparkSession, batch: int) -> int:
        """Events in the batches before this one."""
        if not batch:
            return 0
        done = self.versions(spark).filter(F.col("batch") < batch)
        return done.agg(F.sum("n")).first()[0] or 0

    def versions(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("n long, last_seq long, batch long").parquet(f"{self.path}/versions")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        offset = self.before(spark, batch_id)
        events = epochs.numbered(parse_events(batch), "seq", "k")
        events = events.withColumn("epoch", F.floor((F.col("k") + offset) / self.per_epoch).cast("long"))
        log = unified_log(events, self.mapping, keep=("epoch", "ts_ms")).withColumn("seq", F.col("seq") * 64 + F.col("part"))
        log.drop("part").withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").partitionBy("batch").parquet(f"{self.path}/log")
        count = batch.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq")).withColumn("batch", F.lit(batch_id).cast("long"))
        count.write.mode("overwrite").partitionBy("batch").parquet(f"{self.path}/versions")


def ingest(stream: DataFrame, mapping: GraphMapping, path: str, per_epoch: int = 10_000, available_now: bool = True):
    """Start the query; with available_now it ends when the present input is read. Resumes from its checkpoint."""
    writer = stream.writeStream.foreachBatch(LogWriter(mapping, path, per_epoch)).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log")


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; those later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
