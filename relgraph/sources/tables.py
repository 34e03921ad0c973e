"""Table sources, the legacy text log, and result sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from relgraph.types import spark_type


def load_csv(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "|", header: bool = False) -> DataFrame:
    """Delimited text with declared SQL types: no pass over the data to infer them."""
    schema = ", ".join(f"`{c}` {spark_type(t).simpleString()}" for c, t in columns.items())
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def parse_location(location: str) -> tuple[str, str, dict[str, str]]:
    """(path, format, options) of ``path#header_row=true&label=x``; the format is the suffix, csv if there is none."""
    path, _, rest = location.partition("#")
    options = dict(x.split("=", 1) for x in re.split("[&#]", rest) if "=" in x)
    suffix = re.search(r"\.(csv|parquet|json|orc)$", path)
    return path, suffix[1] if suffix else "csv", options


def load(spark: SparkSession, location: str) -> DataFrame:
    path, kind, options = parse_location(location)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.options(header=options.get("header_row", "true"), sep=options.get("delimiter", ","), inferSchema="true")
    return reader.load(path)


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    """(op, label_id, epoch, seq, ids array, rest array) of lines ``op|epoch|...``: vertex lines hold an id and properties,
    edge lines a label and two ids."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    f = F.split("value", r"\|")
    edge = f[0].endswith("edge")
    return lines.filter("value != ''").select(
        f[0].alias("op"),
        f[1].cast("long").alias("epoch"),
        "seq",
        F.when(edge, f[2].cast("int")).alias("label_id"),
        F.when(edge, F.array(f[3].cast("long"), f[4].cast("long"))).otherwise(F.array(f[2].cast("long"))).alias("ids"),
        F.when(edge, F.slice(f, 6, 1 << 20)).otherwise(F.slice(f, 4, 1 << 20)).alias("rest"),
    )


def catalog(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of every column."""
    return [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]


def write_pairs(df: DataFrame, path: str, value: str, oid: str = "oid") -> None:
    """Text lines ``oid value``."""
    df.select(F.concat_ws(" ", F.col(oid).cast("string"), F.col(value).cast("string"))).write.text(path)


def json_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def write_columns(df: DataFrame, uri: str, columns: list[str], kind: str = "parquet") -> None:
    df.select(*columns).write.format(kind).save(uri)


def archive(graph, uri: str) -> None:
    """A folder of tables for each vertex and edge label."""
    for label, v in graph.vertices.items():
        v.write.parquet(f"{uri}/vertex/{label}")
    for label, e in graph.edges.items():
        e.write.parquet(f"{uri}/edge/{label}")
