"""SQL column types of a mapping and the Spark types that hold them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# SQL type names that sources declare, by longest prefix.
SQL_TYPES: dict[str, T.DataType] = {
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "char": T.StringType(),
    "character varying": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "double": T.DoubleType(),
    "double precision": T.DoubleType(),
    "float": T.FloatType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "smallint": T.ShortType(),
    "text": T.StringType(),
    "time": T.LongType(),
    "timestamp": T.TimestampNTZType(),
    "varchar": T.StringType(),
}

#: Names in schema renderings.
GRAPH_NAMES = {
    T.IntegerType: "INT",
    T.LongType: "LONG",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "STRING",
    T.DateType: "DATE",
    T.TimestampNTZType: "DATETIME",
    T.BooleanType: "BOOL",
    T.ShortType: "SHORT",
}


def spark_type(sql: str) -> T.DataType:
    """The Spark type of a declared SQL type; time without a date is microseconds of the day."""
    name = re.sub(r"\(.*?\)", "", sql.strip().lower()).strip()
    for known in sorted(SQL_TYPES, key=len, reverse=True):
        if re.match(rf"{known}(?![a-z])", name):
            return SQL_TYPES[known]
    raise TypeError(f"unsupported type {sql!r}")


def graph_type(kind: T.DataType) -> str:
    return GRAPH_NAMES.get(type(kind), kind.simpleString().upper())
