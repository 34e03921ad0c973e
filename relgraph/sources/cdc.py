"""Change events of source tables to operations of the unified log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.operators.epochs import transaction_id
from relgraph.operators.graph import union
from relgraph.operators.log import ADD_EDGE, ADD_VERTEX, DELETE_EDGE, DELETE_VERTEX, UPDATE_VERTEX
from relgraph.plans.mapping import EdgeMapping, GraphMapping, VertexMapping

#: The part of a change event that is read, whatever its tables; images stay JSON text.
EVENT = (
    "op string, before string, after string, "
    "source struct<table:string, db:string, schema:string, snapshot:string, txId:bigint, gtid:string, lsn:bigint, ts_ms:bigint>"
)
LEGACY = "table string, type string, data string, old string"
INSERT, UPDATE, DELETE = "insert", "update", "delete"


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """raw (with the JSON event in ``value``) with kind, table, before, after, tx, ts_ms, snapshot_row, snapshot_end.

    Creates and snapshot reads are inserts; a snapshot read that the source marks as not part of a snapshot, like
    an unknown op, has a null kind. A delete's image is ``before``. Events of a snapshot have tx 0."""
    e = F.from_json(value, EVENT)
    snapshot = F.lower(F.coalesce(F.col("e.source.snapshot"), F.lit("false")))
    kind = (
        F.when(F.col("e.op") == "c", INSERT)
        .when((F.col("e.op") == "r") & (snapshot != "false"), INSERT)
        .when(F.col("e.op") == "u", UPDATE)
        .when(F.col("e.op") == "d", DELETE)
    )
    in_snapshot = (F.col("e.op") == "r") & (snapshot != "false")
    return raw.withColumn("e", e).select(
        *[c for c in raw.columns if c != value],
        kind.alias("kind"),
        F.lower("e.source.table").alias("table"),
        F.col("e.before").alias("before"),
        F.col("e.after").alias("after"),
        F.when(in_snapshot, F.lit(0).cast("long")).otherwise(transaction_id(F.col("e.source.txId"), F.col("e.source.gtid"))).alias("tx"),
        F.col("e.source.ts_ms").alias("ts_ms"),
        in_snapshot.alias("snapshot_row"),
        (in_snapshot & (snapshot == "last")).alias("snapshot_end"),
    )


def parse_legacy_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """The same from ``{table, type, data[, old]}`` events; there is no transaction id."""
    return raw.withColumn("e", F.from_json(value, LEGACY)).select(
        *[c for c in raw.columns if c != value],
        F.when(F.lower("e.type").isin(INSERT, UPDATE, DELETE), F.lower("e.type")).alias("kind"),
        F.lower("e.table").alias("table"),
        F.when(F.lower("e.type") == DELETE, F.col("e.data")).otherwise(F.col("e.old")).alias("before"),
        F.when(F.lower("e.type") != DELETE, F.col("e.data")).alias("after"),
        F.lit(None).cast("long").alias("tx"),
        F.lit(None).cast("long").alias("ts_ms"),
        F.lit(False).alias("snapshot_row"),
        F.lit(False).alias("snapshot_end"),
    )


def image_field(image: str, column: str) -> Column:
    """A column of a JSON row image, as text; null where the image or the column is null."""
    return F.get_json_object(image, f"$.{column}")


def props_of(image: str, m: VertexMapping | EdgeMapping, empty_as_null: bool) -> Column:
    fields = []
    for c, p in m.props.items():
        value = image_field(image, c)
        fields.append((F.when(value != "", value) if empty_as_null else value).alias(p))
    return F.to_json(F.struct(*fields)) if fields else F.lit(None).cast("string")


def unified_log(events: DataFrame, mapping: GraphMapping, seq: str = "seq", empty_as_null: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(op, label, seq, part, oid, src, dst, props, *keep): the operations that each event becomes.

    One event feeds every label mapped to its table; an edge's update is a delete of the old row and an add of the
    new one, in that order (``part`` orders the operations of one event); a delete whose old row is missing does nothing;
    edges with a null end, and tables that are not mapped, are skipped."""
    out = []
    for table, mapped in mapping.tables().items():
        own = events.filter((F.col("table") == table.lower()) & F.col("kind").isNotNull())
        for n, m in enumerate(mapped):
            if isinstance(m, VertexMapping):
                image = own.withColumn("image", F.when(F.col("kind") == DELETE, F.col("before")).otherwise(F.col("after")))
                op = F.when(F.col("kind") == INSERT, ADD_VERTEX).when(F.col("kind") == UPDATE, UPDATE_VERTEX).otherwise(DELETE_VERTEX)
                rows = image.select(
                    op.alias("op"), F.lit(m.label).alias("label"), F.col(seq).alias("seq"), F.lit(2 * n).alias("part"),
                    image_field("image", m.key).cast("long").alias("oid"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"),
                    F.when(F.col("kind") != DELETE, props_of("image", m, empty_as_null)).alias("props"), *keep,
                )
                out.append(rows.filter("oid is not null"))
                continue
            remove = F.struct(F.lit(DELETE_EDGE).alias("op"), F.col("before").alias("image"), F.lit(2 * n).alias("part"))
            add = F.struct(F.lit(ADD_EDGE).alias("op"), F.col("after").alias("image"), F.lit(2 * n + 1).alias("part"))
            steps = F.when(F.col("kind") == INSERT, F.array(add)).when(F.col("kind") == DELETE, F.array(remove)).otherwise(F.array(remove, add))
            split = own.select(F.explode(steps).alias("x"), F.col(seq).alias("seq"), *keep).select("x.*", "seq", *keep).filter("image is not null")
            rows = split.select(
                "op", F.lit(m.label).alias("label"), "seq", "part", F.lit(None).cast("long").alias("oid"),
                image_field("image", m.src).cast("long").alias("src"), image_field("image", m.dst).cast("long").alias("dst"),
                F.when(F.col("op") == ADD_EDGE, props_of("image", m, empty_as_null)).alias("props"), *keep,
            )
            out.append(rows.filter("src is not null and dst is not null"))
    return union(out)


def ends_of(mapping: GraphMapping) -> dict[str, tuple[str, str]]:
    return {e.label: (e.src_label, e.dst_label) for e in mapping.edges}
