"""The registered queries over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from relgraph.functions import algorithms as A, selectors
from relgraph.functions.pregel import Pregel
from relgraph.operators import dynamic, epochs, log as L
from relgraph.operators.graph import PropertyGraph, SimpleGraph, tpch_graph, tpch_mapping, union
from relgraph.operators.traversal import Traversal
from relgraph.plans.mapping import GraphMapping, VertexMapping, EdgeMapping
from relgraph.runtime import dealt
from relgraph.sources import cdc, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(name: str, digits: int = 9):
    return F.round(F.col(name), digits).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans and mappings.


@query(
    " union all ".join(
        f"select '{t}' as label, cast({k} as bigint) as oid from {t}"
        for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))
    )
)
def vertices_by_label(spark, sf_dir):
    return tpch_graph(spark, sf_dir).all_vertices()


EDGES_SQL = """
select 'in_region' as elabel, cast(n_nationkey as bigint) as src, cast(n_regionkey as bigint) as dst from nation
union all select 'cust_nation', c_custkey, c_nationkey from customer union all select 'supp_nation', s_suppkey, s_nationkey from supplier
union all select 'placed', o_custkey, o_orderkey from orders union all select 'contains', l_orderkey, l_partkey from lineitem
union all select 'supplied_by', l_orderkey, l_suppkey from lineitem"""


@query(f"select elabel, count(*) as n, count(distinct (src, dst)) as pairs from ({EDGES_SQL}) group by elabel")
def edges_by_label(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    pairs = {k: dealt(e.select("src", "dst"), "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")) for k, e in g.edges.items()}
    return union([p.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("pairs")).filter("pairs > 0").select(F.lit(k).alias("elabel"), "n", "pairs") for k, p in pairs.items()])


@query("select o_custkey as src, o_orderkey as dst, o_totalprice as total from orders")
def fk_edge_mapping(spark, sf_dir):
    return tpch_graph(spark, sf_dir).edges["placed"]


@query("select l_orderkey as src, l_partkey as dst, l_quantity as quantity, l_extendedprice as price from lineitem")
def nn_edge_mapping(spark, sf_dir):
    return tpch_graph(spark, sf_dir).edges["contains"]


@query("select c_custkey as src, o_orderkey as dst from customer join orders on c_custkey = o_custkey where o_totalprice > 100000 and c_acctbal > 0")
def dangling_edge_drop(spark, sf_dir):
    t = {"customer": table(spark, sf_dir, "customer").filter("c_acctbal > 0"), "orders": table(spark, sf_dir, "orders").filter("o_totalprice > 100000")}
    m = tpch_mapping()
    m = GraphMapping("g", (m.vertex("customer"), m.vertex("orders")), (m.edge("placed"),))
    return PropertyGraph.from_mapping(m, t).edges["placed"].select("src", "dst")


@query("select c_custkey as src, cast(c_nationkey as bigint) as dst from customer where c_acctbal >= 0")
def null_endpoint_skip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")))
    return PropertyGraph.from_mapping(tpch_mapping(), {"customer": c, "nation": table(spark, sf_dir, "nation")}).edges["cust_nation"]


@query(
    f"""with v as (select 'vertex' as kind, label from ({ORACLE_SQL['vertices_by_label']}) union all select 'edge', elabel from ({EDGES_SQL}))
    select kind, label, count(*) as n from v group by rollup(kind, label)"""
)
def label_counts_rollup(spark, sf_dir):
    return tpch_graph(spark, sf_dir).counts()


@query("select l_orderkey as src, l_partkey as dst, count(*) as n from lineitem group by all having count(*) > 1")
def parallel_edges(spark, sf_dir):
    return tpch_graph(spark, sf_dir).edges["contains"].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# Change events.

OPS = GraphMapping(
    "shop",
    (VertexMapping("orders", "orders", "o_orderkey", {"o_totalprice": "total"}), VertexMapping("customer", "customer", "c_custkey", {"c_name": "name"})),
    (EdgeMapping("placed", "orders", "customer", "orders", "o_custkey", "o_orderkey"),),
)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events as JSON text, one an order, in order of o_orderkey; its remainder by 4 tells the kind."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in "curd"]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    image = F.to_json(F.struct("o_orderkey", "o_custkey", F.col("o_totalprice").cast("long").alias("o_totalprice")))
    old = F.to_json(F.struct("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.col("o_totalprice").cast("long").alias("o_totalprice")))
    source = F.struct(
        F.lit("orders").alias("table"), F.when(F.col("o_orderkey") % 4 == 2, "true").otherwise("false").alias("snapshot"),
        F.when(F.col("o_orderkey") % 8 < 4, (F.col("o_orderkey") / 5).cast("long")).alias("txId"), F.concat(F.lit("u-u:"), F.floor(F.col("o_orderkey") / 5)).alias("gtid"),
    )
    event = F.to_json(F.struct(kind.alias("op"), F.when(kind == "d", image).when(kind == "u", old).alias("before"), F.when(kind != "d", image).alias("after"), source.alias("source")))
    return o.select(F.col("o_orderkey").alias("seq"), event.alias("value"))


@query(
    """select o_orderkey as seq, case o_orderkey % 4 when 1 then 'update' when 3 then 'delete' else 'insert' end as kind, 'orders' as "table",
    case when o_orderkey % 4 = 2 then 0 else o_orderkey // 5 end as tx, o_orderkey % 4 = 2 as snapshot_row from orders"""
)
def cdc_normalise(spark, sf_dir):
    return cdc.parse_events(order_events(spark, sf_dir)).select("seq", "kind", "table", "tx", "snapshot_row")


FANOUT_SQL = """
select case o_orderkey % 4 when 1 then 'update_vertex' when 3 then 'del_vertex' else 'add_vertex' end as op, 'orders' as label, o_orderkey as seq,
       0 as part, o_orderkey as oid, null::bigint as src, null::bigint as dst from orders
union all select 'del_edge', 'placed', o_orderkey, 2, null, o_custkey + (o_orderkey % 4 = 1)::int, o_orderkey from orders where o_orderkey % 4 in (1, 3)
union all select 'add_edge', 'placed', o_orderkey, 3, null, o_custkey, o_orderkey from orders where o_orderkey % 4 <> 3"""


@query(FANOUT_SQL)
def cdc_fanout(spark, sf_dir):
    return cdc.unified_log(cdc.parse_events(order_events(spark, sf_dir)), OPS).select("op", "label", "seq", "part", "oid", "src", "dst")


@query(f"select op, seq, src, dst from ({FANOUT_SQL}) where label = 'placed' and seq % 4 = 1")
def edge_update_split(spark, sf_dir):
    events = cdc.parse_events(order_events(spark, sf_dir)).filter("kind = 'update'")
    return cdc.unified_log(events, OPS).filter("label = 'placed'").select("op", "seq", "src", "dst")


@query("select event_id, (row_number() over (order by event_id) - 1) // 1000 as epoch from events")
def epoch_by_count(spark, sf_dir):
    return epochs.by_count(table(spark, sf_dir, "events"), 1000, "event_id").select("event_id", "epoch")


@query("select event_id, epoch_us(ts) // 3600000000 as epoch from events")
def epoch_by_time(spark, sf_dir):
    return epochs.by_time(table(spark, sf_dir, "events"), 3600).select("event_id", "epoch")


@query(
    """with recursive t as (select event_id // 7 as tx, count(*) as n, row_number() over (order by event_id // 7) as i from events group by 1),
    fold(i, tx, epoch, done) as (select i, tx, 0::bigint, n from t where i = 1
      union all select t.i, t.tx, case when done >= 500 then epoch + 1 else epoch end, case when done >= 500 then 0 else done end + n from fold join t on t.i = fold.i + 1)
    select event_id, epoch from events join fold on event_id // 7 = tx"""
)
def epoch_by_tx(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("tx", F.floor(F.col("event_id") / 7))
    return epochs.by_transaction(e, 500).select("event_id", "epoch")


# Versioned reads: users touch items; sign-ups add users, purchases update them, errors delete edges or (k a multiple of 17) users.

TOUCH = {"touch": ("user", "item")}
EPOCHS = 10
LOG_SQL = """
base as (select event_id as seq, ts, user_id, event_type, cast(props->>'$.k' as bigint) as k from events),
log as (
  select case when event_type = 'signup' then 'add_vertex' when event_type = 'purchase' then 'update_vertex' when event_type in ('click', 'view') then 'add_edge'
              when k % 17 = 0 then 'del_vertex' else 'del_edge' end as op,
         case when event_type in ('signup', 'purchase') or (event_type = 'error' and k % 17 = 0) then 'user' else 'touch' end as label,
         seq // ((select count(*) from events) // 10) as epoch, seq, ts,
         case when event_type in ('signup', 'purchase') or (event_type = 'error' and k % 17 = 0) then user_id end as oid,
         case when event_type in ('click', 'view') or (event_type = 'error' and k % 17 <> 0) then user_id end as src,
         case when event_type in ('click', 'view') or (event_type = 'error' and k % 17 <> 0) then k % 10 end as dst,
         cast(seq as varchar) as props
  from base)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    per_epoch = e.count() // EPOCHS
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.select(F.col("event_id").alias("seq"), "ts", "user_id", "event_type", k.alias("k"))
    kind, gone = F.col("event_type"), (F.col("event_type") == "error") & (F.col("k") % 17 == 0)
    vertex = kind.isin("signup", "purchase") | gone
    op = F.when(kind == "signup", L.ADD_VERTEX).when(kind == "purchase", L.UPDATE_VERTEX).when(kind.isin("click", "view"), L.ADD_EDGE).when(gone, L.DELETE_VERTEX).otherwise(L.DELETE_EDGE)
    return e.select(
        op.alias("op"), F.when(vertex, "user").otherwise("touch").alias("label"), F.floor(F.col("seq") / per_epoch).alias("epoch"), "seq", "ts",
        F.when(vertex, F.col("user_id")).alias("oid"), F.when(~vertex, F.col("user_id")).alias("src"), F.when(~vertex, F.col("k") % 10).alias("dst"),
        F.col("seq").cast("string").alias("props"),
    )


VERTEX_SQL = """
select label, oid, props, seq from (select *, row_number() over (partition by label, oid order by seq desc) as r from log
  where op in ('add_vertex', 'update_vertex', 'del_vertex') and epoch <= {e}) where r = 1 and op <> 'del_vertex'"""
ALIVE_SQL = """
select label, src, dst, props, seq from (
  select *, min(b) over (partition by label, src, dst order by seq rows between current row and unbounded following) as low from (
    select *, s - least(0, min(s) over (partition by label, src, dst order by seq)) as b from (
      select *, sum(case when op = 'add_edge' then 1 else -1 end) over (partition by label, src, dst order by seq) as s
      from log where op in ('add_edge', 'del_edge') and epoch <= {e}))) a
where op = 'add_edge' and low >= b"""
EDGE_SQL = ALIVE_SQL + """ and not exists (
  select 1 from log d where d.op = 'del_vertex' and d.label = 'user' and d.oid = a.src and d.seq > a.seq and d.epoch <= {e})"""


@query(f"with {LOG_SQL} {VERTEX_SQL.format(e=6)}")
def vertex_asof(spark, sf_dir):
    return L.vertex_asof(event_log(spark, sf_dir), 6)


@query(f"with {LOG_SQL} {EDGE_SQL.format(e=6)}")
def edge_asof_multigraph(spark, sf_dir):
    return L.edge_asof(event_log(spark, sf_dir), 6, TOUCH)


@query(f"with {LOG_SQL}, born as (select oid as who, min(seq) as b from log where op = 'add_vertex' group by oid) select op, src, dst, seq from log join born on src = who and b < seq where op in ('add_edge', 'del_edge')")
def unknown_endpoint_drop(spark, sf_dir):
    log = event_log(spark, sf_dir)
    items = spark.range(10).select(F.lit(L.ADD_VERTEX).alias("op"), F.lit("item").alias("label"), F.lit(-1).cast("long").alias("seq"), F.col("id").alias("oid"))
    return L.with_known_endpoints(log.unionByName(items, allowMissingColumns=True), TOUCH).filter("src is not null").select("op", "src", "dst", "seq")


@query(
    f"""with {LOG_SQL}, alive as (select label, src, dst, seq, props from ({ALIVE_SQL.format(e=9)}))
    select d.oid, count(*) as removed from log d join alive a on a.src = d.oid and a.seq < d.seq where d.op = 'del_vertex' group by d.oid"""
)
def cascade_delete(spark, sf_dir):
    """Edges that each vertex delete takes with it (an edge counts for every later delete of its source)."""
    log = event_log(spark, sf_dir)
    alive = L.edge_asof(log.filter(F.col("op") != L.DELETE_VERTEX), 9, TOUCH)
    gone = log.filter(F.col("op") == L.DELETE_VERTEX).select("oid", F.col("seq").alias("at"))
    return alive.join(gone, (alive["src"] == gone["oid"]) & (alive["seq"] < gone["at"])).groupBy("oid").agg(F.count(F.lit(1)).alias("removed"))


# The graph of each epoch, read anew: what is alive then, counted. No running sum of the operations.
VERSIONS_SQL = """
ends as (select epoch, max(ts) as end_ts from log group by epoch),
vstate as (select e.epoch, count(*) as n from ends e join (select distinct oid from log where op in ('add_vertex', 'update_vertex', 'del_vertex')) v on
  (select arg_max(op, seq) from log l where l.oid = v.oid and l.op in ('add_vertex', 'update_vertex', 'del_vertex') and l.epoch <= e.epoch) <> 'del_vertex' group by e.epoch),
versions as (select epoch, lag(end_ts) over (order by epoch) as begin_ts, end_ts, coalesce(n, 0) as n_vertices, lead(epoch) over (order by epoch) as next from ends left join vstate using (epoch))"""
EDGE_COUNTS = " union all ".join(f"select {e} as epoch, count(*) as n_edges from ({EDGE_SQL.format(e=e)})" for e in range(EPOCHS))


@query(f"with {LOG_SQL}, {VERSIONS_SQL} select epoch, begin_ts, end_ts, n_vertices, n_edges from versions join ({EDGE_COUNTS}) using (epoch) where next is not null")
def version_list(spark, sf_dir):
    return L.counted_versions(event_log(spark, sf_dir), TOUCH)


@query(f"with {LOG_SQL}, {VERSIONS_SQL} select epoch, end_ts from versions where next is not null and end_ts <= (select ts from events where event_id = (select count(*) from events) // 2) order by epoch desc limit 1")
def version_by_timestamp(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = e.filter(F.col("event_id") == e.count() // 2).first().ts
    return L.version_at(L.versions(event_log(spark, sf_dir)), F.lit(ts).cast("timestamp_ntz")).select("epoch", "end_ts")


@query(f"with {LOG_SQL}, {VERSIONS_SQL} select o.ts, (select max(epoch) from versions v where v.next is not null and v.end_ts <= o.ts) as epoch from events o")
def version_asof_join(spark, sf_dir):
    times = table(spark, sf_dir, "events").select("ts")
    return L.versions_at(L.versions(event_log(spark, sf_dir)), times)


@query(
    f"""with {LOG_SQL}, old as ({VERTEX_SQL.format(e=4)}), new as ({VERTEX_SQL.format(e=6)})
    select 'added' as change, oid, props from new where (oid, props) not in (select oid, props from old)
    union all select 'removed', oid, props from old where (oid, props) not in (select oid, props from new)"""
)
def epoch_diff(spark, sf_dir):
    log = event_log(spark, sf_dir)
    old, new = (L.vertex_asof(log, e).select("oid", "props") for e in (4, 6))
    return L.diff(old, new)


@query(f"with {LOG_SQL} {EDGE_SQL.format(e=8)}")
def compacted_read(spark, sf_dir):
    return L.edge_asof(L.compacted(event_log(spark, sf_dir).drop("ts"), 5, TOUCH), 8, TOUCH)


# Access.


@query("select 'customer' as label, o_custkey as oid, 'placed' as elabel, 'orders' as nbr_label, o_orderkey as nbr from orders")
def out_adjacency(spark, sf_dir):
    return tpch_graph(spark, sf_dir).adjacency("out", ["placed"])


@query("select 'part' as label, l_partkey as oid, 'contains' as elabel, 'orders' as nbr_label, l_orderkey as nbr from lineitem")
def in_adjacency(spark, sf_dir):
    return tpch_graph(spark, sf_dir).adjacency("in", ["contains"])


@query("select label, oid, count(*) as n from (select 'customer' as label, o_custkey as oid from orders union all select 'orders', o_orderkey from orders union all select 'orders', l_orderkey from lineitem union all select 'part', l_partkey from lineitem) group by all")
def both_adjacency(spark, sf_dir):
    return tpch_graph(spark, sf_dir).adjacency("both", ["placed", "contains"]).groupBy("label", "oid").agg(F.count(F.lit(1)).alias("n"))


DEGREES_SQL = f"""
with v as ({ORACLE_SQL['vertices_by_label']}), e as ({EDGES_SQL}),
t(elabel, s, d) as (values ('in_region', 'nation', 'region'), ('cust_nation', 'customer', 'nation'), ('supp_nation', 'supplier', 'nation'), ('placed', 'customer', 'orders'), ('contains', 'orders', 'part'), ('supplied_by', 'orders', 'supplier')),
o as (select s as label, src as oid, count(*) as n from e join t using (elabel) group by all), i as (select d as label, dst as oid, count(*) as n from e join t using (elabel) group by all)
select v.label, v.oid, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) as in_degree from v left join o using (label, oid) left join i using (label, oid)"""


@query(DEGREES_SQL)
def degree_in_out(spark, sf_dir):
    return tpch_graph(spark, sf_dir).degrees_of(out_degree="out", in_degree="in")


@query("select l_orderkey as oid, round(sum(l_quantity), 4) as weight from lineitem group by 1")
def weighted_degree(spark, sf_dir):
    return tpch_graph(spark, sf_dir).edges["contains"].groupBy(F.col("src").alias("oid")).agg(F.round(F.sum("quantity"), 4).alias("weight"))


@query("""with asked as (select c_custkey as u, o_orderkey as v, 'customer' as ul, 'orders' as vl from customer join orders on c_nationkey = o_orderkey % 25 and c_custkey = o_custkey
    union all select o_custkey, o_orderkey, 'customer', 'orders' from orders union all select o_custkey + 1, o_orderkey, 'customer', 'orders' from orders)
    select ul as src_label, u::varchar as src, vl as dst_label, v::varchar as dst, (u, v) in (select (o_custkey, o_orderkey) from orders) as present from (select distinct * from asked)""")
def has_edge_batch(spark, sf_dir):
    """Whether each customer, and the one numbered after, placed each order."""
    from relgraph.nxview import DiGraphView

    o = table(spark, sf_dir, "orders")
    asked = union([o.select(F.lit("customer").alias("src_label"), (F.col("o_custkey") + k).cast("string").alias("src"), F.lit("orders").alias("dst_label"), F.col("o_orderkey").cast("string").alias("dst")) for k in (0, 1)])
    return DiGraphView(tpch_graph(spark, sf_dir)).have_edges(asked)


# Orders contain parts, parts come from suppliers, suppliers ship orders: every row of lineitem, with cycles and triangles. Ids are real:
# a key times four, plus which table it is of.
ORDER, PART, SUPPLIER = 0, 1, 2
LINK_ENDS = (("l_orderkey", ORDER, "l_partkey", PART), ("l_partkey", PART, "l_suppkey", SUPPLIER), ("l_suppkey", SUPPLIER, "l_orderkey", ORDER))
LINKS_SQL = f"""
nodes as materialized (select o_orderkey::bigint * 4 + {ORDER} as id from orders union all select p_partkey::bigint * 4 + {PART} from part union all select s_suppkey::bigint * 4 + {SUPPLIER} from supplier),
edges as materialized ({" union all ".join(f"select {a}::bigint * 4 + {x} as src, {b}::bigint * 4 + {y} as dst, min(l_linenumber) as weight from lineitem group by 1, 2" for a, x, b, y in LINK_ENDS)}),
both_ways as materialized (select src, dst from edges where src <> dst union select dst, src from edges where src <> dst),
origin as (select min(id) as id from nodes where id % 4 = {ORDER})"""


def links(spark: SparkSession, sf_dir: str) -> SimpleGraph:
    """Orders, parts and suppliers by every row of lineitem, with whole-number weights; paths start at the smallest order."""
    keys = (("orders", "o_orderkey", ORDER), ("part", "p_partkey", PART), ("supplier", "s_suppkey", SUPPLIER))
    v = union([table(spark, sf_dir, t).select((F.col(k).cast("long") * 4 + n).alias("id")) for t, k, n in keys])
    li = table(spark, sf_dir, "lineitem")
    three = F.array(*[F.struct((F.col(a).cast("long") * 4 + x).alias("src"), (F.col(b).cast("long") * 4 + y).alias("dst")) for a, x, b, y in LINK_ENDS])
    # Dealt by source, which what follows joins on; the ends of a pair are of two tables, and no two tables are linked both ways.
    e = li.select(F.explode(three).alias("e"), "l_linenumber").select("e.*", "l_linenumber")
    e = dealt(e, "src").groupBy("src", "dst").agg(F.min("l_linenumber").alias("weight"))
    return SimpleGraph(v, e, extra={"source": table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0] * 4 + ORDER}, simple=True)


# The mapped tables as one graph without cycles, by ids over all labels.
LABELS = ("region", "nation", "customer", "supplier", "part", "orders")
WHOLE_ENDS = {"in_region": ("nation", "region"), "cust_nation": ("customer", "nation"), "supp_nation": ("supplier", "nation"), "placed": ("customer", "orders"), "contains": ("orders", "part"), "supplied_by": ("orders", "supplier")}
WHOLE_SQL = f"""
nodes as materialized (select oid + (case label {" ".join(f"when '{x}' then {i}" for i, x in enumerate(LABELS))} end::bigint << 56) as id, label, oid from ({ORACLE_SQL['vertices_by_label']})),
edges as materialized (select src + (case elabel {" ".join(f"when '{k}' then {LABELS.index(s)}" for k, (s, _) in WHOLE_ENDS.items())} end::bigint << 56) as src,
  dst + (case elabel {" ".join(f"when '{k}' then {LABELS.index(d)}" for k, (_, d) in WHOLE_ENDS.items())} end::bigint << 56) as dst from ({EDGES_SQL})),
origin as (select min(id) as id from nodes where label = 'customer')"""


def whole_graph(spark: SparkSession, sf_dir: str) -> SimpleGraph:
    """Every row of the mapped tables as a vertex or an edge, by ids over all labels. Paths start at the smallest customer."""
    g = tpch_graph(spark, sf_dir).flatten()
    return SimpleGraph(g.vertices, g.edges, extra={"source": g.vertices.filter("label = 'customer'").agg(F.min("id")).first()[0]})


@query("select 'sold_to' as elabel, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey = c_nationkey")
def self_loops(spark, sf_dir):
    """Sales within one nation, in the graph of nations that sell to nations."""
    from relgraph.operators.graph import EdgeType

    t = {x: table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier", "nation")}
    sold = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    e = sold.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
    return PropertyGraph({"nation": t["nation"].select(F.col("n_nationkey").alias("oid"))}, {"sold_to": e}, {"sold_to": EdgeType("sold_to", "nation", "nation")}).self_loops()


@query(f"with {LINKS_SQL} select src, array_to_string(list(dst || ':' || weight order by dst), ',') as nbrs from edges group by src")
def adj_map(spark, sf_dir, graph=links):
    from relgraph.nxview import DiGraphView

    g = graph(spark, sf_dir)
    adj = DiGraphView(link_property_graph(g)).adjacency()
    entries = F.array_sort(F.map_entries("adj"), lambda x, y: F.signum(x["key"]["oid"].cast("long") - y["key"]["oid"].cast("long")).cast("int"))
    return adj.select(F.col("oid").alias("src"), F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["key"]["oid"], F.get_json_object(x["value"], "$.weight"))), ",").alias("nbrs"))


@query("select 'orders' as src_label, l_orderkey::varchar as src, 'part' as dst_label, l_partkey::varchar as dst, max(cast(l_quantity as bigint)) as quantity from lineitem group by all")
def edge_data(spark, sf_dir):
    """The attributes that a mapping of edges keeps: of parallel edges those with the largest JSON."""
    from relgraph.nxview import DiGraphView

    g = tpch_graph(spark, sf_dir)
    e = g.edges["contains"].select("src", "dst", F.col("quantity").cast("long").alias("quantity"))
    # Zero-padded, so that the largest text is the largest number.
    e = e.withColumn("quantity", F.format_string("%012d", "quantity"))
    data = DiGraphView(PropertyGraph(g.vertices, {"contains": e}, {"contains": g.types["contains"]})).edge_data()
    return data.select("src_label", "src", "dst_label", "dst", F.get_json_object("data", "$.quantity").cast("long").alias("quantity"))


# Transformations.


@query("select o_orderkey as src, o_custkey as dst, o_totalprice as total from orders")
def reverse_graph(spark, sf_dir):
    return tpch_graph(spark, sf_dir).reverse().edges["placed"].select("src", "dst", "total")


@query(f"with {LINKS_SQL} select least(src, dst) as src, greatest(src, dst) as dst, count(*) as n, max(weight) as weight from edges group by 1, 2")
def to_undirected(spark, sf_dir, graph=links):
    return graph(spark, sf_dir).to_undirected()


@query(f"with {LINKS_SQL} select src, dst, weight from edges union all select dst, src, weight from edges")
def to_directed(spark, sf_dir, graph=links):
    g = graph(spark, sf_dir)
    return SimpleGraph(g.vertices, g.edges, undirected=True).directed()


@query("select o_custkey as src, o_orderkey as dst from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderkey % 2 = 0")
def node_subgraph(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    nodes = g.vertices["customer"].filter("segment = 'BUILDING'").select(F.lit("customer").alias("label"), "oid").unionByName(g.vertices["orders"].filter("oid % 2 = 0").select(F.lit("orders").alias("label"), "oid"))
    return g.induced(nodes).edges["placed"].select("src", "dst")


@query("select 'customer' as label, count(distinct o_custkey) as n from orders where o_totalprice > 200000 union all select 'orders', count(*) from orders where o_totalprice > 200000")
def edge_subgraph(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    sub = g.edge_subgraph({"placed": g.edges["placed"].filter("total > 200000")})
    return union([v.select(F.lit(k).alias("label")) for k, v in sub.vertices.items()]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey as id, c_acctbal as data from customer")
def project_simple(spark, sf_dir):
    return tpch_graph(spark, sf_dir).project_simple("customer", "cust_nation", "balance").vertices


@query("select 'customer' as label, c_custkey as oid, c_acctbal as balance, null::integer as size from customer union all select 'supplier', s_suppkey, s_acctbal, null from supplier union all select 'part', p_partkey, null, p_size from part")
def flatten_labels(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    g = g.project({"customer": ["balance"], "supplier": ["balance"], "part": ["size"]}, {})
    return g.flatten_properties().select("label", "oid", "balance", "size")


@query("select c_custkey as oid, c_name as name, o.n as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) o on c_custkey = o_custkey")
def add_column(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    n = g.edges["placed"].groupBy(F.col("src").alias("oid")).agg(F.count(F.lit(1)).alias("orders"))
    return g.add_column("customer", n, "orders").vertices["customer"].select("oid", "name", "orders")


@query(
    """with a as (select user_id as src, cast(props->>'$.k' as bigint) % 20 as dst, event_id from events where event_type in ('click', 'view'))
    select src, dst, max(event_id) as last, count(*) as merged from a group by all"""
)
def dynamic_add_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'view')")
    new = e.select(
        F.col("user_id").cast("string").alias("src"), (F.get_json_object("props", "$.k").cast("long") % 20).cast("string").alias("dst"),
        F.create_map(F.lit("last"), F.col("event_id").cast("string")).alias("attrs"), F.col("event_id").alias("seq"),
    )
    counted = new.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("merged"))
    g = dynamic.DynamicGraph.empty(spark).add_edges(new)
    return g.edges.join(counted, ["src", "dst"]).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("attrs")["last"].cast("long").alias("last"), "merged")


# Algorithms.


def steps(first: str, step: str, n: int) -> str:
    """CTEs s0..sn: ``step`` with {p} for the one before."""
    return ", ".join([f"s0 as ({first})", *[f"s{k} as ({step.format(p=f's{k - 1}')})" for k in range(1, n + 1)]])


@query(
    f"""with v as ({ORACLE_SQL['vertices_by_label']}), e0 as ({EDGES_SQL}),
    t(elabel, s, d) as (values ('in_region', 'nation', 'region'), ('cust_nation', 'customer', 'nation'), ('supp_nation', 'supplier', 'nation'), ('placed', 'customer', 'orders'), ('contains', 'orders', 'part'), ('supplied_by', 'orders', 'supplier')),
    e as (select s as sl, src, d as dl, dst from e0 join t using (elabel)),
    deg as (select sl as label, src as oid, count(*) as deg from e group by all), n as (select count(*) as n from v),
    {steps("select label, oid, 1.0::double / n as rank from v, n",
           '''select v.label, v.oid, 0.15 / n + 0.85 * held / n + 0.85 * coalesce(f.flow, 0) as rank from v cross join n
              cross join (select coalesce(sum(rank), 0) as held from {p} left join deg using (label, oid) where deg is null)
              left join (select dl as label, dst as oid, sum(rank / deg) as flow from e join {p} p on p.label = e.sl and p.oid = e.src join deg on deg.label = e.sl and deg.oid = e.src group by all) f using (label, oid)''', 5)}
    select label, oid, round(rank, 12) as rank from s5"""
)
def pagerank5(spark, sf_dir):
    g = tpch_graph(spark, sf_dir).flatten()
    return A.pagerank(g).join(g.vertices, "id").select("label", "oid", rounded("rank", 12))


BFS_SQL = f"with recursive {LINKS_SQL}, r(id, depth) as (select id, 0 from origin union select e.dst, r.depth + 1 from r join edges e on e.src = r.id where r.depth < 12)"


@query(f"{BFS_SQL} select id, min(depth)::double as distance from r group by id")
def sssp_unweighted(spark, sf_dir, graph=links):
    return A.sssp(g := graph(spark, sf_dir), g.extra["source"]).select("id", "distance")


@query(
    f"""with recursive {LINKS_SQL}, r(id, d) as (select id, 0::bigint from origin union select e.dst, r.d + e.weight from r join edges e on e.src = r.id where r.d < 25)
    select id, min(d)::double as distance from r group by id"""
)
def sssp_weighted(spark, sf_dir, graph=links):
    return A.sssp(g := graph(spark, sf_dir), g.extra["source"], "weight").select("id", "distance")


@query(f"with recursive {WHOLE_SQL}, r(id) as (select id from origin union select e.dst from r join edges e on e.src = r.id) select id as target, id in (select id from r) as reached from nodes")
def sssp_has_path(spark, sf_dir):
    """Whether each vertex is reached from the smallest customer."""
    g = whole_graph(spark, sf_dir)
    return A.reached(g, g.extra["source"], g.vertices)


@query(f"with recursive {WHOLE_SQL}, r(id) as (select id from origin union select e.dst from r join edges e on e.src = r.id), asked as (select min(id) as target from nodes group by label) select target, target in (select id from r) as reached from asked")
def has_path(spark, sf_dir):
    """The same of the smallest vertex of each label, by a search that ends where the last is found."""
    g = whole_graph(spark, sf_dir)
    asked = [r[0] for r in g.vertices.groupBy("label").agg(F.min("id")).select("min(id)").collect()]
    return spark.createDataFrame(list(A.has_paths(g, g.extra["source"], asked).items()), "target long, reached boolean")


@query(
    f"""{BFS_SQL}, b as (select id, min(depth) as depth from r group by id)
    select b.id, b.depth::bigint as depth, min(p.id) as pred from b left join edges e on e.dst = b.id left join b p on p.id = e.src and p.depth = b.depth - 1 group by all"""
)
def bfs_levels(spark, sf_dir, graph=links):
    return A.bfs(g := graph(spark, sf_dir), g.extra["source"])


LEAST_STEP = "select p.id, least(any_value(p.label), coalesce(min(q.label), any_value(p.label))) as label from {p} p left join both_ways b on b.dst = p.id left join {p} q on q.id = b.src group by p.id"


@query(f"with {LINKS_SQL}, {steps('select id, id as label from nodes', LEAST_STEP, 10).replace(' as (', ' as materialized (')} select id, label as component from s10")
def wcc(spark, sf_dir, graph=links):
    return A.wcc(graph(spark, sf_dir))


@query(
    f"""with {LINKS_SQL}, e as (select src, dst from edges where src <> dst union all select dst, src from edges where src <> dst),
    {steps("select id, id as label from nodes",
           '''select n.id, coalesce(b.label, p0.label) as label from nodes n join {p} p0 on p0.id = n.id left join (
              select id, label from (select id, label, row_number() over (partition by id order by n desc, label) as r from (
                select e.src as id, p.label, count(*) as n from e join {p} p on p.id = e.dst group by all)) where r = 1) b on b.id = n.id''', 4)}
    select id, label from s4"""
)
def cdlp(spark, sf_dir, graph=links):
    return A.cdlp(graph(spark, sf_dir), 4)


TRIANGLES_SQL = f"""with {LINKS_SQL}, u as (select src as a, dst as b from both_ways where src < dst),
tri as (select x.a, x.b, y.b as c from u x join u y on y.a = x.b join u z on z.a = x.a and z.b = y.b),
per as (select id, count(*) as t from (select a as id from tri union all select b from tri union all select c from tri) group by 1),
deg as (select src as id, count(*) as d from both_ways group by 1)"""


@query(f"{TRIANGLES_SQL} select n.id, coalesce(t, 0) as triangles from nodes n left join per using (id)")
def triangles(spark, sf_dir, graph=links):
    return A.triangles(graph(spark, sf_dir))


@query(f"{TRIANGLES_SQL} select n.id, round(case when d > 1 then 2 * coalesce(t, 0) / (d * (d - 1)) else 0 end, 9) as coefficient from nodes n left join per using (id) left join deg using (id)")
def clustering(spark, sf_dir, graph=links):
    return A.clustering(graph(spark, sf_dir)).select("id", rounded("coefficient"))


@query(
    f"""{TRIANGLES_SQL}, de as (select distinct src, dst from edges where src <> dst),
    c as (select x.src as id, count(*) as n from both_ways x join both_ways y on y.src = x.src join de on de.src = x.dst and de.dst = y.dst group by 1)
    select n.id, round(case when d > 1 then coalesce(c.n, 0) / (d * (d - 1)) else 0 end, 9) as coefficient from nodes n left join deg using (id) left join c using (id)"""
)
def lcc(spark, sf_dir, graph=links):
    return A.lcc(graph(spark, sf_dir)).select("id", rounded("coefficient"))


@query(f"{TRIANGLES_SQL} select round(avg(case when d > 1 then 2 * coalesce(t, 0) / (d * (d - 1)) else 0 end), 9) as value from nodes n left join per using (id) left join deg using (id)")
def avg_clustering(spark, sf_dir, graph=links):
    return A.average_clustering(graph(spark, sf_dir)).select(rounded("value"))


@query(f"{TRIANGLES_SQL} select round(3 * (select count(*) from tri) / (select sum(d * (d - 1) / 2) from deg), 9) as value")
def transitivity(spark, sf_dir, graph=links):
    return A.transitivity(graph(spark, sf_dir)).select(rounded("value"))


KCORE_STEP = "select src, dst from {p} where src in (select src from {p} group by src having count(*) >= 3) and dst in (select src from {p} group by src having count(*) >= 3)"


@query(f"with {LINKS_SQL}, {steps('select src, dst from both_ways', KCORE_STEP, 12).replace(' as (', ' as materialized (')} select distinct src as id from s12")
def kcore(spark, sf_dir, graph=links):
    return A.kcore(graph(spark, sf_dir), 3)


HITS_STEP = """select n.id, coalesce(h.h, 0) / mh as hub, coalesce(x.a, 0) / ma as authority from nodes n
  left join (select dst as id, sum(hub) as a from edges e join {p} on id = src group by 1) x using (id)
  left join (select src as id, sum(a) as h from edges e join (select dst as id, sum(hub) as a from edges e join {p} on id = src group by 1) y on y.id = e.dst group by 1) h using (id)
  cross join (select max(a) as ma from (select sum(hub) as a from edges e join {p} on id = src group by dst))
  cross join (select max(h) as mh from (select sum(a) as h from edges e join (select dst as id, sum(hub) as a from edges e join {p} on id = src group by 1) y on y.id = e.dst group by e.src))"""


@query(f"with {LINKS_SQL}, {steps(f'select id, 1.0::double / (select count(*) from nodes) as hub, 0.0::double as authority from nodes', HITS_STEP, 4).replace(' as (', ' as materialized (')} select id, round(hub / (select sum(hub) from s4), 9) as hub, round(authority / (select sum(authority) from s4), 9) as authority from s4")
def hits(spark, sf_dir, graph=links):
    return A.hits(graph(spark, sf_dir), tolerance=0.0, max_rounds=4).select("id", rounded("hub"), rounded("authority"))


@query(f"with {LINKS_SQL}, d as (select id, count(*) as d from (select src as id from edges union all select dst from edges) group by 1) select n.id, round(coalesce(d, 0) / ((select count(*) from nodes) - 1)::double, 12) as centrality from nodes n left join d using (id)")
def degree_centrality(spark, sf_dir, graph=links):
    return A.degree_centrality(graph(spark, sf_dir)).select("id", rounded("centrality", 12))


def power_sql(alpha: str, beta: str, keep: str, start: str, norm: bool) -> str:
    step = f"""select n.id, ({keep} + {alpha} * coalesce(f, 0) + {beta}) as x from nodes n join {{p}} p using (id)
      left join (select dst as id, sum(x) as f from edges e join {{p}} on id = src group by 1) f using (id)"""
    if norm:
        step = f"select id, x / (select sqrt(sum(x * x)) from ({step})) as x from ({step})"
    return f"with {LINKS_SQL}, {steps(f'select id, {start} as x from nodes', step, 4).replace(' as (', ' as materialized (')}"


@query(f"{power_sql('0.1', '1.0', '0', '0.0::double', False)} select id, round(x / (select sqrt(sum(x * x)) from s4), 9) as centrality from s4")
def katz(spark, sf_dir, graph=links):
    return A.katz(graph(spark, sf_dir), tolerance=0.0, max_rounds=4).select("id", rounded("centrality"))


@query(f"{power_sql('1.0', '0.0', 'p.x', '1.0::double / (select count(*) from nodes)', True)} select id, round(x, 9) as centrality from s4")
def eigenvector(spark, sf_dir, graph=links):
    return A.eigenvector(graph(spark, sf_dir), tolerance=0.0, max_rounds=4).select("id", rounded("centrality"))


@query()
def voterank(spark, sf_dir):
    return A.voterank(links(spark, sf_dir), 5)


@query()
def sampling_path(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    return A.sampled_paths([g.edges["placed"], g.edges["contains"]], g.vertices["customer"].select(F.col("oid").alias("id")), 1).select(F.to_json("path").alias("path"))


MOST_STEP = "select p.id, greatest(any_value(p.value), coalesce(max(q.value), any_value(p.value))) as value from {p} p left join edges e on e.dst = p.id left join {p} q on q.id = e.src group by p.id"


@query(f"with {LINKS_SQL}, {steps('select id, id as value from nodes', MOST_STEP, 10).replace(' as (', ' as materialized (')} select id, value from s10")
def pregel_max_value(spark, sf_dir, graph=links):
    """The largest id from which a vertex can be reached, itself included."""
    program = Pregel(
        graph(spark, sf_dir),
        init={"value": F.col("id")},
        send=lambda p: F.col("value"),
        combine=F.max,
        compute=lambda p: {"value": F.greatest("value", "msg")},
        halt=lambda p: F.col("value") == F.col("old_value"),
    )
    return program.run()


@query(f"with {LINKS_SQL}, i as (select dst as id, sum(src) as s from edges group by 1) select n.id, coalesce(s, 0)::bigint as value, (select sum(id) from nodes)::bigint as total from nodes n left join i using (id)")
def pregel_aggregator_sum(spark, sf_dir, graph=links):
    """Each vertex's sum of in-neighbour ids, and the global sum of all ids from the superstep before."""
    program = Pregel(
        graph(spark, sf_dir),
        init={"value": F.col("id"), "total": F.lit(0).cast("long")},
        send=lambda p: F.col("value"),
        combine=F.sum,
        compute=lambda p: {"value": F.coalesce("msg", F.lit(0)), "total": p.agg("all").cast("long")},
        aggregators={"all": ("sum", F.col("value"))},
    )
    return program.run(1)


# Traversals.


@query("select o_custkey as customer, l_partkey as oid, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by all")
def two_hop(spark, sf_dir):
    t = Traversal.of(tpch_graph(spark, sf_dir), "customer").as_("c").out("placed").out("contains")
    return t.df.groupBy(F.col("t_c.oid").cast("long").alias("customer"), F.col("oid").cast("long").alias("oid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {WHOLE_SQL}, h2 as (select a.src, b.dst from edges a join edges b on b.src = a.dst), h3 as (select a.src, b.dst from h2 a join edges b on b.src = a.dst) select dst as oid, count(*) as n from (select * from h2 union all select * from h3) group by 1")
def khop_range(spark, sf_dir):
    t = Traversal.of(link_property_graph(whole_graph(spark, sf_dir))).out("link", times=(2, 4))
    return t.group_count().select(F.col("oid").cast("long").alias("oid"), "n")


def link_property_graph(g: SimpleGraph) -> PropertyGraph:
    from relgraph.operators.graph import EdgeType

    return PropertyGraph({"node": g.vertices.select(F.col("id").alias("oid"))}, {"link": g.edges}, {"link": EdgeType("link", "node", "node")})


@query(
    f"""with {WHOLE_SQL}, p as (select a.src as v0, a.dst as v1, b.dst as v2, c.dst as v3 from edges a join edges b on b.src = a.dst join edges c on c.src = b.dst)
    select v0, v3, count(*) as n from p where v0 <> v1 and v0 <> v2 and v0 <> v3 and v1 <> v2 and v1 <> v3 and v2 <> v3 group by all"""
)
def simple_path(spark, sf_dir):
    t = Traversal.of(link_property_graph(whole_graph(spark, sf_dir))).as_("a").simple_paths().out("link", times=(3, 4))
    return t.df.groupBy(F.col("t_a.oid").cast("long").alias("v0"), F.col("oid").cast("long").alias("v3")).agg(F.count(F.lit(1)).alias("n"))


RECURSIVE_SQL = """{r} walk(id, path, depth) as (select cast({first} as bigint), {start}, 0 union all
  select e.dst, {append}, depth + 1 from walk join edges e on e.src = walk.id where depth < 4 and not {has})
select id, min(depth) as depth, count(*) as n from walk group by id"""


@query("with recursive " + WHOLE_SQL + ", " + RECURSIVE_SQL.format(r="", first="(select id from origin)", start="[(select id from origin)]", append="list_append(path, e.dst)", has="list_contains(path, e.dst)"))
def recursive_path(spark, sf_dir):
    """Paths without a repeated vertex, up to four hops from one customer, by a recursive query of this engine."""
    g = whole_graph(spark, sf_dir)
    source = g.extra["source"]
    sql = RECURSIVE_SQL.format(r="with recursive edges as (select * from {links}),", first=source, start=f"array(cast({source} as bigint))", append="array_append(path, e.dst)", has="array_contains(path, e.dst)")
    return spark.sql(sql, links=A.edges_near(g, source, 4))


@query("select o_custkey as oid, count(distinct l_partkey) as n from orders join lineitem on o_orderkey = l_orderkey group by 1")
def group_count_dedup(spark, sf_dir):
    t = Traversal.of(tpch_graph(spark, sf_dir), "customer").as_("c").out("placed").out("contains")
    return t.group_count("c", distinct=True).select(F.col("oid").cast("long").alias("oid"), "n")


@query("select l_partkey as oid, count(*) as n from lineitem group by 1 order by n desc, oid limit 20")
def order_topk(spark, sf_dir):
    t = Traversal.of(tpch_graph(spark, sf_dir), "orders").out("contains").group_count()
    return t.select(F.col("oid").cast("long").alias("oid"), "n").orderBy(F.desc("n"), "oid").limit(20)


@query(
    """select oid, sum(s)::bigint as score from (select s_suppkey as oid, 1 as s from supplier where s_nationkey = 3
    union all select l_suppkey, 2 from lineitem) group by oid"""
)
def union_score(spark, sf_dir):
    """Suppliers of one nation score 1, and 2 for each line that they supply: the bag of two continuations."""
    start = Traversal.of(tpch_graph(spark, sf_dir), "nation", "orders").tagged("s", F.when(F.col("label") == "nation", 1).otherwise(2))
    both = start.union(lambda t: t.where((F.col("label") == "nation") & (F.col("oid") == 3)).in_("supp_nation"), lambda t: t.where(F.col("label") == "orders").out("supplied_by"))
    return both.df.groupBy(F.col("oid").cast("long").alias("oid")).agg(F.sum("s").cast("long").alias("score"))


@query(
    """select c_custkey as oid, count(distinct o_orderkey) as n from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey
    join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where n_nationkey = 5 and p_size < 10 group by 1 order by n desc, oid limit 20"""
)
def bi3_like(spark, sf_dir):
    t = Traversal.of(tpch_graph(spark, sf_dir), "nation").where(F.col("oid") == "5").in_("cust_nation").as_("c").out("placed").as_("o").out("contains").has("part", "size", lambda c: c < 10)
    n = t.df.groupBy(F.col("t_c.oid").cast("long").alias("oid")).agg(F.count_distinct("t_o").alias("n"))
    return n.orderBy(F.desc("n"), "oid").limit(20)


@query(
    """with o as (select o_custkey as c, count(*) as orders from orders group by 1),
    l as (select o_custkey as c, count(*) as items from orders join lineitem on l_orderkey = o_orderkey group by 1)
    select c as oid, orders, coalesce(items, 0) as items, orders + 2 * coalesce(items, 0) as score from o left join l using (c) order by score desc, oid limit 100"""
)
def bi5_like(spark, sf_dir):
    t = Traversal.of(tpch_graph(spark, sf_dir), "customer").as_("c").out("placed")
    orders = t.group_count("c").select(F.col("oid").cast("long").alias("oid"), F.col("n").alias("orders"))
    items = t.out("contains").group_count("c").select(F.col("oid").cast("long").alias("oid"), F.col("n").alias("items"))
    both = orders.join(items, "oid", "left").select("oid", "orders", F.coalesce("items", F.lit(0)).alias("items"))
    return both.withColumn("score", F.col("orders") + 2 * F.col("items")).orderBy(F.desc("score"), "oid").limit(100)


@query(
    """select s.s_suppkey as oid, count(distinct c.o_custkey) as n from supplier s join lineitem l on l.l_suppkey = s.s_suppkey join orders c on c.o_orderkey = l.l_orderkey
    where s.s_nationkey in (1, 2) group by 1 order by n desc, oid limit 50"""
)
def bi6_like(spark, sf_dir):
    t = Traversal.of(tpch_graph(spark, sf_dir), "nation").where(F.col("oid").isin("1", "2")).in_("supp_nation").as_("s").in_("supplied_by").in_("placed")
    return t.group_count("s", distinct=True).select(F.col("oid").cast("long").alias("oid"), "n").orderBy(F.desc("n"), "oid").limit(50)


@query(
    """with p as (select c.c_custkey as a, s.s_suppkey as b, count(*) as n from customer c join orders o on o.o_custkey = c.c_custkey join lineitem l on l.l_orderkey = o.o_orderkey
       join supplier s on s.s_suppkey = l.l_suppkey where c.c_nationkey = 7 and s.s_nationkey = 8 group by all)
    select a, b, n, n * 4 + 10 as score from p order by score desc, a, b limit 30"""
)
def bi14_like(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    t = Traversal.of(g, "nation").where(F.col("oid") == "7").in_("cust_nation").as_("a").out("placed").out("supplied_by").as_("b").out("supp_nation").where(F.col("oid") == "8")
    n = t.df.groupBy(F.col("t_a.oid").cast("long").alias("a"), F.col("t_b.oid").cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("score", F.col("n") * 4 + 10).orderBy(F.desc("score"), "a", "b").limit(30)


@query(f"with {LINKS_SQL} select a.src as v0, a.dst as v1, b.dst as v2 from edges a join edges b on b.src = a.dst join edges c on c.src = b.dst and c.dst = a.src where a.src < a.dst and a.src < b.dst and a.dst <> b.dst")
def cycle_detect(spark, sf_dir, graph=links):
    """Directed cycles of three, each from its smallest vertex."""
    g = graph(spark, sf_dir)
    e = g.edges.select("src", "dst").filter("src != dst")
    a, b, c = (e.toDF(f"{x}s", f"{x}d") for x in "abc")
    three = a.filter("as < ad").join(b, F.col("ad") == F.col("bs")).filter("as < bd").join(c, (F.col("bd") == F.col("cs")) & (F.col("cd") == F.col("as")))
    return three.select(F.col("as").alias("v0"), F.col("ad").alias("v1"), F.col("bd").alias("v2"))


# Results.


@query("select c_custkey as node, c_acctbal as money from customer where c_custkey >= 100 and c_custkey < 500")
def selector_vertex_range(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    return selectors.select(g, None, {"node": "v:customer.id", "money": "v:customer.balance"}, (100, 500))


@query("select l_orderkey as s, l_partkey as d, l_quantity as q from lineitem")
def selector_labeled(spark, sf_dir):
    return selectors.select(tpch_graph(spark, sf_dir), None, {"s": "e:contains.src", "d": "e:contains.dst", "q": "e:contains.quantity"})


@query(f"{BFS_SQL} select '{{\"label_id\":0,\"oid\":' || id || ',\"distance\":' || min(depth) || '}}' as json from r group by id")
def json_output(spark, sf_dir, graph=links):
    d = A.bfs(g := graph(spark, sf_dir), g.extra["source"]).select(F.lit(0).alias("label_id"), F.col("id").alias("oid"), F.col("depth").alias("distance"))
    return tables.json_rows(d, "label_id", "oid", "distance")


# More of the same.


VALIDITY_SQL = """v as (select *, lead(epoch) over (partition by label, oid order by epoch) as until_epoch from (
  select * from (select *, row_number() over (partition by label, oid, epoch order by seq desc) as r from log where op in ('add_vertex', 'update_vertex', 'del_vertex')) where r = 1))"""


@query(f"with {LOG_SQL}, {VALIDITY_SQL} select label, oid, props, epoch as from_epoch, until_epoch from v where op <> 'del_vertex'")
def vertex_validity(spark, sf_dir):
    return L.vertex_validity(event_log(spark, sf_dir))


@query(
    f"""with {LOG_SQL}, {VALIDITY_SQL} select s.seq, s.src as oid, v.props from log s join v on v.op <> 'del_vertex' and v.oid = s.src and s.epoch >= v.epoch and (v.until_epoch is null or s.epoch < v.until_epoch)
    where s.op = 'add_edge'"""
)
def interval_join(spark, sf_dir):
    """Each added edge with the state of its source in its epoch."""
    log = event_log(spark, sf_dir)
    times = log.filter(F.col("op") == L.ADD_EDGE).select("seq", F.lit("user").alias("label"), F.col("src").alias("oid"), "epoch")
    return L.valid_at(L.vertex_validity(log), times).select("seq", "oid", "props")


@query(f"with {LINKS_SQL}, {steps('select src, dst from both_ways', KCORE_STEP.replace('>= 3', '>= 2'), 25).replace(' as (', ' as materialized (')} select distinct src as id from s25")
def core_two(spark, sf_dir, graph=links):
    return A.kcore(graph(spark, sf_dir), 2)


@query(f"{BFS_SQL}, b as (select id, min(depth) as depth from r group by id) select min(p.id) as src, b.id as dst from b join edges e on e.dst = b.id join b p on p.id = e.src and p.depth = b.depth - 1 group by b.id")
def shortest_path_tree(spark, sf_dir, graph=links):
    return A.path_edges(g := graph(spark, sf_dir), g.extra["source"])


@query(f"with recursive {WHOLE_SQL}, r(s, id, depth) as (select id, id, 0 from nodes union select r.s, e.dst, r.depth + 1 from r join edges e on e.src = r.id where r.depth < 3) select s as source, id, min(depth)::bigint as distance from r group by all")
def distances_within_three(spark, sf_dir):
    return A.all_distances(whole_graph(spark, sf_dir), 3)


@query(f"with recursive {WHOLE_SQL}, r(s, id, depth) as (select id, id, 0 from nodes union select r.s, e.dst, r.depth + 1 from r join edges e on e.src = r.id), d as (select s, id, min(depth) as d from r group by all) select round(sum(d) / ((select count(*) from nodes) * ((select count(*) from nodes) - 1)::double), 12) as value from d")
def average_length(spark, sf_dir):
    return spark.createDataFrame([(round(A.average_length(whole_graph(spark, sf_dir)), 12),)], "value double")


@query()
def kshell(spark, sf_dir):
    return A.kshell(links(spark, sf_dir), 4)


@query(f"with {LINKS_SQL}, n as (select dst as id, count(*) as n from edges where dst % 4 = {PART} group by 1), f as (select e.dst as id, o_orderstatus as label, count(*) as k from edges e join orders on e.src = o_orderkey * 4 group by all) select f.id, f.label, round(k / n.n, 9) as share from f join n using (id)")
def label_propagation(spark, sf_dir):
    """What orders of each status share of the parts in them."""
    g = links(spark, sf_dir)
    seeds = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("long") * 4 + ORDER).alias("id"), F.col("o_orderstatus").alias("label"))
    out = A.propagate_labels(g, seeds, 1).join(seeds, "id", "left_anti")
    return out.select("id", F.explode("labels").alias("label", "share")).select("id", "label", rounded("share"))


@query("select 'customer' as label, c_custkey::varchar as oid, coalesce(c_mktsegment, 'none') as segment from customer union all select 'supplier', s_suppkey::varchar, 'none' from supplier")
def nx_nodes_data(spark, sf_dir):
    from relgraph.nxview import DiGraphView

    g = tpch_graph(spark, sf_dir).project({"customer": ["segment"], "supplier": []}, {})
    return DiGraphView(g).nodes("segment", "none")


@query("select 'customer' as src_label, o_custkey::varchar as src, 'orders' as dst_label, o_orderkey::varchar as dst, cast(o_totalprice as bigint)::varchar as total from orders where o_custkey between 1 and 20")
def nx_out_edges(spark, sf_dir):
    from relgraph.nxview import DiGraphView

    g = tpch_graph(spark, sf_dir)
    g = PropertyGraph(g.vertices, {"placed": g.edges["placed"].withColumn("total", F.rint("total").cast("long"))}, {"placed": g.types["placed"]})
    some = spark.range(1, 21).select(F.lit("customer").alias("label"), F.col("id").cast("string").alias("oid"))
    return DiGraphView(g).out_edges(some, "total")


@query(f"with {LINKS_SQL}, e as (select src as id, weight from edges union all select dst, weight from edges) select 'node' as label, n.id::varchar as oid, coalesce(sum(weight), 0)::double as degree from nodes n left join e using (id) group by n.id")
def nx_weighted_degree(spark, sf_dir, graph=links):
    from relgraph.nxview import DiGraphView

    return DiGraphView(link_property_graph(graph(spark, sf_dir))).degree("both", "weight")


UNDIRECTED_SQL = f"""with recursive {WHOLE_SQL}, u as (select src, dst from edges union all select dst, src from edges),
walk(id, path, depth) as (select id, [id], 0 from origin union all select u.dst, list_append(path, u.dst), depth + 1 from walk join u on u.src = walk.id where depth < 4 and not list_contains(path, u.dst))"""


@query(f"{UNDIRECTED_SQL} select id as oid, depth as hops, count(*) as n from walk where depth >= 1 group by all")
def undirected_paths(spark, sf_dir):
    """Simple paths of one to four undirected hops from one customer, by end and length."""
    g = whole_graph(spark, sf_dir)
    near = SimpleGraph(g.vertices, A.edges_near(g, g.extra["source"], 4, both=True))
    t = Traversal.of(link_property_graph(near)).where(F.col("oid") == g.extra["source"]).simple_paths().both("link", times=(1, 5))
    return t.df.groupBy(F.col("oid").cast("long").alias("oid"), (F.size("path") - 1).alias("hops")).agg(F.count(F.lit(1)).alias("n"))


@query("select 'region' as label, r_regionkey::bigint << 0 as oid, r_regionkey::bigint as id from region union all select 'nation', n_nationkey, n_nationkey + (1::bigint << 56) from nation union all select 'supplier', s_suppkey, s_suppkey + (3::bigint << 56) from supplier")
def global_ids(spark, sf_dir):
    return tpch_graph(spark, sf_dir).flatten(["region", "nation", "supplier"], ["in_region"]).vertices.select("label", "oid", "id")


@query(f"with recursive {LINKS_SQL}, r(id, d) as (select id, 0 from origin union select e.dst, r.d + 1 from r join edges e on e.src = r.id where r.d < 12) select id, min(d)::bigint as d from r group by id")
def pie_distances(spark, sf_dir, graph=links):
    from relgraph.functions.pie import messages, run_pie

    far = 1 << 40
    g0 = graph(spark, sf_dir)
    source = g0.extra["source"]

    def first(g):
        return g.vertices.select("id", F.when(F.col("id") == source, 0).otherwise(far).cast("long").alias("d"), (F.col("id") == source).alias("changed"))

    def next_(g, state, changed):
        inbox = messages(g, changed, "d", F.col("d") + 1, F.min)
        return state.drop("changed").join(inbox, "id", "left").select("id", F.least("d", "msg").alias("d"), F.coalesce(F.col("msg") < F.col("d"), F.lit(False)).alias("changed"))

    return run_pie(g0, first, next_).filter(F.col("d") < far)
