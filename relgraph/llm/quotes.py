"""Quotation linking: from messages that quote one another to conversations without quotes.

Quoted blocks (lines that begin with ``>``, and the attribution line before them) are cut
from each message. Their lines are parsed into nested levels; runs of one level are
passages, which are normalised and hashed. A passage links to the latest earlier message
of the conversation that says the same, as a whole, a paragraph, a line, or consecutive
lines or paragraphs. Messages then stand in reply order: each after the message that it
answers, and before what was said later to that message's predecessors. All of it is
DataFrame expressions; what must follow an order within a conversation goes by ranges of
places and what the ranges before leave, so a conversation of a third of all rows is the
work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ascii_lower, done_with, materialise, table, text_or_empty

MARK = r"[ ]{0,3}>[^\n]*"
#: Contiguous quoted lines, with an attribution line that may precede them. Possessive: no backtracking, so no deep stack on long quotes.
BLOCK = rf"(?:^|\n)(?:On [^\n]{{1,200}} wrote:[ ]*\n)?({MARK}(?:\n{MARK})*+)"
#: Places in a range: even a conversation of a third of all rows is ordered by many tasks.
BUCKET = 1024
#: What excerpts are made of, by the pattern between.
UNITS = {"lines": r"\n", "paragraphs": r"\n[ \t\r]*\n"}


def own_text(text: Column) -> Column:
    """A message without its quoted blocks, trimmed."""
    return F.btrim(F.regexp_replace(text, BLOCK, "\n"), F.lit(" \t\r\n"))


def normalised(text: Column) -> Column:
    return F.trim(ascii_lower(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def message_keys() -> tuple[Column, Column]:
    """A digest of (role, text), which orders the messages of one turn, and one of the whole message; nulls count."""
    said = F.md5(F.concat(F.coalesce("role", F.lit("\1")), F.lit("\2"), "text"))
    return said, F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("\1")), F.lit("\2"), F.coalesce(F.col("turn").cast("string"), F.lit("\1")), F.lit("\2"), said))


def same(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """a joined with b on columns, null meeting null; b has each combination once."""
    other = b.withColumnsRenamed({c: f"__{c}" for c in columns})
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(other, on).drop(*[f"__{c}" for c in columns])


def running(df: DataFrame, keys: list[str], order: str, bucket: Column, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of its keys before each, by order; bucket is a range of order."""
    df = df.withColumn("__b", bucket)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__s")).select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inner = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = same(df.withColumn("__i", F.coalesce(F.sum(value).over(inner), F.lit(0))), sums, *keys, "__b")
    return out.withColumn(name, F.col("__i") + F.col("__o")).drop("__b", "__i", "__o")


def latest(queries: DataFrame, values: DataFrame, keys: list[str], at: str, strict: bool) -> DataFrame:
    """As-of join without pairs: queries with the ``value`` of the last row of values at or (strict) before their place ``at``."""
    rest = [c for c in queries.columns if c not in (*keys, at)]
    both = queries.withColumn("__q", F.struct(*[F.col(c) for c in rest] or [F.lit(0)])).select(*keys, at, "__q").unionByName(values.select(*keys, at, "value"), allowMissingColumns=True)
    both = both.withColumns({"__b": F.floor(F.col(at) / BUCKET), "__k": (F.col("__q").isNull() == F.lit(strict)).cast("int")})
    ends = both.filter("__q is null").groupBy(*keys, "__b").agg(F.max_by("value", at).alias("__e"))
    ends = ends.unionByName(both.filter("__q is not null").select(*keys, "__b").distinct(), allowMissingColumns=True).groupBy(*keys, "__b").agg(F.first("__e", ignorenulls=True).alias("__e"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    left = ends.select(*keys, "__b", F.last("__e", ignorenulls=True).over(before).alias("__l"))
    inner = Window.partitionBy(*keys, "__b").orderBy(at, "__k").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__v", F.last("value", ignorenulls=True).over(inner)).filter("__q is not null")
    out = same(seen.drop("value"), left, *keys, "__b")
    return out.select(*keys, at, *[F.col(f"__q.{c}").alias(c) for c in rest], F.coalesce("__v", "__l").alias("value"))


def units(text: str, by: str) -> Column:
    """The lines or paragraphs of a text, normalised, without empty ones."""
    return F.filter(F.transform(F.split(text, UNITS[by]), normalised), lambda x: x != "")


def passages(messages: DataFrame) -> DataFrame:
    """(__m, conv_id, turn, level, key, lines, paragraphs): the quoted passages of messages, one row each."""
    lines = (
        messages.filter(F.col("text").rlike(BLOCK))
        .select("__m", "conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(BLOCK), F.lit(1))).alias("b", "block"))
        .select("__m", "conv_id", "turn", "b", F.posexplode(F.split("block", "\n")).alias("l", "line"))
        .withColumn("marks", F.regexp_extract("line", r"^[ ]{0,3}((?:>[ ]?)++)", 1))
        .withColumn("level", F.length(F.regexp_replace("marks", "[^>]", "")))
        .withColumn("said", F.regexp_replace("line", r"^[ ]{0,3}(?:>[ ]?)++", ""))
    )
    block = Window.partitionBy("__m", "b").orderBy("l")
    new = (F.coalesce(F.lag("level").over(block), F.lit(0)) != F.col("level")).cast("int")
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(block.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("__m", "conv_id", "turn", "b", "run", "level").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "said"))), lambda x: x["said"]), "\n").alias("said")
    )
    out = whole.select("__m", "conv_id", "turn", "level", normalised(F.col("said")).alias("said"), *[units("said", by).alias(by) for by in UNITS])
    return out.filter("said != ''").select("__m", "conv_id", "turn", "level", F.md5("said").alias("key"), *UNITS)


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, __r, n, key): what each message itself says: whole, by paragraph and by line."""
    pieces = F.array_union(
        F.array(F.col("own")), F.array_union(F.split("own", r"\n[ \t\r]*\n"), F.split("own", "\n"))
    )
    said = messages.select("conv_id", "turn", "__r", "n", F.explode(pieces).alias("said")).withColumn("said", normalised(F.col("said")))
    return said.filter("said != ''").select("conv_id", "turn", "__r", "n", F.md5("said").alias("key")).distinct()


def excerpts(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, __r, n, key): runs of consecutive lines or paragraphs of messages that begin like a passage and are as long.

    A message's runs are keyed once for each length that passages with that beginning have, however many these are."""
    out = []
    for by in UNITS:
        asked = quoted.filter(F.size(by) > 1).select("conv_id", F.md5(F.element_at(by, 1)).alias("first"), F.size(by).alias("len")).distinct()
        own = messages.select("conv_id", "turn", "__r", "n", "__m", units("own", by).alias("units"))
        own = own.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
        begins = own.select("conv_id", "__m", F.size("units").alias("size"), F.posexplode("units").alias("at", "unit")).withColumn("first", F.md5("unit")).drop("unit")
        found = begins.join(asked, ["conv_id", "first"]).filter("at + len <= size").groupBy("__m").agg(F.collect_list(F.struct("at", "len")).alias("runs"))
        text = F.transform("runs", lambda r: F.md5(F.array_join(F.slice("units", r["at"] + 1, r["len"]), " ")))
        out.append(own.join(found, "__m").select("conv_id", "turn", "__r", "n", F.explode(text).alias("key")))
    return out[0].unionByName(out[1])


def ranked(messages: DataFrame) -> DataFrame:
    """messages with __r, how many come before by turn, then digest; nulls first."""
    base = messages.select("conv_id", "turn", "__k", "n")
    turns = base.groupBy("conv_id", "turn").agg(F.sum("n").alias("n"))
    turns = running(turns, ["conv_id"], "turn", F.floor(F.col("turn") / BUCKET), "n", "t").drop("n")
    own = running(base, ["conv_id", "turn"], "__k", F.substring("__k", 1, 2), "n", "i").drop("n")
    places = same(own, turns, "conv_id", "turn").select("conv_id", "turn", "__k", (F.col("i") + F.col("t")).cast("long").alias("__r"))
    return same(messages, places, "conv_id", "turn", "__k")


def segment_places(jumps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, at, start, place): each run of messages that follow one another, from ``at`` on, with its first place in reply order.

    jumps (conv_id, at, parent) are the messages that answer another than the one before, by rank; sizes (conv_id, total).
    Runs are the nodes of a tree; its preorder is a linked list of their beginnings and ends, ranked by pointer doubling:
    as many rounds as the logarithm of the runs of the longest conversation."""
    starts = jumps.select("conv_id", "at").unionByName(jumps.select("conv_id", F.lit(0).cast("long").alias("at")).distinct())
    starts = materialise(starts.withColumn("value", F.col("at")), "starts")
    back = lambda df, *c: df.withColumn("at", -F.col("at")).select(*c)
    after = latest(back(starts.select("conv_id", "at", F.col("at").alias("start")), "conv_id", "at", "start"), back(starts, "conv_id", "at", "value"), ["conv_id"], "at", True)
    runs = after.join(sizes, "conv_id").select("conv_id", "start", (F.coalesce("value", "total") - F.col("start")).alias("size"))
    tree = latest(jumps.select("conv_id", F.col("parent").alias("at"), F.col("at").alias("start")), starts, ["conv_id"], "at", False)
    tree = materialise(tree.select("conv_id", "start", F.col("at").alias("parent"), F.col("value").alias("above")), "tree")
    # The run that hangs lowest comes first; of those at one message, the earliest.
    child = tree.groupBy("conv_id", "above").agg(F.max(F.struct("parent", (-F.col("start")).alias("s"))).alias("x")).select("conv_id", F.col("above").alias("start"), (-F.col("x.s")).alias("child"))
    alike = tree.select("conv_id", "parent", (-F.col("start")).alias("at"), "start", "above")
    sibling = latest(alike, alike.select("conv_id", "parent", "at", F.col("start").alias("value")), ["conv_id", "parent"], "at", True).withColumnRenamed("value", "next")
    hooks = tree.groupBy("conv_id", "above", F.col("parent").alias("at")).agg(F.min("start").alias("value"))
    sibling = latest(sibling.select("conv_id", "above", F.col("parent").alias("at"), "start", "next"), hooks, ["conv_id", "above"], "at", True)
    sibling = sibling.select("conv_id", "start", "above", F.coalesce("next", "value").alias("next"))
    nodes = runs.join(child, ["conv_id", "start"], "left").join(sibling, ["conv_id", "start"], "left")
    into, end = F.col("start") * 2, F.col("start") * 2 + 1
    enter = F.struct(into.alias("node"), F.coalesce(F.col("child") * 2, end).alias("to"), F.col("size").alias("w"))
    leave = F.struct(end.alias("node"), F.coalesce(F.col("next") * 2, F.col("above") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("w"))
    lists = materialise(nodes.select("conv_id", F.explode(F.array(enter, leave)).alias("x")).select("conv_id", "x.*"), "lists")
    while not lists.filter("to is not null").isEmpty():
        far = lists.select("conv_id", F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("w").alias("more"))
        lists, before = materialise(lists.join(far, ["conv_id", "to"], "left").select("conv_id", "node", F.col("beyond").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")), "lists"), lists
        done_with(before)
    places = lists.filter("node % 2 = 0").join(sizes, "conv_id")
    return places.select("conv_id", (F.col("node") / 2).cast("long").alias("start"), (F.col("total") - F.col("w")).alias("place"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), n_quotes, n_linked, depth, reply_to, position.

    ``depth`` is the deepest quote level; ``reply_to`` the turn that the shallowest linked
    passage comes from (ties: the latest message), null where nothing links, so that the message
    answers the one before. ``position`` counts from 0 in reply order: the preorder of the tree in which each
    message hangs below the one that it answers, those below one message by turn (then by a digest of role and text). A null text is empty; null conv_id or
    turn make a conversation or place of their own, first in order, and link nothing; repeated
    rows stay, next to one another; other columns of the input are not read; no messages, no rows."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", text_or_empty("text").alias("text"))
    # Repeated rows are one message, said n times.
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    said, whole = message_keys()
    rows = materialise(ranked(rows.withColumns({"__k": said, "__m": whole})), "messages").withColumn("own", own_text(F.col("text")))
    quoted = materialise(passages(rows.filter("conv_id is not null and turn is not null").select("__m", "conv_id", "turn", "text")), "quoted")
    out = rows.drop("text", "__k")
    if quoted.isEmpty():
        links = quoted.select("__m", *[F.lit(0).alias(c) for c in ("n_quotes", "n_linked", "depth")], F.lit(None).cast("long").alias("reply_to"))
        return _message_rows(out.withColumn("place", F.col("__r")), links)
    quotable = rows.filter("turn is not null").select("conv_id", "turn", "__r", "n", "__m", "own").join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    said = originals(quotable).unionByName(excerpts(quotable, quoted)).distinct().join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    # Of one turn's messages that say the same, the last.
    said = said.groupBy("conv_id", "key", "turn").agg(F.max(F.struct("turn", "__r", "n")).alias("value"))
    seen = latest(quoted.select("conv_id", "key", "turn", "__m", "level"), said, ["conv_id", "key"], "turn", True)
    links = seen.groupBy("__m").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("value").alias("n_linked"),
        F.max("level").alias("depth"),
        F.max(F.when(F.col("value").isNotNull(), F.struct((-F.col("level")).alias("l"), "value"))).alias("x"),
    )
    links = materialise(links.select("__m", "n_quotes", "n_linked", "depth", F.col("x.value.turn").alias("reply_to"), F.col("x.value.__r").alias("parent"), F.col("x.value.n").alias("said")), "links")
    jumps = rows.select("conv_id", "__m", F.col("__r").alias("at")).join(links.filter("parent is not null"), "__m").filter("parent + said != at").select("conv_id", "at", "parent")
    jumps = materialise(jumps, "jumps")
    if jumps.isEmpty():
        return _message_rows(out.withColumn("place", F.col("__r")), links)
    some = jumps.select("conv_id").distinct()
    sizes = materialise(rows.join(some, "conv_id", "left_semi").groupBy("conv_id").agg(F.sum("n").alias("total")), "sizes")
    places = segment_places(jumps, sizes)
    starts = places.select("conv_id", F.col("start").alias("at"), F.struct("start", "place").alias("value"))
    moved = latest(rows.join(some, "conv_id", "left_semi").select("conv_id", F.col("__r").alias("at"), "__m"), starts, ["conv_id"], "at", False)
    moved = moved.select("__m", (F.col("value.place") + F.col("at") - F.col("value.start")).alias("__p"))
    return _message_rows(out.join(moved, "__m", "left").withColumn("place", F.coalesce("__p", "__r")), links)


def _message_rows(placed: DataFrame, links: DataFrame) -> DataFrame:
    out = placed.join(links.select("__m", "n_quotes", "n_linked", "depth", "reply_to"), "__m", "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("n_quotes", "n_linked", "depth")],
        "reply_to",
        (F.col("place") + F.col("copy")).cast("long").alias("position"),
    )


def chat_format(linked: DataFrame) -> DataFrame:
    """linked with ``chat``: a message as a block of a chat transcript, to be read by conv_id and position."""
    return linked.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n")))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(link_quotes(table(spark, sf_dir, "conversations")))


#: DuckDB's form of op8_quotation_linking.
OP8_SQL = r"""
with recursive rows as (
  select conv_id, turn, role, coalesce(text, '') as body,
         regexp_replace(regexp_replace(coalesce(text, ''), '(?:^|\n)(?:On [^\n]{1,200} wrote:[ ]*\n)?([ ]{0,3}>[^\n]*(?:\n[ ]{0,3}>[^\n]*)*)', chr(10), 'g'),
                        '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as own
  from conversations),
blocks as (
  select distinct conv_id, turn, role, body,
         regexp_extract_all(body, '(?:^|\n)(?:On [^\n]{1,200} wrote:[ ]*\n)?([ ]{0,3}>[^\n]*(?:\n[ ]{0,3}>[^\n]*)*)', 1) as bs
  from rows),
block as (select conv_id, turn, role, body, unnest(bs) as block, generate_subscripts(bs, 1) as b from blocks),
line as (
  select conv_id, turn, role, body, b, unnest(string_split(block, chr(10))) as line,
         generate_subscripts(string_split(block, chr(10)), 1) as l from block),
lev as (
  select *, length(regexp_replace(regexp_extract(line, '^[ ]{0,3}((?:>[ ]?)+)', 1), '[^>]', '', 'g')) as level,
         regexp_replace(line, '^[ ]{0,3}(?:>[ ]?)+', '') as said from line),
edge as (
  select *, (coalesce(lag(level) over (partition by conv_id, turn, role, body, b order by l), 0) <> level)::int as new from lev),
run as (
  select *, sum(new) over (partition by conv_id, turn, role, body, b order by l) as run from edge),
passage as (
  select conv_id, turn, role, body, level,
         trim(translate(regexp_replace(string_agg(said, chr(10) order by l), '[ \t\r\n]+', ' ', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as said
  from run group by conv_id, turn, role, body, b, run, level),
piece as (
  select conv_id, turn, role, body, trim(translate(regexp_replace(unnest(list_concat([own], regexp_split_to_array(own, '\n[ \t\r]*\n'), string_split(own, chr(10)))), '[ \t\r\n]+', ' ', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as said from rows),
original as (select distinct conv_id, turn, said from piece),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, md5(coalesce(role, chr(1)) || chr(2) || body)) - 1 as r,
         count(*) over (partition by conv_id, turn, role, body) as n from rows),
message as (select conv_id, turn, role, body, min(r) as r, any_value(n) as n from numbered group by all),
source as (select o.conv_id, o.turn, o.said, max(m.r) as r from original o join message m on m.conv_id = o.conv_id and m.turn = o.turn join piece p
           on p.conv_id = m.conv_id and p.turn = m.turn and p.role is not distinct from m.role and p.body = m.body and p.said = o.said group by all),
linked as (
  select p.conv_id, p.turn, p.role, p.body, p.level,
         (select max({'t': o.turn, 'r': o.r}) from source o where o.conv_id = p.conv_id and o.said = p.said and o.turn < p.turn) as source
  from passage p where p.said <> '' and p.conv_id is not null and p.turn is not null),
found as (
  select conv_id, turn, role, body, count(*) as n_quotes, count(source) as n_linked, max(level) as depth,
         max({'l': -level, 's': source}) filter (where source is not null) as best
  from linked group by conv_id, turn, role, body),
answer as (
  select m.conv_id, m.r, m.n, coalesce(f.best.s.r, (select max(b.r) from message b where b.conv_id is not distinct from m.conv_id and b.r < m.r)) as above
  from message m left join found f on m.conv_id is not distinct from f.conv_id and m.turn is not distinct from f.turn and m.role is not distinct from f.role and m.body = f.body),
path(conv_id, r, n, way) as (
  select conv_id, r, n, [r] from answer where above is null
  union all select a.conv_id, a.r, a.n, list_append(p.way, a.r) from answer a join path p on a.conv_id is not distinct from p.conv_id and a.above = p.r),
placed as (select conv_id, r, sum(n) over (partition by conv_id order by way) - n as place from path)
select x.conv_id, x.turn, x.role, x.own as text, coalesce(n_quotes, 0)::int as n_quotes, coalesce(n_linked, 0)::int as n_linked,
       coalesce(depth, 0)::int as depth, best.s.t as reply_to, (place + x.r - m.r)::bigint as position,
       '<|' || coalesce(x.role, 'unknown') || '|>' || chr(10) || x.own || chr(10) as chat
from numbered x join message m on x.conv_id is not distinct from m.conv_id and x.turn is not distinct from m.turn and x.role is not distinct from m.role and x.body = m.body
join placed q on q.conv_id is not distinct from m.conv_id and q.r = m.r
left join found f on x.conv_id is not distinct from f.conv_id and x.turn is not distinct from f.turn and x.role is not distinct from f.role and x.body = f.body
"""
