"""URL filter: host rules first, else a character language-model ratio.

Two smoothed variable-order Markov models over the characters of a URL, one learned
from URLs that an allow rule accepts and one from URLs that a block rule rejects, are
compared by the difference of their log-likelihoods per character. The threshold is
calibrated on a fifth of the rule-labelled URLs, which the models do not see. All of it
is DataFrame expressions; each distinct URL is scored once, and its windows are summed
where they are made, because the joined model table is bounded by its alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, materialise, table

#: (host, path prefix) -> verdict.
RULES = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
#: Folded symbols that a model predicts: letters, digits as 0, six marks, others as *, and the end $.
SYMBOLS = 26 + 1 + 6 + 1 + 1
#: Characters of context. With ^ as padding there are at most 36**4 windows, about 1.7 million.
ORDER = 3
#: Up to so many windows (a few characters and a number each) are broadcast; more, as a higher order may have, are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
BIN = 0.01


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: dict[tuple[str, str], str]) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first by name) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (h, p), v in sorted(rules.items(), key=lambda x: (len("".join(x[0])), [-ord(c) for c in "".join(x[0])])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def windows(host: Column, path: Column, order: int = ORDER) -> Column:
    """Every run of order+1 symbols of the padded, folded URL: a zero-width match at each place, so linear in its length."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0"), "[^a-z0./_~%-]", "*")
    return F.regexp_extract_all(F.concat(F.lit("^" * order), folded, F.lit("$")), F.lit("(?=(.{%d}))" % (order + 1)), F.lit(1))


def window_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, ratio) from (g, a, r), the counts of a window in accepted and rejected URLs.

    Witten-Bell interpolation from no context up to ``order`` characters: a context that a
    model never saw leaves the shorter one's probability, so the order varies with the data."""
    levels = {order: grams.select("g", "a", "r")}
    for k in range(order - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.substring("g", 2, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    lower = None
    for k in range(order + 1):
        level = levels[k].withColumn("ctx", F.substring("g", 1, k))
        seen = level.groupBy("ctx").agg(
            *[F.sum(x).alias(f"n{x}") for x in "ar"], *[F.sum((F.col(x) > 0).cast("long")).alias(f"t{x}") for x in "ar"]
        )
        level = level.join(seen, "ctx")
        if lower is None:
            level = level.withColumns({"qa": F.lit(1.0 / SYMBOLS), "qr": F.lit(1.0 / SYMBOLS)})
        else:
            level = level.withColumn("tail", F.substring("g", 2, k)).join(lower, "tail")
        prob = {
            f"p{x}": F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"q{x}"))
            for x in "ar"
        }
        level = level.withColumns(prob)
        lower = level.select(F.col("g").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
    return level.select("g", (F.log("pa") - F.log("pr")).alias("ratio"))


def url_filter(pages: DataFrame, rules: dict[tuple[str, str], str] = RULES, order: int = ORDER, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score (allow: at or above the calibrated threshold).

    Null, empty or schemeless URLs have empty host and path and are judged like any other
    text; repeated rows are judged alike; with no labelled URL of either kind every ratio
    and the threshold are 0 and the method allows; no pages, no rows. Columns of pages with those five names are
    replaced; all others pass through whatever their names and types (and move once, to meet their score). The rules are configuration: a driver-side dictionary."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    given = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("page"), F.col(f"`{url}`").alias("url"))
    rows = given.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    held_out = F.pmod(F.crc32(F.coalesce(F.col("url"), F.lit("")).cast("binary")), F.lit(5)) == 0
    bits = rows.select("verdict", held_out.alias("held"), F.explode(windows(F.col("host"), F.col("path"), order)).alias("g"))
    counted = bits.groupBy("g").agg(
        *[F.sum(((F.col("verdict") == v) & ~F.col("held")).cast("long")).alias(x) for x, v in (("a", "allow"), ("r", "block"))]
    )
    counted = counted.select("g", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in "ar"])
    ratios = materialise(window_ratios(counted, order), "url-ratios")
    ratios = F.broadcast(ratios) if ratios.count() <= BROADCAST_WINDOWS else ratios

    def scored(some: DataFrame, keep: list[str]) -> DataFrame:
        """some with its score; a URL's windows meet again by a number in the scan and by ``keep``."""
        parts = some.select("id", *keep, F.explode(windows(F.col("host"), F.col("path"), order)).alias("g"))
        return parts.join(ratios, "g").groupBy("id", *keep).agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))

    held = rows.filter(F.col("verdict").isNotNull() & held_out).withColumn("id", F.monotonically_increasing_id())
    threshold = calibrated(scored(held, ["verdict", "host", "path"]))
    # What has a rule still gets a score. Equal hosts and paths have one: the rows meet it by these, so nothing else of a page moves with its windows.
    urls = rows.select("host", "path").distinct().withColumn("id", F.lit(0))
    score = scored(urls, ["host", "path"]).select(F.col("host").alias("h"), F.col("path").alias("p"), "score")
    out = rows.join(score, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    judged = F.coalesce(F.col("verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select("page.*", "host", "path", "rule", judged.alias("verdict"), "score")


def calibrated(held: DataFrame) -> float:
    """The bin edge with the largest balanced accuracy on (verdict, score); ties: the one nearest 0, then the smaller.

    A ratio per character lies within the log of the smallest smoothed probability, so the histogram
    has a few thousand bins at most however many URLs there are."""
    bins = held.groupBy(F.floor(F.col("score") / BIN).alias("b")).agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("r")
    )
    found = sorted((x.b, x.a, x.r) for x in bins.collect())
    na, nr = sum(x[1] for x in found), sum(x[2] for x in found)
    if not na or not nr:
        return 0.0
    best, above, below = None, na, 0
    for b, a, r in found:
        key = (-(above / na + below / nr), abs(b), b)
        best = min(best or key, key)
        above, below = above - a, below + r
    return best[2] * BIN


def op1_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _oracle(rules: dict[tuple[str, str], str] = RULES, order: int = ORDER) -> str:
    """DuckDB's form of op1_url_language_model."""
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    longest = sorted(rules.items(), key=lambda x: -len("".join(x[0])))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for (h, p), _ in longest)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for (h, p), v in longest)
    out = f"""
with cut as (
  select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
crc(i, c) as materialized (
  select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) from (select unnest(range(256))::bigint as i)),
ruled as (
  select *, row_number() over () as id, case {rule} end as rule, case {verdict} end as given,
         '{"^" * order}' || regexp_replace(regexp_replace(lower(host || path), '[0-9]', '0', 'g'), '[^a-z0./_~%-]', '*', 'g') || '$' as t from cut),
table_of as materialized (select list(c order by i) as tab from crc),
rows as materialized (
  select r.*, xor(list_reduce(list_concat([4294967295::bigint], coalesce(list_transform(range(strlen(coalesce(url, ''))), lambda k: ('0x' || substr(hex(encode(coalesce(url, ''))), 2 * k + 1, 2))::bigint), [])),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 as held from ruled r, table_of),
parts as materialized (select id, given, held, substr(t, k, {order + 1}) as g from (select *, unnest(range(1, length(t) - {order} + 1)) as k from rows)),
level{order} as (select g, count(*) filter (given = 'allow' and not held)::double as a, count(*) filter (given = 'block' and not held)::double as r from parts group by g)"""
    for k in range(order - 1, -1, -1):
        out += f",\nlevel{k} as (select substr(g, 2) as g, sum(a) as a, sum(r) as r from level{k + 1} group by 1)"
    for k in range(order + 1):
        qa, qr, joined = (f"1.0::double / {SYMBOLS}", f"1.0::double / {SYMBOLS}", "") if k == 0 else ("q.pa", "q.pr", f"join prob{k - 1} q on q.g = substr(l.g, 2)")
        out += f""",
prob{k} as materialized (select l.g, case when na > 0 then (l.a + ta * {qa}) / (na + ta) else {qa} end as pa, case when nr > 0 then (l.r + tr * {qr}) / (nr + tr) else {qr} end as pr
  from level{k} l join (select substr(g, 1, {k}) as ctx, sum(a) as na, sum(r) as nr, count(*) filter (a > 0) as ta, count(*) filter (r > 0) as tr from level{k} group by 1) c on c.ctx = substr(l.g, 1, {k}) {joined})"""
    return (
        out
        + f""",
scores as materialized (select id, sum(ln(pa) - ln(pr)) / count(*) as score from parts join prob{order} using (g) group by id),
bins as (select floor(score / {BIN}) as b, count(*) filter (given = 'allow') as a, count(*) filter (given = 'block') as r from rows join scores using (id) where held and given is not null group by 1),
totals as (select sum(a) as na, sum(r) as nr from bins),
ranked as (select b, sum(a) over (order by b rows between current row and unbounded following) as above, coalesce(sum(r) over (order by b rows between unbounded preceding and 1 preceding), 0) as below from bins),
best as (select b * {BIN} as threshold from ranked, totals where na > 0 and nr > 0 order by above / na + below / nr desc, abs(b), b limit 1)
select page_id, host, path, rule, coalesce(given, case when score >= coalesce((select threshold from best), 0) then 'allow' else 'block' end) as verdict, round(score, 6) as score
from rows join scores using (id)"""
    )


OP1_SQL = _oracle()
