"""URL filter, quotation linking and vector search on their own odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relgraph.llm import ann, quotes, url_filter

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.NET/en/x?q#f", "http://b.example.net/de/1", "http://net/x", "http://foo.net", "http://x.example.com/de/9", "http://x.example.com/en/9",
    "https://h.org/fr/1", "https://h.org/FR/1", "http://notexample.net/en/1", None, "", "no scheme", "://", "http://u@h.org:80/fr/x", "http://a?b://c", "ü://Ünet/en/",
    "http://h.org/fr/" + "a" * 50_000, "http://a.example.net/en/1",
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0] + best[1])):
            best = h, p
    return host, path, best


def test_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(URLS)], "page_id long, url string, score string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and "".join(rule)), u
        assert got[i].verdict in ("allow", "block") and (rule is None or got[i].verdict == url_filter.RULES[rule])


def test_clashing_columns_pass_through(spark, monkeypatch):
    rows = [(i, u, f"<{i}>", {"k": f"v{i}"}, i * 2, "r", "x") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, props map<string,string>, g int, ratio string, page string")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert all((got[i].html, got[i].props, got[i].g, got[i].ratio, got[i].page) == r[2:] for i, r in enumerate(rows))
    monkeypatch.setattr(url_filter, "BROADCAST_WINDOWS", 1)
    assert {(r.page_id, r.verdict, round(r.score, 9)) for r in url_filter.url_filter(pages).collect()} == {(r.page_id, r.verdict, round(r.score, 9)) for r in got.values()}


def test_ratio_is_that_of_two_witten_bell_models(spark):
    accepted, rejected = ["abab/", "abba"], ["cdcd", "dc0"]
    pad = lambda s: "^" * 3 + s + "$"
    rows = [(w, int(s in accepted), int(s in rejected)) for s in accepted + rejected + ["abcd"] for p in [pad(s)] for w in [p[i : i + 4] for i in range(len(p) - 3)]]
    grams = spark.createDataFrame(rows, "g string, a long, r long").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    got = {r.g: r.ratio for r in url_filter.window_ratios(grams).collect()}

    def prob(texts, context, c):
        p = 1 / url_filter.SYMBOLS
        for k in range(4):
            tail = context[3 - k :] if k else ""
            seen = [x[i] for x in map(pad, texts) for i in range(3, len(x)) if x[i - k : i] == tail]
            if seen:
                p = (seen.count(c) + len(set(seen)) * p) / (len(seen) + len(set(seen)))
        return p

    for g, ratio in got.items():
        assert math.isclose(ratio, math.log(prob(accepted, g[:3], g[3])) - math.log(prob(rejected, g[:3], g[3])), abs_tol=1e-9)


def test_filter_learns_from_the_rules(spark, sf):
    out = url_filter.op1_url_language_model(spark, sf).filter("rule is not null").collect()
    right = sum((r.score >= 0) == (r.verdict == "allow") for r in out)
    assert right > 0.8 * len(out)


def test_no_pages(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


CHAT = [
    (1, 0, "user", "Hello there.\n\nHow are  you?"),
    (1, 1, "assistant", "> how are you?\n\nFine."),
    (1, 2, "user", "On Monday, A wrote:\n> > Hello there.\n> Fine.\nGood."),
    (1, 3, "user", ">>> nobody said\n> fine.\nOk"),
    (1, 4, None, "x > y is no quote\n> Good.\n> Good."),
    (2, 0, "user", "Fine."),
    (2, 0, "user", "Fine."),
    (2, None, "user", "> Fine.\nlost"),
    (None, 1, "user", "> Fine."),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, "user", "> Fine.\n" * 2000),
]


def test_quotes(spark):
    df = spark.createDataFrame([(*r, None) for r in CHAT], "conv_id long, turn long, role string, text string, own string")
    out = quotes.chat_format(quotes.link_quotes(df)).collect()
    got = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(CHAT)
    assert got[1, 1].text == "Fine." and got[1, 1].reply_to == 0 and got[1, 1].depth == 1
    assert (got[1, 2].text, got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].depth, got[1, 2].reply_to) == ("Good.", 2, 2, 2, 1)
    assert (got[1, 3].n_quotes, got[1, 3].n_linked, got[1, 3].depth, got[1, 3].reply_to) == (2, 1, 3, 1)
    assert got[1, 4].text == "x > y is no quote" and got[1, 4].n_linked == 0 and got[1, 4].chat.startswith("<|unknown|>")
    assert got[2, 1].text == "" and got[2, 3].text == "" and got[2, None].reply_to is None and got[None, 1].reply_to is None
    assert sorted(r.position for r in out if r.conv_id == 2) == list(range(6))
    assert [got[1, t].position for t in range(5)] == [0, 1, 2, 3, 4]


def thread(replies):
    """Positions by a plain walk of the tree: replies[i] is whom message i answers, None for the one before."""
    below = {}
    for i, x in enumerate(replies):
        if i:
            below.setdefault(i - 1 if x is None else x, []).append(i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += reversed(below.get(i, []))
    return {i: n for n, i in enumerate(order)}


def quoting_table(spark, replies, conv=1):
    rows = [(conv, i, f"r{i % 3}", f"says {i}" if x is None else f"> says {x}\nsays {i}") for i, x in enumerate(replies)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("bucket", [4, 1024])
def test_replies_decide_the_order(spark, monkeypatch, tmp_path, bucket):
    import duckdb

    monkeypatch.setattr(quotes, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    all_replies = [[None, None, 0, None, 1, 1, None, 2, 0], [None, *[0] * 12], [None] * 6, [None, *[int(rng.integers(i)) if rng.random() < 0.5 else None for i in range(1, 60)]]]
    df = quoting_table(spark, all_replies[0], 0)
    for c, replies in enumerate(all_replies[1:], 1):
        df = df.unionByName(quoting_table(spark, replies, c))
    got = {(r.conv_id, r.turn): (r.position, r.reply_to) for r in quotes.link_quotes(df).collect()}
    for c, replies in enumerate(all_replies):
        for i, n in thread(replies).items():
            assert got[c, i] == (n, replies[i])
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    assert {(c, t): (p, a) for c, t, p, a in con.sql(f"select conv_id, turn, position, reply_to from ({quotes.OP8_SQL})").fetchall()} == got


def test_null_and_repeated_turns_in_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BUCKET", 8)
    rows = [(1, None, "u", f"n{i}") for i in range(40)] + [(1, 3, "u", f"t{i}") for i in range(40)] + [(1, 5, "u", "same")] * 30 + [(1, 9, "u", "> t7\nyes")]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.position for r in out) == list(range(len(rows)))
    at = {r.text: r.position for r in out}
    assert at["yes"] > at["t7"] and all(r.position < 40 for r in out if r.turn is None)
    assert [r.reply_to for r in out if r.text == "yes"] == [3]


def test_quotes_match_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in CHAT if None not in r[:2]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    names = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "depth", "reply_to", "position", "chat"]
    expected = con.sql(f"select {', '.join(names)} from ({quotes.OP8_SQL})").fetchall()
    got = quotes.chat_format(quotes.link_quotes(df)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_excerpts_link(spark):
    said = "a\nb  B\nc\n\nd\ne\n\nf"
    replies = ["> a\n> b b", "> B b\n> c", "> b b\n> c\n>\n> d", "> a b b c\n>\n> d e", "> d e\n>\n> f", "> a\n> c", "> c\n> b b", "> e\n> f\n> g", "> x\n> a\n> b b"]
    rows = [(c, t, "user", x) for c, r in enumerate(replies) for t, x in ((0, said), (1, r))] + [(99, 0, "user", "> a\n> b b"), (99, 1, "user", said)]
    got = {r.conv_id: (r.n_linked, r.reply_to) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.n_quotes}
    assert got == {c: (1, 0) if c < 5 else (0, None) for c in range(len(replies))} | {99: (0, None)}


def test_no_messages(spark):
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute(rows, every, k):
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in [i for i in x if i % every == 0]:
        scored = sorted((-(x[i] * x[q]).sum(), i) for i in x if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("group", [60, 8192])
def test_search(spark, monkeypatch, group):
    monkeypatch.setattr(ann, "GROUP_ROWS", group)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 700)]  # ties
    odd = [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0, None] + [0.0] * 14), (980, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows + odd], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    expected = brute(rows, 20, 20)
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hit >= 0.9 * sum(map(len, expected.values()))
    x = dict(rows)
    assert all(math.isclose(s, float(np.dot(x[q], x[i])), rel_tol=1e-12, abs_tol=1e-12) for q, v in got.items() for i, s in v)
    assert [i for i, _ in got[600]][:1] == [0] and all(sorted(v, key=lambda t: (-t[1], t[0])) == v for v in got.values())


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected = brute(rows, 20, 20)
    got = {}
    for r in ann.op7_ivf_pq(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in v}) for q, v in expected.items()) >= 0.9 * sum(map(len, expected.values()))


def test_repeated_ids_and_whole_types(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 8))
    rows = [(i % 25, x[i].tolist()) for i in range(50)]  # each vec_id twice, other vectors
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = ann.search(df, probes=1000).collect()
    x = x.astype(np.float32).astype(float)
    expected = []
    for q in (0, 20, 25, 45):
        scored = sorted((-float(x[q] @ x[i]), i % 25) for i in range(50) if i != q)[:20]
        expected += [(q % 25, n, i, round(-s, 9)) for n, (s, i) in enumerate(scored, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(expected)


def test_clustered_vectors_need_few_lists(spark):
    """Visited vectors a query do not grow with the table: sixteen times as many rows, in as many more clusters."""
    shares, work = [], []
    for n in (1500, 24_000):
        rng = np.random.default_rng(4)
        centres = rng.normal(size=(n // 50, 16)) * 4
        x = (centres[np.arange(n) % len(centres)] + rng.normal(size=(n, 16)) * 0.3).astype(np.float32)
        index = ann.fit(x[: ann.SAMPLE_ROWS].astype(float), int(2 * math.sqrt(n)), 16)
        own = index.lists(x.astype(float))
        df = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, own))], "row long, v array<float>, list int")
        pilots = df.filter("row % 20 = 0").limit(50).collect()
        probes = ann.calibrated_probes(df, index, pilots, 20)
        shares.append(probes / len(index.centroids))
        work.append(probes * n / len(index.centroids))
    assert shares[1] < shares[0] / 2 and work[1] < 8 * work[0]


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(three).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


def found(df, **how):
    out = {}
    for r in ann.search(df, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def ids_of(got):
    return {q: [i for i, _ in v] for q, v in got.items()}


def test_groups_of_lists_hold_nothing_back(spark, monkeypatch):
    """A query's best are all in one list, and so in one of its groups, which gives a share first: the result is that of a single group."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 16)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * 0.5).astype(np.float32).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = ids_of(found(df, lists=8, probes=8, rerank=20))
    monkeypatch.setattr(ann, "GROUP_ROWS", 210)
    assert ids_of(found(df, lists=8, probes=8, rerank=20)) == whole
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    assert ids_of(found(df, lists=8, probes=8, rerank=20)) == whole


def test_many_copies(spark):
    """Copies, more than are ranked exactly, take no candidate's place, and of equal scores the smaller vec_id comes first."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[0] + rng.normal(size=(10, 16)) * 0.01
    vectors = [x[0]] * 500 + [-0.0 * x[0] + near[0]] * 300 + list(near) + list(x[1:])
    ids = rng.permutation(len(vectors))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, expected = found(df), brute(rows, 20, 20)
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    copies = {int(i) for i in ids[:811]}
    assert sum(q in copies for q in got) > 20
    for q in got.keys() & copies:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected) >= 0.9 * sum(map(len, expected.values()))


def test_near_copies(spark):
    """Hundreds of near copies, closer to each other than a code of the other vectors tells: their order by the tables is good enough too."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2000, 32))
    x[:600] = x[0] + rng.normal(size=(600, 32)) * 0.003
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, expected = ids_of(found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows, 20, 20)
    hits = {q: len(set(got[q]) & {i for i, _ in v}) / len(v) for q, v in expected.items()}
    assert np.mean([h for q, h in hits.items() if q < 600]) >= 0.9 and np.mean(list(hits.values())) >= 0.9


def test_small_lists_still_give_k(spark):
    """Lists with fewer than k vectors: a query goes on to the next ones until it has k."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 16)) * 4
    rows = [(i, (centres[i % 60] + rng.normal(size=16) * 0.1).tolist()) for i in range(300)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lists=60, probes=1)
    assert all(len(got[q]) == 20 for q in range(0, 300, 20))
