"""Each operator on documents against a plain computation, on rows with every odd case, and on no rows."""

import hashlib
import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from relgraph.llm import katz, minhash, mixing, packing, quality, sharding, simhash
from relgraph.llm.components import connected_components

from odd_rows import ROWS


def bag(rows):
    return Counter(tuple(r) for r in rows)


def words(text):
    return (text or "").encode().lower().split()


# Sharding.


def test_shuffle_is_whole_even_and_gapless(clashing):
    out = sharding.two_pass_shuffle(clashing, shards=3, bucket_bytes=2000).collect()
    assert bag((r.doc_id, r.text) for r in out) == bag((r[0], r[1]) for r in ROWS)
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shuffle_moves_rows_and_is_seeded(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    runs = [[r.doc_id for r in sharding.two_pass_shuffle(df, 1, seed, 1000).orderBy("slot").collect()] for seed in (1, 1, 2)]
    assert sorted(runs[0]) == list(range(2000)) and runs[0] == runs[1] and runs[0] != runs[2]
    assert abs(np.corrcoef(runs[0], range(2000))[0, 1]) < 0.1


def test_shuffle_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    runs = []
    for parts, aqe, rows in (("8", "true", df), ("3", "false", df.repartition(5)), ("1", "true", df.orderBy(F.desc("doc_id")))):
        with_conf = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.enabled": aqe}
        before = {k: spark.conf.get(k) for k in with_conf}
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        runs.append(sorted(map(tuple, sharding.two_pass_shuffle(rows, 5, bucket_rows=200).select("doc_id", "shard", "slot").collect())))
        for k, v in before.items():
            spark.conf.set(k, v)
    assert runs[0] == runs[1] == runs[2]


def test_fisher_yates_by_hand(spark):
    got = spark.range(12).select("id", sharding.fisher_yates(F.col("id").cast("int"), F.lit(77).cast("long")).alias("a")).collect()
    draw = {(i): r.d for i in range(2, 12) for r in spark.range(1).select(F.xxhash64(F.lit(77).cast("long"), F.lit(i)).alias("d")).collect()}
    for r in got:
        a = list(range(r.id))
        for i in range(r.id, 1, -1):
            j = draw[i] % i
            a[i - 1], a[j] = a[j], a[i - 1]
        assert r.a == a


def test_repeated_rows_fill_no_bucket(spark):
    df = spark.createDataFrame([(1, "same")] * 900 + [(i, "other") for i in range(2, 302)], "doc_id long, text string")
    out = sharding.two_pass_shuffle(df, 4, bucket_rows=100).collect()
    assert bag((r.doc_id, r.text) for r in out) == bag(map(tuple, df.collect()))
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(4) for k in range(300)]


def test_shards_on_disk(documents, tmp_path):
    sharding.write_shards(sharding.two_pass_shuffle(documents, shards=2), str(tmp_path / "s"))
    back = documents.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ROWS) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}


# SimHash.


def plain_fingerprint(text, width):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(clashing):
    got = simhash.simhash_components(clashing).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("h"), "component_id").collect()
    fps = [plain_fingerprint(r[1], 3) for r in ROWS]
    expected = []
    for i, r in enumerate(ROWS):
        group, front = {i}, [i]
        while front:
            x = front.pop()
            new = {j for j in range(len(ROWS)) if j not in group and (fps[x] ^ fps[j]).bit_count() <= 3}
            group, front = group | new, front + list(new)
        expected.append((r[0], f"{fps[i]:016x}", min((ROWS[j][0] for j in group if ROWS[j][0] is not None), default=None)))
    assert bag(got) == bag(expected)


@pytest.mark.parametrize("block", [40, 4096])
def test_links_lose_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = {int(base[i % 3]) ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64)) for i in range(400)} | {int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.simhash_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links.collect())
    root = {r.node: r.root for r in connected_components(links).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(root.get(x, x) == find(x) for x in fps)


def test_crowded_key_links_across_the_sign_bit(spark):
    base = 0x0123456789ABCDEF
    fps = {base ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(11, 20), 2)} | {base, base ^ 1 << 63 ^ 1 << 20}
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    assert len(fps) > simhash.PAIRS_UPTO
    links = simhash.simhash_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert {r.node for r in connected_components(links).collect() if r.root == min(fps)} == set(fps)


def test_near_duplicates_go(spark):
    base = [f"word{i}" for i in range(60)]
    near = base[:59] + ["other"]
    far = base[:30] + [f"x{i}" for i in range(30)]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(far)), (7, " ".join(base)), (7, " ".join(base)), (1, None), (2, ""), (None, " "), (4, "a b"), (6, "a b")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == [(False, 1), (False, 3), (False, 4), (False, 9), (True, None)]


def test_near_duplicates_keep_clashing_columns(spark, documents):
    mine = documents.select("*", *[F.concat(F.lit(f"my {c} "), F.coalesce("lang", F.lit("?"))).alias(c) for c in ("__t", "__d", "__i", "id", "second", "row", "best")])
    out = simhash.drop_near_duplicates(mine)
    assert out.schema.simpleString() == mine.schema.simpleString()
    assert {tuple(r) for r in out.drop("text").collect()} <= {tuple(r) for r in mine.drop("text").collect()}


def test_texts_that_share_a_hash_both_stay(spark, monkeypatch):
    monkeypatch.setattr(minhash, "text_id", lambda t: F.when(t.startswith("same"), F.lit(7).cast("long")).otherwise(F.xxhash64(t)))
    rows = [(3, "same hash one two three four five six"), (1, "same hash but quite another text than that"), (2, "same hash one two three four five six"), (4, "something else")]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 2, 4]


def test_dense_group_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_UPTO", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    rng = np.random.default_rng(0)
    base = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        w[int(rng.integers(80))] = f"new{i}"
        rows.append((i, " ".join(w)))
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


# MinHash.


def test_minhash_rows(clashing, monkeypatch):
    got = minhash.minhash_fingerprints(clashing).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    expected = []
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        text = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        sig = [minhash.signature(minhash.shingle_hashes(words(t))) for t in (own, text, after)]
        expected.append((r[0], len(own), hashlib.sha256(text.encode()).hexdigest(), sig[0].tobytes().hex(), sig[1].tobytes().hex(), minhash.likeness(sig[0], sig[1]), minhash.likeness(sig[0], sig[2])))
    assert bag(got) == bag(expected)


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        both, n = rng.integers(0, 2**64, int(1000 * share), dtype=np.uint64), 500 - int(500 * share)
        a, b = (np.concatenate([both, rng.integers(0, 2**64, n, dtype=np.uint64)]) for _ in "ab")
        true = len(both) / (len(both) + 2 * n)
        assert abs(minhash.likeness(minhash.signature(a), minhash.signature(b)) - true) < 0.15


# Katz.


def test_katz_against_recursion(clashing, monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 5000)
    monkeypatch.setattr(katz, "GROUP_TOKENS", 4000)
    held = F.col("doc_id") % 3 == 0
    got = katz.katz_scores(clashing.drop("held_out"), held).collect()
    docs = [(r[0], [*[w.decode() for w in words(r[1])], "\n"], r[0] is None or r[0] % 3 == 0) for r in ROWS]
    uni, pair, context = Counter(), Counter(), Counter()
    for _, w, out in docs:
        if not out:
            uni.update(w)
            pair.update(zip(["\ns", *w], w))
            context.update(["\ns", *w[:-1]])
    n, z = sum(uni.values()), sum(uni.values()) + 0.1 * (len(uni) + 1)
    d = katz.discounts([sum(c == r for c in pair.values()) for r in range(1, 7)])
    follow = {}
    for (v, w), c in pair.items():
        follow.setdefault(v, {})[w] = c
    p1 = lambda w: (uni[w] + 0.1) / z
    weight = {v: (1 - sum(d[min(c, 6) - 1] * c / context[v] for c in f.values())) / (1 - sum(map(p1, f))) for v, f in follow.items()}

    def p(w, v):
        if v not in follow:
            return p1(w)
        c = follow[v].get(w, 0)
        return d[min(c, 6) - 1] * c / context[v] if c else weight[v] * p1(w)

    for v in follow:
        assert math.isclose(sum(p(w, v) for w in uni) + p("unseen word", v), 1, abs_tol=1e-9)
    expected = [(i, out, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p(x, v)) for v, x in zip(["\ns", *w], w))) for i, w, out in docs]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], atol=1e-6)


def test_katz_sums_follow_the_tokens(spark, monkeypatch):
    """What word partitions write a document stays the same when documents and partitions are sixteen times as many."""
    import pyarrow as pa

    monkeypatch.setattr(katz, "PART_TOKENS", 60)
    monkeypatch.setattr(katz, "GROUP_TOKENS", 3000)
    each = []
    for n in (100, 1600):
        rng = np.random.default_rng(2)
        docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 40) % (20 * n)), False) for i in range(n)], "doc_id long, text string, held_out boolean").repartition(2)
        hot = katz.hot_words(docs)
        total, _, _, counts = katz.corpus_counts(docs, hot)
        by = {int(h): counts[w] for h, w in zip(katz.word_hashes(hot), hot)}
        rows = katz.deal(docs, hot, max(1, math.ceil(total / 60))).toPandas()
        written = 0
        for part, own in rows.groupby("part"):
            out = katz.count_partition(pa.Table.from_pandas(own, preserve_index=False), by)
            if part >= 0:
                written += sum(len(x) for kind, blob in zip(out["kind"].to_pylist(), out["blob"].to_pylist()) if kind == katz.KIND_SUMS for x in katz.opened(blob) for x in [x[1]])
        each.append(written / n)
    assert each[1] < 1.3 * each[0] and each[1] <= 41  # a document has 41 tokens


def test_katz_without_training(documents):
    out = katz.katz_scores(documents, F.lit(True)).collect()
    assert len(out) == len(ROWS) and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score) < 1e-6 for r in out)


# Packing.


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_pieces_are_the_tokenizers(clashing, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    got = Counter()
    for r in packing.tokenised_pieces(clashing, tokenizer, 100).collect():
        got[r.doc_id, r.piece, r.start, r.length, bytes(r.ids)] += 1
    expected = Counter()
    for doc_id, text, *_ in ROWS:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(-(-len(ids) // 100)):
            part = ids[100 * k : 100 * k + 100]
            expected[doc_id, k, 100 * k, len(part), np.array(part, "<u4").tobytes()] += 1
    assert got == expected


def test_packing_is_gapless_and_near_the_bound(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 3000).tolist()
    pieces = spark.createDataFrame([(i, int(n), None) for i, n in enumerate(lengths)], "doc_id long, length long, offset string")
    rows = packing.pack(pieces, 100, part_rows=600).collect()
    assert bag((r.doc_id, r.length) for r in rows) == bag(enumerate(lengths))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    assert len(by) <= 1.02 * packing.lower_bound(np.array(lengths), 100)
    # Every partition is certified, or the gap that is left is stated.
    parts = {}
    for r in rows:
        if r.length < 100:
            parts.setdefault(r.sequence_id >> 24, []).append(r)
        else:
            assert r.bound_gap == 0
    for own in parts.values():
        gap = len({r.sequence_id for r in own}) - packing.lower_bound(np.array([r.length for r in own]), 100)
        assert gap >= 0 and {r.bound_gap for r in own} == {gap}


def test_exchange_goes_on_while_it_wins(spark):
    rng = np.random.default_rng(8)
    # Pieces of 34 to 50 of 100: two fill a sequence badly, so partitions keep gaps and exchange.
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(20, 60, 1500))], "doc_id long, length long")
    rows = packing.pack(pieces, 100, part_rows=100).collect()
    once = packing.best_fit_decreasing(np.array([r.length for r in rows]), 100)[2]
    assert len({r.sequence_id for r in rows}) <= 1.1 * once and bag((r.doc_id, r.length) for r in rows) == bag(map(tuple, pieces.collect()))


def optimum(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, int(rng.integers(1, 9))).tolist(), reverse=True)
        best = optimum(lengths, 20)
        made = packing.best_fit_decreasing(np.array(lengths), 20)[2]
        assert packing.lower_bound(np.array(lengths), 20) <= best <= made
    assert packing.lower_bound(np.array([11] * 5), 20) == 5


def test_packing_worker_decodes_some_texts_at_a_time(spark, tokenizer, monkeypatch):
    """Beside a batch a worker holds a slice, not all texts: three times the texts take no more."""
    text = ROWS[9][1]
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    sent = []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, func, *a: sent.append((self, func)) or plain(self, func, *a))
    packing.tokenised_pieces(docs, tokenizer)
    rows, func = sent[-1]
    one = rows.toArrow()
    peaks = []
    for n in (30, 30, 90):
        batch = pa.concat_tables([one] * n).combine_chunks().to_batches()
        tracemalloc.start()
        pieces = sum(b.num_rows for b in func(iter(batch)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert pieces % n == 0 and pieces >= n * 30_000 // packing.CAPACITY
    assert peaks[2] < peaks[1] + (2 << 20), peaks


# Quality and mixing.


def test_quality_scores_every_row(clashing, labels):
    model = quality.fit_quality(clashing, labels)
    out = quality.score_quality(clashing, model).collect()
    assert bag((r.doc_id, r.text) for r in out) == bag((r[0], r[1]) for r in ROWS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not words(r.text)}) == 1
    assert quality.keep_quality(clashing, labels).columns == clashing.columns


def test_quality_worker_takes_little_beside_its_batch(spark, labels, monkeypatch):
    """Of a batch of 8 MB and 400,000 distinct words: the text is sent once, decoded and examined some at a time, and words are forgotten."""
    texts = [" ".join(f"w{i * 4000 + j:x}{'xyz'[j % 3] * 12}" for j in range(4000)) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sent = []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, func, *a: sent.append((self, func)) or plain(self, func, *a))
    quality.keep_quality(docs, labels)
    rows, func = sent[-1]
    batches = rows.toArrow().combine_chunks().to_batches()
    size = sum(len(t) for t in texts)
    assert size > 7 << 20 and sum(b.nbytes for b in batches) < 1.5 * size
    tracemalloc.start()
    scored = list(func(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in scored) == 100 and peak < 75 << 20
    monkeypatch.undo()
    model = quality.fit_quality(docs, labels)
    assert quality.keep_quality(docs, labels).count() == sum(r.score >= quality.THRESHOLD for r in quality.score_quality(docs, model).collect())


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = quality.AttentionModel()
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x, bounds, y, weight = rng.normal(size=(9, quality.FEATURES + quality.CONTENT)), np.array([0, 2, 5, 9]), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        s = model.forward(x, bounds)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    found = model.gradients(x, bounds, y, weight)
    for k, p in model.p.items():
        at = tuple(0 for _ in p.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert math.isclose((up - down) / 2e-6, found[k][at], rel_tol=1e-3, abs_tol=1e-7)


def plain_score(model, text):
    """The forward pass of one document, a passage and a word at a time."""
    w = text.split()
    p = {k: v.astype(float) for k, v in model.p.items()}
    outs, heights = [], []
    for first in range(0, max(1, len(w)), quality.PASSAGE_WORDS):
        own = w[first : first + quality.PASSAGE_WORDS]
        surface = [0.0] * quality.FEATURES
        counts = [0.0] * quality.CONTENT
        if own:
            shapes = [quality.word_shapes([x])[0] for x in own]
            surface = [float(sum(s[i] for s in shapes)) / len(own) for i in range(quality.WORD_FEATURES)]
            surface[0] /= 10
            surface += [sum(a == b for a, b in zip(own, own[1:])) / len(own), len(set(own)) / len(own), math.log1p(len(own)), math.log1p(len(w)), 1.0]
            for x in own:
                for b in quality.content_buckets([x])[0]:
                    counts[b] += 1 / len(own)
        x = (np.array(surface + counts) - model.mean) / model.scale
        h = np.tanh(x @ p["W"])
        outs.append(h)
        heights.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"][:, 0]))
    a = [math.exp(e - max(heights)) for e in heights]
    z = sum(x * h for x, h in zip(a, outs)) / sum(a)
    return 1 / (1 + math.exp(-float(z @ p["c"][:, 0] + p["b"][0, 0])))


def test_scores_are_those_of_a_plain_forward_pass(spark, sf):
    from relgraph.llm.common import table

    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf, "labels"))
    extra = spark.createDataFrame([(-1, ""), (-2, None), (-3, ROWS[9][1]), (-4, ROWS[8][1])], "doc_id long, text string")
    rows = quality.score_quality(docs.limit(60).unionByName(extra), model).collect()
    for r in rows:
        assert abs(r.score - plain_score(model, r.text or "")) < 1e-3
    # Long documents are learned from whole: a bag has a passage for each 64 words.
    x, content, bounds, _ = quality.training_bags(spark.createDataFrame([(1, ROWS[9][1], 1)], "doc_id long, text string, quality int"), ["quality"])
    assert len(x) == len(content) == bounds[-1] == -(-len(ROWS[9][1].split()) // quality.PASSAGE_WORDS)


def test_quality_held_out(spark, sf):
    from relgraph.llm.common import table

    rows = quality.op9_attention_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out and quality is not null").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.2, 0.2, 0.2], 500)
    tokens = rng.integers(1, 900, 500)
    df = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p)], "tokens long, posterior array<double>")
    have = tokens @ p
    targets = have * np.array([1.3, 0.5, 0.8])
    steps = mixing.fit_rates(df, targets, 8.0)
    r = mixing.replayed(p, steps, 8.0)
    assert (r >= 0).all() and np.allclose((tokens * r) @ p, targets, rtol=2e-3)
    out = mixing.with_rates(df, steps, 8.0).collect()
    assert np.allclose(sorted(x.rate for x in out), sorted(r))


def test_mixing_bears_all_rows(clashing, labels):
    out = mixing.mix(clashing, labels).collect()
    assert bag((r.doc_id, r.text) for r in out) == bag((r[0], r[1]) for r in ROWS)
    assert all(r.rate >= 0 and r.copies >= 0 and abs(sum(r.posterior) - 1) < 1e-6 for r in out)
    assert mixing.mixed_documents(clashing, labels).columns == clashing.columns


def test_mixing_keeps_clashing_columns(documents, labels):
    mine = documents
    for c in ("tokens", "posterior", "rate", "copies", "__n", "row"):
        mine = mine.withColumn(c, F.concat(F.lit(f"my {c} "), F.coalesce("lang", F.lit("?"))))
    out = mixing.mixed_documents(mine, labels, targets={"clean": 0.9, "toxic": 0.1}, most=1.0, anchor="clean")
    assert out.schema.simpleString() == mine.schema.simpleString() and out.count() > 0
    assert {tuple(r) for r in out.drop("text").collect()} <= {tuple(r) for r in mine.drop("text").collect()}


def test_free_domain_and_anchor(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.dirichlet([30, 0.3, 0.2], 400), rng.dirichlet([0.3, 20, 0.2], 80), rng.dirichlet([0.5, 0.5, 20], 20)])
    tokens = rng.integers(1, 900, len(p))
    df = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p)], "tokens long, posterior array<double>")
    for asked in (0.05, 0.0001):  # within reach; below what the clean documents hold
        goal = mixing.anchored_goal(df, np.array([1 - asked, asked, np.nan]), 0, 1.0)
        r = mixing.replayed(p, mixing.fit_rates(df, goal, 1.0), 1.0)
        got = (tokens * r) @ p
        clean = p.argmax(1) == 0
        floor = (tokens[clean] @ p[clean])[1]
        assert np.allclose(got[:2], goal[:2], rtol=2e-3) and r[clean].mean() > 0.99
        if asked == 0.05:
            assert abs(got[1] / got[:2].sum() - asked) < 1e-3
        else:
            assert got[1] <= floor * 1.2


def test_posteriors_by_hand(clashing, labels):
    model = mixing.fit_domains(clashing, labels)
    rows = clashing.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = bag((r.doc_id, r.tokens, tuple(round(x, 5) for x in r.posterior)) for r in mixing.domain_posteriors(rows, model).collect())
    expected = Counter()
    for doc_id, text, *_ in ROWS:
        maker = mixing.DocumentFeatures()
        dense, _, bucket, counts = maker.rows([text or ""])
        x = [1.0, *((dense[0] - model.mean) / model.scale)] + [float(b in {model.place[i] for i in bucket if model.place[i] >= 0}) for b in range(int(model.place.max()) + 1)]
        e = [sum(a * w for a, w in zip(x, column)) for column in np.asarray(model.weights, float).T]
        z = [math.exp(v - max(e)) for v in e]
        expected[doc_id, int(counts[0]), tuple(round(v / sum(z), 5) for v in z)] += 1
    assert sum((got & expected).values()) >= len(ROWS) - 1  # a last digit may round either way


# No rows.


def test_empty_tables(empty, labels, tokenizer):
    none = labels.limit(0)
    assert sharding.two_pass_shuffle(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    assert minhash.minhash_fingerprints(empty).count() == 0
    assert katz.katz_scores(empty, F.col("doc_id") % 10 == 0).count() == 0
    assert packing.packed_documents(empty, tokenizer).count() == 0
    assert quality.score_quality(empty, quality.fit_quality(empty, none)).count() == 0
    assert mixing.mix(empty, none).count() == 0


def test_digest_columns(spark, sf):
    out = sharding.op10_two_pass_shuffle(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out)
