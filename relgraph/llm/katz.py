"""Katz backoff language model over words, with tables partitioned by word.

p(w | v) = d(c) c(v w) / c(v) where the pair was seen in training, else a(v) p(w); p(w) is the
additively smoothed unigram of the base score. d are Good-Turing discounts up to count 5 (and a
thousandth off above, so that each context keeps mass to back off with); a(v) is exact:
(1 - sum of discounted p(w | v)) / (1 - sum of p(w)) over the words seen after v.

One shuffle moves the corpus: each token goes, with its predecessor and its document's place in a
group, to the partition of its word, as compressed arrays. There counts are whole, so a document's
seen pairs are scored there; what a context's backoff weight needs is summed by context in a second,
smaller step, and the pairs that back off (of held-out documents only) are joined to it. Words above
a share of the corpus are spread over all partitions by their predecessor; there are few by
definition, and their counts are broadcast.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_shuffles, materialise, table, text_or_empty, trim_memory

CUT = 5
ABOVE = 1e-3
#: Tokens in a partition and in a group of documents, at the mean.
PART_TOKENS, GROUP_TOKENS = 2_000_000, 1_000_000
#: Words above a share of a sample are hot: HOT_SHARE or, as the corpus grows, what fills half a partition, but never below
#: LEAST_SHARE, so there are at most half a million. The sample, of bounded size, only chooses them; their counts are exact.
HOT_SHARE, LEAST_SHARE, HOT_SAMPLE, MOST_SAMPLE = 0.004, 2e-6, 500, 20_000
END, START = b"\n</s>", b"\n<s>"  # no word holds a line feed


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, 9) for w in words], np.uint64)


def sealed(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(pickle.dumps(arrays, 5))


def opened(blob: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def small(x: np.ndarray) -> np.ndarray:
    """x in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def sample_counts(documents: DataFrame, rows: int, of: int) -> Counter:
    """Token counts of about ``rows`` of all ``of`` documents, from everywhere in the table."""
    share = int(min(1.0, rows / max(of, 1)) * (1 << 30))
    picked = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)) < share
    some = documents.filter(picked).select(text_or_empty("text").cast("binary").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                c.update(tokens(t.as_py()))
        # A word seen once says nothing about its share.
        kept = [(w, n) for w, n in c.items() if n > 1 or w == END]
        rest = sum(c.values()) - sum(n for _, n in kept)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept] + [None], pa.binary()), pa.array([n for _, n in kept] + [rest], pa.int64())], ["w", "n"])

    return Counter({r.w if r.w is None else bytes(r.w): r.n for r in some.mapInArrow(count, "w binary, n long").collect()})


def hot_words(documents: DataFrame) -> list[bytes]:
    """END and the words that fill half a partition or more by their share of a bounded sample (at least those above
    HOT_SHARE, never those below LEAST_SHARE)."""
    rows_in_all = documents.count()
    found = sample_counts(documents, HOT_SAMPLE, rows_in_all)
    total, docs = sum(found.values()), found[END]
    if not docs:
        return [END]
    everything = rows_in_all * total / docs
    share = max(LEAST_SHARE, min(HOT_SHARE, PART_TOKENS / 2 / everything))
    rows = min(MOST_SAMPLE, int(20 / share * docs / total))
    if rows > HOT_SAMPLE:
        found = sample_counts(documents, rows, rows_in_all) or found
    least = share * sum(found.values())
    return sorted({END} | {w for w, n in found.items() if w is not None and n > least})


def corpus_counts(documents: DataFrame, hot: list[bytes]) -> tuple[int, int, int, dict[bytes, int]]:
    """All tokens; training tokens and documents; the exact training count of each hot word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(hot)}
        sums = np.zeros(len(hot) + 3, np.int64)
        for b in batches:
            for t, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = tokens(t)
                sums[-3] += len(own)
                if not held:
                    sums[-2] += len(own)
                    sums[-1] += 1
                    for w, n in Counter(own).items():
                        if w in place:
                            sums[place[w]] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int64()), pa.array(sums)], ["k", "n"])

    rows = documents.select(text_or_empty("text").cast("binary").alias("t"), "held_out").mapInArrow(count, "k long, n long")
    found = {r.k: r.n for r in rows.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    get = lambda i: found.get(i, 0)
    return get(len(hot)), get(len(hot) + 1), get(len(hot) + 2), {w: get(i) for i, w in enumerate(hot)}


class Places(dict):
    """Numbers words as they come; START is 0."""

    def __init__(self) -> None:
        super().__init__({START: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def deal(documents: DataFrame, hot: list[bytes], parts: int) -> DataFrame:
    """(part, grp, blob): the pairs of each group of documents for each partition, and at a part below 0 the group's documents."""
    hot_hashes = np.sort(word_hashes(hot))

    def emit(grp: int, docs: list, place: Places, codes: list[np.ndarray], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        known = word_hashes(list(place))
        order = np.argsort(known, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        known = known[order]
        second = rank[np.concatenate(codes)]
        size = np.array(sizes, np.int64)
        starts = np.cumsum(size) - size
        first = np.concatenate([[0], second[:-1]])
        first[starts] = rank[0]
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        held = np.array([d[1] for d in docs], bool)
        is_hot = np.isin(known, hot_hashes)
        part = (known % np.uint64(parts)).astype(np.int64)[second]
        spread = ((known >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)[first]
        part = np.where(is_hot[second], (part + spread) % parts, part)
        key = second << 32 | first
        del second, first, spread
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(part[order].astype(np.uint16 if parts < 65536 else np.int64), kind="stable")]
        key, doc, part = key[order], doc[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        out = [(-1 - grp % 1_000_003, sealed([d[0] for d in docs], held, size))]
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            k, d = key[cuts[p] : cuts[p + 1]], doc[cuts[p] : cuts[p + 1]]
            new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            uses = np.diff(np.concatenate([new, [len(k)]]))
            train = np.add.reduceat((~held[d]).astype(np.int64), new)
            pair2, pair1 = k[new] >> 32, k[new] & 0xFFFFFFFF
            seconds, times = np.unique(pair2, return_counts=True)
            # Documents ascend within a pair: differences are small numbers.
            step = np.diff(d, prepend=0)
            step[new] = d[new]
            out.append((p, sealed(len(size), known[seconds], small(times), known[pair1], small(uses), small(train), small(step))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([grp] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["part", "grp", "blob"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        grp = TaskContext.get().partitionId() << 24
        docs, place, codes, sizes, total = [], Places(), [], [], 0
        for b in batches:
            for name, text, held in zip(*b.columns):
                name, own, held = name.as_py(), tokens(text.as_py()), held.as_py()
                docs.append((name, held))
                codes.append(np.fromiter(map(place.__getitem__, own), np.int32, len(own)))
                sizes.append(len(own))
                total += len(own)
                if total >= GROUP_TOKENS:
                    yield from emit(grp, docs, place, codes, sizes)
                    grp, docs, place, codes, sizes, total = grp + 1, [], Places(), [], [], 0
                    trim_memory()
        if docs:
            yield from emit(grp, docs, place, codes, sizes)
        trim_memory()

    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty("text").cast("binary").alias("text"), "held_out")
    return rows.mapInArrow(run, "part int, grp long, blob binary")


COUNTED = "kind int, grp long, blob binary, word long, doc int, n long, types long, c1 long, c2 long, c3 long, c4 long, c5 long, c6 long, above long"
#: Groups whose sums travel together: 16 of one scan partition.
GROUPS_BITS = 4
KIND_DOCS, KIND_SUMS, KIND_CONTEXT, KIND_BACKOFF, KIND_TOTALS = range(5)


def counted_rows(kind: int, rows: int, **columns) -> pa.Table:
    names = [c.split() for c in COUNTED.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns["kind"] = np.full(rows, kind)
    return pa.table({c: pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(rows, kinds[t]) for c, t in names})


def count_partition(t: pa.Table, hot: dict[int, int]) -> pa.Table:
    """What one word partition knows: document sums by group, context sums, pairs that back off, counts of counts."""
    out = []
    grps, blobs = t.column("grp").to_pylist(), t.column("blob").to_pylist()
    if t.column("part")[0].as_py() < 0:
        return counted_rows(KIND_DOCS, len(grps), grp=grps, blob=blobs)
    seconds, firsts, trains, uses, docs, sizes = [], [], [], [], [], []
    for blob in blobs:
        n, second, times, first, use, train, step = opened(blob)
        second = np.repeat(second, times)
        new = np.cumsum(use.astype(np.int64)) - use
        total = np.cumsum(step.astype(np.int64))
        # Undo the differences: each pair's begin anew.
        docs.append((total - np.repeat(total[new] - step[new], use)).astype(np.int32))
        for have, x in ((seconds, second), (firsts, first), (trains, train.astype(np.int64)), (uses, use.astype(np.int64))):
            have.append(x)
        sizes.append(n)
    lengths = [len(x) for x in seconds]
    second, first, train = np.concatenate(seconds), np.concatenate(firsts), np.concatenate(trains)
    del seconds, firsts, trains
    order = np.lexsort((first, second))
    s2, s1 = second[order], first[order]
    del second, first
    new2 = np.concatenate([[True], s2[1:] != s2[:-1]])
    new = np.flatnonzero(new2 | np.concatenate([[True], s1[1:] != s1[:-1]]))
    pair_count = np.add.reduceat(train[order], new)
    pair_of = np.empty(len(order), np.int32)
    pair_of[order] = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [len(order)]])))
    starts2 = np.flatnonzero(new2)
    word_count = np.add.reduceat(train[order], starts2)
    words = s2[starts2]
    del s2, train, order
    names = np.array(sorted(hot), np.uint64)
    at = np.searchsorted(names, words)
    is_hot = names[np.minimum(at, len(names) - 1)] == words
    word_count[is_hot] = np.array([hot[int(x)] for x in words[is_hot]], np.int64)
    vocabulary = int((word_count[~is_hot] > 0).sum())
    pair_word = np.searchsorted(starts2, new, side="right") - 1
    c2 = word_count[pair_word]
    end = word_hashes([END])[0]
    is_end = words[pair_word] == end
    with np.errstate(divide="ignore"):
        base = np.log10(c2 + 0.1)
        score = np.where(pair_count > 0, np.log10(np.maximum(pair_count, 1)), base) - np.where((c2 > 0) & ~is_end, np.log10(np.maximum(c2, 1)), 0)
    cls = np.where(pair_count == 0, 0, np.minimum(pair_count, CUT + 1))
    back, sums = [], {}
    upto = np.cumsum([0, *lengths])
    for i, grp in enumerate(grps):
        pairs = np.repeat(pair_of[upto[i] : upto[i + 1]], uses[i])
        doc, n = docs[i], sizes[i]
        # Only of documents that have a token here: what is written follows the tokens, not documents x partitions.
        here, at = np.unique(doc, return_inverse=True)
        count = lambda m: small(np.bincount(at[m], minlength=len(here)))
        own = cls[pairs]
        classes = [count(own == r) for r in range(CUT + 2)]
        sums.setdefault(grp >> GROUPS_BITS, []).append(
            (grp, small(np.diff(here, prepend=0)), np.bincount(at, base[pairs]), np.bincount(at, score[pairs]), count(c2[pairs] > 0), *[c if c.any() else None for c in classes])
        )
        m = own == 0
        if m.any():
            k, times = np.unique(pairs[m] * n + doc[m], return_counts=True)
            back.append((np.full(len(k), grp), s1[new][k // n], k % n, times))
    for parts in sums.values():
        out.append(counted_rows(KIND_SUMS, 1, grp=[parts[0][0]], blob=[sealed(*parts)]))
    if back:
        g, w, d, n = (np.concatenate(x) for x in zip(*back))
        out.append(counted_rows(KIND_BACKOFF, len(g), grp=g, word=w.view(np.int64), doc=d, n=n))
    seen = np.flatnonzero(pair_count > 0)
    seen = seen[np.argsort(s1[new][seen], kind="stable")]
    if len(seen):
        context, c, follow = s1[new][seen], pair_count[seen], c2[seen]
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        each = lambda x: np.add.reduceat(x.astype(np.int64), at)
        out.append(
            counted_rows(
                KIND_CONTEXT, len(at), word=context[at].view(np.int64), n=each(follow), types=each(c > 0), above=each(np.where(c > CUT, c, 0)),
                **{f"c{r}": each(c == r) for r in range(1, CUT + 1)},
            )
        )
    totals = {f"c{r}": [int((pair_count == r).sum())] for r in range(1, CUT + 2)}
    out.append(counted_rows(KIND_TOTALS, 1, n=[vocabulary], **totals))
    return pa.concat_tables(out)


def discounts(n: list[int]) -> list[float]:
    """Good-Turing ratios of counts 1 to CUT from the numbers of pairs seen 1 to CUT+1 times (Katz's form); where
    they leave (0, 1), as on tiny corpora, half a count is taken off instead. Last, the ratio above."""
    out = [1 - 0.5 / r for r in range(1, CUT + 1)]
    if all(n) and (x := (CUT + 1) * n[CUT] / n[0]) < 1:
        found = [((r + 1) * n[r] / (r * n[r - 1]) - x) / (1 - x) for r in range(1, CUT + 1)]
        if all(0 < d < 1 for d in found):
            out = found
    return [*out, 1 - ABOVE]


def katz_scores(documents: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out is a Column; the model learns from the other rows. Null texts are empty: the end token
    alone. Rows with a null doc_id count as held out if the column says so or is null; repeated rows are
    documents of their own; an empty table gives no rows; other columns are not read."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    hot = hot_words(docs)
    all_tokens, n, train_docs, hot_counts = corpus_counts(docs, hot)
    parts = max(1, math.ceil(all_tokens / PART_TOKENS))
    by_hash = {int(h): hot_counts[w] for h, w in zip(word_hashes(hot), hot)}
    dealt = deal(docs, hot, parts)

    def count(t: pa.Table) -> pa.Table:
        try:
            return count_partition(t, by_hash)
        finally:
            trim_memory()

    counted = materialise(dealt.groupBy("part").applyInArrow(count, COUNTED), "katz", by=["kind"])
    free_shuffles(spark)
    of = lambda kind: counted.filter(F.col("kind") == kind)
    totals = of(KIND_TOTALS).agg(F.sum("n"), *[F.sum(f"c{r}") for r in range(1, CUT + 2)]).first()
    vocabulary = (totals[0] or 0) + sum(c > 0 for c in hot_counts.values())
    d = discounts([x or 0 for x in totals[1:]])
    z = n + 0.1 * (vocabulary + 1)
    # Backoff weights by context.
    freed = sum((F.col(f"c{r}") * r * (1 - d[r - 1]) for r in range(1, CUT + 1)), F.col("above") * (1 - d[CUT]))
    count_of = sum((F.col(f"c{r}") * r for r in range(1, CUT + 1)), F.col("above"))
    contexts = of(KIND_CONTEXT).select("word", freed.alias("freed"), count_of.alias("count"), (F.col("n") + 0.1 * F.col("types")).alias("mass"))
    contexts = contexts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("freed", "count", "mass")])
    # log10 of the weight times the context's count, which every pair's score was divided by.
    weight = F.log10("freed") - F.log10(1 - F.col("mass") / z)
    backed = of(KIND_BACKOFF).join(contexts.select("word", weight.alias("weight")), "word").groupBy("grp", "doc").agg(F.sum(F.col("n") * F.col("weight")).alias("x"))
    rows = of(KIND_DOCS).unionByName(of(KIND_SUMS)).select("kind", "grp", "blob", F.lit(None).cast("int").alias("doc"), F.lit(None).cast("double").alias("x"))
    rows = rows.unionByName(backed.select(F.lit(KIND_BACKOFF).alias("kind"), "grp", F.lit(None).cast("binary").alias("blob"), "doc", "x"))
    log_d, log_z, first = [math.log10(x) for x in d], math.log10(z), math.log10(train_docs) if train_docs else 0.0

    def score(t: pa.Table) -> pa.Table:
        kinds, blobs, grps = t.column("kind").to_numpy(), t.column("blob"), t.column("grp").to_numpy()
        have = {}
        for i in np.flatnonzero(kinds == KIND_DOCS).tolist():
            ids, held, size = opened(blobs[i].as_py())
            have[int(grps[i])] = ids, held, size, -size * log_z, np.full(len(size), -first), np.zeros(len(size), np.int64)
        for i in np.flatnonzero(kinds == KIND_SUMS).tolist():
            for grp, step, b, s, k, unseen, *seen in opened(blobs[i].as_py()):
                here = np.cumsum(step.astype(np.int64))
                _, _, _, base, total, known = have[int(grp)]
                base[here] += b
                known[here] += k
                total[here] += s
                for r, m in zip((-log_z, *log_d), (unseen, *seen)):
                    if m is not None:
                        total[here] += m.astype(float) * r
        at = np.flatnonzero(kinds == KIND_BACKOFF)
        doc, x = t.column("doc").to_numpy()[at].astype(np.int64), t.column("x").to_numpy()[at]
        out = []
        for grp, (ids, held, size, base, total, known) in have.items():
            own = grps[at] == grp
            total += np.bincount(doc[own], x[own], len(size)) if own.any() else 0
            columns = {
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(size), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(size), n), pa.int64()), "base_score": pa.array(base), "score": pa.array(total),
            }
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    groups = rows.withColumn("groups", F.shiftright("grp", GROUPS_BITS)).groupBy("groups")
    return groups.applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    return katz_scores(table(spark, sf_dir, "documents"), held)
