"""MinHash fingerprints over word shingles, banded links and verified Jaccard similarity.

A shingle is hashed once; a signature is the minimum of many universal hash permutations
(multiply, add, keep the high bits) of those hashes, all in numpy. Signatures are cut into
bands; texts that share a band are candidates, joined in Spark, and their shingle sets decide.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .bloom import maybe_in
from .common import materialise, table, text_or_empty, trim_memory

PERMUTATIONS, BANDS = 120, 20  # six rows a band: a pair of similarity 0.8 is missed once in 400, one of 0.5 is found once in four
WIDTH, SIMILARITY = 5, 0.8
#: Up to so many texts of one band value are joined as pairs; beyond that, blocks of about BLOCK_SHINGLES are searched for spanning links.
PAIRS_UPTO, BLOCK_SHINGLES = 32, 1 << 19
_random = np.random.default_rng(20240601)
A = _random.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
ROWS_AT_ONCE = 256


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """XXH64 of each word shingle; of all words if there are fewer; nothing for no words."""
    import xxhash

    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], "<u8")
    return np.array([xxhash.xxh64_intdigest(b" ".join(s)) for s in zip(*(words[k:] for k in range(width)))], "<u8")


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each permutation, 32 bits; all ones for no shingles."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for first in range(0, len(hashes), ROWS_AT_ONCE):
        part = hashes[first : first + ROWS_AT_ONCE, None] * A
        part += B
        np.minimum(out, part.min(0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def text_words(text: bytes) -> list[bytes]:
    return text.lower().split()




def edited(own: str, following: str) -> str:
    """own with its last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


#: Bytes of text in a run of neighbouring documents that one task fingerprints.
RUN_BYTES = 16 << 20
#: Up to so many runs (12 bytes each) the rows that they lend are found by a broadcast; beyond that, by a shuffle.
BROADCAST_RUNS = 100_000


def neighbour_runs(documents: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(run, doc_id, text, borrowed): documents in runs of neighbouring doc_id, descending, and in each run
    the first document of the next run as a borrowed row (the last run borrows from the first).

    The bounds are quantiles of doc_id, a number for each run; the texts move once. Null texts are empty;
    null doc_ids make the last run."""
    docs = documents.select("doc_id", text_or_empty("text").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // run_bytes) + 1
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], min(100 * n, 1_000_000))).first()[0] if n > 1 else None
    bounds = np.unique(np.array(found or [], np.int64))
    last = len(bounds) + 1

    @F.pandas_udf(T.IntegerType())
    def place(ids):
        return (len(bounds) - pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left"))).astype("int32")

    def run_of(c: str) -> Column:
        return F.when(F.col(c).isNull(), last).otherwise(place(F.coalesce(F.col(c).cast("long"), F.lit(0))))

    ids = documents.select("doc_id").withColumn("run", run_of("doc_id"))
    firsts = ids.groupBy("run").agg(F.max("doc_id").alias("first"))
    # A row for each run: bounded by bytes of input over run_bytes.
    runs = sorted((r.run, r.first) for r in firsts.collect())
    spark = documents.sparkSession
    before = [(first, runs[i - 1][0]) for i, (_, first) in enumerate(runs)]
    lent_to = spark.createDataFrame(before, "first long, run int")
    lent_to = F.broadcast(lent_to) if len(before) <= BROADCAST_RUNS else lent_to
    own = docs.withColumn("run", run_of("doc_id")).withColumn("borrowed", F.lit(False))
    lent = docs.join(lent_to, docs["doc_id"].cast("long") == lent_to["first"]).select("doc_id", "text", "run", F.lit(True).alias("borrowed"))
    own = own.select("doc_id", "text", "run", "borrowed").unionByName(lent)
    nameless = [to for first, to in before if first is None]
    if nameless:
        lent = docs.filter("doc_id is null").select("doc_id", "text", F.lit(nameless[0]).alias("run"), F.lit(True).alias("borrowed"))
        own = own.unionByName(lent)
    return own.select("run", "doc_id", "text", "borrowed")


class Fingerprinted:
    """A text with its words and shingle hashes."""

    def __init__(self, text: str):
        self.text, self.data = text, text.encode()
        self.words = text_words(self.data)
        self.hashes = shingle_hashes(self.words)


def edited_signature(own: Fingerprinted, following: Fingerprinted, text: str, minima) -> np.ndarray:
    """The signature of own's edited text. Shingles that lie whole in the unchanged part of either text are
    not hashed again: minima(which, first, last) gives the signature of a run of own's or the following's."""
    words = text_words(text.encode())
    half = len(own.text) // 2
    # Words surely unchanged: all of own's part but its last, and of the following's part all but its first and last.
    k = max(0, len(text_words(own.text[: len(own.text) - half].encode())) - 1)
    c = max(0, len(text_words(following.text[:half].encode())) - 2)
    if min(k, c) < 2 * WIDTH or k + c > len(words):
        return signature(shingle_hashes(words))
    at = len(words) - 1 - c  # where the following's second word stands
    middle = shingle_hashes(words[k - WIDTH + 1 : at + WIDTH - 1])
    end = shingle_hashes(words[-WIDTH:])
    parts = [minima(0, 0, k - WIDTH + 1), minima(1, 1, 1 + c - WIDTH + 1), signature(middle), signature(end)]
    return np.minimum.reduce(parts)


def fingerprint_run(t: pa.Table) -> pa.Table:
    """The digest rows of one run of neighbours."""
    rows = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), t.column("borrowed").to_pylist()))
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1])
    own = sorted((r for r in rows if not r[2]), key=key, reverse=True)
    lent = max((r for r in rows if r[2]), key=key, default=own[0])
    out = defaultdict(list)
    order = own + [lent]
    current = Fingerprinted(order[0][1])
    whole = signature(current.hashes)
    for (doc_id, *_), (_, text, _) in zip(own, order[1:]):
        following = Fingerprinted(text)
        whole_next = signature(following.hashes)
        changed = edited(current.text, following.text)
        sig = edited_signature(current, following, changed, lambda w, a, b: signature((current, following)[w].hashes[a:b]))
        for name, value in (
            ("doc_id", doc_id),
            ("n_chars", len(current.text)),
            ("edited_sha256", hashlib.sha256(changed.encode()).hexdigest()),
            ("fingerprint", whole.tobytes().hex()),
            ("edited_fingerprint", sig.tobytes().hex()),
            ("near_edited", likeness(whole, sig)),
            ("near_next", likeness(whole, whole_next)),
        ):
            out[name].append(value)
        current, whole = following, whole_next
    kinds = {"doc_id": t.schema.field("doc_id").type, "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})


FINGERPRINT_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def minhash_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A fingerprint is the signature in hex. Null texts are empty and have a fingerprint of ones; a single
    document is its own next; repeated rows are neighbours; an empty table gives no rows; other columns
    are not read."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return neighbour_runs(documents).groupBy("run").applyInArrow(_run_rows, f"doc_id {kind}, {FINGERPRINT_COLUMNS}")


def _run_rows(t: pa.Table) -> pa.Table:
    if not any(not x for x in t.column("borrowed").to_pylist()):
        return pa.table({"doc_id": t.column("doc_id").slice(0, 0), **{c.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64()}.get(c.split()[1], pa.string())) for c in FINGERPRINT_COLUMNS.split(", ")}})
    return fingerprint_run(t)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_fingerprints(table(spark, sf_dir, "documents"))


# Banded links.


def text_id(text: Column) -> Column:
    """What names a text in link tables: equal texts are one node."""
    return F.xxhash64(text)


def shingle_table(texts: DataFrame, width: int = WIDTH, bands: bool = True) -> DataFrame:
    """(id, words, bands array<long>) from (id, text): words is the number of distinct shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = PERMUTATIONS // BANDS
        for batch in batches:
            sizes, values = [], []
            for x in batch.column(1):
                h = shingle_hashes(x.as_py().lower().split(), width)
                sizes.append(len(h))
                s = signature(h).astype(np.uint64).reshape(BANDS, rows)
                mixed = np.full(BANDS, 0x9E3779B97F4A7C15, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(rows):
                    mixed = (mixed ^ s[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    mixed ^= mixed >> np.uint64(29)
                values.append(mixed.view(np.int64))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists], ["id", "shingles", "bands"])
        trim_memory()

    return texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(each, "id long, shingles long, bands array<long>")


def shingle_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, s array<long>): the distinct shingle hashes of each text, ascending."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py().lower().split(), width)).view(np.int64) for x in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "s"])
        trim_memory()

    return texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(each, "id long, s array<long>")


def spanning_jaccard(ids: list[int], sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links of at least ``similarity`` that connect all texts which such links connect.

    One inverted index over the block; a text's overlaps with all others are one count over its postings."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, codes = np.unique(flat, return_inverse=True)
    order = np.argsort(codes, kind="stable")
    posted, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(values)))])
    upto = np.concatenate([[0], np.cumsum(sizes)])
    open_, a, b = np.ones(len(sets), bool), [], []
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first], stack = False, [first]
        while stack:
            x = stack.pop()
            mine = codes[upto[x] : upto[x + 1]]
            if not len(mine):
                continue
            shared = np.bincount(np.concatenate([posted[starts[c] : starts[c + 1]] for c in mine]), minlength=len(sets))
            near = np.flatnonzero(open_ & (shared >= similarity * (sizes + sizes[x] - shared) - 1e-9))
            open_[near] = False
            a += [ids[x]] * len(near)
            b += [ids[i] for i in near]
            stack += near.tolist()
    return a, b


def verified_links(documents: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, more: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of text ids whose shingle sets have a Jaccard similarity of at least ``similarity``, enough to
    connect all that the candidates connect.

    Candidates share a band of their signatures, or are rows of ``more`` (a, b). documents has (id, text); texts
    without words link to nothing here, as there is one such class by spelling. Bands that many texts share
    are searched block against block, never listed as pairs."""
    banded = shingle_table(documents, width).filter("shingles > 0").groupBy("id").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles"))
    keyed = materialise(banded.select("id", "shingles", F.explode("bands").alias("key")), "bands")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("weight")).filter("n > 1")
    shared = materialise(keyed.join(sizes, "key"), "shared-bands")
    few = shared.filter(F.col("n") <= PAIRS_UPTO)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    if more is not None:
        pairs = pairs.unionByName(more.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = materialise(pairs.distinct(), "candidates")
    many = shared.filter(F.col("n") > PAIRS_UPTO).select("id", "key", "weight")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(many.select("id")).distinct()
    # Thinned where the texts are read, so that few texts move; the join decides.
    wanted = materialise(wanted, "wanted")
    thin = documents.filter(maybe_in(wanted)(F.col("id")))
    rows = thin.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    sets = materialise(shingle_sets(rows, width), "shingle-sets")
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = with_b.filter(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")
    many = many.withColumn("blocks", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int")).withColumn("own", F.pmod(F.col("id"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("id", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "id")

    def span(t: pa.Table) -> pa.Table:
        column = t.column("s").combine_chunks()
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        a, b = spanning_jaccard(t.column("id").to_pylist(), [flat[p:q] for p, q in zip(ends, ends[1:])], similarity)
        trim_memory()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links.unionByName(many.groupBy("key", "i", "j").applyInArrow(span, "a long, b long"))
