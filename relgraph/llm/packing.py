"""Best-fit packing of tokenised documents, certified by lower bounds.

Texts become token ids once per distinct chunk of a batch (the tokenizer never joins
across ASCII white space). Documents longer than a sequence are cut into pieces; full
pieces fill a sequence each. The rest are dealt by hash to partitions of a fixed size,
each packed by best-fit decreasing and compared with lower bounds from dual-feasible
functions. A partition that meets its bound is final; those with a gap exchange their
documents by another hash and are packed again, and the new packing is kept if it needs
fewer sequences: until all meet their bounds or an exchange wins nothing.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import materialise, table, text_or_empty, trim_memory

CAPACITY = 2048
#: Pieces in a packing partition, at the mean.
PART_ROWS = 50_000
#: Distinct chunks that a worker remembers, and bytes of text that it cuts at a time.
CACHE, SLICE_BYTES = 600_000, 2 << 20
#: Chunks encoded in one call; only chunks whose letters fold one to one and compose no further, and no special token.
PART_CHUNKS = 64
LETTER_MARK = re.compile(rb"([a-z])([.,])(?=[ \n])")
PLAIN = re.compile("(?!.*<[|])[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017e]+")
#: The tokenizer's pre-tokens (a fixed value of its vocabulary file).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class ChunkTokenizer:
    """Ids of texts by way of their chunks: runs without ASCII white space, which the tokenizer drops and never crosses."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        # Number 0 is the end of a document: the single id 0.
        self.known: dict[bytes | None, int] = {None: 0}
        self.flat, self.starts, self.lengths = np.zeros(1, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _encode_parts(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and number of ids of many plain chunks at once: each pre-token ends in one id of a word's end."""
        parts = [" ".join(plain[i : i + PART_CHUNKS]) for i in range(0, len(plain), PART_CHUNKS)]
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        ends = np.flatnonzero(self.word_end[ids])
        tokens = np.cumsum([1 if c.isalpha() else len(PRE_TOKEN.findall(c.lower())) for c in plain])
        if tokens[-1] != len(ends) or ends[-1] != len(ids) - 1:
            return None
        return ids, np.diff(ends[tokens - 1], prepend=-1)

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        plain = [i for i, c in enumerate(texts) if PLAIN.fullmatch(c)]
        found = self._encode_parts([texts[i] for i in plain]) if plain else None
        parts, lengths = ([found[0]], [found[1]]) if found else ([], [])
        alone = sorted(set(range(len(texts))).difference(plain)) if found else list(range(len(texts)))
        for i in alone:
            own = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            parts.append(own)
            lengths.append(np.array([len(own)]))
        ordered = [chunks[i] for i in (plain if found else []) + alone]
        new = np.concatenate(lengths).astype(np.int64)
        base = len(self.flat)
        self.known.update(zip(ordered, range(len(self.lengths), len(self.lengths) + len(new))))
        self.starts = np.concatenate([self.starts, base + np.cumsum(new) - new])
        self.lengths = np.concatenate([self.lengths, new])
        self.flat = np.concatenate([self.flat, *parts])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by 0, and where each text's begin and the last end."""
        if len(self.known) > CACHE:
            self.forget()
            trim_memory()
        words: list[bytes | None] = []
        ends = []
        for t in texts:
            # The tokenizer folds case and cuts between letter and mark; where a special token may stand, its spelling counts.
            words += (t if b"<|" in t else LETTER_MARK.sub(rb"\1 \2", t.lower())).split()
            words.append(None)
            ends.append(len(words))
        codes = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(codes < 0).tolist()):
            self._learn(list({words[i] for i in missing}))
            codes[missing] = [self.known[words[i]] for i in missing]
        lengths = self.lengths[codes]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[codes] - upto[:-1], lengths) + np.arange(upto[-1])
        return self.flat[at], np.concatenate([[0], upto[np.asarray(ends, np.int64)]])


@functools.lru_cache(2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of texts of such sizes, of about ``limit`` bytes."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def tokenised_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece; a null text is empty: the id 0 alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.binary_length(texts).to_pylist()):
                ids, bounds = encoder.encode(texts.slice(a, b - a).to_pylist())
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = bounds[row] + start
                data = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(row)),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([data[4 * x : 4 * (x + n)] for x, n in zip(at.tolist(), length.tolist())], pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )
        # Only the tokenizer itself outlives a task: its worker goes on to other stages.
        encoder.forget()
        trim_memory()

    docs = documents.select("doc_id", text_or_empty("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each piece's bin and place in it, and the number of bins: longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    room = 0  # bit r: a bin with room r is open
    made = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = room >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                room &= ~(1 << r)
        else:
            r, b = capacity, made
            made += 1
        bins[i], places[i] = b, capacity - r
        left = r - n
        if left:
            free[left].append(b)
            room |= 1 << left
    return bins, places, made


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins from three families of dual-feasible functions.

    The identity; for each e up to half the capacity, pieces over capacity-e count as whole bins
    and those under e as nothing; and for k up to 20, x counts as x where (k+1)x is a multiple of
    the capacity, else as floor((k+1)x/capacity) k-ths of a bin."""
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int(counts @ x) // capacity)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    e = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    if len(e):
        best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 21):
        f = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int(counts @ f) // (capacity * k)))
    return best


def packer(turn: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """What packs one partition in one round and states its number of bins and its bound on each row."""

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("__u")
        lengths = t.column("length").to_numpy()
        bins, places, made = best_fit_decreasing(lengths, capacity)
        part = t.column("__part").to_numpy().astype(np.int64)
        more = {
            "sequence_id": (turn << 52) + (part << 24) + bins,
            "offset": places,
            "__bins": np.full(len(part), made),
            "__bound": np.full(len(part), lower_bound(lengths, capacity)),
        }
        for k, v in more.items():
            t = t.append_column(k, pa.array(v, pa.int64()))
        return t

    return fit


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """pieces (with ``length`` from 1 to capacity) with sequence_id, offset and bound_gap.

    bound_gap is how many sequences the piece's partition has above its lower bound: 0 where the packing is certified.

    Any other columns pass through, nulls too; columns of those names are replaced. Repeated
    rows are pieces of their own. An empty table gives no rows. No partition ever holds more than
    its share of the rows: they are dealt by their number in the scan."""
    pieces = materialise(pieces.drop("sequence_id", "offset", "bound_gap"), "pieces")
    names = pieces.columns
    full = pieces.filter(F.col("length") == capacity).select(
        *names, F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("bound_gap")
    )
    rest = pieces.filter(F.col("length") != capacity).withColumn("__u", F.monotonically_increasing_id())
    left, done = rest.count(), []
    best_total, previous = None, None
    for turn in itertools.count():
        parts = max(1, math.ceil(left / part_rows))
        dealt = rest.withColumn("__part", F.pmod(F.xxhash64(F.lit(turn), "__u"), F.lit(parts)).cast("int"))
        schema = T.StructType([*dealt.schema.fields, *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "__bins", "__bound")]])
        placed = materialise(dealt.groupBy("__part").applyInArrow(packer(turn, capacity), schema), "packed")
        each = placed.groupBy("__part").agg(F.first("__bins").alias("b"), F.first("__bound").alias("l"), F.count(F.lit(1)).alias("n"))
        gap = F.col("b") > F.col("l")
        total, open_parts, open_bins, left = each.agg(
            F.sum("b"), F.sum(gap.cast("int")), F.sum(F.when(gap, F.col("b"))), F.sum(F.when(gap, F.col("n")))
        ).first()
        if best_total is not None and total >= best_total:
            done.append(previous)  # the exchange won nothing: the earlier packing stands
            break
        # Each further exchange has won a sequence at least, so the rounds end; one partition has none to exchange with.
        if (open_parts or 0) < 2:
            done.append(placed)
            break
        done.append(placed.filter("__bins <= __bound"))
        previous, best_total = placed.filter("__bins > __bound"), open_bins
        rest = previous.select(*names, "__u")
    out = full
    for x in done:
        out = out.unionByName(x.select(*names, "sequence_id", "offset", (F.col("__bins") - F.col("__bound")).alias("bound_gap")))
    return out


def packed_documents(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, bound_gap of every piece of documents.

    The ids themselves are digested before they move; write ``tokenised_pieces`` to keep them."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    digests = tokenised_pieces(documents, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bound_gap")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
