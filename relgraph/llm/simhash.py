"""SimHash near-dedup with pivot distance tables.

A fingerprint's Hamming distances to many reference fingerprints are computed once. The
references come in two sets. The structured ones select: each of the 64 differs from the zero reference
in one bit of one of six blocks, so two fingerprints have the same relative distances to a
block's references just if they agree there; as at most ``RADIUS`` = 3 bits differ, they agree
in three blocks at least, and an equi-join on the relative distances of three blocks finds
every pair (it is a join on the bits of three blocks, read off as distances). The scattered references then discard pairs whose distances differ by more than
the radius in any coordinate (the triangle inequality), and the survivors' bits are compared.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import minhash
from .common import materialise, table, text_or_empty
from .components import connected_components

RADIUS = 3
SEED = 42
#: Blocks of bits (first, width): RADIUS differing bits leave BLOCKS - RADIUS of them alike.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
SCATTERED = [x - (1 << 64) if x >> 63 else x for x in (random.Random(7).getrandbits(64) for _ in range(8))]
#: Up to so many fingerprints of one key are joined as pairs; beyond that, blocks of BLOCK_ROWS are searched for links that span them.
PAIRS_UPTO, BLOCK_ROWS = 32, 4096
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(words: list[bytes], width: int) -> int:
    """The 64-bit SimHash of the word shingles, repeats included, as a signed number."""
    import xxhash

    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for first in range(0, n, SHINGLES_AT_ONCE):
        last = min(n, first + SHINGLES_AT_ONCE)
        part = words[first : last + width - 1]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(width)))] or [xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; null and empty texts have fingerprint zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.lower().split(), width) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    docs = documents.select("doc_id", text_or_empty("text").cast("binary").alias("text"))
    return docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def distances(fps: np.ndarray, references: list[int]) -> np.ndarray:
    """Hamming distance of every fingerprint (rows) to every reference."""
    return np.bitwise_count(fps.view("<u8")[:, None] ^ np.array([x & (2**64 - 1) for x in references], "<u8")).astype(np.int64)


def pivot_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the keys, which pack the relative distances to three blocks' references, and the
    distances to the scattered references, a byte each."""
    zero = distances(fps, [0])
    # d(x, 0) - d(x, one bit) is 1 or -1.
    relative = (zero - distances(fps, [1 << i for i in range(64)]) + 1) // 2
    blocks = [relative[:, first : first + width] @ (1 << np.arange(width)) for first, width in BLOCKS]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        key, at = np.full(len(fps), n), 5
        for i in chosen:
            key, at = key | blocks[i] << at, at + BLOCKS[i][1]
        keys.append(key)
    coordinates = np.ascontiguousarray(distances(fps, SCATTERED).astype(np.uint8)).view("<i8")[:, 0]
    return np.stack(keys, 1), coordinates


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, coordinates, key): a row for each key of each fingerprint."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            keys, coordinates = pivot_rows(own)
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.repeat(coordinates, n)), pa.array(keys.ravel())], ["fp", "coordinates", "key"])

    return fps.select("fp").mapInArrow(each, "fp long, coordinates long, key long")


def near_coordinates(a: Column, b: Column, radius: int) -> Column:
    """Whether no coordinate of two pivot rows differs by more than the radius."""
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    out = F.lit(True)
    for i in range(len(SCATTERED)):
        out = out & (F.abs(byte(a, i) - byte(b, i)) <= radius)
    return out


def spanning_links(fps: np.ndarray, coordinates: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links within the radius that connect all fingerprints which such links connect: one less than each class has."""
    fps, at = np.unique(fps, return_index=True)
    table = coordinates[at].astype("<i8").view(np.uint8).reshape(-1, 8).astype(np.int16)
    a, b = [], []
    while len(fps):
        stack = [(fps[0], table[0])]
        fps, table = fps[1:], table[1:]
        while stack and len(fps):
            x, place = stack.pop()
            near = np.flatnonzero(np.abs(table - place).max(1) <= radius)
            # Unsigned: of a negative number the bits of its magnitude would be counted.
            near = near[np.bitwise_count((fps[near] ^ x).view("<u8")) <= radius]
            if len(near):
                found = fps[near]
                a += [int(x)] * len(near)
                b += found.tolist()
                stack += list(zip(found, table[near]))
                keep = np.ones(len(fps), bool)
                keep[near] = False
                fps, table = fps[keep], table[keep]
    return a, b


def simhash_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at most ``radius`` bits, enough to connect
    all that such links connect. No link between different fingerprints is lost to a cap: keys that many
    fingerprints share are searched block against block."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the key tables find up to {RADIUS} differing bits")
    pivots = pivot_table(fps.select("fp").distinct())
    keyed = materialise(pivots, "pivot-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(keyed.join(sizes, "key"), "shared-keys")
    few = shared.filter(F.col("n") <= PAIRS_UPTO)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))).filter(
        near_coordinates(F.col("x.coordinates"), F.col("y.coordinates"), radius)
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
    )
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    many = shared.filter(F.col("n") > PAIRS_UPTO).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("fp", "coordinates", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def span(t: pa.Table) -> pa.Table:
        a, b = spanning_links(t.column("fp").to_numpy(), t.column("coordinates").to_numpy(), radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.unionByName(many.groupBy("key", "i", "j").applyInArrow(span, "a long, b long"))


def simhash_components(documents: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id that links reach, itself included.

    Null, empty and wordless texts share fingerprint zero and link like any other. Rows with a null
    doc_id take part and get their component's smallest id (null if it has none); repeated rows
    stay; other columns are not read; an empty table gives no rows."""
    docs = materialise(fingerprints(documents, width), "fingerprints")
    classes = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(simhash_links(classes, radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicate_links(texts: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between near-duplicate texts of (id, text), verified on their word shingles.

    Candidates are the fingerprints within the radius and, as a similarity of 0.8 leaves ten differing bits
    of 64 at the mean, which no key table reaches, the texts that share a band of MinHash signatures."""
    fps = materialise(
        fingerprints(texts.select(F.col("id").alias("doc_id"), "text"), width).filter("fp != 0").select(F.col("doc_id").alias("id"), "fp").distinct(), "text-fps"
    )
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    same = fps.join(least, "fp").select(F.col("id").alias("a"), F.col("least").alias("b"))
    links = simhash_links(fps.select("fp").distinct(), radius)
    links = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(
        least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b"
    )
    candidates = same.unionByName(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return minhash.verified_links(texts, width, similarity, candidates)


def drop_near_duplicates(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The document with the smallest doc_id of each group that equal texts and near-duplicate links connect.

    Columns keep their values, whatever their names. Null, empty and wordless texts group with texts of the same spelling only (null
    as empty); rows with a null doc_id come last in their group; of rows with one doc_id and text one stays;
    an empty table gives no rows. Links name a text by a 64-bit hash; should two texts share one (a second hash tells),
    one document of each stays, and neither goes for a link."""
    text = text_or_empty("text")
    texts = documents.select("doc_id", text.alias("text"), minhash.text_id(text).alias("id"), F.xxhash64(F.lit(1), text).alias("second"))
    roots = connected_components(near_duplicate_links(texts.select("id", "text"), width, similarity))
    # The row that stays: least (null last, doc_id, text id) of its component.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "second")
    classes = texts.groupBy("id", "second").agg(F.min(order).alias("best"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    classes = classes.withColumn("odd", F.when(shared, F.col("second")))
    best = classes.join(roots, classes["id"] == roots["node"], "left").groupBy(F.when(F.col("odd").isNull(), F.coalesce("root", "id")).otherwise(F.col("id")), "odd").agg(F.min("best").alias("best"))
    best = best.select(F.col("best.doc_id").alias("d"), F.col("best.id").alias("i"), F.col("best.second").alias("s"))
    named = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", minhash.text_id(text).alias("id"), F.xxhash64(F.lit(1), text).alias("second"))
    kept = named.join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("id") == F.col("i")) & (F.col("second") == F.col("s")), "left_semi")
    return kept.dropDuplicates(["doc_id", "id", "second"]).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
