"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is
indexed: its list, the length of its residual, and a byte for each subspace of the residual's
direction, and what scales the vector to its true length, so that near copies are told apart
as finely as far vectors. A query visits the lists
whose centroids have the largest inner product with it, ranks their vectors by asymmetric
distance tables (centroid term plus one table entry for each code), and the best of those
are fetched and ranked again by the exact inner product in double precision. How many lists
it visits and how many it ranks again is calibrated: as few as give the wanted recall for a
bounded set of pilot queries, whose true neighbours are found by one pass over all vectors. So
clustered vectors need a small and shrinking share of the lists, and vectors without structure
as many as they must. Only codes move to the queries; vectors move once for each candidate that
is reranked. Lists are put together or cut into groups of bounded size, and queries come in
blocks, so no task holds a whole hot list. A group gives its share of a query's best first; where
what it held back could be among them, it is asked again for all of them.

Equal vectors are indexed once, and searched for once. A query has at most its own vector besides
its k nearest others, so of rows with equal vectors the k+1 of smallest vec_id are all that a
result can name: the copies cost no candidates, and ties between them are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import done_with, materialise, table

#: The fit reads so many vectors, chosen by a hash of vec_id, or SAMPLE_LIST for each list if that is more; there are at most MOST_LISTS.
SAMPLE_ROWS, SAMPLE_LIST, MOST_LISTS = 20_000, 16, 16_384
CODES = 256
#: Queries whose exact neighbours decide how many lists are visited, and the share of these neighbours that the lists must hold.
PILOTS, WANTED = 200, 0.95
#: The share of what the visited lists hold of these neighbours that must be among the candidates ranked exactly.
RANKED = 0.97
#: Vectors in a group of lists, and queries that meet them in one task.
GROUP_ROWS, BLOCK_QUERIES = 16_384, 1024
EVERY = 20


@dataclass
class IvfPq:
    """The fitted index: centroids (lists x d) and codebooks (subspaces x codes x d/subspaces)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of the residuals' directions, the residuals' lengths, and what scales the vector so told to its true length."""
        directions, lengths = unit(x - self.centroids[lists])
        codes = np.stack([nearest(p, c) for p, c in zip(split(directions, len(self.codebooks)), self.codebooks)], 1)
        told = self.centroids[lists] + np.concatenate([c[i] for c, i in zip(self.codebooks, codes.T)], 1) * lengths[:, None]
        true, own = unit(x)[1], unit(told)[1]
        return codes.astype(np.uint8), lengths.astype(np.float32), np.where(own > 0, true / np.where(own > 0, own, 1), 1)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The lists with the largest inner products of centroid and query (ties: the smaller)."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Queries x subspaces x codes: the inner product of each part of a query with each code."""
        return np.stack([part @ book.T for part, book in zip(split(q, len(self.codebooks)), self.codebooks)], 1).astype(np.float32)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows scaled to length one (zero stays zero), and their lengths."""
    lengths = np.sqrt((x * x).sum(1))
    return x / np.where(lengths > 0, lengths, 1)[:, None], lengths


def by_tables(base: np.ndarray, tables: np.ndarray, codes: np.ndarray, lengths: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Queries x vectors: the centroid terms and, by the tables, those of the residuals, together scaled to the vectors' true lengths."""
    score = np.zeros((len(tables), len(codes)), np.float32)
    for s in range(codes.shape[1]):
        score += tables[:, s][:, codes[:, s]]
    return (base + score * lengths) * scales


def split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by Euclidean distance, in slices that bound the memory."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 8192] @ centres.T, axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """k centres by Lloyd's steps from distinct random rows; an empty centre moves to a random row."""
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    centres = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(steps):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int, seed: int = 11) -> IvfPq:
    rng = np.random.default_rng(seed)
    while sample.shape[1] % subspaces:
        subspaces -= 1
    centroids = kmeans(sample, lists, rng)
    directions, lengths = unit(sample - centroids[nearest(sample, centroids)])
    books = []
    for part in split(directions[lengths > 0] if lengths.any() else directions, subspaces):
        book = kmeans(part, CODES, rng, 8)
        books.append(np.concatenate([book, np.repeat(book[-1:], CODES - len(book), 0)]))
    return IvfPq(centroids, np.stack(books))


def list_groups(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each list and the number of groups it is cut into."""
    first, cuts, group, room = [], [], -1, 0
    for n in sizes:
        if n > GROUP_ROWS:
            cuts.append(-(-n // GROUP_ROWS))
            first.append(group + 1)
            group, room = group + cuts[-1], 0
        else:
            if n > room or group < 0:
                group, room = group + 1, GROUP_ROWS
            first.append(group)
            cuts.append(1)
            room -= n
    return np.array(first), np.array(cuts)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v): rows whose vector is not null, zero, or with null or non-finite components, and
    has the commonest length; the rest take no part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    if v.schema["v"].dataType.elementType.simpleString() != "float":  # a float's double is exact: it is made where it is read
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(finite & F.exists("v", lambda x: x != 0))
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("v") == (lengths.d if lengths else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(name: np.ndarray, ids: np.ndarray, score: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Positions of the best rows of each name (a number), k[name] of them: largest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, name))
    own = name[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(own)]])))
    return order[place < k[own]]


def distinct_vectors(v: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (vec_id, v, row), a class being the rows of one vector, named by its first row in the order of vec_id and row:

    the members (class, vec_id, row, n, v) that a result can name, the first k+1 of each class (v with the first and the last of these only),
    and the queries (class, vec_id, row), all of them."""
    keyed = v.withColumn("h", F.xxhash64("v"))
    order = Window.partitionBy("h", "v").orderBy("vec_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = keyed.withColumn("class", F.first("row").over(order)).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    members = materialise(first.withColumn("v", F.when(F.col("n").isin(1, k + 1), F.col("v"))).select("class", "vec_id", "row", "n", "v", "h"), "members")
    full = members.filter(F.col("n") == k + 1).select("class", "h", "v", F.struct("vec_id", "row").alias("last"))
    # Queries of a class of more than k+1 rows, behind its members.
    behind = keyed.filter(F.col("vec_id") % every == 0).join(full, ["h", "v"]).filter(F.struct("vec_id", "row") > F.col("last"))
    columns = ["class", "vec_id", "row"]
    queries = members.filter(F.col("vec_id") % every == 0).select(*columns).unionByName(behind.select(*columns))
    return members.drop("h"), materialise(queries, "queries")


def true_neighbours(inverted: DataFrame, pilots: list, k: int) -> list:
    """(pilot, row, list) of the pilots' k nearest vectors, found by one pass over all vectors."""
    if not pilots:
        return []
    rows, q = np.array([r.row for r in pilots]), np.array([r.v for r in pilots], np.float64)

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x, at = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2)
            if not len(own):
                continue
            score = q @ x.T
            score[rows[:, None] == own[None, :]] = -np.inf
            top = np.argpartition(-score, min(k, len(own)) - 1, axis=1)[:, :k]
            n, top = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(score[n, top]), b.column(0).take(pa.array(top)), at.take(pa.array(top))], ["pilot", "score", "row", "list"])

    found = inverted.select("row", "v", "list").mapInArrow(nearest_of, "pilot int, score double, row long, list int")
    order = Window.partitionBy("pilot").orderBy(F.desc("score"), "row")
    # k rows for each of PILOTS queries.
    return found.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= k) & (F.col("score") > float("-inf"))).select("pilot", "row", "list").collect()


def calibrated_probes(inverted: DataFrame, index: IvfPq, pilots: list, k: int, true: list | None = None) -> int:
    """The fewest lists that hold WANTED of the pilots' k nearest vectors (``true``, if they are known)."""
    lists = len(index.centroids)
    true = true_neighbours(inverted, pilots, k) if true is None else true
    if not true:
        return lists
    place = np.argsort(index.probes(np.array([r.v for r in pilots], np.float64), lists), axis=1)
    at = np.sort([place[r.pilot, r.list] for r in true])
    return int(at[min(len(at) - 1, math.ceil(WANTED * len(at)) - 1)]) + 1


def calibrated_rerank(inverted: DataFrame, index: IvfPq, pilots: list, true: list, probes: int, least: int) -> int:
    """The fewest candidates (``least`` or more) that, ranked by the tables, hold RANKED of the pilots' true neighbours in visited lists.
    One pass over all codes counts what is ranked before each of them."""
    if not true:
        return least
    rows, q = np.array([r.row for r in pilots]), np.array([r.v for r in pilots], np.float64)
    base, tables = q @ index.centroids.T, index.tables(q)
    visited = np.zeros((len(q), len(index.centroids)), bool)
    np.put_along_axis(visited, index.probes(q, probes), True, 1)
    named = inverted.sparkSession.createDataFrame([(i,) for i in sorted({r.row for r in true})], "row long")
    code = {r.row: r for r in inverted.join(F.broadcast(named), "row").select("row", "codes", "length", "scale").collect()}
    marks: list[list[float]] = [[] for _ in pilots]
    for r in true:
        if visited[r.pilot, r.list]:
            c = code[r.row]
            codes, length = np.frombuffer(c.codes, np.uint8)[None], np.array([c.length], np.float32)
            marks[r.pilot].append(by_tables(base[r.pilot, r.list].reshape(1, 1), tables[r.pilot : r.pilot + 1], codes, length, np.array([c.scale]))[0, 0])
    levels = [np.sort(m) for m in marks]

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = [np.zeros(len(m) + 1, np.int64) for m in levels]
        for b in batches:
            own, at, lengths, scales = (b.column(i).to_numpy() for i in (0, 1, 3, 4))
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(own), -1)
            for i in range(0, len(own), 2048):
                part = slice(i, i + 2048)
                score = by_tables(base[:, at[part]], tables, codes[part], lengths[part], scales[part])
                counted = visited[:, at[part]] & (rows[:, None] != own[None, part])
                for p, m in enumerate(levels):
                    above[p] += np.bincount(np.searchsorted(m, score[p, counted[p]]), minlength=len(m) + 1)
        # A vector of place i is above the first i levels.
        out = [(p, j, int(n)) for p, c in enumerate(above) for j, n in enumerate(np.cumsum(c[::-1])[::-1][1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64()))], ["pilot", "level", "n"])

    if not any(marks):
        return least
    counts = inverted.select("row", "list", "codes", "length", "scale").mapInArrow(before, "pilot int, level int, n long")
    # A row for each true neighbour of PILOTS queries.
    places = sorted(r.n + 1 for r in counts.groupBy("pilot", "level").agg(F.sum("n").alias("n")).collect())
    return max(least, places[math.ceil(RANKED * len(places)) - 1])


def search(
    vectors: DataFrame, every: int = EVERY, k: int = 20, lists: int | None = None, probes: int | None = None, subspaces: int = 32, rerank: int = 100, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the k rows found with the
    largest inner product, itself excepted (all there are, if fewer), ties to the smaller vec_id.

    Every row is a candidate for every other, repeated vec_ids too: a row that repeats a query's vec_id is found under that id, and each
    of several query rows of one vec_id has its ranks. vec_id may be of any whole type. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do those of another length than the commonest, with which no inner product is defined.
    ``lists`` defaults to twice the square root of the distinct vectors, up to MOST_LISTS; ``probes``, the lists that a query visits, is
    calibrated unless it is given, and a query visits more where these hold too few vectors. The ``rerank`` best vectors of a query by the
    tables, or more if the pilots need them, are ranked exactly."""
    v = materialise(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    members, queries = distinct_vectors(v, every, k)
    done_with(v)
    # From here a row is a class of equal vectors.
    distinct = members.filter(F.col("n") == 1).select("vec_id", "v", "row")
    rows = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    lists = lists or max(1, min(MOST_LISTS, int(2 * math.sqrt(rows))))
    sample_rows = max(sample_rows, SAMPLE_LIST * lists)
    sample = np.array([r.v for r in distinct.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample_rows).select("v").collect()], np.float64)
    index = fit(sample, lists, subspaces)
    del sample
    lists = len(index.centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1))
            own = index.lists(x)
            codes, lengths, scales = index.encode(x, own)
            told = [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lengths), pa.array(scales)]
            yield pa.RecordBatch.from_arrays([*b.columns, *told], ["vec_id", "v", "row", "list", "codes", "length", "scale"])

    kind = v.schema["v"].dataType.simpleString()
    inverted = materialise(distinct.mapInArrow(place, f"vec_id long, v {kind}, row long, list int, codes binary, length float, scale double"), "inverted")
    asked = materialise(inverted.join(queries.select(F.col("class").alias("row")).distinct(), "row", "left_semi").select("vec_id", "row", "v"), "asked")
    pilots = asked.orderBy(F.xxhash64("vec_id", "row"), "row").limit(PILOTS).select("row", "v").collect()
    true = true_neighbours(inverted, pilots, k)
    probes = min(calibrated_probes(inverted, index, pilots, k, true) if probes is None else probes, lists)
    rerank = calibrated_rerank(inverted, index, pilots, true, probes, rerank)
    # A row for each list (MOST_LISTS at most): neighbouring lists share a group of bounded size, a large list has several.
    sizes = {r.list: r.n for r in inverted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(lists)])
    first, cuts = list_groups(held.tolist())
    query_blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))

    def visited(q: np.ndarray) -> np.ndarray:
        """Queries x lists: the best ``probes``, and the next ones until they hold the query and ``rerank`` others."""
        order = index.probes(q, lists)
        n = np.maximum(probes, (np.cumsum(held[order], 1) <= rerank).sum(1) + 1)
        out = np.zeros((len(q), lists), bool)
        np.put_along_axis(out, order, np.arange(lists) < n[:, None], 1)
        return out

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ids = b.column("list").to_numpy(), b.column("row").to_numpy()
            mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((first[own] + mixed.astype(np.int64) % cuts[own]).astype(np.int32))], [*b.schema.names, "group"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, len(whole), 128)):
                for i, chosen in enumerate(visited(matrix(b.column(1)))):
                    groups = np.unique(np.concatenate([first[c] + np.arange(cuts[c]) for c in np.flatnonzero(chosen)])).astype(np.int32)
                    taken = b.take(pa.array(np.full(len(groups), i)))
                    # First a group's share of the best, and four deviations more; what it holds back is asked for where it may count.
                    share = rerank / max(1, len(groups))
                    kept = np.full(len(groups), min(rerank, math.ceil(share + 4 * math.sqrt(share))), np.int32)
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(groups), pa.array(kept)], ["query", "q", "group", "kept"])

    block = F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("block")
    asked_q = asked.select(F.col("row").alias("query"), F.col("v").alias("q"))
    going = asked_q.mapInArrow(visits, f"query long, q {kind}, group int, kept int").select("*", block)
    coded = ["row", "list", "codes", "length", "scale"]
    codes = inverted.select(*coded).mapInArrow(grouped, "row long, list int, codes binary, length float, scale double, group int")

    def near(queries: pa.Table, items: pa.Table) -> pa.Table:
        out = [], [], [], []
        if len(queries) and len(items):
            own = items.column("list").to_numpy()
            order = np.argsort(own, kind="stable")
            own = own[order]
            ids, lengths, scales = (items.column(c).to_numpy()[order] for c in ("row", "length", "scale"))
            packed = np.frombuffer(b"".join(items.column("codes").to_pylist()), np.uint8).reshape(len(items), -1)[order]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            names, all_q, kept = queries.column("query").to_numpy(), matrix(queries.column("q")), queries.column("kept").to_numpy()
            for i in range(0, len(names), 128):
                q, name, most = all_q[i : i + 128], names[i : i + 128], kept[i : i + 128]
                chosen, base, tables = visited(q), q @ index.centroids.T, index.tables(q)
                score = np.full((len(q), len(own)), -np.inf)
                for a, b in zip(cut, cut[1:]):
                    some = np.flatnonzero(chosen[:, own[a]])
                    if len(some):
                        score[some, a:b] = by_tables(base[some, own[a], None], tables[some], packed[a:b], lengths[a:b], scales[a:b])
                score[name[:, None] == ids[None, :]] = -np.inf
                there = score > -np.inf
                # As many as are kept and what equals the last of these.
                last = len(own) - min(len(own), int(most.max()))
                who, at = np.nonzero(there & (score >= np.partition(score, last, axis=1)[:, last, None]))
                best = best_of(who, ids[at], score[who, at], most)
                by, at = who[best], at[best]
                # The last that a group gives, if it holds back others.
                more = np.append(by[1:] != by[:-1], True)[: len(by)] & (there.sum(1) > most)[by]
                for column, x in zip(out, (name[by], ids[at], score[by, at], more)):
                    column.append(x)
        kinds = (np.int64, np.int64, np.float64, bool)
        told = {c: np.concatenate([np.zeros(0, t), *x]).astype(t) for c, x, t in zip(("query", "row", "near", "more"), out, kinds)}
        at = {c: np.full(len(told["query"]), queries.column(c)[0].as_py() if len(queries) else 0, np.int32) for c in ("group", "block")}
        return pa.table(told | at)

    def met(going: DataFrame, everywhere: bool) -> DataFrame:
        """The best of what the groups give each query that goes to them; a group goes to the blocks that visit it."""
        if everywhere:
            here = codes.withColumn("block", F.lit(0))
        else:
            wanted = going.select(F.col("group").alias("to_group"), F.col("block").alias("to_block")).distinct()
            here = codes.join(wanted, F.col("group") == F.col("to_group")).select(*coded, "group", F.col("to_block").alias("block"))
        told = "query long, row long, near double, more boolean, group int, block int"
        found = going.groupBy("group", "block").cogroup(here.groupBy("group", "block")).applyInArrow(near, told)
        return best_candidates(found)

    def best_candidates(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("near"), "row")
        return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rerank)

    best = materialise(met(going, query_blocks == 1), "best")
    # What a group holds back comes after the last it gave: it counts only if that is among the best, and not the last of them.
    short = best.filter(F.col("more") & (F.col("r") < rerank)).select("query", "group", "block")
    chosen = best.select("query", "row")
    if not short.isEmpty():
        again = short.join(asked_q, "query").select("query", "q", "group", F.lit(rerank).alias("kept"), "block")
        rest = best.join(short.select("query", "group"), ["query", "group"], "left_anti")
        columns = ["query", "row", "near"]
        chosen = best_candidates(rest.select(*columns).unionByName(met(again, False).select(*columns))).select("query", "row")
    # Exactly, on the vectors of the reranked few and the query's own, which its copies have.
    chosen = chosen.unionByName(asked.select(F.col("row").alias("query"), "row"))
    pairs = chosen.join(inverted.select("row", "vec_id", "v"), "row").join(asked_q, "query")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.einsum("ij,ij->i", matrix(b.column(3)), matrix(b.column(4))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(score)], ["query", "row", "vec_id", "score"])

    scored = pairs.select("query", "row", "vec_id", "v", "q").mapInArrow(exact, "query long, row long, vec_id long, score double")
    # k+1 vectors by their first rows, then k+1 rows: the k nearest of any query row of this vector, and itself.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    top = scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("query", F.col("row").alias("class"), "score")
    named = top.join(members.select("class", "vec_id", "row"), "class").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    nearest_rows = named.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "row", "score"))).alias("near"))
    out = queries.select(F.col("class").alias("query"), F.col("vec_id").alias("query_id"), "row").join(nearest_rows, "query")
    ranked = out.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
