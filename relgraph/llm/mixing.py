"""Soft-membership mixing to target weights.

A classifier learned from the labelled table gives each document a posterior over domains
(clean, toxic, junk). Rates r >= 0, one a document, are fitted by projected gradient so that
the expected tokens of each domain, sum of rate x tokens x posterior, come nearest to their
targets by weighted least squares. Only as many numbers as there are domains travel in a
step: a document's rate follows from its posterior and the steps so far, so rates are
replayed where the documents are. The first steps are found on sums over cells of similar
posteriors, which are a few thousand however many documents there are; then every step is of
all documents. A document is then repeated floor(rate + u) times, with u a hash of it in [0, 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import materialise, table, text_or_empty, trim_memory
from .quality import FEATURES, PassageFeatures, labelled_sample, text_slices

DOMAINS = ("clean", "toxic", "junk")
TARGETS = {"clean": 0.90, "toxic": 0.02, "junk": 0.08}
#: Bounds of the fit: labelled documents (chosen by hash), hashed words, and of these the ones that the model reads
#: (those that tell most, by chi-square).
SAMPLE_ROWS, BUCKETS, CHOSEN = 12_000, 1 << 16, 512
#: Characters of a word's beginning that are a feature of their own.
STEM = 4
#: A fit ends when no domain's residual, or no domain's change in a step, is above this share of its tokens
#: (on cells, where steps cost nothing, a smaller share).
TOLERANCE, STILL = 1e-4, 1e-6
#: Cells of the posterior histogram along one domain.
CELLS = 128


class DocumentFeatures(PassageFeatures):
    """Means and maxima of a document's passage features, and which hashed words occur."""

    def forget(self) -> None:
        super().forget()
        self.buckets = np.zeros((0, 2), np.int64)

    def learn(self, new: list[str]) -> None:
        import xxhash

        super().learn(new)
        plain = [w.lower().strip(".,;:!?\"'()") for w in new]
        hashed = [xxhash.xxh32_intdigest(x) % BUCKETS for w in plain for x in (w, f"{w[:STEM]}*")]
        self.buckets = np.concatenate([self.buckets, np.array(hashed, np.int64).reshape(-1, 2)])

    def rows(self, texts: list[str], read: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Dense rows, (document, bucket) occurrences without repeats, and the number of words of each text;
        only of the buckets where ``read`` holds, if it is given."""
        codes, counts = self.coded(texts)
        x, bounds = self.passages(codes, counts)
        starts, sizes = bounds[:-1], np.diff(bounds)[:, None]
        dense = np.concatenate([np.add.reduceat(x, starts) / sizes, np.maximum.reduceat(x, starts)], 1)
        doc = np.repeat(np.arange(len(texts)), counts)
        if read is not None:
            some = read[self.buckets].any(1)[codes]
            codes, doc = codes[some], doc[some]
        pairs = np.unique(doc[:, None] * BUCKETS + self.buckets[codes])
        return dense, pairs // BUCKETS, pairs % BUCKETS, counts


class DomainModel:
    """Softmax regression on standardised dense features and the presence of chosen words."""

    def __init__(self, k: int = len(DOMAINS)):
        self.place = np.full(BUCKETS, -1, np.int64)
        self.mean, self.scale = np.zeros(2 * FEATURES), np.ones(2 * FEATURES)
        self.weights = np.zeros((2 * FEATURES + 1, k))

    def design(self, dense: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        n = len(self.weights) - 2 * FEATURES - 1
        present = np.zeros((len(dense), n), np.float32)
        at = self.place[bucket]
        present[doc[at >= 0], at[at >= 0]] = 1
        return np.concatenate([np.ones((len(dense), 1), np.float32), ((dense - self.mean) / self.scale).astype(np.float32), present], 1)

    def posteriors(self, dense: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        e = self.design(dense, doc, bucket) @ self.weights
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def fit(self, dense: np.ndarray, doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.05) -> DomainModel:
        """The words are those whose presence differs most between a domain and the rest (by chi-square); then Adam.
        With no labels the posterior is even."""
        k = self.weights.shape[1]
        if not len(y):
            return self
        seen = np.stack([np.bincount(bucket[y[doc] == c], minlength=BUCKETS) for c in range(k)], 1).astype(float)
        total, size = seen.sum(1), np.bincount(y, minlength=k).astype(float)
        expected = total[:, None] * size / len(y)
        chi = np.where(total >= 5, ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).max(1), 0)
        chosen = np.flatnonzero(chi > 10)
        chosen = chosen[np.argsort(-chi[chosen], kind="stable")][:CHOSEN]
        self.place[chosen] = np.arange(len(chosen))
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-2
        self.weights = np.zeros((2 * FEATURES + 1 + len(chosen), k), np.float32)
        x, wanted = self.design(dense, doc, bucket), np.eye(k, dtype=np.float32)[y]
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            e = x @ self.weights
            e = np.exp(e - e.max(1, keepdims=True))
            d = x.T @ ((e / e.sum(1, keepdims=True) - wanted) / np.float32(len(y))) + np.float32(1e-4) * self.weights
            m, v = (0.9 * m + 0.1 * d).astype(np.float32), (0.99 * v + 0.01 * d * d).astype(np.float32)
            self.weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def fit_domains(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DomainModel:
    """Domain of a labelled document: toxic if it is marked so, else junk if its quality is 0, else clean."""
    sample = labelled_sample(documents, labels, ["quality", "toxic"], rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = DocumentFeatures()
        for b in batches:
            for first, texts in text_slices(b.column(1)):
                n = len(texts)
                dense, doc, bucket, _ = maker.rows(texts)
                cuts = np.searchsorted(doc, np.arange(n + 1))
                words = [bucket[p:q].astype("<u2").tobytes() for p, q in zip(cuts, cuts[1:])]
                own = [b.column(i).slice(first, n) for i in (0, 2, 3)]
                packed = [r.tobytes() for r in dense.astype("<f4")]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(packed, pa.binary()), pa.array(words, pa.binary()), *own[1:]], ["doc_id", "x", "w", "quality", "toxic"])
        del maker
        trim_memory()

    kinds = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in ("quality", "toxic"))
    found = sample.mapInArrow(features, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, x binary, w binary, {kinds}").collect()
    found.sort(key=lambda r: (r.doc_id, r.x))
    dense = np.array([np.frombuffer(r.x, "<f4") for r in found], np.float64).reshape(-1, 2 * FEATURES)
    words = [np.frombuffer(r.w, "<u2").astype(np.int64) for r in found]
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words]) if words else np.zeros(0, np.int64)
    y = np.array([1 if r.toxic else 0 if r.quality else 2 for r in found], np.int64)
    return DomainModel().fit(dense, doc, np.concatenate(words) if words else np.zeros(0, np.int64), y)


def domain_posteriors(rows: DataFrame, model: DomainModel) -> DataFrame:
    """rows (with ``text``, read as empty where null) without the text, with tokens (words) and posterior (array)."""
    at = rows.columns.index("text")
    names = [c for c in rows.columns if c != "text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = DocumentFeatures()
        for b in batches:
            for first, texts in text_slices(b.column(at)):
                dense, doc, bucket, counts = maker.rows(texts, model.place >= 0)
                p = model.posteriors(dense, doc, bucket)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.astype(np.float64).ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(first, len(p)) for c in names], pa.array(counts), lists], [*names, "tokens", "posterior"])
        del maker
        trim_memory()

    kept = [rows.schema[c] for c in names]
    return rows.mapInArrow(predict, T.StructType([*kept, T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]))


def replayed(p: np.ndarray, steps: list[np.ndarray], most: float) -> np.ndarray:
    """The rates of documents with posteriors p after the steps: each moves a rate by its posterior and projects it to [0, most]."""
    r = np.ones(len(p))
    for s in steps:
        r = np.clip(r - p @ s, 0, most)
    return r


def posterior_matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k)


def gradient(now: np.ndarray, goal: np.ndarray, have: np.ndarray) -> np.ndarray:
    """One number a domain: its residual over the tokens that it has, 0 where the goal is nan (a free domain)."""
    return np.where(np.isnan(goal), 0.0, np.divide(now - goal, have, out=np.zeros(len(now)), where=have > 0))


def fit_rates(posteriors: DataFrame, goal: np.ndarray, most: float) -> list[np.ndarray]:
    """The gradient steps, one number a domain each, from (tokens, posterior).

    Each domain's squared residual is divided by the tokens that it has, so that a full step is never too long
    (the tokens are the row sums of the normal matrix) and a target out of reach in a small domain does not
    turn the others; a document's own step is scaled by its tokens, so that its length does not decide its rate.
    The steps go on until the residuals or the changes vanish, however many that takes."""
    k, taken = len(goal), []
    have = domain_totals(posteriors, k)

    def totals() -> np.ndarray:
        done = list(taken)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(k)
            for b in batches:
                t, p = b.column(0).to_numpy().astype(float), posterior_matrix(b.column(1), k)
                sums += (t * replayed(p, done, most)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], [f"s{i}" for i in range(k)])

        parts = posteriors.select("tokens", "posterior").mapInArrow(run, ", ".join(f"s{i} double" for i in range(k)))
        return np.array([x or 0.0 for x in parts.agg(*[F.sum(f"s{i}") for i in range(k)]).first()])

    def still(now: np.ndarray, before: np.ndarray, share: float) -> bool:
        return not np.any(np.abs(now - before) > share * have)

    # On the cells: at most CELLS + 1 along each domain but the last.
    at = [F.floor(F.col("posterior")[i] * CELLS).alias(f"c{i}") for i in range(k - 1)]
    cells = posteriors.groupBy(*at).agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in range(k)]).filter("t > 0").collect()
    cells.sort(key=lambda x: tuple(x[: k - 1]))
    t = np.array([x.t for x in cells], float)
    p = np.array([[x[f"s{i}"] for i in range(k)] for x in cells], float).reshape(-1, k) / t[:, None]
    r = np.ones(len(t))
    now = (t * r) @ p
    while np.abs(step := gradient(now, goal, have)).max() >= TOLERANCE / 2:
        taken.append(step)
        r = np.clip(r - p @ step, 0, most)
        now, before = (t * r) @ p, now
        if still(now, before, STILL):
            break
    # On the documents.
    now = totals()
    while np.abs(step := gradient(now, goal, have)).max() >= TOLERANCE:
        taken.append(step)
        now, before = totals(), now
        if still(now, before, TOLERANCE):
            break
    return taken


def domain_totals(posteriors: DataFrame, k: int) -> np.ndarray:
    """Expected tokens of each domain."""
    return np.array([x or 0.0 for x in posteriors.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]) for i in range(k)]).first()])


def with_rates(posteriors: DataFrame, steps: list[np.ndarray], most: float) -> DataFrame:
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = replayed(posterior_matrix(b.column("posterior"), k), steps, most)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*b.schema.names, "rate"])

    return posteriors.mapInArrow(run, T.StructType([*posteriors.schema.fields, T.StructField("rate", T.DoubleType())]))


def uniform(seed: int, *columns: str) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def anchored_goal(posteriors: DataFrame, shares: np.ndarray, anchor: int, most: float) -> np.ndarray:
    """Domain totals in the shares (nan: a free domain) when all documents that are likeliest of the anchor keep a rate of 1.

    The rates of the others, one for each domain, follow from linear equations and are clipped to [0, most], so that the
    goal is within reach: where a share is not, the goal is the nearest that rates in bounds allow."""
    k = len(shares)
    largest = F.array_max("posterior")
    kind = F.coalesce(*[F.when(F.col("posterior")[i] == largest, i) for i in range(k)]).alias("kind")
    sums = posteriors.groupBy(kind).agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in range(k)])
    held = np.zeros((k, k))
    for x in sums.collect():
        held[x.kind] = [x[f"s{i}"] or 0.0 for i in range(k)]
    named = ~np.isnan(shares)
    others = [d for d in range(k) if d != anchor and named[d]]
    base = held[[d for d in range(k) if d not in others]].sum(0)
    ratio = shares / shares[anchor]
    a = np.array([[held[e, d] - ratio[d] * held[e, anchor] for e in others] for d in others]).reshape(len(others), len(others))
    rates = np.clip(np.linalg.lstsq(a, np.array([ratio[d] * base[anchor] - base[d] for d in others]), rcond=None)[0], 0, most)
    return np.where(named, base + rates @ held[others], np.nan)


def rated_rows(
    documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, most: float = 8.0, anchor: str | None = None, seed: int = 3
) -> DataFrame:
    """(row, tokens, posterior, rate, copies): the documents as structs, whatever their columns are called; see ``mix``."""
    model = fit_domains(documents, labels)
    rows = documents.select(F.struct(*documents.columns).alias("row"), text_or_empty("text").alias("text"))
    found = materialise(domain_posteriors(rows, model), "posteriors")
    shares = np.array([targets.get(d, np.nan) for d in DOMAINS]) / sum(targets.values())
    if anchor is not None:
        goal = anchored_goal(found, shares, DOMAINS.index(anchor), most)
    else:
        have = domain_totals(found, len(DOMAINS))
        goal = shares * (have[~np.isnan(shares)].sum() if budget is None else budget)
    rated = with_rates(found, fit_rates(found, goal, most), most)
    copies = F.floor(F.col("rate") + uniform(seed, "row.doc_id", "row.text")).cast("int")
    return rated.withColumn("copies", copies)


def mix(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """documents with tokens, posterior (array by DOMAINS), rate and copies.

    Targets are shares of ``budget`` expected tokens (default: as many as there are) over the domains that they name; a domain
    without a target is free. With an ``anchor`` the budget is instead that which leaves every document that is likeliest of that
    domain whole, and shares that rates in [0, most] cannot reach then give way to the nearest that they can.
    Null texts are empty and have no tokens; rows with null or repeated doc_id are fitted and
    drawn like any other (one row's copies differ from its repetition's only by their text); an empty
    table gives no rows. Columns of documents with those four names are replaced."""
    own = [c for c in documents.columns if c not in ("tokens", "posterior", "rate", "copies")]
    return rated_rows(documents, labels, **how).select(*[F.col(f"row.`{c}`") for c in own], "tokens", "posterior", "rate", "copies")


def mixed_documents(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents, each as often as its copies say; every column keeps its value and type, whatever its name.

    Nulls, repeats and empty tables as in ``mix``."""
    out = rated_rows(documents, labels, **how).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def reached_shares(rated: DataFrame) -> dict[str, float]:
    """Shares of expected tokens by domain, of rows with tokens, posterior and rate."""
    sums = rated.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.col("posterior")[i]) for i in range(len(DOMAINS))]).first()
    return {d: (x or 0.0) / (sum(y or 0.0 for y in sums) or 1.0) for d, x in zip(DOMAINS, sums)}


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    named = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return out.select("doc_id", "tokens", *named, "rate", "copies")
