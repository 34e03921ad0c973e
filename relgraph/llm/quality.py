"""Quality classifier: gated attention over passages (multiple-instance learning).

A document is a bag of passages of 64 words; its label holds for the bag, not for any one
passage. Each passage is encoded by a small learned layer from its word shapes, its repetitions
and its content: hashed words and hashed character trigrams. Gated attention (a tanh and a
sigmoid branch, multiplied) weighs the passages; the weighted mean representation is scored.
Everything is learned from document labels, by gradient descent in numpy on a bounded sample of
documents, of each of which all passages are read; every passage of every document is scored.
The layer is linear before its tanh, so a word's content is projected once for each distinct word.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, text_or_empty, trim_memory

PASSAGE_WORDS = 64
#: Labelled documents to learn from, chosen by hash: the first bound of the fit.
SAMPLE_ROWS = 6000
#: Bytes of text in that sample: documents, in hash order, that would pass this are left out whole, never cut.
SAMPLE_BYTES = 96 << 20
#: Hash buckets of words and of character trigrams.
WORD_BUCKETS, GRAM_BUCKETS = 256, 256
CONTENT = WORD_BUCKETS + GRAM_BUCKETS
#: Weight decay of the content's part of the layer, besides the common one.
CONTENT_DECAY = 2e-3
THRESHOLD = 0.7
HIDDEN = 12
SLICE_BYTES = 1 << 20
WORD_FEATURES, FEATURES = 10, 15
#: Distinct words that a worker remembers, and new ones that it examines at once: their characters take many times their result.
KNOWN_WORDS, PART_WORDS = 200_000, 1 << 13


#: Class of a code point: other, upper-case letter, other letter, digit, plain mark.
OTHER, UPPER, LETTER, DIGIT, PLAIN = range(5)
CLASSES = np.array([UPPER if chr(c).isupper() else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else PLAIN if chr(c) in ".,;:?'\"()-" else OTHER for c in range(0x2000)], np.uint8)


def word_shapes(words: list[str]) -> np.ndarray:
    """A row for each word, from the classes of its characters; all words at once."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.full(len(points), LETTER, np.uint8)
    low = points < len(CLASSES)
    kinds[low] = CLASSES[points[low]]
    owner = np.repeat(np.arange(len(words)), n)
    counts = np.bincount(owner * 5 + kinds, minlength=5 * len(words)).reshape(-1, 5).astype(np.float32)
    letters = counts[:, UPPER] + counts[:, LETTER]
    size = n.astype(np.float32)
    return np.stack(
        [
            np.minimum(size, 40), letters / size, counts[:, DIGIT] / size, counts[:, OTHER] / size, counts[:, OTHER] > 0, (letters > 1) & (counts[:, UPPER] == letters),
            counts[:, UPPER] > 0, letters == 0, counts[:, PLAIN] > 0, size > 20,
        ],
        1,
    ).astype(np.float32)


def content_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owners): each word's own bucket and those of the trigrams of ^word$ (ASCII case folded), all words at once."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(words)), n)
    place = (np.arange(len(points)) - np.repeat(starts, n)).astype(np.uint64)
    mix = lambda x: (x ^ x >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
    own = mix(np.add.reduceat(points * (place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), starts)) if len(words) else np.zeros(0, np.uint64)
    inside = np.flatnonzero(place[2:] >= 2) + 2
    grams = mix((points[inside - 2] * np.uint64(0x9E3779B1) + points[inside - 1]) * np.uint64(0x85EBCA77) + points[inside])
    buckets = np.concatenate([own % np.uint64(WORD_BUCKETS), WORD_BUCKETS + grams % np.uint64(GRAM_BUCKETS)]).astype(np.int64)
    owners = np.concatenate([np.arange(len(words)), owner[inside]])
    order = np.argsort(owners, kind="stable")
    return buckets[order], owners[order]


def word_parts(words: list[str]) -> Iterator[list[str]]:
    return (words[i : i + PART_WORDS] for i in range(0, len(words), PART_WORDS))


class PassageFeatures:
    """Feature rows of passages; each distinct word is examined once."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shapes = np.zeros((0, WORD_FEATURES), np.float32)

    def learn(self, new: list[str]) -> None:
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.shapes = np.concatenate([self.shapes, *map(word_shapes, word_parts(new))])

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words and how many each text has."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        words, counts = [], []
        for t in texts:
            own = t.split()
            counts.append(len(own))
            words += own
        codes = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(codes < 0).tolist()):
            self.learn(list({words[i] for i in missing}))
            codes[missing] = [self.known[words[i]] for i in missing]
        return codes, np.array(counts, np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all passages and where each text's begin and the last end; a wordless text has one row of zeros."""
        return self.passages(*self.coded(texts))

    def passages(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bags = np.maximum(1, -(-counts // PASSAGE_WORDS))
        bounds = np.concatenate([[0], np.cumsum(bags)])
        out = np.zeros((bounds[-1], FEATURES), np.float32)
        if len(codes):
            place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
            passage = np.repeat(bounds[:-1], counts) + place // PASSAGE_WORDS
            starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            rows = passage[starts]
            n = np.diff(np.concatenate([starts, [len(codes)]])).astype(np.float32)
            out[rows, :WORD_FEATURES] = np.add.reduceat(self.shapes[codes], starts) / n[:, None]
            again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])])
            out[rows, WORD_FEATURES] = np.add.reduceat(again.astype(np.float32), starts) / n
            pairs = np.sort(passage * len(self.known) + codes)
            distinct = np.concatenate([[True], pairs[1:] != pairs[:-1]])
            unique = np.bincount(pairs[distinct] // len(self.known), minlength=len(out))[rows]
            out[rows, WORD_FEATURES + 1] = unique / n
            out[rows, WORD_FEATURES + 2] = np.log1p(n)
            out[rows, WORD_FEATURES + 3] = np.log1p(np.repeat(counts, bags)[rows])
            out[rows, WORD_FEATURES + 4] = 1
            out[rows, 0] /= 10
        return out, bounds


class ContentFeatures(PassageFeatures):
    """Passage features with the content's share of the layer: ``layer`` (buckets x units), of which a word's rows are summed once."""

    def __init__(self, layer: np.ndarray):
        self.layer = layer.astype(np.float32)
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.projected = np.zeros((0, self.layer.shape[1]), np.float32)

    def learn(self, new: list[str]) -> None:
        super().learn(new)
        self.projected = np.concatenate([self.projected, *map(self.project, word_parts(new))])

    def project(self, words: list[str]) -> np.ndarray:
        buckets, owners = content_buckets(words)
        starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        return np.add.reduceat(self.layer[buckets], starts)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows of all passages, the mean projection of their words, and the bounds of the texts."""
        codes, counts = self.coded(texts)
        x, bounds = self.passages(codes, counts)
        content = np.zeros((len(x), self.layer.shape[1]), np.float32)
        if len(codes):
            starts, rows, n = passage_starts(counts, bounds)
            content[rows] = np.add.reduceat(self.projected[codes], starts) / n[:, None]
        return x, content, bounds


def passage_starts(counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the passages that have words begin among all words, their row numbers and their sizes."""
    total = int(counts.sum())
    place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = np.repeat(bounds[:-1], counts) + place // PASSAGE_WORDS
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    return starts, passage[starts], np.diff(np.concatenate([starts, [total]])).astype(np.float32)


class BucketCounts(PassageFeatures):
    """Passage features with how often each bucket of content occurs in a passage (up to 255): what the fit reads."""

    def forget(self) -> None:
        super().forget()
        self.flat, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        super().learn(new)
        found = [(buckets, np.bincount(owners, minlength=len(part))) for part in word_parts(new) for buckets, owners in [content_buckets(part)]]
        self.flat = np.concatenate([self.flat, *(buckets for buckets, _ in found)])
        self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in found)])

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, counts = self.coded(texts)
        x, bounds = self.passages(codes, counts)
        content = np.zeros((len(x), CONTENT), np.uint8)
        if len(codes):
            starts, rows, n = passage_starts(counts, bounds)
            first = np.cumsum(self.sizes) - self.sizes
            row = np.repeat(rows, n.astype(np.int64))
            for a in range(0, len(codes), 1 << 15):
                some = codes[a : a + (1 << 15)]
                size = self.sizes[some]
                upto = np.cumsum(size)
                at = np.arange(upto[-1]) - np.repeat(upto - size, size) + np.repeat(first[some], size)
                cell, times = np.unique(np.repeat(row[a : a + (1 << 15)], size) * CONTENT + self.flat[at], return_counts=True)
                have = content.reshape(-1)
                have[cell] = np.minimum(255, have[cell].astype(np.int64) + times)
        return x, content, bounds


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """h = tanh(Wx); a = softmax over a bag of w.(tanh(Vh) * sigmoid(Uh)); score = sigmoid(c.sum(a h) + b).

    x is a passage's FEATURES, then the mean number of its words in each of CONTENT buckets, both standardised."""

    SHAPES = {"W": (FEATURES + CONTENT, HIDDEN), "V": (HIDDEN, HIDDEN), "U": (HIDDEN, HIDDEN), "w": (HIDDEN, 1), "c": (HIDDEN, 1), "b": (1, 1)}

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES + CONTENT, np.float32), np.ones(FEATURES + CONTENT, np.float32)
        self.p = {k: rng.normal(0, 1 / np.sqrt(min(s[0], FEATURES)), s).astype(np.float32) for k, s in self.SHAPES.items()}
        self.p["W"][FEATURES:] *= 0.1

    def attend(self, before: np.ndarray, bounds: np.ndarray) -> tuple:
        """The forward pass from the layer's sums before its tanh."""
        p = self.p
        h = np.tanh(before)
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = ((t * g) @ p["w"])[:, 0]
        starts, sizes = bounds[:-1], np.diff(bounds)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, sigmoid(z @ p["c"] + p["b"])[:, 0]

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple:
        return self.attend(x @ self.p["W"], bounds)

    def content_layer(self) -> np.ndarray:
        """What a mean count of 1 in each bucket adds to the layer's sums."""
        return self.p["W"][FEATURES:] / self.scale[FEATURES:, None]

    def scores(self, x: np.ndarray, content: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """From FEATURES rows and projected content."""
        shift = (self.mean / self.scale) @ self.p["W"]
        return self.attend((x / self.scale[:FEATURES]) @ self.p["W"][:FEATURES] + content - shift, bounds)[-1]

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(bounds)
        h, t, g, a, z, s = self.forward(x, bounds)
        d = ((s - y) * weight)[:, None] / weight.sum()
        out = {"c": z.T @ d, "b": d.sum(0, keepdims=True)}
        dz = np.repeat(d @ p["c"].T, sizes, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bounds[:-1]), sizes))
        out["w"] = (t * g).T @ de[:, None]
        dtg = de[:, None] @ p["w"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        out["V"], out["U"] = h.T @ dt, h.T @ dg
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        out["W"] = x.T @ dh
        return out

    def fit(self, x: np.ndarray, content: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, least_steps: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> AttentionModel:
        """Adam over batches of bags, each with all its passages; both labels weigh the same in sum by half. content holds counts by
        bucket. With one label or none the score is its share."""
        if not len(y) or y.min() == y.max():
            self.p = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()}
            self.p["b"] += (4.0 if y[0] else -4.0) if len(y) else 1.0
            return self
        # A passage's words, from its own feature.
        words = np.maximum(1, np.rint(np.expm1(x[:, WORD_FEATURES + 2]))).astype(np.float32)
        sums = np.zeros((2, CONTENT))
        for i in range(0, len(x), 4096):
            c = content[i : i + 4096] / words[i : i + 4096, None]
            sums += c.sum(0), (c * c).sum(0)
        m, v = sums / len(x)
        self.mean = np.concatenate([x.mean(0), m]).astype(np.float32)
        # No bucket counts for more than one of a standard deviation of a fiftieth.
        self.scale = np.concatenate([x.std(0) + 1e-3, np.sqrt(np.maximum(v - m * m, 0)) + 0.02]).astype(np.float32)
        share = y.mean()
        weight = np.where(y == 1, 1 / np.sqrt(share), 1 / np.sqrt(1 - share)).astype(np.float32)
        m, v = ({k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()} for _ in "mv")
        rng, step = np.random.default_rng(seed), 0
        sizes = np.diff(bounds)
        epochs = max(epochs, -(-least_steps // max(1, -(-len(y) // batch))))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            now = rate * (1 - epoch / epochs) + rate / 20
            for i in range(0, len(y), batch):
                chosen = order[i : i + batch]
                n = sizes[chosen]
                upto = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(bounds[chosen] - upto[:-1], n) + np.arange(upto[-1])
                rows = np.concatenate([x[at], content[at] / words[at, None]], 1, dtype=np.float32)
                rows = (rows - self.mean) / self.scale
                step += 1
                for k, d in self.gradients(rows, upto, y[chosen], weight[chosen]).items():
                    d = d + np.float32(decay) * self.p[k]
                    if k == "W":
                        d[FEATURES:] += np.float32(CONTENT_DECAY) * self.p[k][FEATURES:]
                    m[k] = (0.9 * m[k] + 0.1 * d).astype(np.float32)
                    v[k] = (0.99 * v[k] + 0.01 * d * d).astype(np.float32)
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def text_slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of texts of about SLICE_BYTES, made of Arrow's one run at a time; a null text is empty."""
    first, size = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        size += n
        if size >= SLICE_BYTES or i == len(sizes) - 1:
            yield first, [t or "" for t in texts.slice(first, i + 1 - first).to_pylist()]
            first, size = i + 1, 0


def held_out(fold: int = 2, folds: int = 4):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """(doc_id, text, labels) of up to ``rows`` labelled documents (and SAMPLE_BYTES of text) outside the held-out fold, chosen by a
    hash of doc_id, each whole."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).na.drop(subset=columns).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` rows of numbers.
    sizes = documents.select("doc_id", F.octet_length(text_or_empty("text")).alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *columns).agg(F.sum("n").alias("n"))
    kept, total = [], 0
    for r in sorted(sizes.select("*", F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r.h, r.doc_id)):
        if total + r.n <= SAMPLE_BYTES:
            kept.append((r.doc_id, *[r[c] for c in columns]))
            total += r.n
    chosen = documents.sparkSession.createDataFrame(kept, chosen.schema)
    found = documents.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.select("doc_id", "text", *columns)


def training_bags(sample: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, content counts, bounds and labels of a sample, all passages of each; they are made where the texts are."""
    import zstandard

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seal = BucketCounts(), zstandard.ZstdCompressor(1)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                rows, content, bounds = maker.counted(texts)
                packed = [rows[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                counts = [seal.compress(content[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                own = [batch.column(i).slice(first, len(texts)) for i in (0, *range(2, 2 + len(columns)))]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(packed, pa.binary()), pa.array(counts, pa.binary()), *own[1:]], ["doc_id", "x", "c", *columns])
        del maker
        trim_memory()

    kinds = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in columns)
    rows = sample.mapInArrow(bags, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, x binary, c binary, {kinds}").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    each = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    x = np.concatenate(each) if each else np.zeros((0, FEATURES), np.float32)
    content = np.zeros((len(x), CONTENT), np.uint8)
    opened = zstandard.ZstdDecompressor()
    for r, a, b in zip(rows, bounds, bounds[1:]):
        content[a:b] = np.frombuffer(opened.decompress(r.c), np.uint8).reshape(-1, CONTENT)
    return x, content, bounds, np.array([[getattr(r, c) for c in columns] for r in rows], np.float32).reshape(-1, len(columns))


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AttentionModel:
    x, content, bounds, y = training_bags(labelled_sample(documents, labels, ["quality"], rows), ["quality"])
    return AttentionModel().fit(x, content, bounds, y[:, 0])


def scored_batches(batches: Iterator[pa.RecordBatch], model: AttentionModel, text_of: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.RecordBatch]:
    """The batches, each with a last column ``score``."""
    maker = ContentFeatures(model.content_layer())
    for batch in batches:
        out = [model.scores(*maker.encoded(texts)) for _, texts in text_slices(text_of(batch))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((np.concatenate(out) if out else np.zeros(0)).astype(np.float64))], [*batch.schema.names, "score"])
    del maker
    trim_memory()


def with_score(rows: DataFrame, model: AttentionModel, text_of: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    from pyspark.sql import types as T

    return rows.mapInArrow(lambda batches: scored_batches(batches, model, text_of), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def score_quality(documents: DataFrame, model: AttentionModel) -> DataFrame:
    """documents with ``score`` (replaced if it is there). Only the text is read: null and wordless texts are scored as an
    empty passage; other columns pass through, nulls and repeated rows too; an empty table gives no rows."""
    documents = documents.drop("score")
    at = documents.columns.index("text")
    return with_score(documents, model, lambda batch: batch.column(at))


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(documents, table(spark, sf_dir, "labels"))
    out = score_quality(documents, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject; columns as they are, whatever their names. Null texts are judged as empty
    ones; repeated rows are judged alike; an empty table gives no rows, and without labels nothing is rejected."""
    # The text goes to the workers once, in its row.
    rows, at = documents.select(F.struct(*documents.columns).alias("row")), documents.columns.index("text")
    scored = with_score(rows, fit_quality(documents, labels), lambda batch: batch.column(0).field(at))
    return scored.filter(F.col("score") >= threshold).select("row.*")
