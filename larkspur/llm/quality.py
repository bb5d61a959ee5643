"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

A word's index vector is sparse and random (made from its hash); its context vector is the sum of the index vectors
around it in the training documents. A document is pooled from its words' vectors of both kinds: their mean,
their spread, and how often neighbours are alike. The network's
probabilities are calibrated by a temperature on rows that it was not fitted on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

#: Labelled rows that the classifier is fitted on, at most: chosen by hash, so the same at each run.
SAMPLE_ROWS = 6000
BUCKETS = 1 << 15
DIMENSIONS, NONZERO, WINDOW = 64, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 128, 3e-3, 1e-3
THRESHOLD = 0.3
FOLDS = 5
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
KEPT_WORDS = 100_000


class Buckets(dict):
    """The bucket of each word by hash; words seen often are remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = bucket = zlib.crc32(word.lower().encode()) % BUCKETS
        return bucket


_buckets = Buckets()


def word_ids(text: str | None) -> np.ndarray:
    """The buckets of the words and symbol runs of a text, in order."""
    return np.array([_buckets[x] for x in TOKEN.findall(text or "")], np.int32)


def index_vectors() -> np.ndarray:
    """A random vector of a few +1 and -1 for each bucket; the same at every run."""
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    places = rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO))
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


def context_vectors(documents: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """The sums of the index vectors within the window, scaled to length one."""
    out = np.zeros_like(index)
    for ids in documents:
        for gap in range(1, WINDOW + 1):
            np.add.at(out, ids[gap:], index[ids[:-gap]])
            np.add.at(out, ids[:-gap], index[ids[gap:]])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean and the spread of the words' vectors, the length of the mean, how often neighbouring words and those
    two apart share a vector, and how many words there are; without words, zeros."""
    wide = vectors.shape[1]
    out = np.zeros(2 * wide + 4, np.float32)
    if len(ids):
        found, count = np.unique(ids, return_counts=True)
        rows, share = vectors[found], count.astype(np.float32) / len(ids)
        mean = share @ rows
        out[:wide] = mean
        out[wide : 2 * wide] = np.sqrt(np.maximum(share @ (rows * rows) - mean * mean, 0))
        out[2 * wide] = np.linalg.norm(mean)
        out[2 * wide + 1] = np.mean(ids[1:] == ids[:-1]) if len(ids) > 1 else 0
        out[2 * wide + 2] = np.mean(ids[2:] == ids[:-2]) if len(ids) > 2 else 0
        out[2 * wide + 3] = np.log1p(len(ids)) / 10
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fits on four of five rows by Adam; the fifth sets the temperature. With one class, a constant."""
    rng = np.random.default_rng(7)
    aside = np.arange(len(x)) % 5 == 4
    xs, ys = (x[~aside], y[~aside]) if aside.any() else (x, y)
    n = Network(xs.mean(0) if len(xs) else np.zeros(x.shape[1]), xs.std(0) + 1e-3 if len(xs) else np.ones(x.shape[1]), rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))
    if len(xs) == 0 or ys.min() == ys.max():
        n.w2[:], n.b2[0] = 0, 0 if len(xs) == 0 else 4 * (2 * ys[0] - 1)
        return n
    names = ("w1", "b1", "w2", "b2")
    state = {k: (np.zeros_like(getattr(n, k)), np.zeros_like(getattr(n, k))) for k in names}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            xb, yb = (xs[rows] - n.mean) / n.scale, ys[rows]
            h = n.hidden(xs[rows])
            error = (1 / (1 + np.exp(-np.clip(h @ n.w2 + n.b2, -60, 60))) - yb) / len(rows)
            back = np.outer(error, n.w2) * (1 - h * h)
            slopes = {"w1": xb.T @ back + DECAY * n.w1, "b1": back.sum(0), "w2": h.T @ error + DECAY * n.w2, "b2": error.sum(keepdims=True)}
            step += 1
            for k in names:
                m, v = state[k]
                m += 0.1 * (slopes[k] - m)
                v += 0.001 * (slopes[k] ** 2 - v)
                setattr(n, k, getattr(n, k) - RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    if aside.any():
        logits = n.logits(x[aside])
        n.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: log_loss(logits / t, y[aside])))
    return n


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.network.probability(np.stack([pool(word_ids(x), self.vectors) for x in texts]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` documents (doc_id, text) that ``labels`` (doc_id, quality) marks and that are not held out.

    Their words, as numbers, are all that comes to the driver. Null labels and ids are left out.
    """
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 0).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([word_ids(x).tobytes() for x in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "quality", "ids"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    found = common.map_texts(sample, numbers, "doc_id bigint, quality int, ids binary")
    table = found.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    sample = [np.frombuffer(x, np.int32) for x in table["ids"].to_pylist()]
    index = index_vectors()
    vectors = np.hstack([context_vectors(sample, index), index])
    x = np.stack([pool(ids, vectors) for ids in sample]) if sample else np.zeros((0, 2 * vectors.shape[1] + 4), np.float32)
    order = np.random.default_rng(3).permutation(len(x))
    return Model(vectors, train(x[order].astype(float), np.array(table["quality"].to_pylist(), float)[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text), from its whole text; null counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return common.map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), apply, "doc_id bigint, score double")


def filtered(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text scores at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array(sent.value.score(part.column(at).to_pylist()) >= threshold))

    return common.map_texts(docs, choose, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted.

    Labels, language, source and doc_id are no inputs of a score. Rows with equal doc_id each come back; other
    columns are not used; an empty table gives no rows. Without usable labels every score is 0.5.
    """
    scored = score(docs, fit(docs, labels, rows))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels"))
