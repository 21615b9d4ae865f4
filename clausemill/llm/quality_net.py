"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word is one of ``WORDS`` hashed words, and one of ``SHAPES`` shapes (case,
symbols, digits, length, repeat of the word before).  Each has a sparse ternary
index vector that follows from its number.  Its word vector is the sum of the
index vectors of its neighbours over all documents of the corpus, plus its own,
scaled to length one.  A document is pooled into the means of its words' and its
shapes' vectors and the logs of its number of words and lines.  The network, tanh
and logistic, is trained in numpy on a bounded labelled sample; one part of the
sample sets the temperature that calibrates its probabilities.

The vectors have a fixed size.  Each task sends the sums that are not zero as (slot,
value) rows, which Spark adds up before and after the shuffle.

Defined results: null and empty texts pool to zero vectors and get a score as
such; repeated rows and null ids pass through one for one (a null id counts as held
out); of several labels of one id the largest counts; without labels of
both kinds every score is the share of label 1, or 0.5; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, sample, sigmoid
from .words import Words, slices

PARTS, PART = 5, 0
WORDS, SHAPES, DIMENSIONS, NONZERO = 16_384, 96, 64, 4
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.01, 1e-4
THRESHOLD = 0.3
#: Sums sent at once.
_ROWS = 50_000

_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_SYMBOL[list(b"#*$%&|<>{}[]\\/=+~^_@!")] = True


def index_vectors() -> np.ndarray:
    """The sparse ternary vector of every word and shape number."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((WORDS + SHAPES, DIMENSIONS), np.int64)
    for row in out:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def numbers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape number of every word of a slice."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = words.hashes(0, lower=True)
    body = words.data[words.ink]
    lens = words.end - words.start
    at = np.cumsum(lens) - lens
    upper, letter, digit, symbol = (np.add.reduceat(table[body].astype(np.int64), at) for table in (_UPPER, _LETTER, _DIGIT, _SYMBOL))
    case = np.where(upper == 0, 0, np.where((upper == 1) & (letter > 1), 1, 2))
    again = np.zeros(len(words), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    marks = np.where(symbol == 0, 0, np.where(letter == 0, 1, 2))
    shape = ((case * 3 + marks) * 2 + (digit > 0)) * 2 + again  # 36 shapes
    shape = shape * 2 + (lens > 12)
    return (hashes % np.uint64(WORDS)).astype(np.int64), WORDS + shape


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all words and shapes, from every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((WORDS + SHAPES) * DIMENSIONS, np.int64)
        places = np.stack([np.flatnonzero(row) for row in index])
        signs = np.take_along_axis(index, places, axis=1)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                w, s = numbers(words)
                same = words.doc[1:] == words.doc[:-1]
                for a, b in ((w[:-1], w[1:]), (w[1:], w[:-1]), (s[:-1], s[1:]), (s[1:], s[:-1])):
                    a, b = a[same], b[same]
                    for k in range(NONZERO):
                        np.add.at(total, a * DIMENSIONS + places[b, k], signs[b, k])
        slots = np.flatnonzero(total).astype(np.int32)
        for a in range(0, len(slots), _ROWS):
            part = slots[a : a + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["slot", "value"])

    rows = docs.select("text").mapInArrow(count, "slot int, value long").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()  # as many as the table has numbers
    total = np.zeros((WORDS + SHAPES) * DIMENSIONS, np.int64)
    total[rows["slot"].to_numpy()] = rows["value"].to_numpy()
    vectors = total.reshape(WORDS + SHAPES, DIMENSIONS).astype(float)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1.0)
    vectors += index_vectors() / NONZERO**0.5
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def pooled(part: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """Features of each text of a slice."""
    words = Words(part.column("text"))
    w, s = numbers(words)
    n = np.diff(words.first)
    rows = part.num_rows
    out = np.zeros((rows, 2 * DIMENSIONS + 2), np.float32)
    if len(w):
        bounds = words.first[:-1][n > 0]
        out[n > 0, :DIMENSIONS] = np.add.reduceat(vectors[w], bounds, axis=0) / n[n > 0, None]
        out[n > 0, DIMENSIONS : 2 * DIMENSIONS] = np.add.reduceat(vectors[s], bounds, axis=0) / n[n > 0, None]
    out[:, -2] = np.log1p(n) / 10
    lines = np.searchsorted(np.flatnonzero(words.data == 10), np.append(words.start, len(words.data))[words.first])
    out[:, -1] = np.log1p(np.diff(lines)) / 10
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def constant(share: float) -> Network:
    size = 2 * DIMENSIONS + 2
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam on the logistic loss; every fifth row is kept for the temperature."""
    if not len(y) or not 0 < y.sum() < len(y):
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(y))
    x, y = x[order].astype(float), y[order].astype(float)
    kept = np.arange(len(y)) % 5 == 0
    vx, vy, x, y = x[kept], y[kept], x[~kept], y[~kept]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            rows = order[a : a + BATCH]
            hidden = np.tanh(x[rows] @ params[0] + params[1])
            gap = (sigmoid(hidden @ params[2] + params[3]) - y[rows]) / len(rows)
            back = gap[:, None] * params[2] * (1 - hidden**2)
            grads = [x[rows].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ gap + DECAY * params[2], gap.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if len(vy):
        logits = net.logits(vx)
        choices = np.exp(np.linspace(-np.log(4), np.log(20), 81))
        losses = [np.mean(np.logaddexp(0, logits / t) - vy * logits / t) for t in choices]
        net.temperature = float(choices[int(np.argmin(losses))])
    return net


def _features(docs: DataFrame, key: str, kind: str, vectors: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = pooled(part, sent.value)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(list(x), pa.list_(pa.float32()))], [key, "x"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, x array<float>")


def fit(docs: DataFrame, rows: DataFrame) -> tuple[np.ndarray, Network]:
    """Vectors from all documents, network from a bounded sample of (text, y)."""
    vectors = corpus_vectors(docs)
    seen = _features(rows, "y", "int", vectors).toArrow()  # one pooled vector a sampled row
    y = seen["y"].to_numpy().astype(float)
    x = seen["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), 2 * DIMENSIONS + 2)
    order = np.lexsort([*x.T, y]) if len(y) else slice(None)  # the order in which rows came does not matter
    return vectors, train(x[order], y[order])


def scored(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of every document; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))  # fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(network.scores(pooled(part, vectors)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth is held out of the fit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors, network = fit(docs, sample(docs, labels, "quality", PARTS, PART))
    return scored(docs, vectors, network).select("doc_id", held_out("doc_id", PARTS, PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
