"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

A document becomes a sparse vector in 2 ** BITS buckets: word unigrams, word bigrams, the punctuation that ends
words and its bigrams, a bucket for a word that repeats the one before, and the order of magnitude of its length.
A feature's value is its share of the document's n-grams, so long texts weigh no more than short ones.

Training takes at most `max_rows` labelled documents (those first by hash of id; a documented bound) in one task,
which gets their vectors only. The model is 2 ** BITS float32 weights: a fixed 1 MB, sent to every executor.

Defined results: a null or empty text has the bias and the smallest length as its features; a very long text is
scored whole; without any labelled row (an empty table too) every score is 0.5; labels for missing documents, null
labels and null ids are not learnt from; of several labels of one id the least counts; documents that share an id are
all learnt from, in the order of their vectors; copies of a row are scored alike, a row each; an empty table gives an
empty result; columns that are not asked for are ignored, also those named as the results are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_text, batched, mixed

BITS = 18
MAX_ROWS = 8000
#: Passes over the training rows: as many as make TRAIN_STEPS updates, within these bounds.
TRAIN_STEPS, LEAST_EPOCHS, MOST_EPOCHS = 32_000, 4, 40
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SCALE = 8.0
_CORE = re.compile(r"\W+|_+")
_SEED = {"word": 1, "tail": 2, "pair": 3, "tails": 4, "repeat": 5, "length": 6, "bias": 7}


def _bucket(h: np.ndarray, kind: str) -> np.ndarray:
    return (mixed(h + np.uint64(_SEED[kind] * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of all texts one after another, and each text's bounds in them."""
    words = Words(texts)
    names = [w.lower() for w in words.dictionary.to_pylist()]
    core = np.fromiter((xxhash.xxh64_intdigest(_CORE.sub("", w)) for w in names), np.uint64, len(names))
    tail = np.fromiter((xxhash.xxh64_intdigest("".join(_CORE.findall(w))) for w in names), np.uint64, len(names))
    n_texts, n = len(words.bounds) - 1, len(words.ids)
    core, tail = (core[words.ids], tail[words.ids]) if n else (np.zeros(0, np.uint64),) * 2
    owner = np.repeat(np.arange(n_texts), np.diff(words.bounds))
    pairs = np.flatnonzero(owner[:-1] == owner[1:]) if n > 1 else np.zeros(0, np.int64)
    same = pairs[core[pairs] == core[pairs + 1]]
    sizes = np.diff(words.bounds)
    magnitude = np.floor(2 * np.log2(1 + sizes)).astype(np.uint64)
    share = SCALE / np.maximum(sizes, 1)
    parts = [
        (owner, _bucket(core, "word"), 1.0),
        (owner, _bucket(tail, "tail"), 1.0),
        (owner[pairs], _bucket(core[pairs] * np.uint64(3) + core[pairs + 1], "pair"), 1.0),
        (owner[pairs], _bucket(tail[pairs] * np.uint64(3) + tail[pairs + 1], "tails"), 1.0),
        (owner[same], np.full(len(same), _bucket(np.zeros(1, np.uint64), "repeat")[0]), 1.0),
        (np.arange(n_texts), _bucket(magnitude, "length"), None),
        (np.arange(n_texts), np.full(n_texts, _bucket(np.zeros(1, np.uint64), "bias")[0]), None),
    ]
    who = np.concatenate([p[0] for p in parts])
    what = np.concatenate([p[1] for p in parts])
    value = np.concatenate([share[p[0]] if p[2] else np.ones(len(p[0])) for p in parts])
    order = np.argsort(who, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n_texts))]).astype(np.int64)
    return what[order], value[order], bounds


class Ftrl:
    """FTRL-proximal logistic regression over 2 ** BITS coordinates."""

    def __init__(self):
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One document: at are distinct buckets."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> np.ndarray:
    """The weights learnt from labels (id, label), of which the first max_rows by hash of id are used."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most max_rows small rows

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, x, bounds = features(as_text(batch.column("text")))
        out_at, out_x = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            u, inv = np.unique(at[a:b], return_inverse=True)
            out_at.append(u.astype("<i4").tobytes())
            out_x.append(np.bincount(inv, x[a:b]).astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("y"), pa.array(out_at, pa.binary()), pa.array(out_x, pa.binary())], names=["id", "y", "at", "x"])

    def train(batches):
        seen = [row for b in batches for row in zip(b.column("id").to_pylist(), b.column("y").to_pylist(), b.column("at").to_pylist(), b.column("x").to_pylist())]
        seen.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r))
        model = Ftrl()
        for _ in range(min(MOST_EPOCHS, max(LEAST_EPOCHS, TRAIN_STEPS // len(seen))) if seen else 0):
            for _, y, at, x in seen:
                model.update(np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(float), y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["w"])

    made = batched(rows, vectors, "id bigint, y double, at binary, x binary").repartition(1).mapInArrow(train, "w binary").collect()
    return np.frombuffer(bytes(made[0].w), "<f4") if made else np.zeros(1 << BITS, "<f4")


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1, as sparse dot products."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(weights.tobytes())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = np.frombuffer(sent.value, "<f4")
        at, x, bounds = features(as_text(batch.column("text")))
        logit = np.add.reduceat(w[at] * x, bounds[:-1]) if len(at) else np.zeros(0)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], names=["id", "score"])

    out = batched(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)
