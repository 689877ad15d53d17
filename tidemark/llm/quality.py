"""Quality from random-indexing word vectors, pooled per document, by a two-layer network in numpy.

A word's vector is the sum of sparse random index vectors of the words around it, over the whole corpus. Words are hashed
to a fixed number of buckets, so the table of vectors has the same size for any corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo
from tidemark.llm.labelled import held_out, sample

BUCKETS, DIM, NONZERO, WINDOW = 8192, 32, 4, 2
HIDDEN, EPOCHS, BATCH = 32, 60, 256
#: Tokens that are placed in their contexts at a time.
CHUNK = 100_000
PART = re.compile(r"[^\W\d_]+|[^\w\s]+|[\d_]+")
FEATURES = 2 * DIM + 4


def index_vectors() -> np.ndarray:
    """Sparse vectors of -1, 0 and 1 per bucket, and a row of zeros for the gaps between documents."""
    draw, table = np.random.default_rng(7), np.zeros((BUCKETS + 1, DIM), np.int8)
    for row in table[:-1]:
        row[draw.choice(DIM, NONZERO, replace=False)] = draw.choice([-1, 1], NONZERO)
    return table


class Tokens:
    """Bucket numbers of a text's tokens: runs of letters, of digits and of other signs."""

    def __init__(self):
        self.memo = Memo(lambda word: np.array([xxhash.xxh32_intdigest(part) % BUCKETS for part in PART.findall(word)], np.int32).tobytes())

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, (text or "").split())), np.int32)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts and context sums by bucket."""
    tokens, index = Tokens(), index_vectors()
    sums, counts = np.zeros((BUCKETS + 1, DIM), np.int64), np.zeros(BUCKETS + 1, np.int64)
    gap, held, size = np.full(WINDOW, BUCKETS, np.int32), [], 0

    def place() -> None:
        ids = np.concatenate([gap, *held])
        for at in range(0, len(ids), CHUNK):
            # A piece takes its neighbours with it; only its own tokens are placed.
            low, high = max(0, at - WINDOW), min(len(ids), at + CHUNK + WINDOW)
            near = index[ids[low:high]]
            around = np.zeros_like(near)
            for k in range(1, WINDOW + 1):
                around[k:] += near[:-k]
                around[:-k] += near[k:]
            own, around = ids[at : at + CHUNK], around[at - low :][: min(CHUNK, len(ids) - at)]
            order = np.argsort(own, kind="stable")
            buckets, first, n = np.unique(own[order], return_index=True, return_counts=True)
            sums[buckets] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
            counts[buckets] += n

    for batch in batches:
        for value in batch.column(0):
            ids = tokens(value.as_py())
            held += [ids, gap]
            size += len(ids) + WINDOW
            if size >= CHUNK:
                place()
                held, size = [], 0
    if held:
        place()
    used = np.flatnonzero(counts[:-1])
    columns = [pa.array(used.astype(np.int32)), pa.array(counts[used]), *(pa.array(sums[used, k]) for k in range(DIM))]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", *(f"d{k}" for k in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of the buckets from the contexts of all tokens of all documents; a table of fixed size."""
    parts = docs.select("text").mapInArrow(_contexts, "bucket int, n long, " + ", ".join(f"d{k} long" for k in range(DIM)))
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIM))).collect()
    vectors, n = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for row in rows:
        vectors[row[0]], n[row[0]] = np.array(row[2:], float) / row[1], row[1]
    if n.sum():
        vectors[n > 0] -= (vectors * n[:, None]).sum(axis=0) / n.sum()
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return (vectors / np.maximum(length, 1e-9)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's vectors, likeness of neighbours, share of distinct tokens, length."""
    if not len(ids):
        return np.zeros(FEATURES, np.float32)
    total, squares, alike, last = np.zeros(DIM), np.zeros(DIM), 0.0, None
    for at in range(0, len(ids), CHUNK):
        x = vectors[ids[at : at + CHUNK]]
        total += x.sum(axis=0)
        squares += np.einsum("ij,ij->j", x, x)
        alike += float(np.einsum("ij,ij->", x[:-1], x[1:])) + (float(last @ x[0]) if last is not None else 0.0)
        last = x[-1]
    n = len(ids)
    mean = total / n
    same = np.count_nonzero(ids[1:] == ids[:-1]) / n
    return np.concatenate([mean, np.sqrt(np.maximum(0, squares / n - mean * mean)), [alike / n, same, len(np.unique(ids)) / n, np.log1p(n)]]).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, label: bool = False) -> DataFrame:
    """doc_id (and label) with the pooled features of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            rows = np.array([pool(tokens(v.as_py()), vectors) for v in batch.column(1)], np.float32).reshape(-1, FEATURES)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], flat], ["doc_id", *(["label"] if label else []), "features"])

    chosen = docs.select("doc_id", "text", *(["label"] if label else []))
    return chosen.mapInArrow(measure, f"doc_id {kind}, {'label int, ' if label else ''}features array<float>")


@dataclass(frozen=True)
class Network:
    """Standardised features, a tanh layer, a logit, and the temperature that calibrates it."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.c_[(x - self.centre) / self.scale, np.ones(len(x))] @ self.first)
        return np.c_[hidden, np.ones(len(x))] @ self.second

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Adam on four fifths of the rows; the temperature is fitted on the rest. One class alone gives its constant."""
    draw = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 else FEATURES
    first, second = draw.normal(0, 0.2, (width + 1, HIDDEN)), draw.normal(0, 0.2, HIDDEN + 1)
    if len(y) == 0 or y.min() == y.max():
        second[:] = 0
        second[-1] = 0.0 if len(y) == 0 else 4.0 * (2 * y[0] - 1)
        return Network(np.zeros(width), np.ones(width), first, second, 1.0)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    order = draw.permutation(len(y))
    fitted, kept = order[: max(1, len(y) * 4 // 5)], order[len(y) * 4 // 5 :]
    z, t = np.c_[(x - centre) / scale, np.ones(len(x))][fitted], y[fitted]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (first, second)]
    step = 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(t))
        for at in range(0, len(t), BATCH):
            rows, step = order[at : at + BATCH], step + 1
            hidden = np.c_[np.tanh(z[rows] @ first), np.ones(len(rows))]
            error = (1 / (1 + np.exp(-np.clip(hidden @ second, -30, 30))) - t[rows]) / len(rows)
            down = z[rows].T @ (error[:, None] * second[None, :-1] * (1 - hidden[:, :-1] ** 2)) + 1e-4 * first
            for p, g, m in ((first, down, moments[0]), (second, hidden.T @ error + 1e-4 * second, moments[1])):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                p -= 0.01 * (1 - epoch / EPOCHS) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    made = Network(centre, scale, first, second, 1.0)
    logits, truth = made.logits(x[kept]), y[kept]
    loss = lambda temperature: np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / temperature).mean()
    return Network(centre, scale, first, second, float(min(np.geomspace(0.5, 8, 49), key=loss)) if len(kept) else 1.0)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, threshold: float = 0.3) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    The word vectors come from all documents; the network is fitted on at most SAMPLE_ROWS labelled rows that are not held
    out. Null and empty texts have zero features and get the score of those. Rows that repeat are scored each; without
    labels all scores are one half; an empty table gives no rows.
    """
    vectors = word_vectors(docs)
    known = sample(docs.select("doc_id", "text"), labels, "quality", modulus, rest).withColumn("label", F.col("label").cast("int"))
    rows = pooled(known, vectors, label=True).select("label", "features").toPandas()
    network = train(np.stack(rows["features"]).astype(float) if len(rows) else np.zeros((0, FEATURES)), rows["label"].to_numpy(float))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            rows = np.array([pool(tokens(v.as_py()), vectors) for v in batch.column(1)], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(rows))], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
