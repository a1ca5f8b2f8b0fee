"""Operator 8: quality classifier on random-indexing word vectors.

Every word class (letter case and ending, or a run of signs) has a sparse random index vector.  Its word vector sums the index vectors of its
neighbours over the whole corpus.  A document pools the vectors of its words into a mean, a deviation and a mean weighted by rarity, with
the lengths of both means (few different words make long means), and a two-layer network turns these into a probability, whose temperature
is set on documents that the network has not seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.sampling import hash_sample
from tabprofile.llm.common import HASH_BLOCK, documents, mix64, pieces, powers
from tabprofile.llm.quality_rules import labelled

#: Word classes, dimensions, non-zero entries of an index vector, and neighbours on either side.
CLASSES, DIMENSIONS, ENTRIES, REACH = 1 << 13, 64, 4, 2
#: Labelled documents that the network is trained on, at most.
TRAIN_DOCS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 0.003, 1e-3
#: Pooled values of a document.
POOLED = 3 * DIMENSIONS + 2
_rng = np.random.default_rng(8)
#: Index vectors: the places and signs of each class's entries.
_PLACES = np.stack([_rng.permutation(DIMENSIONS)[:ENTRIES] for _ in range(CLASSES)])
_SIGNS = _rng.choice([-1.0, 1.0], (CLASSES, ENTRIES))
_KIND = np.full(256, 3, np.uint8)  # signs
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58)]] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_classes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words and sign runs of some texts, end to end, and the number of them in each text."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    kind = _KIND[data]
    change = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    starts = change[kind[change] > 0]
    ends = np.append(change, len(data))[np.searchsorted(change, starts) + 1]
    up, down, values = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[np.frombuffer(joined.translate(_LOWER), np.uint8)] * up[: len(data)], out=sums[1:])
    tail = np.maximum(starts, ends - 3)
    ending = (sums[ends] - sums[tail]) * down[tail]
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
    upper = uppers[ends] - uppers[starts]
    case = np.where(upper == 0, 0, np.where(upper == ends - starts, 2 - (upper == 1), 1))
    long = np.minimum(ends - starts, 4)
    shape = (kind[starts].astype(np.int64) * 4 + case) * 8 + long
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return (mix64(ending ^ shape.astype(np.uint64) << np.uint64(48)) % np.uint64(CLASSES)).astype(np.int64), np.diff(bounds)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in pieces(batches, HASH_BLOCK):
        yield batch, *word_classes([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((CLASSES, DIMENSIONS))
    seen = np.zeros(CLASSES, np.int64)
    for _, words, counts in _texts(batches):
        seen += np.bincount(words, minlength=CLASSES)
        owner = np.repeat(np.arange(len(counts)), counts)
        for gap in range(1, REACH + 1):
            if len(words) <= gap:
                continue
            same = owner[gap:] == owner[:-gap]
            a, b = words[:-gap][same], words[gap:][same]
            for e in range(ENTRIES):
                total += np.bincount(a * DIMENSIONS + _PLACES[b, e], weights=_SIGNS[b, e], minlength=total.size).reshape(total.shape)
                total += np.bincount(b * DIMENSIONS + _PLACES[a, e], weights=_SIGNS[a, e], minlength=total.size).reshape(total.shape)
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(seen[used], pa.int64()), *(pa.array(total[used, d].astype(np.int64)) for d in range(DIMENSIONS))],
        ["class", "n", *(f"d{d}" for d in range(DIMENSIONS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of every class and, in a last column, its rarity (minus the log of its share), from all words of all texts.

    A task sums its own texts up to one row per class, and those are summed per class, so the work follows the corpus and the result does
    not: it has ``CLASSES`` rows.  What all classes share is taken off, and vectors get length 1; classes never seen stay 0.
    """
    columns = [f"d{d}" for d in range(DIMENSIONS)]
    partial = documents(docs).select("text").mapInArrow(_neighbours, "class int, n bigint, " + ", ".join(f"{c} bigint" for c in columns))
    rows = partial.groupBy("class").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect()
    out = np.zeros((CLASSES, DIMENSIONS + 1), np.float32)
    if not rows:
        return out
    at = np.array([r["class"] for r in rows])
    seen = np.array([r["n"] for r in rows], float)
    sums = np.array([r[2:] for r in rows], float)
    own = sums / seen[:, None] - sums.sum(axis=0) / seen.sum()
    out[at, :-1] = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    out[:, -1] = np.log(seen.sum())  # of a class met once
    out[at, -1] -= np.log(seen)
    return out


def pool(vectors: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The pooled values of each text; zeros for a text without words."""
    out = np.zeros((len(counts), POOLED), np.float32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    heads = (np.cumsum(counts) - counts)[full]
    found = vectors[words]
    found, rarity = found[:, :-1], found[:, -1:]
    mean = np.add.reduceat(found, heads, axis=0) / counts[full, None]
    square = np.add.reduceat(found * found, heads, axis=0) / counts[full, None]
    rare = np.add.reduceat(found * rarity, heads, axis=0) / np.maximum(np.add.reduceat(rarity, heads, axis=0), 1e-9)
    norms = np.stack([np.log(np.linalg.norm(v, axis=1) + 1e-3) for v in (mean, rare)], axis=1)
    out[full] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), rare, norms], axis=1)
    return out


@dataclass
class Network:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 8) -> Network:
    """Fit the network by Adam on four fifths of the rows and its temperature on the others; without both labels it gives their mean."""
    rng = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 and len(x) else POOLED
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    net = Network(vectors, np.zeros(width), np.ones(width), rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(mean / (1 - mean))))
    if len(y) < 10 or y.min() == y.max():
        return net
    net.centre, net.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    order = rng.permutation(len(y))
    checked, fitted = order[: len(y) // 5], order[len(y) // 5:]
    z = (x - net.centre) / net.scale
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    bias, step = np.array([net.b2]), 0
    for _ in range(EPOCHS):
        for at in range(0, len(fitted), BATCH):
            rows = rng.choice(fitted, BATCH) if at else fitted[rng.permutation(len(fitted))[:BATCH]]
            hidden = np.tanh(z[rows] @ net.w1 + net.b1)
            wrong = (1 / (1 + np.exp(-(hidden @ net.w2 + bias[0]))) - y[rows]) / len(rows)
            below = wrong[:, None] * net.w2 * (1 - hidden ** 2)
            steps = (z[rows].T @ below + DECAY * net.w1, below.sum(axis=0), hidden.T @ wrong + DECAY * net.w2, wrong.sum(keepdims=True))
            step += 1
            for p, g, m in zip((net.w1, net.b1, net.w2, bias), steps, moments):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= RATE * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(bias[0])
    logits = net.logits(x[checked])
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.mean(np.logaddexp(0, -np.where(y[checked] > 0, 1, -1) * logits / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def learn_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, column: str = "quality", limit: int = TRAIN_DOCS) -> Network:
    """Word vectors from all texts, and a network trained on at most ``limit`` usable labelled documents, chosen by a hash of their ids."""
    vectors = word_vectors(docs)
    sample = hash_sample(labelled(labels, column, usable), "doc_id", limit)
    rows = _pooled(documents(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text"), vectors).join(F.broadcast(sample), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["pooled"]))
    return train(vectors, np.array([r["pooled"] for r in rows]), np.array([r["label"] for r in rows]))


def _pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, counts in _texts(batches):
            rows = list(pool(shared.value, words, counts).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "pooled"])

    return docs.mapInArrow(run, "doc_id bigint, pooled array<double>")


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score`` for every row: the probability of label 1, from the whole text alone.

    Null, empty and wordless texts pool to zeros and get the score of that point; every row is scored by itself, so repeated rows and null
    ids need no rule; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, counts in _texts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shared.value.score(pool(shared.value.vectors, words, counts)), pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id bigint, score double")
