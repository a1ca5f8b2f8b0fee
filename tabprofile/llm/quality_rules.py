"""Operator 5: quality rules as gradient-boosted trees over document statistics.

Statistics are counted over whole texts; trees are grown on histograms with monotonic constraints on chosen statistics and flattened into
numpy node arrays, so that a batch of documents walks all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.sampling import hash_sample
from tabprofile.llm.common import HASH_BLOCK, documents, pieces

#: Labelled documents that the trees are grown on, at most.
TRAIN_DOCS = 20_000
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of a document that trees look at, with the direction in which quality may depend on each (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": -1,
    "distinct_share": 0, "stops_per_word": 0, "digits_per_word": 0, "lines_per_word": 0,
}
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_NOT_STOPS = bytes(c for c in range(256) if c not in b".!?")
_NOT_DIGITS = bytes(c for c in range(256) if c not in b"0123456789")
_NOT_LEADS = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes
_SPACES = b" \t\n\v\f\r"


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The counts of :data:`COUNTS` and the values of :data:`FEATURES`; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, _NOT_LEADS + _SPACES))
    symbols = len(raw.translate(None, _NOT_SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    dup_lines = len(lines) - len(set(lines))
    different = len(set(words))
    repeated = 0
    if n >= WINDOW and different < n:
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(code.__getitem__, words), np.int64, n)
        rank, width = ids, 1
        while width < WINDOW:  # numbers for equal windows of 2, 4 and 8 words: exact, no hash
            pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
            order = np.argsort(pair, kind="stable")
            ranked = pair[order]
            group = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank = np.empty(len(pair), np.int64)
            rank[order] = group
            width *= 2
            if int(group[-1]) == len(group) - 1:  # no window is met twice, nor will be a longer one
                break
        else:
            twice = np.bincount(rank)[rank] > 1
            edge = np.zeros(n + 1, np.int64)
            edge[: len(twice)] += twice
            edge[WINDOW: WINDOW + len(twice)] -= twice
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    m = max(n, 1)
    letters = len(raw.translate(None, _NOT_LETTERS))
    values = [
        float(np.log1p(n)), chars / m, symbols / m, repeated / m, dup_lines / max(len(lines), 1), len(raw.translate(None, _NOT_UPPER)) / max(letters, 1),
        different / m, len(raw.translate(None, _NOT_STOPS)) / m, len(raw.translate(None, _NOT_DIGITS)) / m, len(lines) / m,
    ]
    return (n, chars, symbols, dup_lines, repeated), values


@dataclass
class Trees:
    """All trees in one set of arrays: a leaf points to itself; ``roots`` are the first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row of ``x``."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0) -> Trees:
    """Boost the logistic loss.  A split on a constrained statistic must order its sides, and their subtrees stay within the middle value."""
    n, width = x.shape
    mean = min(max(float(y.mean()) if n else 1.0, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        one = np.zeros(1, np.int64)
        return Trees(one, np.zeros(1), one, one, np.zeros(1), one, 0, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(low: float, high: float, g: float, h: float) -> int:
        feature.append(0), threshold.append(0.0), left.append(len(left)), right.append(len(right))
        value.append(min(max(-g / (h + penalty), low), high))
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        root = leaf(-np.inf, np.inf, grad.sum(), hess.sum())
        roots.append(root)
        where = np.full(n, root)
        open_ = {root: (-np.inf, np.inf)}
        for _ in range(depth):
            nodes = sorted(open_)
            slot = np.searchsorted(nodes, where)
            slot = np.where((slot < len(nodes)) & (np.asarray(nodes)[np.minimum(slot, len(nodes) - 1)] == where), slot, -1)
            live = slot >= 0
            best: dict[int, tuple] = {}
            for f in range(width):
                cell = slot[live] * bins + binned[live, f]
                g = np.bincount(cell, weights=grad[live], minlength=len(nodes) * bins).reshape(-1, bins)
                h = np.bincount(cell, weights=hess[live], minlength=len(nodes) * bins).reshape(-1, bins)
                gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                gain = gl ** 2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt ** 2 / (ht + penalty)
                fits = (hl > 1) & (ht - hl > 1)
                if signs[f]:
                    fits &= signs[f] * (-(gt - gl) / (ht - hl + penalty) + gl / (hl + penalty)) >= 0
                gain = np.where(fits, gain, 0)[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                for i, k in enumerate(gain.argmax(axis=1).tolist()):
                    if gain[i, k] > best.get(i, (1e-6,))[0]:
                        best[i] = (gain[i, k], f, k, gl[i, k], hl[i, k], gt[i, 0], ht[i, 0])
            following = {}
            for i, (_, f, k, gl, hl, gt, ht) in best.items():
                node = nodes[i]
                low, high = open_[node]
                a, b = (min(max(-g / (h + penalty), low), high) for g, h in ((gl, hl), (gt - gl, ht - hl)))
                middle = (a + b) / 2
                sides = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
                feature[node], threshold[node] = f, float(edges[f][k])
                left[node], right[node] = leaf(*sides[0], gl, hl), leaf(*sides[1], gt - gl, ht - hl)
                here = where == node
                where[here] = np.where(binned[here, f] <= k, left[node], right[node])
                following |= {left[node]: sides[0], right[node]: sides[1]}
            open_ = following
            if not open_:
                break
        margin += rate * np.array(value)[where]
    out = np.array(value) * rate
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), out, np.array(roots), depth, base)


_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", features array<double>"


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts and the features of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, HASH_BLOCK):
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*(f[0] for f in found))), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
                ["doc_id", *COUNTS, "features"])

    return documents(docs).mapInArrow(run, _SCHEMA)


def labelled(labels: DataFrame, column: str, usable: Column | None = None) -> DataFrame:
    """One 0/1 label per usable document: the mean of its labels, at least a half being 1; null ids and labels are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("double").alias("label"))
    rows = rows if usable is None else rows.where(usable)
    return rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))


def learn_rules(docs: DataFrame, labels: DataFrame, usable: Column | None = None, limit: int = TRAIN_DOCS) -> Trees:
    """Trees grown on at most ``limit`` usable labelled documents, chosen by a hash of their ids."""
    sample = hash_sample(labelled(labels, "quality", usable), "doc_id", limit)
    chosen = documents(docs).join(F.broadcast(sample), "doc_id")  # at most ``limit`` rows of two numbers
    rows = document_statistics(chosen.select("doc_id", "text")).select("doc_id", "features").join(F.broadcast(sample), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    return grow(np.array([r["features"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows]), list(FEATURES.values()))


def apply_rules(docs: DataFrame, trees: Trees, threshold: float = 0.3, least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` and ``kept`` for every row.

    A document fails the base with fewer than ``least_words`` words or more than ``repeat_percent`` of them in repeated windows; others are
    kept where the trees give at least ``threshold``.  Null and empty texts have only zeros and fail; every row is judged by itself, so
    repeated rows and null ids need no rule; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, HASH_BLOCK):
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            score = shared.value.score(np.array([f[1] for f in found]))
            counts = np.array([f[0] for f in found], np.int64)
            failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > repeat_percent * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    kinds = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return documents(docs).mapInArrow(run, kinds)
