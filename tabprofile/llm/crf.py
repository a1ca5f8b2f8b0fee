"""Operator 2: language of documents by a linear-chain conditional random field over their words.

A word's score per language sums learned weights of its hashed byte n-grams (those with a boundary mark are its affixes) and of the lexicons
it stands in; learned transitions link neighbouring words.  Forward-backward gives every word's language probabilities, so text that switches
languages is labelled word by word; a document takes the language with the largest mean.  Chains run over stretches of ``CHAIN`` words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.llm.common import HASH_BLOCK, claim, pieces, spread

#: Documents per language that the model is learned from, and documents of all languages together: with more than 64 languages each gives fewer.
TRAIN_DOCS, TRAIN_ALL = 500, 32_000
CHAIN = 64
#: Words of a training sequence, and the longest stretch from one document in it (so that switches are learned).
SEQUENCE, STRETCH = 32, 24
EPOCHS, BATCH, RATE = 2, 256, 0.3
BITS = 16
LEXICON_WORDS = 400
_CACHE_WORDS = 300_000
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters are folded, other ASCII bytes part words, bytes of other scripts stay
_FOLD = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- to 4-grams of each word between boundary marks: feature ids and the word each belongs to."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words) + b"\0\0\0", np.uint8).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(length, length) - spread(length)
    code = data[:-3]
    ids, owners = [], []
    for n in (2, 3, 4):
        code = code << np.uint64(8) | data[n - 1: len(data) - 3 + n - 1]
        whole = left >= n
        ids.append(((code[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[whole])
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class Chain:
    """The learned weights: n-grams x languages, lexicon x languages, transitions and starts."""

    languages: list[str]
    lexicon: dict[bytes, int]  # word -> row of ``marks``
    marks: np.ndarray  # one bit per language; the last row, for all other words, is empty
    grams: np.ndarray
    lists: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray
    _cache: dict = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_cache", "_rows")} | {"_cache": {}, "_rows": None}

    def forget(self) -> None:
        self._cache, self._rows = {}, None

    def memberships(self, words: list[bytes]) -> np.ndarray:
        other = len(self.marks) - 1
        at = np.array([self.lexicon.get(w, other) for w in words], np.int64)
        return np.unpackbits(self.marks[at], axis=1, count=len(self.languages)).astype(np.float32)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        ids, owner = ngrams(words)
        scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(words)), 1))
        summed = np.stack([np.bincount(owner, weights=self.grams[ids, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)
        return (summed * scale[:, None] + self.memberships(words) @ self.lists).astype(np.float32)

    def rows(self, words: list[list[bytes]]) -> np.ndarray:
        """Emission scores of all words of some texts; each different word is computed once and remembered."""
        if len(self._cache) > _CACHE_WORDS or self._rows is None:
            self._cache, self._rows = {}, np.empty((0, len(self.languages)), np.float32)
        new = set().union(*words) - self._cache.keys()
        if new:
            new = list(new)
            self._cache.update(zip(new, range(len(self._rows), len(self._rows) + len(new))))
            self._rows = np.concatenate([self._rows, self.emissions(new)])
        get = self._cache.__getitem__
        total = sum(map(len, words))
        return self._rows[np.fromiter((get(w) for text in words for w in text), np.int64, total)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and mean probability of each text; ``und`` and 0 where there is no letter or no language was learned."""
        words = [words_of(t) if t and self.languages and _LETTER.search(t) else [] for t in texts]
        counts = np.array([len(w) for w in words])
        if not counts.sum():
            return [("und", 0.0)] * len(texts)
        posterior = chained(self.rows(words), counts, self.transitions, self.starts)
        owner = np.repeat(np.arange(len(texts)), counts)
        share = np.stack([np.bincount(owner, weights=posterior[:, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        share /= np.maximum(counts, 1)[:, None]
        best = share.argmax(axis=1)
        return [(self.languages[k], min(max(float(share[i, k]), 0.0), 1.0)) if counts[i] else ("und", 0.0) for i, k in enumerate(best)]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, starts: np.ndarray, pairs: bool = False):
    """Probabilities per word and label of sequences (sequence x place x label), by scaled forward and backward passes.

    With ``pairs``, the expected number of each transition over all sequences comes too.
    """
    n, steps, labels = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move, first = np.exp(transitions), np.exp(starts)
    ahead = np.empty_like(local)
    ahead[:, 0] = local[:, 0] * first
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (ahead[:, t - 1] @ move) * local[:, t]
        ahead[:, t] = now / now.sum(axis=1, keepdims=True)
    back = np.ones((n, labels), local.dtype)
    out = np.empty_like(local)
    expected = np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        within = (t < lengths - 1)[:, None]
        if t < steps - 1:
            came = local[:, t + 1] * back
            if pairs:
                joint = ahead[:, t, :, None] * move * came[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                expected += (joint * within[:, :, None]).sum(axis=0)
            now = came @ move.T
            back = np.where(within, now / now.sum(axis=1, keepdims=True), 1).astype(local.dtype)
        both = ahead[:, t] * back
        out[:, t] = both / both.sum(axis=1, keepdims=True)
    return (out, expected) if pairs else out


def chained(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word probabilities of texts laid end to end, in chains of ``CHAIN`` words that start anew."""
    whole = -(-counts // CHAIN)
    lengths = np.minimum(np.repeat(counts, whole) - spread(whole) * CHAIN, CHAIN)
    out = np.empty_like(scores)
    begin = np.cumsum(lengths) - lengths
    # chains of like length go together; only the last places of a group are padding
    order = np.argsort(lengths, kind="stable")
    for group in np.array_split(order, max(1, len(order) // 2048)):
        if not len(group):
            continue
        size = int(lengths[group].max())
        at = begin[group][:, None] + np.arange(size)
        real = np.arange(size) < lengths[group][:, None]
        got = forward_backward(scores[np.where(real, at, begin[group][:, None])], lengths[group], transitions, starts)
        out[at[real]] = got[real]
    return out


def train(rows: list[tuple[str, str]], seed: int = 2) -> Chain:
    """Learn from (text, language): stochastic ascent of the conditional log-likelihood with AdaGrad steps.

    Training sequences are put together from stretches of different documents, so that staying and switching are both learned.
    """
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    number = {lang: k for k, lang in enumerate(languages)}
    texts = [(words_of(t), number[lang]) for t, lang in rows]
    n = len(languages)
    seen: list[Counter[bytes]] = [Counter() for _ in languages]
    for ws, lang in texts:
        seen[lang].update(set(ws))
    lists = [sorted(c, key=lambda w: (-c[w], w))[:LEXICON_WORDS] for c in seen]
    lexicon = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lists for w in ws))}
    marks = np.zeros((len(lexicon) + 1, -(-n // 8)), np.uint8)
    for k, ws in enumerate(lists):
        marks[[lexicon[w] for w in ws], k // 8] |= 128 >> k % 8
    model = Chain(languages, lexicon, marks, np.zeros((1 << BITS, n), np.float32), np.eye(n, dtype=np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32))
    stretches = []
    for ws, lang in texts:
        at = 0
        while at < len(ws):
            size = int(rng.integers(1, STRETCH + 1))
            stretches.append((ws[at: at + size], lang))
            at += size
    if n < 2 or not stretches:
        return model
    known: dict[bytes, int] = {}
    sums = [np.full(a.shape, 1e-3, np.float32) for a in (model.grams, model.lists, model.transitions, model.starts)]

    def climb(target: np.ndarray, total: np.ndarray, step: np.ndarray) -> None:
        total += step * step
        target += RATE * step / np.sqrt(total)

    for _ in range(EPOCHS):
        flat, label = [], []
        for k in rng.permutation(len(stretches)):
            flat.extend(stretches[k][0])
            label.extend([stretches[k][1]] * len(stretches[k][0]))
        label = np.array(label)
        for at in range(0, len(flat), BATCH * SEQUENCE):
            ws, y = flat[at: at + BATCH * SEQUENCE], label[at: at + BATCH * SEQUENCE]
            m = len(ws) // SEQUENCE
            if not m:
                continue
            ws, y = ws[: m * SEQUENCE], y[: m * SEQUENCE]
            known = {w: i for i, w in enumerate(dict.fromkeys(ws))}
            types = list(known)
            which = np.array([known[w] for w in ws])
            scores = model.emissions(types)[which].reshape(m, SEQUENCE, n)
            posterior, expected = forward_backward(scores, np.full(m, SEQUENCE), model.transitions, model.starts, pairs=True)
            truth = np.eye(n, dtype=np.float32)[y].reshape(m, SEQUENCE, n)
            wrong = (truth - posterior).reshape(-1, n)
            by_type = np.stack([np.bincount(which, weights=wrong[:, k], minlength=len(types)) for k in range(n)], axis=1) / m
            ids, owner = ngrams(types)
            scaled = by_type / np.sqrt(np.maximum(np.bincount(owner, minlength=len(types)), 1))[:, None]
            step = np.stack([np.bincount(ids, weights=scaled[owner, k], minlength=1 << BITS) for k in range(n)], axis=1)
            climb(model.grams, sums[0], step.astype(np.float32))
            climb(model.lists, sums[1], (model.memberships(types).T @ by_type).astype(np.float32))
            pairs = np.zeros((n, n))
            np.add.at(pairs, (y.reshape(m, -1)[:, :-1].ravel(), y.reshape(m, -1)[:, 1:].ravel()), 1)
            climb(model.transitions, sums[2], ((pairs - expected) / m).astype(np.float32))
            climb(model.starts, sums[3], (truth[:, 0] - posterior[:, 0]).mean(axis=0).astype(np.float32))
    return model


def learn(docs: DataFrame, usable: Column, per_language: int = TRAIN_DOCS) -> Chain:
    """Learn every language from ``text`` and ``lang`` of usable rows: ``per_language`` rows of each, chosen by hash.

    With so many languages that this exceeds ``TRAIN_ALL`` rows, each gives an equal share of these, but one at the least.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("_order"))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    per_language = max(1, min(per_language, TRAIN_ALL // max(len(found), 1)))
    # a share of each language, by hash, that holds twice the wanted number, so that few rows are ranked
    fits = F.lit(False)
    for r in found:
        fits = fits | (F.col("lang") == F.lit(r["lang"])) & (F.pmod("_order", F.lit(1 << 20)) < F.lit(int((2 * per_language + 20) / r["n"] * (1 << 20)) + 1))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "text"))
    picked = rows.where(fits).withColumn("_nth", nth).where(F.col("_nth") <= per_language)
    return train(sorted((r["text"], r["lang"]) for r in picked.select("text", "lang").collect()))


def predict_languages(docs: DataFrame, model: Chain, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row with ``lang_pred`` and ``score``: the predicted language and its mean word probability.

    ``und`` with score 0 where the text is null or empty or has no letter, or nothing was learned.  Every row is predicted by itself, so
    repeated rows and null ids need no rule; only ``text`` is looked at, and columns not carried may have any name; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_{i}" for i in range(len(carry))]
    given = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        claim(f"chain {id(chain)}", chain.forget)
        for batch in pieces(batches, HASH_BLOCK):
            found = chain.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*names, "lang_pred", "score"])

    kinds = T.StructType([*(given.schema[n] for n in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(run, kinds).select(*[F.col(n).alias(c) for n, c in zip(names, carry)], "lang_pred", "score")
