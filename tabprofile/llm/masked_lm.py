"""Operator 9: documents scored by masked pseudo-likelihood.

A small network predicts every token from a window on both sides, and a document's score sums the log-probabilities of all its words.  Tokens
are whole words where the corpus uses them most and classes of words (letter case and ending) otherwise; a word of a class has the probability of
its class in the window times its share of the class in the corpus.  The output layer is a product of two choices, first of a group of tokens
and then of a token in it, so predicting costs two short rows instead of one long.

Training goes over the whole corpus: in every round each task starts from the shared weights, learns on all tokens of all its documents, each
masked in its turn, and hands back its weights, which are averaged by the tokens seen.  Words are counted over the whole corpus, and their
counts stay a Spark table; only the most frequent ones go to all tasks, the others meet the table in a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import documents, mix64, pieces, powers
from tabprofile.session import materialise, shuffle_partitions

#: Groups and tokens per group; of all tokens, so many are whole words, and the rest classes.
GROUPS, MEMBERS, WHOLE = 32, 32, 512
#: Tokens of the window on either side, width of an embedding and of the hidden layer.
REACH, WIDTH, HIDDEN = 3, 16, 32
#: Rounds, tokens per step and step size; every token is masked once in a round.
ROUNDS, BATCH, RATE = 2, 4096, 0.1
#: Classes of words, and words of classes whose shares are sent to all tasks; this only decides which words take the join.
CLASSES, FREQUENT = GROUPS * MEMBERS - WHOLE, 1 << 18
_TEXT_BYTES = 1 << 20
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_CASE = np.zeros(256, np.uint64)
_CASE[65:91] = 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash and a class number (in [0, 2^16)) of each word of some texts, end to end, and the words per text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    up, down, values = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    whole = mix64((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))
    tail = np.maximum(starts, ends - 2)
    first, last = _CASE[data[starts]], _CASE[data[ends - 1]]
    kind = mix64(((sums[ends] - sums[tail]) * down[tail]) * _STEP + first * np.uint64(2) + last) >> np.uint64(48)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return whole, kind.astype(np.int64), np.diff(bounds)


@dataclass
class Weights:
    embed: np.ndarray  # token -> vector, one table per side
    mix: np.ndarray
    mix_bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    inner: np.ndarray  # what the group adds to the hidden layer
    member: np.ndarray
    member_bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 9) -> Weights:
        rng = np.random.default_rng(seed)
        tokens = GROUPS * MEMBERS

        def normal(*shape: int) -> np.ndarray:
            return rng.normal(0, shape[-2] ** -0.5 if len(shape) == 2 else 0.3, shape).astype(np.float32)

        return Weights(
            normal(2, tokens + 1, WIDTH), normal(2 * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN, GROUPS), np.zeros(GROUPS, np.float32),
            normal(GROUPS, HIDDEN) * 0.3, normal(HIDDEN, MEMBERS), np.zeros(MEMBERS, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Weights:
        parts, at = [], 0
        for a in self.arrays():
            parts.append(flat[at: at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Weights(*parts)


def windows(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every token its neighbours: REACH before, then REACH after; places beyond a text hold an extra token."""
    blank = GROUPS * MEMBERS
    padded = np.full(len(tokens) + REACH * (len(counts) + 1), blank, np.int32)
    at = np.arange(len(tokens)) + REACH * (np.repeat(np.arange(len(counts)), counts) + 1)
    padded[at] = tokens
    return padded[at[:, None] + np.array([*range(-REACH, 0), *range(1, REACH + 1)])]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _forward(w: Weights, near: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    both = np.concatenate([sum(w.embed[side][near[:, side * REACH + k]] for k in range(REACH)) for side in (0, 1)], axis=1)
    hidden = np.tanh(both @ w.mix + w.mix_bias)
    group = tokens // MEMBERS
    first = _softmax(hidden @ w.group + w.group_bias)
    narrowed = np.tanh(hidden + w.inner[group])
    second = _softmax(narrowed @ w.member + w.member_bias)
    return both, hidden, group, first, narrowed, second


def log_probabilities(w: Weights, near: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The log-probability of every token given its window."""
    out = np.empty(len(tokens))
    for at in range(0, len(tokens), 4 * BATCH):
        t = tokens[at: at + 4 * BATCH]
        _, _, group, first, _, second = _forward(w, near[at: at + 4 * BATCH], t)
        rows = np.arange(len(t))
        out[at: at + 4 * BATCH] = np.log(np.maximum(first[rows, group] * second[rows, t % MEMBERS], 1e-30))
    return out


def train_step(w: Weights, sums: list[np.ndarray], near: np.ndarray, tokens: np.ndarray) -> None:
    """One AdaGrad step on the mean negative log-probability of ``tokens``."""
    both, hidden, group, first, narrowed, second = _forward(w, near, tokens)
    rows, n = np.arange(len(tokens)), len(tokens)
    second[rows, tokens % MEMBERS] -= 1
    first[rows, group] -= 1
    second /= n
    first /= n
    d_narrowed = (second @ w.member.T) * (1 - narrowed ** 2)
    d_hidden = (first @ w.group.T + d_narrowed) * (1 - hidden ** 2)
    d_both = d_hidden @ w.mix.T
    chosen = np.zeros((n, GROUPS), d_narrowed.dtype)
    chosen[rows, group] = 1
    d_inner = chosen.T @ d_narrowed
    d_embed = np.zeros_like(w.embed)
    for side, part in enumerate((d_both[:, :WIDTH], d_both[:, WIDTH:])):
        places = near[:, side * REACH: (side + 1) * REACH].ravel().astype(np.uint16)  # narrow numbers are sorted by their digits
        order = np.argsort(places, kind="stable")
        places = places[order]
        head = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        d_embed[side, places[head]] = np.add.reduceat(part[order // REACH], head, axis=0)
    steps = [d_embed, both.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ first, first.sum(axis=0), d_inner, narrowed.T @ second, second.sum(axis=0)]
    for p, g, s in zip(w.arrays(), steps, sums):
        s += g * g
        p -= RATE * g / np.sqrt(s)


class Vocabulary:
    """Token numbers: the most frequent words by hash, then classes."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.sort(np.array(hashes, np.uint64))

    def tokens(self, whole: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = WHOLE + kind % CLASSES
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, whole), len(self.hashes) - 1)
            known = self.hashes[at] == whole
            out[known] = at[known]
        return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 4 * _TEXT_BYTES):
        whole, kind, _ = word_hashes(_bytes(batch))
        words, first, n = np.unique(whole, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([
            pa.array(words.view("<i8")), pa.array((kind[first] % CLASSES).astype("i4")), pa.array(n, pa.int64())], ["word", "kind", "n"])


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


@dataclass
class Shares:
    """Log-shares of words in their classes: the most frequent words by hash, all words as the table ``word, share``, and unseen ones by class.

    A class has room for one word more than were counted, which is what an unseen word gets.
    """

    hashes: np.ndarray
    logs: np.ndarray
    table: DataFrame
    unseen: list[float]

    @staticmethod
    def of(counts: DataFrame, whole: list[int]) -> Shares:
        """From ``word, kind, n`` of the corpus, without the words that are tokens themselves."""
        others = counts.where(~F.col("word").isin(whole)) if whole else counts
        totals = dict(others.groupBy("kind").agg(F.sum("n")).collect())  # one row per class
        unseen = [-float(np.log(totals.get(c, 0) + 1)) for c in range(CLASSES)]
        table = others.select("word", "n", (F.log("n") + F.array(*[F.lit(u) for u in unseen])[F.col("kind")]).alias("share"))
        common = table.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "share").toArrow()
        hashes, logs = common.column("word").to_numpy().view(np.uint64), common.column("share").to_numpy()
        order = np.argsort(hashes)
        return Shares(hashes[order], logs[order], table.select("word", "share"), unseen)


@dataclass
class MaskedModel:
    vocabulary: Vocabulary
    weights: Weights
    shares: Shares


def learn_model(docs: DataFrame, rounds: int = ROUNDS) -> MaskedModel:
    """Learn from every text: words are counted over the corpus, then the network is trained on all tokens of all documents.

    Weights of the tasks are averaged in two levels (up to 64 sets at a time) by the tokens that they learned from; one averaged set of about
    {size} numbers, whatever the corpus, comes to the driver in each round.
    """
    texts = documents(docs).select("text")
    spark = docs.sparkSession
    counts = materialise(texts.mapInArrow(_count, "word bigint, kind int, n bigint").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(WHOLE).collect()
    vocabulary = Vocabulary([r["word"] & (1 << 64) - 1 for r in top])
    weights = Weights.fresh()
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, weights))

        def run(batches: Iterable[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            words, start = shared.value
            w = start.filled(start.flat())
            sums = [np.full(a.shape, 1e-6, np.float32) for a in w.arrays()]
            learned, number = 0, 0
            for batch in pieces(batches, _TEXT_BYTES):
                whole, kind, per_text = word_hashes(_bytes(batch))
                if not len(whole):
                    continue
                number += 1
                tokens = words.tokens(whole, kind)
                near = windows(tokens, per_text)
                # windows leave out the token itself, so all of them can be masked in turn; another run takes them in the same order
                masked = np.random.default_rng(len(tokens) + turn).permutation(len(tokens))
                for at in range(0, len(masked), BATCH):
                    some = masked[at: at + BATCH]
                    train_step(w, sums, near[some], tokens[some])
                learned += len(masked)
            if learned:
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(mix64(np.array([learned], np.uint64))[0] % np.uint64(1 << 20))], pa.int64()), pa.array([learned], pa.int64()),
                    pa.array([w.flat().astype("<f4").tobytes()], pa.binary())], ["task", "n", "weights"])

        sets = texts.mapInArrow(run, "task bigint, n bigint, weights binary")
        groups = max(1, min(64, shuffle_partitions(spark)))
        halves = sets.withColumn("part", F.pmod("task", F.lit(groups))).groupBy("part").applyInPandas(_average, "part bigint, n bigint, weights binary")
        found = halves.collect()
        if not found:
            break
        total = _average(pd.DataFrame([r.asDict() for r in sorted(found, key=lambda r: r["part"])]))
        weights = weights.filled(np.frombuffer(total["weights"][0], "<f4"))
    return MaskedModel(vocabulary, weights, Shares.of(counts, [r["word"] for r in top]))


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "weights"])
    total = int(pdf["n"].sum())
    mean = sum(np.frombuffer(w, "<f4").astype(np.float64) * (n / total) for w, n in zip(pdf["weights"], pdf["n"]))
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "n": [total], "weights": [mean.astype("<f4").tobytes()]})


learn_model.__doc__ = learn_model.__doc__.format(size=Weights.fresh().flat().size)


def score_documents(docs: DataFrame, model: MaskedModel) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` for every row: the sum and the mean of its words' log-probabilities.

    A word that is a token has the token's log-probability, any other that of its class plus its log-share in it.
    Null, empty and wordless texts have no tokens, sum 0 and mean null; every row is scored by itself, so repeated rows and null ids need
    no rule; an empty table gives no rows; a text of any length is scored whole, each token once; words that the model has not seen share
    the place that their class has for them.
    """
    shares = model.shares
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.weights, shares.hashes, shares.logs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, hashes, shares_of = shared.value
        for batch in pieces(batches, _TEXT_BYTES):
            whole, kind, counts = word_hashes(_bytes(batch))
            tokens = vocabulary.tokens(whole, kind)
            logs = log_probabilities(weights, windows(tokens, counts), tokens)
            apart = tokens >= WHOLE
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, whole), len(hashes) - 1)
                known = apart & (hashes[at] == whole)
                logs[known] += shares_of[at[known]]
                apart &= ~known
            owner = np.repeat(np.arange(len(counts)), counts)
            total = np.bincount(owner, weights=logs, minlength=len(counts))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[apart], minlength=len(counts)))]).astype("i4"))
            rare = pa.StructArray.from_arrays([pa.array(whole[apart].view("<i8")), pa.array((tokens[apart] - WHOLE).astype("i4"))], ["word", "kind"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(total, pa.float64()), pa.ListArray.from_arrays(ends, rare),
            ], ["doc_id", "n_tokens", "log_likelihood", "rare"])

    scored = materialise(documents(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, log_likelihood double, rare array<struct<word: bigint, kind: int>>").withColumn("row", F.monotonically_increasing_id()))
    unseen = F.array(*[F.lit(u) for u in shares.unseen])[F.col("kind")]
    rare = scored.select("row", F.inline("rare")).groupBy("row", "word", "kind").agg(F.count(F.lit(1)).alias("times"))
    rest = rare.join(shares.table, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce("share", unseen)).alias("rest"))
    whole = scored.drop("rare").join(rest, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0)))
    return whole.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"))
