"""Operator 11: spelling variants, found by probing generated edits against Bloom filters of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import documents, mix64, pieces
from tabprofile.session import materialise, shuffle_partitions

#: Words whose counts a task holds before it hands them on.
HELD_WORDS = 200_000
#: Bits of filter for each word, blocks of so many 64-bit lanes, and the most bytes of all filters together.
BITS = 16
LANES = 8
MAX_FILTER_BYTES = 64 << 20
#: Words from this length on share :data:`LONG_SHARDS` filters, dealt by length, which get more bits as such words have more edits.
LONG = 40
LONG_SHARDS = 8
LONG_BITS = 64
#: Filter bytes that one row carries when filters are built.
SEGMENT_BYTES = 1 << 16
#: Edits that a task holds at a time.
PROBES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- words


def word_counts(docs: DataFrame, every: int | None = 97) -> DataFrame:
    """``word, n``: runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z lower-cased, with how often each occurs.

    With ``every``, a run loses one code point where ``every`` divides the checksum of ``<doc_id>:<run>``, which plants misspellings to be
    found.  Null texts have no runs; a null ``doc_id`` is written as nothing.  Tasks count before anything is shuffled.
    """
    runs = re.compile("[a-zÀ-ÿ]+")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in pieces(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for doc, text in zip(ids, texts):
                if not text:
                    continue
                found = Counter(runs.findall(text.lower().decode()))  # of bytes, only A-Z are lower-cased
                if every:
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word in list(found):
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            at = h % len(word)
                            short, n = word[:at] + word[at + 1:], found.pop(word)
                            held[short] += n
                held.update(found)
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return documents(docs).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- filters


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of letters (n x length): a sum over places, so that an edit changes few of its terms."""
    return (_LETTERS[codes] * _place(codes.shape[1])).sum(1, dtype=np.uint64)


def _place(length: int) -> np.ndarray:
    """A factor per place."""
    out = np.full(length, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _shard(length: int) -> int:
    return length if length < LONG else LONG + length % LONG_SHARDS


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, letters as rows) for each length; all letters are below 256."""
    raw = [w.encode("latin-1") for w in words]
    lengths = np.array([len(r) for r in raw], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint8).reshape(len(at), length)


class Filters:
    """Blocked Bloom filters by length: a word's hash names one block of its length's filter and a bit in each lane of it.

    ``blocks`` is how many blocks each shard has, ``lanes`` the filters themselves.
    """

    def __init__(self, blocks: dict[int, int], lanes: dict[int, np.ndarray] | None = None):
        self.blocks, self.lanes = blocks, lanes

    @classmethod
    def sized(cls, words: dict[int, int]) -> Filters:
        """Filters for so many words of each shard; if all would pass :data:`MAX_FILTER_BYTES`, each gets its share of that, and more edits pass."""
        block = LANES * 64
        want = {s: -(-n * (LONG_BITS if s >= LONG else BITS) // block) + 8 for s, n in words.items()}
        share = min(1.0, MAX_FILTER_BYTES / max(1, sum(want.values()) * block // 8))
        return cls({s: max(1, int(n * share)) for s, n in want.items()})

    def spots(self, shard: int, hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Block of each hash and its bit in every lane."""
        mixed = mix64(hashes)
        block = ((mixed >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)
        bits = mix64(mixed + np.uint64(1))
        return block.astype(np.int64), [np.uint64(1) << ((bits >> np.uint64(6 * k)) & np.uint64(63)) for k in range(LANES)]

    def maybe(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that the filter of ``shard`` may hold."""
        lanes = self.lanes.get(shard)
        if lanes is None:
            return np.zeros(0, np.int64)
        mixed = mix64(hashes)
        left, block = np.arange(len(hashes)), (((mixed >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)).astype(np.int64)
        bits = mix64(mixed + np.uint64(1))
        for k in range(LANES):  # most hashes fall out at the first lanes
            hit = (lanes[block, k] >> ((bits >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1)
            keep = np.flatnonzero(hit)
            left, block, bits = left[keep], block[keep], bits[keep]
        return left


def build_filters(vocabulary: DataFrame) -> Filters:
    """Filters of all words of ``vocabulary`` (``word``).

    Words are dealt out by shard and segment of its filter, so a task fills whole segments and none has to be merged; the driver joins
    segments of at most :data:`MAX_FILTER_BYTES` together.
    """
    length = F.length("word")
    shard = F.when(length < LONG, length).otherwise(LONG + length % LONG_SHARDS)
    sized = Filters.sized({r["shard"]: r["n"] for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).toLocalIterator()})
    blocks, per_segment = sized.blocks, SEGMENT_BYTES // (LANES * 8)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, _, codes in _by_length(batch.column("word").to_pylist()):
                hashes = _hashes(codes)
                block, _ = sized.spots(_shard(n), hashes)
                out.append((np.full(len(block), _shard(n), np.int64), block // per_segment, hashes.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["shard", "segment", "hash"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lanes = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([lanes.tobytes()], pa.binary())], ["shard", "segment", "lanes"])

        for batch in batches:
            shards, segments, hashes = (batch.column(c).to_numpy() for c in ("shard", "segment", "hash"))
            edges = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (segments[1:] != segments[:-1])) + 1), len(shards)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if at != (key := (int(shards[start]), int(segments[start]))):
                    if at is not None:
                        yield out()
                    at, lanes = key, np.zeros((min(per_segment, blocks[key[0]] - key[1] * per_segment), LANES), np.uint64)
                block, bits = sized.spots(key[0], hashes[start: stop].view(np.uint64))
                for k, bit in enumerate(bits):
                    np.bitwise_or.at(lanes[:, k], block - key[1] * per_segment, bit)
        if at is not None:
            yield out()

    filled = vocabulary.select("word").mapInArrow(place, "shard bigint, segment bigint, hash bigint").repartition("shard", "segment").sortWithinPartitions(
        "shard", "segment").mapInArrow(fill, "shard bigint, segment bigint, lanes binary")
    lanes = {s: np.zeros((n, LANES), np.uint64) for s, n in blocks.items()}
    for row in filled.toLocalIterator():
        part = np.frombuffer(row["lanes"], np.uint64).reshape(-1, LANES)
        lanes[row["shard"]][row["segment"] * per_segment:][: len(part)] = part
    return Filters(blocks, lanes)


# ---------------------------------------------------------------- neighbourhoods


def _edits(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, str, int, np.ndarray, np.ndarray]]:
    """(rows from, kind, place, letter codes, hashes of rows x letters) of the deletions and the replacements by larger letters.

    An insertion is a deletion seen from the other word, and a replacement by a smaller letter one by a larger letter.  A deletion within
    a run of one letter gives one word, so only the first of the run is taken.
    """
    n, length = codes.shape
    factors = _place(length + 1)
    for at in range(0, n, max(1, PROBES // (len(letters) + 1))):
        rows = codes[at: at + max(1, PROBES // (len(letters) + 1))]
        terms = _LETTERS[rows] * factors[:length]
        whole = terms.sum(1, dtype=np.uint64)
        before = np.zeros(len(rows), np.uint64)
        after = (_LETTERS[rows[:, 1:]] * factors[:length - 1]).sum(1, dtype=np.uint64)  # what stands behind place 0, one place earlier
        for i in range(length):
            fresh = np.flatnonzero(rows[:, i] != rows[:, i - 1]) if i else np.arange(len(rows))
            yield at, "delete", i, fresh, (before + after)[fresh]
            rest = whole - terms[:, i]
            places, kinds = np.nonzero(letters[None, :] > rows[:, i: i + 1])
            yield at, "replace", i, np.stack([places, letters[kinds]]), rest[places] + _LETTERS[letters[kinds]] * factors[i]
            before = before + terms[:, i]
            if i + 1 < length:
                after = after - _LETTERS[rows[:, i + 1]] * factors[i]


def near_pairs(vocabulary: DataFrame, filters: Filters | None = None) -> DataFrame:
    """``word, n, near, near_n``, both ways, of all words of ``vocabulary`` (``word, n``) that one edit parts.

    Every word probes its deletions and replacements; what the filters pass is written out, shuffled and joined with the vocabulary, which
    drops what they passed wrongly.  All letters of the vocabulary are tried.  The filters are broadcast: :data:`MAX_FILTER_BYTES` bounds
    them, whatever the vocabulary's size.
    """
    spark = vocabulary.sparkSession
    filters = filters or build_filters(vocabulary)
    found = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().toLocalIterator()
    letters = np.array(sorted(ord(r["c"]) for r in found), np.uint8)
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for length, at, codes in _by_length(words):
                near, source = [], []
                for start, kind, i, what, hashes in _edits(codes, letters):
                    if kind == "delete":
                        for k in what[table.maybe(_shard(length - 1), hashes)].tolist():
                            w = words[at[start + k]]
                            near.append(w[:i] + w[i + 1:])
                            source.append(at[start + k])
                    else:
                        hit = table.maybe(_shard(length), hashes)
                        for k, c in zip(what[0][hit].tolist(), what[1][hit].tolist()):
                            w = words[at[start + k]]
                            near.append(w[:i] + chr(c) + w[i + 1:])
                            source.append(at[start + k])
                    if len(near) > 10_000 or near and sum(map(len, near[-8:])) > 1 << 20:
                        yield _rows(near, [words[k] for k in source], [counts[k] for k in source])
                        near, source = [], []
                if near:
                    yield _rows(near, [words[k] for k in source], [counts[k] for k in source])

    even = vocabulary.repartition(4 * shuffle_partitions(spark), "word")
    maybe = even.select("word", "n").mapInArrow(run, "near string, word string, n bigint")
    pairs = maybe.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def _rows(near: list[str], words: list[str], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(near, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["near", "word", "n"])


def variants(counts: DataFrame, wanted: Column | None = None, factor: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``counts`` (``word, n``), which may be restricted by ``wanted``.

    ``form`` is the most frequent word one edit away (ties: the first in code-point order) if it occurs at least ``factor`` times as often,
    else null.  ``root`` follows forms to the last.  Counts grow by ``factor`` on the way, so the rounds that hand roots down from words
    without a form number at most the logarithm of the largest count; a join in them has as many rows per key as a word has neighbours.

    Words are of letters below U+0100.  Null words take no part, repeated words are summed, an empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("forms lead to a last word only if each occurs more often than the one before")
    words = counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    vocabulary = materialise(words.where(wanted) if wanted is not None else words)
    pairs = near_pairs(vocabulary)
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    formed = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(-F.col("best.less") >= factor * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    formed = materialise(formed.select("word", "n", "n_near", "f.form", "f.form_n"))
    done = materialise(formed.where("form IS NULL").select("word", F.col("word").alias("root")))
    roots, last, left = [done], done, materialise(formed.where("form IS NOT NULL").select("word", "form"))
    while left.head(1):
        up = last.select(F.col("word").alias("form"), "root")
        joined = materialise(left.join(up, "form", "left"))
        last = joined.where("root IS NOT NULL").select("word", "root")
        left = joined.where("root IS NULL").select("word", "form")
        roots.append(last)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return formed.join(found, "word").select("word", "form", "root", "n", "n_near", "form_n")
