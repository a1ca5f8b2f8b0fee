"""Operator 10: packing into sequences by minimum bin slack.

A document's ids are cut into full sequences and one shorter rest.  The rests of a batch are known by their length counts
alone, so a sequence is filled by a subset-sum over the lengths still there: reachable sums are the bits of an integer,
the sum nearest the capacity is traced back into a multiset of lengths, and that multiset is used as often as the counts
allow.  What fills no sequence at a task's end is cut so that every sequence has a power of two of ids and none is padded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tabprofile.llm.common import documents, encoder, pieces, tokenizer_spec

#: Rests that a task gathers before it fills sequences from them.
POOL = 32_768
#: Ids handed over to Spark at a time.
_EMIT_IDS = 1 << 20


def best_fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """Lengths and how often each is used, with the largest sum up to ``room``; ``counts[l]`` pieces have length ``l``."""
    goal, mask = 1 << room, (2 << room) - 1
    reach, steps = 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        if not length:
            continue
        left, many = min(int(counts[length]), room // length), 1
        while left and not reach & goal:
            many = min(many, left)
            steps.append((reach, length, many))
            reach = (reach | reach << length * many) & mask
            left -= many
            many *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, many in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + many
            total -= length * many
    return used


def fill_sequences(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns of lengths with the number of sequences that each fills exactly; ``counts`` keeps what is left.

    The longest piece left is always placed first.  A pattern that leaves slack is not used: its longest piece waits.
    """
    patterns, waiting = [], []
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1
            used = best_fill(counts, capacity - length)
            counts[length] += 1
            used[length] = used.get(length, 0) + 1
            if sum(k * v for k, v in used.items()) != capacity:
                waiting.append((length, int(counts[length])))
                counts[length] = 0
                break
            times = min(int(counts[k]) // v for k, v in used.items())
            for k, v in used.items():
                counts[k] -= v * times
            patterns.append((used, times))
    for length, n in waiting:
        counts[length] += n
    return patterns


class _Packer:
    """Pieces of one task: (document row, start, length, sequence, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.rests: dict[int, deque] = {}
        self.n_rests = 0

    def add(self, doc: int, n: int) -> Iterator[tuple]:
        whole = n // self.capacity
        for k in range(whole):
            yield doc, k * self.capacity, self.capacity, self.next, 0
            self.next += 1
        if n % self.capacity:
            self.rests.setdefault(n % self.capacity, deque()).append((doc, whole * self.capacity))
            self.n_rests += 1

    def fill(self) -> Iterator[tuple]:
        counts = np.zeros(self.capacity + 1, np.int64)
        for length, queue in self.rests.items():
            counts[length] = len(queue)
        for used, times in fill_sequences(counts, self.capacity):
            for _ in range(times):
                offset = 0
                for length, many in used.items():
                    for _ in range(many):
                        doc, start = self.rests[length].popleft()
                        yield doc, start, length, self.next, offset
                        offset += length
                        self.n_rests -= 1
                self.next += 1

    def finish(self) -> Iterator[tuple]:
        """Fill what can be filled; then lay the others end to end and cut them into powers of two."""
        yield from self.fill()
        left = [(doc, start, length) for length, q in sorted(self.rests.items(), reverse=True) for doc, start in q]
        total, at = sum(p[2] for p in left), 0
        bounds = []
        while at < total:
            size = self.capacity if total - at >= self.capacity else 1 << (total - at).bit_length() - 1
            bounds.append(at + size)
            at += size
        offset, k, at = 0, 0, 0
        for doc, start, length in left:
            while length:
                take = min(length, bounds[k] - at)
                yield doc, start, take, self.next, offset
                start, length, at, offset = start + take, length - take, at + take, offset + take
                if at == bounds[k]:
                    self.next, k, offset = self.next + 1, k + 1, 0
        self.rests, self.n_rests = {}, 0


SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, pool: int = POOL) -> DataFrame:
    """One row per piece: where it lies in its document, its ids (little-endian unsigned 32-bit) and its place in a sequence.

    Every task packs the documents of its own partition, so nothing is shuffled; a sequence's number starts with its
    task's.  A task holds at most ``pool`` rests, each shorter than ``capacity`` (a power of two).

    Every row is a document of its own, also where ``doc_id`` repeats or is null; null and empty texts are ``end_id``
    alone; an empty table gives no rows; a text of any length is cut into full sequences.
    """
    if capacity & capacity - 1 or capacity < 1:
        raise ValueError("capacity must be a power of two")
    spec = tokenizer_spec(docs.sparkSession, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        packer = _Packer(capacity, TaskContext.get().partitionId() << 40)
        held: dict[int, tuple] = {}  # row -> document, its length, where the kept ids start, the kept ids
        out: list[tuple] = []
        ready, row = 0, 0
        end = np.array([end_id], enc.dtype)

        def emit(placed: Iterable[tuple], rests: bool) -> None:
            nonlocal ready
            for doc, start, length, sequence, offset in placed:
                doc_id, n, base, ids = held[doc]
                cut = ids[start - base: start - base + length].astype("<u4").tobytes()
                out.append((doc_id, start, length, cut, n, sequence, offset))
                ready += length
                if rests and start + length == n:
                    del held[doc]

        def flush() -> pa.RecordBatch:
            nonlocal ready
            columns = list(zip(*out))
            out.clear()
            ready = 0
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in pieces(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                ids = np.concatenate([np.frombuffer(raw, enc.dtype), end])
                held[row] = doc_id, len(ids), 0, ids
                emit(packer.add(row, len(ids)), False)
                kept = len(ids) // capacity * capacity
                if kept == len(ids):
                    del held[row]
                else:
                    held[row] = doc_id, len(ids), kept, ids[kept:].copy()
                row += 1
                if packer.n_rests >= pool:
                    emit(packer.fill(), True)
                    if packer.n_rests >= pool // 2:
                        emit(packer.finish(), True)
                if ready >= _EMIT_IDS:
                    yield flush()
        emit(packer.finish(), True)
        if out:
            yield flush()

    return documents(docs).mapInArrow(run, SCHEMA)
