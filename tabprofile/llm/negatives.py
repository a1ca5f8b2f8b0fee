"""Operator 12: hard negatives by an inverted multi-index over two half-spaces.

Each half of the space has a codebook; the pair of nearest codes is a vector's cell.  An anchor's inner product with any row of a cell is
at most the sum of two half-bounds, code score plus anchor length times code radius.  A heap walks the cells in falling order of that sum,
and an anchor is done when no cell left can reach into a window that is still open.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.session import materialise, shuffle_partitions

#: Most codes of each half, which bound the cells by their square, and the rows aimed at per cell below that.
CODES = 256
CELL_ROWS = 64
#: Rows that the codebooks are fitted on, chosen by hash; every row is indexed.
FIT_ROWS = 20_000
#: Rows in a block of the index, and anchors that travel together.
BLOCK_ROWS = 2048
ANCHOR_ROWS = 256
#: Rows that a first walk visits at least, to learn how far the second has to go.
PROBE_ROWS = 1024
_FAR = 1 << 62
#: Inner products below this are exact in double precision.
_EXACT = float(1 << 52)


@dataclass
class MultiIndex:
    """``blocks``: packed rows; ``codes``: two codebooks; ``cells``: per cell (first code, second code, rows before it, rows);
    ``within``: per cell the largest distance of a row from its code in each half.
    """

    blocks: DataFrame
    codes: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray
    within: np.ndarray
    width: int


def _fit(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Codes of one half by a few rounds of Lloyd's method; codes that lose all rows stay where they are."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    codes = distinct[rng.permutation(len(distinct))[:k]].astype(float)
    for _ in range(8):
        near = _nearest(rows, codes)[0]
        sums = np.zeros_like(codes)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(codes))
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


def _nearest(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each row and the distance from it."""
    near = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        part = rows[at: at + 4096]
        near[at: at + 4096] = np.argmin((codes * codes).sum(1) - 2 * part @ codes.T, axis=1)
    return near, np.sqrt(((rows - codes[near]) ** 2).sum(1))


def _dense(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` 64-bit integers; missing components are 0."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width) < lens[:, None]] = flat
    return out


def build_multi_index(vectors: DataFrame) -> MultiIndex:
    """Index all rows of ``vec_id, label, vector``.

    Codebooks are fitted on at most about :data:`FIT_ROWS` rows.  Rows are numbered by cell and, within it, by hash; blocks are cut from
    these numbers, so a cell with any share of the rows fills many blocks of one size.  The driver holds codes and cells, whose number
    :data:`CODES` bounds.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width, half = max(size["width"] or 0, 2), max(size["width"] or 0, 2) // 2
    share = min(1.0, FIT_ROWS / max(size["n"], 1))
    fit = vectors.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else vectors
    found = fit.select("vector").limit(2 * FIT_ROWS).toArrow().column("vector").combine_chunks() if size["n"] else pa.array([], pa.list_(pa.int64()))
    sample = _dense(found, width).astype(float)
    k = min(CODES, max(4, int((size["n"] / CELL_ROWS) ** 0.5)))
    codes = _fit(sample[:, :half], k, 1), _fit(sample[:, half:], k, 2)
    shared = spark.sparkContext.broadcast(codes)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for batch in batches:
            rows = _dense(batch.column("vector"), width).astype(float)
            (a, far_a), (b, far_b) = _nearest(rows[:, :half], first), _nearest(rows[:, half:], second)
            arrays = [pa.array(a * len(second) + b, pa.int64()), pa.array(far_a), pa.array(far_b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "cell", "far_a", "far_b"])

    placed = materialise(vectors.select("vec_id", "label", "vector").mapInArrow(
        assign, "vec_id bigint, label bigint, vector array<bigint>, cell bigint, far_a double, far_b double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_a").alias("a"), F.max("far_b").alias("b")).orderBy("cell").toPandas()
    n = cells["n"].to_numpy(np.int64)
    at = cells["cell"].to_numpy(np.int64)
    table = np.stack([at // len(codes[1]), at % len(codes[1]), np.cumsum(n) - n, n], axis=1) if len(n) else np.zeros((0, 4), np.int64)
    within = np.stack([cells["a"].to_numpy(float), cells["b"].to_numpy(float)], axis=1)
    before = spark.createDataFrame([(int(c), int(s), int(m)) for c, s, m in zip(at, table[:, 2], n)], "cell bigint, before bigint, in_cell bigint")
    # within a cell a row takes a place by hash of its place in the stored table: cells of equal rows are spread as evenly as others
    numbered = placed.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(before), "cell").withColumn(
        "block", F.floor((F.col("before") + F.pmod("spread", "in_cell")) / F.lit(BLOCK_ROWS)).cast("bigint"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None

        def row() -> pa.RecordBatch:
            cell, ids, labels = (np.concatenate([h[i] for h in held]) for i in range(3))
            values = np.concatenate([h[3] for h in held])
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            packed = [cell[starts], np.r_[starts, len(cell)], ids, labels, values]
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *(pa.array([np.ascontiguousarray(p, "<i8").tobytes()], pa.binary()) for p in packed)],
                ["block", "cells", "starts", "ids", "labels", "values"])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if held and blocks[start] != block:
                    yield row()
                    held = []
                block, part = int(blocks[start]), batch.slice(start, stop - start)
                held.append((*(part.column(c).to_numpy() for c in ("cell", "vec_id", "label")), _dense(part.column("vector"), width)))
        if held:
            yield row()

    packed = numbered.select("block", "cell", "vec_id", "label", "vector").repartition("block").sortWithinPartitions(
        "block", "cell", "vec_id").mapInArrow(pack, "block bigint, cells binary, starts binary, ids binary, labels binary, values binary")
    return MultiIndex(materialise(packed), codes, table, within, width)


class Walks:
    """What the walks of all anchors share: codes, cells by code pair, and the largest radius of each code."""

    def __init__(self, codes: tuple[np.ndarray, np.ndarray], cells: np.ndarray, within: np.ndarray):
        self.codes, self.cells, self.within = codes, cells, within
        self.radii = [np.zeros(len(c)) for c in codes]
        for side in (0, 1):
            np.maximum.at(self.radii[side], cells[:, side], within[:, side])
        self.width = len(codes[1])
        self.number = cells[:, 0] * self.width + cells[:, 1]
        self.place = dict(zip(self.number.tolist(), range(len(cells))))
        self.largest = [float(np.linalg.norm(c, axis=1).max(initial=0)) + float(r.max(initial=0)) for c, r in zip(codes, self.radii)]

    def of(self, anchor: np.ndarray) -> Walk:
        return Walk(self, anchor.astype(float))


class Walk:
    """Cells in falling order of their bound for one anchor: the multi-sequence of two sorted lists of half-bounds."""

    def __init__(self, shared: Walks, q: np.ndarray):
        half = shared.codes[0].shape[1]
        sides = q[:half], q[half:]
        lengths = [float(np.linalg.norm(x)) for x in sides]
        sums = [c @ x for c, x in zip(shared.codes, sides)]
        bounds = [s + n * r for s, n, r in zip(sums, lengths, shared.radii)]
        self.shared, self.cells = shared, shared.cells
        self.order = [np.argsort(-b, kind="stable").tolist() for b in bounds]
        self.bounds = [b[o].tolist() for b, o in zip(bounds, self.order)]
        # floats may be off in their last digits
        self.slack = 1e-3 + 1e-10 * sum(n * m for n, m in zip(lengths, shared.largest))
        # a cell's own radii give a closer bound
        own = sums[0][self.cells[:, 0]] + sums[1][self.cells[:, 1]] + lengths[0] * shared.within[:, 0] + lengths[1] * shared.within[:, 1]
        self.own = own + self.slack

    def __iter__(self) -> Iterator[tuple[float, int]]:
        """(bound of all cells from here on, place of the cell in the table); cells without rows are passed over."""
        (a, b), (order_a, order_b), place, width = self.bounds, self.order, self.shared.place, self.shared.width
        heap, reached = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = place.get(order_a[i] * width + order_b[j])
            if cell is not None:
                yield -bound + self.slack, cell
            for nxt in ((i + 1, j), (i, j + 1)):
                if nxt[0] < len(a) and nxt[1] < len(b) and nxt not in reached:
                    reached.add(nxt)
                    heapq.heappush(heap, (-(a[nxt[0]] + b[nxt[1]]), *nxt))

    def probe(self, rows: int) -> list[int]:
        """The first cells that hold ``rows`` rows together."""
        out, n = [], 0
        for _, cell in self:
            out.append(cell)
            n += self.cells[cell, 3]
            if n >= rows:
                break
        return out

    def down_to(self, least: float) -> list[int]:
        """All cells that may hold a score of ``least`` or more."""
        out = []
        for bound, cell in self:
            if bound < least:
                break
            if self.own[cell] >= least:
                out.append(cell)
        return out


def _visit(index: MultiIndex, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor_id, low, high, score, vec_id``: the ``k`` best rows of each window in the cells that a walk visits.

    ``anchors`` has ``anchor_id, label, vector, least`` and ``windows``, pairs of lowest and highest score; ``least`` ends the walk, null
    for a probe of :data:`PROBE_ROWS` rows.  Only rows of the anchor's label count, or only others.  A task walks for many anchors and sends them, per block of the index, with the cells that each wants.
    """
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast((index.codes, index.cells, index.within, index.width))  # CODES bounds it

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, width = Walks(*shared.value[:3]), shared.value[3]
        cells, number = walks.cells, walks.number
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHOR_ROWS):
                part = batch.slice(at, ANCHOR_ROWS)
                vectors = _dense(part.column("vector"), width)
                ids, labels, least = (part.column(c).to_pylist() for c in ("anchor_id", "label", "least"))
                windows = part.column("windows").to_pylist()
                wanted: dict[int, list[tuple[int, int]]] = {}
                for i in range(len(ids)):
                    path = walks.of(vectors[i])
                    for cell in path.probe(PROBE_ROWS) if least[i] is None else path.down_to(least[i]):
                        start, n = cells[cell, 2:]
                        for block in range(start // BLOCK_ROWS, (start + n - 1) // BLOCK_ROWS + 1):
                            wanted.setdefault(int(block), []).append((i, int(number[cell])))
                for block, pairs in wanted.items():
                    some = sorted({i for i, _ in pairs})
                    back = {i: k for k, i in enumerate(some)}
                    flat = [w for i in some for w in windows[i]]
                    arrays = [
                        np.array([ids[i] for i in some]), np.array([labels[i] for i in some]), vectors[some],
                        np.array([(back[i], c) for i, c in pairs]), np.cumsum([0, *(len(windows[i]) for i in some)]),
                        np.array([(w["low"], w["high"]) for w in flat])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), *(pa.array([np.ascontiguousarray(x, "<i8").tobytes()], pa.binary()) for x in arrays)],
                        ["block", "q_ids", "q_labels", "q_values", "q_cells", "q_windows", "q_limits"])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = shared.value[3]
        names = [("cells", 1), ("starts", 1), ("ids", 1), ("labels", 1), ("values", width), ("q_ids", 1), ("q_labels", 1), ("q_values", width), ("q_cells", 2), ("q_windows", 1), ("q_limits", 2)]
        for batch in batches:
            for row in range(batch.num_rows):
                cells, starts, ids, labels, values, q_ids, q_labels, q_values, pairs, edges, limits = (
                    np.frombuffer(batch.column(c)[row].as_buffer(), "<i8").reshape(-1, w) if w > 1 else np.frombuffer(batch.column(c)[row].as_buffer(), "<i8")
                    for c, w in names)
                exact = float(np.abs(q_values).max(initial=0)) * float(np.abs(values).max(initial=0)) * width < _EXACT
                left, right = (values.astype(float), q_values.astype(float)) if exact else (values, q_values)
                place = {int(c): k for k, c in enumerate(cells)}
                out = []
                for i in range(len(q_ids)):
                    runs = [place[c] for c in pairs[pairs[:, 0] == i, 1].tolist() if c in place]
                    if not runs:
                        continue
                    pick = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in runs])
                    pick = pick[((labels[pick] == q_labels[i]) == same) & (ids[pick] != q_ids[i])]
                    scores = np.rint(left[pick] @ right[i]).astype(np.int64) if exact else left[pick] @ right[i]
                    for low, high in np.unique(limits[edges[i]: edges[i + 1]], axis=0):
                        inside = np.flatnonzero((scores >= low) & (scores <= high))
                        if len(inside) > k:
                            edge = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                            inside = inside[scores[inside] >= edge]
                        best = inside[np.lexsort((ids[pick[inside]], -scores[inside]))[:k]]
                        n = len(best)
                        out.append((np.full(n, q_ids[i]), np.full(n, low), np.full(n, high), scores[best], ids[pick[best]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["anchor_id", "low", "high", "score", "vec_id"])

    asked = anchors.select("anchor_id", "label", "vector", "least", "windows").repartition(shuffle_partitions(spark), "anchor_id").mapInArrow(
        walk, "block bigint, q_ids binary, q_labels binary, q_values binary, q_cells binary, q_windows binary, q_limits binary")
    found = index.blocks.join(asked, "block").mapInArrow(score, "anchor_id bigint, low bigint, high bigint, score bigint, vec_id bigint")
    order = Window.partitionBy("anchor_id", "low", "high").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vec_id, label, vector`` rows of integers.

    An anchor's positives are its best ``positives`` other rows of its label by inner product; for each, the best ``negatives`` rows of
    other labels whose score is between ``percent`` per cent of the positive's and the positive's are returned.  Ties go to the smaller
    ``vec_id``.  Walks come in pairs: a probe of the nearest cells gives scores that the final result cannot fall below, and the second
    walk ends where bounds fall below them, so results are exact whatever the codebooks are.

    Rows with a null id, label or vector take no part.  A row that repeats another's id is a separate candidate, but none for an anchor
    of that id; of anchors that repeat an id the first by label and vector stands.  Missing components of shorter vectors are 0.  A
    positive of negative score has an empty window and no rows, as has an anchor without positives.  An empty table gives no rows.
    """
    rows = materialise(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "vector").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()))
    index = build_multi_index(rows)
    anchors = materialise(rows.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(
        F.min(F.struct("label", "vector")).alias("a")).select("anchor_id", "a.label", "a.vector"))
    all_scores = F.array(F.struct(F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high")))

    def lowest(found: DataFrame, keys: list[str], k: int, floor) -> DataFrame:
        """The k-th best score of each window, or ``floor`` where fewer were found."""
        return found.groupBy(*keys).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(floor).alias("least"))

    probed = _visit(index, anchors.withColumns({"least": F.lit(None).cast("double"), "windows": all_scores}), positives, True)
    reach = lowest(probed, ["anchor_id"], positives, F.lit(-float(_FAR)))
    asked = anchors.join(reach, "anchor_id", "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(-float(_FAR))))
    best = materialise(_visit(index, asked.withColumn("windows", all_scores), positives, True).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("high"),
        F.expr(f"(score * {int(percent)} + 99) div 100").alias("low")).where("high >= 0"))
    windows = best.groupBy("anchor_id").agg(F.collect_set(F.struct("low", "high")).alias("windows"), F.min("low").alias("low"), F.max("high").alias("high"))
    asked = materialise(anchors.join(windows, "anchor_id"))
    probed = _visit(index, asked.withColumn("least", F.lit(None).cast("double")), negatives, False)
    closed = lowest(probed, ["anchor_id", "low", "high"], negatives, F.col("low"))
    open_windows = asked.select("anchor_id", F.explode("windows").alias("w")).select("anchor_id", "w.low", "w.high")
    reach = open_windows.join(closed, ["anchor_id", "low", "high"], "left").groupBy("anchor_id").agg(
        F.min(F.coalesce("least", "low")).cast("double").alias("least"))
    final = _visit(index, asked.join(reach, "anchor_id"), negatives, False)
    return best.join(final.withColumnRenamed("vec_id", "negative_id"), ["anchor_id", "low", "high"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))


def labelled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector`` of ``vec_id, label, embedding``, each component x as floor(scale * x) in 64 bits.

    Rows whose id, label or vector is null, or whose vector holds a null or non-finite component, are left out, as are other columns.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")).alias("vector"))
