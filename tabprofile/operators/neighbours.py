"""Exact k-nearest-neighbour self-join without comparing all pairs.

Space is cut into boxes of similar size from a bounded sample.  Each point first searches its own
box, which bounds the distance of its k-th neighbour; it is then sent only to the boxes that this
ball touches.  The answer is exact for any box layout; the layout only decides the work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.functions.sampling import hash_sample
from tabprofile.session import materialise, shuffle_partitions

#: Dimensions up to which boxes tell near points from far ones well, so that small boxes save work; wider balls touch most boxes anyway.
NARROW = 8
POINTS_PER_BOX = 500
POINTS_PER_WIDE_BOX = 8_192
#: Queries that one group of a box serves, and pairs that one task compares.
QUERIES_PER_GROUP = 8_000
PAIRS_PER_TASK = 50_000_000
MAX_TASKS = 4_096
#: Rows of a batch handed on to boxes.
SPREAD_ROWS = 20_000
MAX_BOXES = 16_384
LAYOUT_SAMPLE = 100_000


@dataclass(frozen=True)
class Boxes:
    """A binary tree over space: inner nodes split one dimension, leaves are boxes.

    ``low``/``high`` are the extremes of the points really inside each node.
    """

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return self.leaf[node]
            at = node[inner]
            goes_left = x[inner, self.dim[at]] <= self.cut[at]
            node[inner] = np.where(goes_left, self.left[at], self.right[at])

    def touching(self, x: np.ndarray, radius: np.ndarray, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs whose box comes within the row's radius."""
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        rows, leaves = [], []
        while len(row):
            gap = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0.0)
            # a hair of slack so that rounding cannot exclude a box that is exactly in reach
            away = np.sqrt((gap * gap).sum(1)) if metric == "euclidean" else gap.max(1)
            near = away <= radius[row] * (1 + 1e-9)
            row, node = row[near], node[near]
            done = self.dim[node] < 0
            rows.append(row[done])
            leaves.append(self.leaf[node[done]])
            row, node = row[~done], node[~done]
            row, node = np.r_[row, row], np.r_[self.left[node], self.right[node]]
        return np.concatenate(rows), np.concatenate(leaves)

    def with_extents(self, extents: dict[int, tuple[np.ndarray, np.ndarray]], width: int) -> Boxes:
        low, high = np.full((len(self.dim), width), np.inf), np.full((len(self.dim), width), -np.inf)
        for node in range(len(self.dim) - 1, -1, -1):  # children follow their parent
            if self.dim[node] < 0:
                if int(self.leaf[node]) in extents:
                    low[node], high[node] = extents[int(self.leaf[node])]
            else:
                kids = [self.left[node], self.right[node]]
                low[node], high[node] = low[kids].min(0), high[kids].max(0)
        return Boxes(self.dim, self.cut, self.left, self.right, self.leaf, low, high)


def _layout(sample: np.ndarray, boxes: int) -> Boxes:
    dim, cut, left, right, leaf = [], [], [], [], []
    leaves = 0
    queue = [(sample, boxes, None, None)]
    while queue:
        points, share, parent, side = queue.pop(0)
        me = len(dim)
        if parent is not None:
            (left if side == "left" else right)[parent] = me
        dim.append(-1), cut.append(0.0), left.append(-1), right.append(-1), leaf.append(-1)
        if share > 1 and len(points) > 1:
            axis = int(np.argmax(points.max(0) - points.min(0)))
            middle = float(np.quantile(points[:, axis], 0.5, method="lower"))
            below = points[:, axis] <= middle
            if below.any() and not below.all():
                dim[me], cut[me] = axis, middle
                queue.append((points[below], share // 2, me, "left"))
                queue.append((points[~below], share - share // 2, me, "right"))
                continue
        leaf[me] = leaves
        leaves += 1
    return Boxes(*[np.array(v) for v in (dim, cut, left, right, leaf)])


def _rough(x, px, metric: str):
    """Distances (squared ones for ``euclidean``) of rows and points, and per row a bound on their error.

    Many dimensions are one matrix product around the points' middle; its rounding grows with the lengths that cancel in it.
    """
    if metric == "euclidean" and px.shape[1] > NARROW:
        whole = np.isfinite(px).all(1)
        if not whole.all():
            px = np.where(whole[:, None], px, 0.0)
        middle = px.mean(0)
        qc, pc = x - middle, px - middle
        qs, ps = (qc * qc).sum(1), (pc * pc).sum(1)
        rough = qc @ pc.T
        rough *= -2.0
        rough += qs[:, None]
        rough += np.where(whole, ps, np.inf)[None, :]
        return rough, 8.0 * np.finfo(float).eps * (px.shape[1] + 8) * (qs + ps.max())
    rough = np.zeros((len(x), len(px)))
    for j in range(px.shape[1]):
        diff = x[:, j, None] - px[None, :, j]
        if metric == "euclidean":
            diff *= diff
            rough += diff
        else:
            np.maximum(rough, np.abs(diff, out=diff), out=rough)
    return rough, np.zeros(len(x))


def _exact(x, y, metric: str):
    """Distances of paired rows."""
    distance = np.zeros(len(x))
    for j in range(x.shape[1]):
        diff = x[:, j] - y[:, j]
        if metric == "euclidean":
            distance += diff * diff
        else:
            np.maximum(distance, np.abs(diff), out=distance)
    return np.sqrt(distance) if metric == "euclidean" else distance


def _nearest(qx, qid, px, pid, pn, k: int, metric: str = "euclidean"):
    """For each query the closest points of one box, enough to cover k copies: (query, point, distance, copies).

    Rough distances pick the points that may be among them; only for these exact ones are taken.
    """
    out_q, out_p, out_d, out_n = [], [], [], []
    if not len(px):
        return [np.array([])] * 4
    step = max(1, 4_000_000 // len(px))
    in_order = np.argsort(pid, kind="stable")
    take = min(k, len(px))
    for start in range(0, len(qx), step):
        x, ids = qx[start : start + step], qid[start : start + step]
        rough, error = _rough(x, px, metric)
        # a point is no neighbour of itself unless it stands for more rows
        own = in_order[np.minimum(np.searchsorted(pid, ids, sorter=in_order), len(pid) - 1)]
        alone = np.flatnonzero((pid[own] == ids) & (pn[own] <= 1))
        rough[alone, own[alone]] = np.inf
        # candidates up to the k-th distance, ties and what rounding may hide included
        kth = np.partition(rough, take - 1, axis=1)[:, take - 1]
        r, c = np.nonzero(rough <= (kth * (1 + 1e-12) + 2 * error)[:, None])
        real = np.isfinite(rough[r, c])
        r, c = r[real], c[real]
        d = _exact(x[r], px[c], metric)
        order = np.lexsort((pid[c], d, r))
        r, c, d = r[order], c[order], d[order]
        n = pn[c] - (ids[r] == pid[c])
        first = np.r_[True, np.diff(r) != 0] if len(r) else np.array([], dtype=bool)
        run = np.cumsum(n)
        base = np.maximum.accumulate(np.where(first, run - n, 0)) if len(r) else run
        keep = run - n - base < k
        out_q.append(ids[r[keep]]), out_p.append(pid[c[keep]]), out_d.append(d[keep]), out_n.append(n[keep])
    return [np.concatenate(v) if v else np.array([]) for v in (out_q, out_p, out_d, out_n)]


def nearest_neighbours(points: DataFrame, k: int, points_per_box: int | None = None, metric: str = "euclidean") -> DataFrame:
    """``id, other, distance, copies`` of the k nearest neighbours of every point; ``metric`` may be ``max``, the largest difference.

    ``points`` has a unique ``id`` (bigint), ``x`` (array of doubles, no nulls) and ``n``, how many
    equal rows the point stands for.  A point's own further copies are its neighbours at distance
    0; ``copies`` of a point's neighbours add up to k.  Equal distances are taken in id order.
    """
    points = materialise(points.select("id", "x", F.col("n").cast("bigint").alias("n")))
    total = points.count()
    width = points.select(F.size("x")).first()[0] if total else 0
    if total == 0 or k < 1:
        return points.sparkSession.createDataFrame([], "id bigint, other bigint, distance double, copies bigint")
    if points_per_box is None:
        points_per_box = POINTS_PER_BOX if width <= NARROW else POINTS_PER_WIDE_BOX
    wanted = int(min(max(1, -(-total // points_per_box)), MAX_BOXES))
    spark = points.sparkSession

    def tasks(pairs: float, groups: int) -> int:
        """How many tasks share the work: it follows the pairs compared, not the bytes read, by which Spark would merge partitions."""
        return int(max(1, min(groups, max(shuffle_partitions(spark), pairs // PAIRS_PER_TASK), MAX_TASKS)))

    picked = hash_sample(points, "id", LAYOUT_SAMPLE).select("x") if wanted > 1 else points.limit(1).select("x")
    boxes = _layout(np.array([r[0] for r in picked.collect()], dtype=float).reshape(-1, width), wanted)

    @F.pandas_udf(T.IntegerType())
    def box_of(x):
        import pandas as pd
        return pd.Series(boxes.assign(np.stack(x.to_numpy())) if len(x) else [], dtype="int32")

    placed = points.withColumn("box", box_of("x"))
    extents = placed.groupBy("box").agg(
        F.array(*[F.min(F.col("x")[i]) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.col("x")[i]) for i in range(width)]).alias("high"), F.count(F.lit(1)).alias("n"),
    ).collect()  # one row per box
    tree = boxes.with_extents({r["box"]: (np.array(r["low"]), np.array(r["high"])) for r in extents}, width)

    def own_radius(group):
        import pandas as pd

        x, ids, n = np.stack(group["x"].to_numpy()), group["id"].to_numpy(), group["n"].to_numpy()
        q, _, d, copies = _nearest(x, ids, x, ids, n, k, metric)
        radius = pd.DataFrame({"id": q, "d": d, "c": copies}).groupby("id").agg(d=("d", "max"), c=("c", "sum"))
        full = radius["d"].where(radius["c"] >= k, np.inf).reindex(ids, fill_value=np.inf)
        return pd.DataFrame({"id": ids, "x": list(x), "radius": full.to_numpy()})

    held = {r["box"]: r["n"] for r in extents}
    alike = tasks(sum(n * n for n in held.values()), len(held))
    searched = placed.repartition(alike, "box").groupBy("box").applyInPandas(own_radius, "id bigint, x array<double>, radius double")

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            row, leaf = tree.touching(x, batch.column("radius").to_numpy(zero_copy_only=False), metric)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for start in range(0, len(row), SPREAD_ROWS):
                some = row[start : start + SPREAD_ROWS]
                ends = pa.array(np.arange(0, len(some) * width + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[some]), pa.ListArray.from_arrays(ends, pa.array(x[some].ravel())),
                    pa.array(leaf[start : start + SPREAD_ROWS].astype("int32"))], ["id", "x", "box"])

    asked = materialise(searched.mapInArrow(spread, "id bigint, x array<double>, box int"))
    # a box asked by very many points is copied so that no task serves more than a few boxes' worth
    loads = {r["box"]: r["c"] for r in asked.groupBy("box").agg(F.count(F.lit(1)).alias("c")).collect()}
    most = max(4 * points_per_box, QUERIES_PER_GROUP if points_per_box >= POINTS_PER_BOX else 0)
    copies_of = {b: -(-c // most) for b, c in loads.items() if c > most}
    met = tasks(sum(c * held.get(b, 0) for b, c in loads.items()), sum(copies_of.get(b, 1) for b in loads))
    shares = lambda: F.broadcast(spark.createDataFrame(
        [(b, int(copies_of.get(b, 1))) for b in loads], "box int, shares int"))
    asked = asked.join(shares(), "box").select(
        "id", "x", "box", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
    served = placed.join(shares(), "box").select(
        "id", "x", "n", "box", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def answer(queries, pts):
        import pandas as pd

        if not len(queries) or not len(pts):
            return pd.DataFrame({"id": [], "other": [], "distance": [], "copies": []})
        q, p, d, n = _nearest(
            np.stack(queries["x"].to_numpy()), queries["id"].to_numpy(),
            np.stack(pts["x"].to_numpy()), pts["id"].to_numpy(), pts["n"].to_numpy(), k, metric)
        return pd.DataFrame({"id": q, "other": p, "distance": d, "copies": n})

    together = [side.repartition(met, "box", "share").groupBy("box", "share") for side in (asked, served)]
    found = together[0].cogroup(together[1]).applyInPandas(
        answer, "id bigint, other bigint, distance double, copies bigint")
    by_distance = Window.partitionBy("id").orderBy("distance", "other")
    return (
        found.withColumn("before", F.sum("copies").over(by_distance) - F.col("copies"))
        .where(F.col("before") < k)
        .select("id", "other", "distance", F.least("copies", k - F.col("before")).alias("copies"))
    )
