"""Outlier detectors.  Each returns the rows it flags; :func:`outlier_report` condenses them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.functions.frames import as_double, col, normalise, numeric_columns, per_column, scalars
from tabprofile.functions.sampling import unit_hash, with_point_id
from tabprofile.functions.stats import exact_quantiles
from tabprofile.operators.neighbours import nearest_neighbours
from tabprofile.session import materialise

# Fences, cut-offs and forest size of the detectors.
IQR_FACTOR = 1.5
IQR_MIN_VALUES = 5
Z_LIMIT = 3.0
EXAMPLES = 20
TREES = 100
TREE_ROWS = 256
FOREST_LIMIT = 0.5
NEIGHBOURS = 20
LOF_LIMIT = 1.5

METHODS = ("iqr", "zscore", "isolation_forest", "lof")


def iqr_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    """Fences per column, or ``None`` where there are too few values or no spread."""
    counts = scalars(df, {c: F.count(as_double(df, c)) for c in columns})
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    bounds: dict[str, tuple[float, float] | None] = {}
    for c in columns:
        q1, q3 = quartiles[c]
        flat = counts[c] < IQR_MIN_VALUES or q3 == q1
        bounds[c] = None if flat else (q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1))
    return bounds


def iqr_tests(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Per column a never-null test of lying outside the fences."""
    tests = {}
    for c, bounds in iqr_bounds(df, columns).items():
        value = as_double(df, c)
        outside = (value < bounds[0]) | (value > bounds[1]) if bounds else F.lit(False)
        tests[c] = F.coalesce(outside, F.lit(False))
    return tests


def zscore_tests(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    facts = scalars(df, {
        (c, k): e
        for c in columns
        for k, e in (("mean", F.avg(as_double(df, c))), ("std", F.stddev_samp(as_double(df, c))))
    })
    tests = {}
    for c in columns:
        mean, std = facts[c, "mean"], facts[c, "std"]
        beyond = F.abs((as_double(df, c) - mean) / std) > Z_LIMIT if std else F.lit(False)
        tests[c] = F.coalesce(beyond, F.lit(False))
    return tests


def outlier_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of a column's non-null values outside the IQR fences (0 for fewer than five)."""
    df = normalise(df)
    tests = iqr_tests(df, columns)
    return per_column(df, columns, {
        "outlier_rate": lambda c: F.coalesce(
            F.avg(F.when(as_double(df, c).isNotNull(), tests[c].cast("int").cast("double"))), F.lit(0.0))
    })


def _filled(df: DataFrame, columns: Sequence[str]) -> Column:
    """Numeric vector with gaps filled by the column mean (0 for a column without values)."""
    means = scalars(df, {c: F.avg(as_double(df, c)) for c in columns})
    return F.array(*[F.coalesce(as_double(df, c), F.lit(means[c] or 0.0)) for c in columns])


def _grow(x: np.ndarray, seed: int) -> list[tuple]:
    """One random isolation tree as (feature, threshold, left, right, path) rows; leaves have feature -1."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    queue = [(np.arange(len(x)), 0, None, 0)]
    while queue:
        rows, depth, parent, side = queue.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][2 + side] = me
        nodes.append([-1, 0.0, -1, -1, depth + _average_path(len(rows))])
        low, high = x[rows].min(0), x[rows].max(0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        below = x[rows, feature] <= threshold
        nodes[me][:2] = [feature, threshold]
        queue.append((rows[below], depth + 1, me, 0))
        queue.append((rows[~below], depth + 1, me, 1))
    return [tuple(n) for n in nodes]


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return float(2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n)


def isolation_scores(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``score`` in (0, 1), higher being easier to isolate.

    Each of the trees is grown from a small hash sample in its own task; the finished forest has a
    fixed size and scores all rows batch by batch.  A tree's sample is the rows with the smallest hashes of tree and key, whatever the
    size of the table; a share of the rows that surely holds them is taken first, so few rows are copied.
    """
    df = normalise(df)
    names = list(columns or numeric_columns(df))
    vector = _filled(df, names)
    total = df.count()
    rows_per_tree = min(TREE_ROWS, total)
    data = df.select(col(key).alias("k"), vector.alias("x"))
    u = lambda tree: F.xxhash64(tree, F.col("k").cast("string")).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    share = min(1.0, (2.0 * rows_per_tree + 200.0) / max(total, 1))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda tree: u(tree) <= F.lit(share))
    each = data.withColumn("tree", F.explode(drawn)).withColumn("u", u(F.col("tree")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("u", "k"))
    samples = each.withColumn("r", place).where(F.col("r") <= rows_per_tree).select("tree", "k", "x")

    def grow(group):
        import pandas as pd

        group = group.sort_values("k")
        tree = int(group["tree"].iloc[0])
        nodes = _grow(np.stack(group["x"].to_numpy()), tree)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
        return out.assign(tree=tree, node=np.arange(len(out)))

    schema = "tree int, node int, feature int, threshold double, left int, right int, path double"
    forest = samples.groupBy("tree").applyInPandas(grow, schema).orderBy("tree", "node").toPandas()
    trees = [tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path"))
             for _, t in forest.groupby("tree")]
    normal = _average_path(rows_per_tree) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=float)
        m = np.stack(x.to_numpy())
        depth = np.zeros(len(m))
        for feature, threshold, left, right, path in trees:
            node = np.zeros(len(m), dtype=np.int64)
            while True:
                open_ = np.flatnonzero(feature[node] >= 0)
                if not len(open_):
                    break
                at = node[open_]
                node[open_] = np.where(m[open_, feature[at]] <= threshold[at], left[at], right[at])
            depth += path[node]
        return pd.Series(np.exp2(-depth / len(trees) / normal))

    return df.withColumn("score", score(vector))


def lof_scores(df: DataFrame, key: str, columns: Sequence[str] | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Add ``lof``, the local outlier factor over the k nearest neighbours.

    Equal rows become one weighted point before the neighbour search.
    """
    df = normalise(df)
    names = list(columns or numeric_columns(df))
    rows = df.withColumn("_x", _filled(df, names))
    total = df.count()
    k = min(neighbours, total - 1)
    points = with_point_id(rows.groupBy("_x").agg(F.min(col(key)).alias("k"), F.count(F.lit(1)).alias("n")), "k").drop("k")
    near = materialise(nearest_neighbours(points.select("id", F.col("_x").alias("x"), "n"), k))
    reach = near.groupBy("id").agg(F.max("distance").alias("reach"))
    with_reach = near.join(reach.select(F.col("id").alias("other"), "reach"), "other")
    density = with_reach.groupBy("id").agg(
        (1.0 / (F.sum(F.greatest("reach", "distance") * F.col("copies")) / k + 1e-10)).alias("density"))
    density = materialise(density)
    around = near.join(density.select(F.col("id").alias("other"), F.col("density").alias("d2")), "other").groupBy(
        "id").agg((F.sum(F.col("d2") * F.col("copies")) / k).alias("around"))
    factors = around.join(density, "id").select("id", (F.col("around") / F.col("density")).alias("lof"))
    labelled = points.join(factors, "id").select("_x", "lof")
    return rows.join(labelled, "_x").drop("_x")


def flag_outliers(df: DataFrame, method: str = "iqr", key: str | None = None) -> tuple[DataFrame, list[str]]:
    """(rows with ``_outlier`` tests per affected candidate column, candidate columns)."""
    if method not in METHODS:
        raise ValueError(f"unknown outlier method '{method}'")
    df = normalise(df)
    names = numeric_columns(df)
    if method in ("iqr", "zscore"):
        tests = (iqr_tests if method == "iqr" else zscore_tests)(df, names) if names else {}
        return df.withColumn("_hits", F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]) if tests
                             else F.array().cast("array<string>")), names
    if not names or df.limit(2).count() < 2:
        return df.withColumn("_hits", F.array().cast("array<string>")), []
    if method == "isolation_forest":
        scored = isolation_scores(df, key).withColumn("_out", F.col("score") > FOREST_LIMIT)
    else:
        scored = lof_scores(df, key).withColumn("_out", F.col("lof") > LOF_LIMIT)
    hits = F.when(F.col("_out"), F.array(*[F.lit(c) for c in names])).otherwise(F.array().cast("array<string>"))
    return scored.withColumn("_hits", hits), names


def detect_outliers(df: DataFrame, method: str, key: str) -> DataFrame:
    """The flagged rows, with the list of columns that made each one an outlier."""
    flagged, _ = flag_outliers(df, method, key)
    return (
        flagged.withColumn("outlier_columns", F.array_compact("_hits"))
        .where(F.size("outlier_columns") > 0)
        .drop("_hits", "_out")
    )


def outlier_report(df: DataFrame, method: str, key: str) -> DataFrame:
    """One row: ``method, outlier_count, affected_columns, examples`` (the first keys, in key order)."""
    # stored once: three aggregates read it, and scoring is not repeated for each
    flagged = materialise(detect_outliers(df, method, key).select(col(key).alias("k"), "outlier_columns"))
    order = {c: i for i, c in enumerate(df.columns)}
    columns = flagged.select(F.explode("outlier_columns").alias("c")).groupBy("c").count()
    counted = flagged.agg(F.count(F.lit(1)).alias("outlier_count"))
    place = F.create_map(*[F.lit(x) for c, i in order.items() for x in (c, i)])
    affected = columns.agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.element_at(place, F.col("c")).alias("i"), "c"))), lambda e: e["c"]))
    first = flagged.orderBy("k").limit(EXAMPLES).agg(F.array_sort(F.collect_list("k")))
    return counted.select(
        F.lit(method).alias("method"), "outlier_count",
        affected.scalar().alias("affected_columns"), first.scalar().alias("examples"))
