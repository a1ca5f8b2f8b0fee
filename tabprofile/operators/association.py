"""Correlation matrices, mutual information and missingness patterns as long (col_a, col_b, value) tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import (
    as_double, chunks, col, normalise, numeric_columns, per_column, scalars, small_or_same, union_all, value_counts,
)
from tabprofile.functions.sampling import ordered_totals, with_point_id
from tabprofile.functions.stats import correlation, exact_quantiles
from tabprofile.operators.neighbours import nearest_neighbours
from tabprofile.session import materialise, shuffle_partitions

METHODS = ("pearson", "spearman", "kendall", "mutual_info", "mutual_info_neighbours")
MAX_COLUMNS = 50
# Up to this many sums the matrix is a set of built-in aggregates, beyond it a matrix product.
TERMS_PER_AGGREGATE = 200
#: Coefficients of ranks that one aggregate computes.
SPEARMAN_PAIRS = 100
#: Values of a slice in which ranks are taken: with more values there are more slices, not larger ones.
RANKED_VALUES = 1_000_000
INFORMATION_BINS = 10
# Slices per side of the rank grid; the grid of one pair has at most the square of this.
MAX_SLICES = 2048

_EMPTY = "col_a string, col_b string, value double"


def correlation_columns(df: DataFrame, limit: int = MAX_COLUMNS) -> tuple[list[str], bool]:
    """The numeric columns of the matrix and whether low-variance ones had to be left out."""
    names = numeric_columns(df)
    if len(names) <= limit:
        return names, False
    spread = scalars(df, {n: F.var_samp(as_double(df, n)) for n in names})
    ranked = sorted(names, key=lambda n: (spread[n] is None, -(spread[n] or 0.0)))
    return ranked[:limit], True


def correlation_preview(df: DataFrame, method: str = "pearson", limit: int = MAX_COLUMNS) -> tuple[DataFrame, bool]:
    """The matrix of the ``limit`` most varied numeric columns, and whether columns were left out."""
    _, truncated = correlation_columns(normalise(df), limit)
    return correlation_matrix(df, method, limit), truncated


def correlation_matrix(df: DataFrame, method: str = "pearson", limit: int | None = None) -> DataFrame:
    """The full square matrix, diagonal included; empty with fewer than two numeric columns.

    All numeric columns take part unless ``limit`` asks for the most varied ones only.
    """
    if method not in METHODS:
        raise ValueError(f"unknown correlation method '{method}'")
    df = normalise(df)
    names = numeric_columns(df) if limit is None else correlation_columns(df, limit)[0]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], _EMPTY)
    build = {"pearson": pearson, "spearman": spearman, "kendall": kendall, "mutual_info": mutual_information, "mutual_info_neighbours": neighbour_information}
    return build[method](df, names)


def _both_ways(upper: DataFrame) -> DataFrame:
    """Mirror (col_a, col_b, value) rows of one triangle; the diagonal stays single."""
    pairs = F.when(
        F.col("col_a") == F.col("col_b"), F.array(F.struct("col_a", "col_b", "value"))
    ).otherwise(F.array(
        F.struct("col_a", "col_b", "value"),
        F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "value"),
    ))
    return upper.select(F.inline(pairs))


def _pairs_with_diagonal(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(n, n) for n in names] + list(combinations(names, 2))


def pearson(df: DataFrame, names: Sequence[str], exprs: dict[str, Column] | None = None) -> DataFrame:
    """Pairwise-complete Pearson; undefined entries (a constant column, also on the diagonal) are 0.

    Columns are shifted by their means, so that sums of products keep their digits.  Columns without
    gaps share their sums between all pairs; few sums are one built-in aggregate, many are matrix
    products.
    """
    exprs = exprs or {n: as_double(df, n) for n in names}
    facts = scalars(df, {
        (n, k): e for n in names
        for k, e in (("mean", F.avg(exprs[n])), ("gaps", F.count_if(exprs[n].isNull())), ("rows", F.count(F.lit(1))))
    })
    means = {n: facts[n, "mean"] for n in names}
    gaps = {n: facts[n, "gaps"] > 0 for n in names}
    x = {n: exprs[n] - F.lit(means[n] or 0.0) for n in names}

    def over(key: str, a: str, b: str) -> tuple:
        # rows where b is present; no restriction when b never lacks
        return key, a, b if gaps[b] and a != b else None

    pairs = _pairs_with_diagonal(names)
    parts = {
        (a, b): [over("s", a, b), over("s", b, a), over("q", a, b), over("q", b, a), ("p", a, b), over("n", a, b)]
        for a, b in pairs
    }
    keys = list(dict.fromkeys(k for terms in parts.values() for k in terms))
    if len(keys) > TERMS_PER_AGGREGATE:
        return _both_ways(_pearson_by_product(df, names, exprs, means))

    def total(key: str, a: str, b: str | None) -> Column:
        value = x[a] * x[b] if key == "p" else x[a] * x[a] if key == "q" else x[a]
        if key != "p" and b is not None:
            value = F.when(exprs[b].isNotNull(), value)
        return F.count(value) if key == "n" else F.coalesce(F.sum(value), F.lit(0.0))

    found = scalars(df, {k: total(*k) for k in keys})
    rows = [(a, b, _coefficient(*[float(found[k]) for k in parts[a, b]])) for a, b in pairs]
    return _both_ways(df.sparkSession.createDataFrame(rows, _EMPTY))


def _coefficient(sa: float, sb: float, qa: float, qb: float, p: float, n: float) -> float:
    if n < 2:
        return 0.0
    va, vb = qa - sa * sa / n, qb - sb * sb / n
    # what remains of a constant column's spread is rounding noise of its squares
    if va <= 1e-12 * qa or vb <= 1e-12 * qb:
        return 0.0
    return max(-1.0, min(1.0, (p - sa * sb / n) / (va**0.5 * vb**0.5)))


def _pearson_by_product(
    df: DataFrame, names: Sequence[str], exprs: dict[str, Column], means: dict[str, float | None]
) -> DataFrame:
    """Sums of products per task as one matrix product, added up per matrix cell afterwards."""
    shifted = df.select(*[(exprs[n] - F.lit(means[n] or 0.0)).alias(f"x{i}") for i, n in enumerate(names)])
    width = len(names)

    def products(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((4, width, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            present = ~np.isnan(x)
            x, m = np.where(present, x, 0.0), present.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(width), pa.int32()), **{k: list(map(list, sums[j])) for j, k in enumerate("nsqp")}})

    partial = shifted.mapInArrow(products, "i int, n array<double>, s array<double>, q array<double>, p array<double>")
    cells = (
        partial.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("j", "c"))
        .groupBy("i", "j").agg(*[F.sum(f"c.{k}").alias(k) for k in ("n", "s", "q", "p")])
    )
    a = cells.where("i <= j")
    b = cells.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    both = a.join(b, ["i", "j"])
    n = F.col("n")
    cov = F.col("p") - F.try_divide(F.col("s") * F.col("s2"), n)
    va, vb = F.col("q") - F.try_divide(F.col("s") ** 2, n), F.col("q2") - F.try_divide(F.col("s2") ** 2, n)
    # what remains of a constant column's spread is rounding noise of its squares
    spread = F.when((va > 1e-12 * F.col("q")) & (vb > 1e-12 * F.col("q2")), F.sqrt(va) * F.sqrt(vb))
    r = F.when(spread.isNotNull(), F.greatest(F.least(cov / spread, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    labels = F.array(*[F.lit(n) for n in names])
    return both.select(labels[F.col("i")].alias("col_a"), labels[F.col("j")].alias("col_b"), r.alias("value"))


def spearman(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson of average ranks, ranked over the rows where both columns are present.

    A column is ranked once per distinct set of rows: over its own values, and again for each
    partner with missing values.  All rankings are made together: values are unpivoted, sliced along
    (ranking, value, row), ranked within their slices, and folded back per row, whatever the number
    of columns.  A frequent value spreads over slices like any other.
    """
    exprs = {n: as_double(df, n) for n in names}
    facts = scalars(df, {**{(n, "gaps"): F.count_if(exprs[n].isNull()) for n in names}, "rows": F.count(F.lit(1))})
    nulls = {n: facts[n, "gaps"] for n in names}
    ranked: dict[tuple[str, str | None], int] = {}
    columns: list[Column] = []

    def ranking(a: str, other: str) -> int:
        mask = other if nulls[other] and other != a else None
        if (a, mask) not in ranked:
            ranked[a, mask] = len(ranked)
            columns.append(exprs[a] if mask is None else F.when(exprs[other].isNotNull(), exprs[a]))
        return ranked[a, mask]

    used = {(a, b): (ranking(a, b), ranking(b, a)) for a, b in _pairs_with_diagonal(names)}
    rows = materialise(df.select(F.array(*columns).alias("x")).withColumn("row", F.monotonically_increasing_id()))
    parts = max(shuffle_partitions(df.sparkSession), -(-facts["rows"] * len(columns) // RANKED_VALUES))
    ranks = _average_ranks(rows.select("row", F.posexplode("x").alias("ranking", "value")).where("value is not null"), parts)
    wide = _in_parts(ranks, parts, "row").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("ranking", "rank"))).alias("r"))
    wide = materialise(wide.select(F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.col("r")[i]).alias("r")))
    out = []
    for group in chunks(list(used), SPEARMAN_PAIRS):
        sums = wide.agg(*[correlation(F.col("r")[used[p][0]], F.col("r")[used[p][1]]).alias(f"c{i}") for i, p in enumerate(group)])
        out.append(sums.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("value")) for i, (a, b) in enumerate(group)]))))
    return _both_ways(union_all(out))


def _in_parts(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows by ``keys`` in ``parts`` partitions where these are more than a shuffle makes by itself."""
    return df.repartition(parts, *keys) if parts > shuffle_partitions(df.sparkSession) else df


def _average_ranks(values: DataFrame, parts: int) -> DataFrame:
    """``row, ranking, rank`` from ``row, ranking, value``: 1-based ranks within a ranking, equal values sharing their mean.

    Slices are sorted on their own.  A value may go on in later slices, but only a slice's first and last value of a ranking can; their
    counts and the slices' sizes, two short rows per slice and ranking, tell where each slice begins and how far its edges reach.
    """
    slices = materialise(
        values.repartitionByRange(parts, "ranking", "value", "row").withColumn("slice", F.spark_partition_id()))
    counts = slices.groupBy("slice", "ranking").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    at_edge = slices.join(F.broadcast(counts), ["slice", "ranking"]).groupBy("slice", "ranking").agg(
        F.count_if(F.col("value") == F.col("low")).alias("n_low"), F.count_if(F.col("value") == F.col("high")).alias("n_high"))
    edges = counts.join(at_edge, ["slice", "ranking"])
    in_order = Window.partitionBy("ranking").orderBy("slice")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # equal edge values of all slices of a ranking, each slice's own count taken once
    ends = edges.select("ranking", "slice", F.inline(F.array_distinct(F.array(
        F.struct(F.col("low").alias("value"), F.col("n_low").alias("k")), F.struct(F.col("high").alias("value"), F.col("n_high").alias("k"))))))
    whole = ends.join(edges.select("ranking", "slice", "base", "n", F.col("low").alias("_low"), F.col("n_high")), ["ranking", "slice"]).groupBy("ranking", "value").agg(
        F.sum("k").alias("all"),
        # the value's first row: its slice's base where it is the low end, else behind the other rows of that slice
        F.min(F.when(F.col("value") == F.col("_low"), F.col("base")).otherwise(F.col("base") + F.col("n") - F.col("n_high"))).alias("first"))
    inner = Window.partitionBy("slice", "ranking").orderBy("value")
    placed = _in_parts(slices, parts, "slice", "ranking").join(F.broadcast(edges.select("slice", "ranking", "base")), ["slice", "ranking"])
    placed = placed.withColumn("_less", F.rank().over(inner) - 1 + F.col("base")).withColumn(
        "_equal", F.count(F.lit(1)).over(Window.partitionBy("slice", "ranking", "value")))
    found = placed.join(F.broadcast(whole), ["ranking", "value"], "left")
    first, equal = F.coalesce("first", "_less"), F.coalesce("all", "_equal")
    return found.select("row", "ranking", (first + (equal + 1) / 2).alias("rank"))


def _inversion_weight(rank, weight, cell=None) -> float:
    """Total weight of pairs out of order: earlier element with the larger rank.

    Works bit by bit: two ranks first differ in one bit, and the pair is out of order when the
    element with that bit set comes first.  Ranks must be distinct.  Only whole-array operations.
    """
    import numpy as np

    total = 0.0
    weight = weight.astype(float)
    for bit in range(max(int(rank.max()).bit_length(), 1) if len(rank) else 0):
        block = rank >> (bit + 1)
        if cell is not None:
            order = np.lexsort((np.arange(len(rank)), block, cell))
            start = np.r_[True, (np.diff(block[order]) != 0) | (np.diff(cell[order]) != 0)]
        else:
            order = np.argsort(block, kind="stable")
            start = np.r_[True, np.diff(block[order]) != 0]
        ones = ((rank[order] >> bit) & 1).astype(float)
        w = weight[order]
        before = np.cumsum(w * ones) - w * ones
        base = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
        total += float(np.sum(w * (1 - ones) * (before - before[base])))
    return total


def kendall(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Kendall's tau-b over pairwise-complete rows, exact in n log n work.

    Equal (a, b) points collapse to weights.  Points are cut into slices along the order by (a, b)
    and along the order by (b, a), so neither a frequent a nor a frequent b makes a slice large.
    Discordant weight then splits into: pairs within an a-slice, pairs within a b-slice but
    different a-slices, and pairs differing in both, which a grid of cell weights answers alone.
    """
    exprs = {n: as_double(df, n) for n in names}
    pairs = list(combinations(names, 2))
    values = df.select(*[exprs[n].alias(f"x{i}") for i, n in enumerate(names)])
    at = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    points = (
        values.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("pair"), at[a].alias("a"), at[b].alias("b")) for i, (a, b) in enumerate(pairs)
        ])))
        .where("a is not null and b is not null")
        .groupBy("pair", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    parts = min(shuffle_partitions(df.sparkSession), MAX_SLICES)
    sliced = points.repartitionByRange(parts, "pair", "a", "b").withColumn("sa", F.spark_partition_id())
    sliced = materialise(sliced).repartitionByRange(parts, "pair", "b", "a").withColumn("sb", F.spark_partition_id())
    sliced = materialise(sliced)

    count_inversions = _inversion_weight

    def along_a(group):
        import numpy as np
        import pandas as pd

        g = group.sort_values(["a", "b"], kind="stable")
        rank = np.empty(len(g), dtype=np.int64)
        rank[np.lexsort((g["a"].to_numpy(), g["b"].to_numpy()))] = np.arange(len(g))
        return pd.DataFrame({"pair": [int(g["pair"].iloc[0])], "d": [count_inversions(rank, g["n"].to_numpy())]})

    def along_b(group):
        import numpy as np
        import pandas as pd

        g = group.sort_values(["a", "b"], kind="stable")
        rank = np.empty(len(g), dtype=np.int64)
        rank[np.lexsort((g["a"].to_numpy(), g["b"].to_numpy()))] = np.arange(len(g))
        w = g["n"].to_numpy()
        d = count_inversions(rank, w) - count_inversions(rank, w, g["sa"].to_numpy())
        return pd.DataFrame({"pair": [int(g["pair"].iloc[0])], "d": [d]})

    def across(grid):
        import numpy as np
        import pandas as pd

        rows, ia = np.unique(grid["sa"].to_numpy(), return_inverse=True)
        cols, ib = np.unique(grid["sb"].to_numpy(), return_inverse=True)
        w = np.zeros((len(rows) + 1, len(cols) + 1))
        np.add.at(w, (ia, ib + 1), grid["w"].to_numpy())
        # weight in later a-slices and earlier b-slices of each cell
        below = np.flip(np.cumsum(np.flip(w, 0), 0), 0)
        corner = np.cumsum(below, 1)
        d = float(np.sum(w[:-1, 1:] * corner[1:, :-1]))
        return pd.DataFrame({"pair": [int(grid["pair"].iloc[0])], "d": [d]})

    schema = "pair int, d double"
    grid = sliced.groupBy("pair", "sa", "sb").agg(F.sum("n").alias("w"))
    discordant = union_all([
        sliced.select("pair", "sa", "a", "b", "n").groupBy("pair", "sa").applyInPandas(along_a, schema),
        sliced.groupBy("pair", "sb").applyInPandas(along_b, schema),
        grid.groupBy("pair").applyInPandas(across, schema),
    ]).groupBy("pair").agg(F.sum("d").alias("discordant"))

    def tied(*keys: str) -> DataFrame:
        w = sliced.groupBy("pair", *keys).agg(F.sum("n").alias("w"))
        return w.groupBy("pair").agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("t_" + "".join(keys)))

    t = discordant.join(tied(), "pair").join(tied("a"), "pair").join(tied("b"), "pair").join(tied("a", "b"), "pair")
    free_a, free_b = F.col("t_") - F.col("t_a"), F.col("t_") - F.col("t_b")
    balance = F.col("t_") - F.col("t_a") - F.col("t_b") + F.col("t_ab") - 2 * F.col("discordant")
    tau = F.coalesce(F.try_divide(balance, F.sqrt(free_a) * F.sqrt(free_b)), F.lit(0.0))
    labels = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, col_a string, col_b string")
    upper = labels.join(t.select("pair", tau.alias("value")), "pair", "left").select(
        "col_a", "col_b", F.coalesce("value", F.lit(0.0)).alias("value"))
    spread = per_column(values, values.columns, {"varies": lambda c: F.min(c) < F.max(c)})
    diagonal = spread.select(
        F.array(*[F.lit(n) for n in names])[F.col("position")].alias("col_a"),
        F.coalesce(F.col("varies").cast("double"), F.lit(0.0)).alias("value"),
    ).select("col_a", F.col("col_a").alias("col_b"), "value")
    return _both_ways(upper.unionByName(diagonal))


def digamma(n: Column) -> Column:
    """The logarithmic derivative of the gamma function at whole numbers from 1: ten steps up, then its asymptotic series."""
    shift = 10
    z = n + F.lit(float(shift))
    steps = sum((F.lit(1.0) / (n + F.lit(float(j))) for j in range(shift)), F.lit(0.0))
    square = F.lit(1.0) / (z * z)
    tail = square * (F.lit(1 / 12) - square * (F.lit(1 / 120) - square * (F.lit(1 / 252) - square * (F.lit(1 / 240) - square * F.lit(1 / 132)))))
    return F.log(z) - F.lit(0.5) / z - tail - steps


def _interval(value, radius):
    """The least and largest numbers whose difference from ``value`` is below ``radius`` as floats are subtracted (all at 0: the value).

    Found by halving over the floats in their order, as sums round elsewhere than differences do, most of all beside 0.
    """
    import numpy as np

    least = np.int64(-1 << 63)

    def place(x):  # whole numbers in the order of floats; negative floats count down
        bits = np.asarray(x + 0.0).view(np.int64)
        return np.where(bits < 0, least - bits, bits)

    def number(place):
        return np.where(place < 0, least - place, place).view(np.float64)

    ends = []
    for sign in (-1.0, 1.0):
        inside, outside = place(value), place(value + sign * (2.0 * radius + np.spacing(np.abs(value))))
        for _ in range(64):
            middle = inside // 2 + outside // 2 + (inside % 2 + outside % 2) // 2
            near = np.abs(number(middle) - value) < radius
            inside, outside = np.where(near, middle, inside), np.where(near, outside, middle)
        ends.append(np.where(radius > 0, number(inside), value))
    return ends


def neighbour_information(df: DataFrame, names: Sequence[str], neighbours: int = 3) -> DataFrame:
    """Mutual information (nats) by nearest neighbours over complete rows (Kraskov, Stoegbauer and Grassberger); 1 on the diagonal.

    Columns are divided by their deviation, taken to ten digits so that equal steps stay equal however sums were added.  A row's radius is the distance of its k-th neighbour in the plane of a pair, by the larger
    of both differences; on each axis the rows nearer than that are counted, itself included.  Ties are taken as they are: at radius 0
    the equal values count.  The estimate is psi(n) + psi(k) minus the mean of psi over both counts, and at least 0.

    All pairs are searched in one go: a pair is a further axis on which pairs lie farther apart than any two rows.  Counts on an axis are
    running totals over one ordering of the values and both ends of every interval, cut into slices of ranges.  With ``neighbours`` or
    fewer complete rows every pair has 0.
    """
    import pandas as pd

    complete = df.select(*[as_double(df, n).alias(f"x{i}") for i, n in enumerate(names)])
    complete = complete.where(sum((F.col(c).isNull().cast("int") for c in complete.columns), F.lit(0)) == 0)
    facts = complete.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in complete.columns for f in (F.stddev_pop, F.min, F.max)]).first()
    spark, rows = df.sparkSession, facts["n"]
    pairs = list(combinations(range(len(names)), 2))
    diagonal = spark.createDataFrame([(n, n, 1.0) for n in names], _EMPTY)
    labels = spark.createDataFrame([(p, names[i], names[j]) for p, (i, j) in enumerate(pairs)], "pair int, col_a string, col_b string")
    if rows <= neighbours:
        return _both_ways(labels.select("col_a", "col_b", F.lit(0.0).alias("value")).unionByName(diagonal))
    scale = {c: float(f"{facts[f'stddev_pop_{c}']:.10g}") or 1.0 for c in complete.columns}
    apart = 4.0 * (1.0 + max((facts[f"max_{c}"] - facts[f"min_{c}"]) / scale[c] for c in complete.columns))
    planes = complete.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("pair"), (F.col(f"x{i}") / F.lit(scale[f"x{i}"])).alias("a"), (F.col(f"x{j}") / F.lit(scale[f"x{j}"])).alias("b"))
        for p, (i, j) in enumerate(pairs)])))
    points = with_point_id(planes.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n")), None)
    near = nearest_neighbours(
        points.select("id", F.array(F.col("pair") * F.lit(apart), "a", "b").alias("x"), "n"), neighbours, metric="max")
    radius = near.groupBy("id").agg(F.max("distance").alias("radius"))
    axes = points.join(radius, "id").select("id", "pair", "n", "radius", F.posexplode(F.array("a", "b")).alias("axis", "value"))

    def ends(batches):
        for batch in batches:
            low, high = _interval(batch["value"].to_numpy(), batch["radius"].to_numpy())
            yield pd.DataFrame({
                "pair": batch["pair"], "axis": batch["axis"], "id": batch["id"], "n": batch["n"], "value": batch["value"], "low": low, "high": high})

    reach = axes.mapInPandas(ends, "pair int, axis int, id bigint, n bigint, value double, low double, high double")
    # an interval begins before and ends behind the rows at its ends
    events = reach.select("pair", "axis", "id", "n", F.inline(F.array(*[
        F.struct(F.col(c).alias("at"), F.lit(kind).alias("kind")) for kind, c in enumerate(("low", "value", "high"))])))
    totals = ordered_totals(events, ["pair", "axis"], ["at", "kind", "id"], F.when(F.col("kind") == 1, F.col("n")).otherwise(0), "before")
    inside = totals.where("kind <> 1").groupBy("pair", "axis", "id").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("before")).otherwise(-F.col("before"))).alias("inside"), F.first("n").alias("n"))
    mean = inside.groupBy("pair").agg((F.sum(digamma(F.col("inside")) * F.col("n")) / F.lit(float(rows))).alias("m"))
    upper = labels.join(mean, "pair").select("col_a", "col_b", F.greatest(
        F.lit(0.0), digamma(F.lit(rows)) + digamma(F.lit(neighbours)) - F.col("m")).alias("value"))
    return _both_ways(upper.unionByName(diagonal))


def mutual_information(df: DataFrame, names: Sequence[str], bins: int = INFORMATION_BINS) -> DataFrame:
    """Mutual information (nats) of equal-frequency bins over complete rows; 1 on the diagonal.

    Bin edges are exact quantiles.  All pairs share one pass, and a pair's joint table has at most
    ``bins`` squared cells.  With three or fewer complete rows every pair has 0.
    """
    complete = df.select(*[as_double(df, n).alias(f"x{i}") for i, n in enumerate(names)])
    complete = complete.where(sum((F.col(c).isNull().cast("int") for c in complete.columns), F.lit(0)) == 0)
    edges = exact_quantiles(complete, complete.columns, [i / bins for i in range(1, bins)])
    binned = [
        sum(((F.col(c) > F.lit(e)).cast("int") for e in edges[c]), F.lit(0)) if edges[c][0] is not None else F.lit(0)
        for c in complete.columns
    ]
    pairs = list(combinations(range(len(names)), 2))
    codes = complete.select(*[b.alias(f"b{i}") for i, b in enumerate(binned)])
    joint = (
        codes.select(F.inline(F.array(*[
            F.struct(F.lit(p).alias("pair"), F.col(f"b{i}").alias("a"), F.col(f"b{j}").alias("b"))
            for p, (i, j) in enumerate(pairs)
        ])))
        .groupBy("pair", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    total = lambda *keys: F.sum("n").over(Window.partitionBy("pair", *keys))
    cells = joint.select("pair", "n", total().alias("all"), total("a").alias("na"), total("b").alias("nb"))
    info = cells.groupBy("pair").agg(
        F.when(F.max("all") > 3, F.greatest(F.lit(0.0), F.sum(
            F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb"))))))
        .otherwise(F.lit(0.0)).alias("value"))
    spark = df.sparkSession
    labels = spark.createDataFrame(
        [(p, names[i], names[j]) for p, (i, j) in enumerate(pairs)], "pair int, col_a string, col_b string")
    upper = labels.join(info, "pair", "left").select("col_a", "col_b", F.coalesce("value", F.lit(0.0)).alias("value"))
    diagonal = spark.createDataFrame([(n, n, 1.0) for n in names], _EMPTY)
    return _both_ways(upper.unionByName(diagonal))


def missing_per_column(df: DataFrame) -> DataFrame:
    df = normalise(df)
    return per_column(df, df.columns, {
        "null_count": lambda c: F.count_if(col(c).isNull()),
        "null_rate": lambda c: F.coalesce(F.try_divide(F.count_if(col(c).isNull()), F.count(F.lit(1))), F.lit(0.0)),
    })


def missing_correlation(df: DataFrame) -> DataFrame:
    """Phi coefficient of missingness between the columns that have nulls (empty below two such)."""
    df = normalise(df)
    nulls = scalars(df, {c: F.count_if(col(c).isNull()) for c in df.columns})
    names = [c for c in df.columns if nulls[c] > 0]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], _EMPTY)
    return pearson(df, names, {c: col(c).isNull().cast("int").cast("double") for c in names})
