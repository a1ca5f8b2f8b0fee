"""Statistics that stay defined on constant, empty and null-bearing columns under ANSI mode."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.frames import as_double, chunks, scalars
from tabprofile.session import shuffle_partitions

# Sketch sizes for moderate and for very large columns, with safe bounds on their rank errors.
SKETCH_SIZES = ((100_000_000, 4_096, 0.003), (float("inf"), 32_768, 0.0005))
# Sketches of all tasks meet in this many groups first, so that no task merges them all.
SKETCH_GROUPS = 128
# Rows of the last bracket, which one task resolves value by value.
BRACKET_LIMIT = 100_000
# Up to this many values a column's quantiles come from a direct aggregate, which keeps every
# distinct value of the columns of one pass in one task.
DIRECT_LIMIT = 1_000_000
DIRECT_COLUMNS = 4


def skewness(value: Column) -> Column:
    """Bias-corrected skew; 0 for fewer than three values or no spread."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n > 2, F.coalesce(F.nanvl(corrected, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for fewer than four values or no spread."""
    n = F.count(value).cast("double")
    corrected = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n > 3, F.coalesce(F.nanvl(corrected, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def correlation(a: Column, b: Column, missing: float | None = 0.0) -> Column:
    """Pearson over rows where both are present; ``missing`` where undefined (a constant side)."""
    left, right = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    value = F.try_divide(F.covar_pop(left, right), spread)
    value = F.when(value > 1, 1.0).when(value < -1, -1.0).otherwise(value)
    return F.coalesce(F.nanvl(value, F.lit(None)), F.lit(missing).cast("double"))


def exact_quantiles(
    df: DataFrame,
    names: Sequence[str],
    probs: Sequence[float],
    direct_limit: int = DIRECT_LIMIT,
    bracket_limit: int = BRACKET_LIMIT,
    exprs: dict[str, Column] | None = None,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of each column, without sorting or shuffling the data.

    A mergeable sketch brackets every wanted rank; one pass counts what lies below and inside each
    bracket, so a bracket that missed is noticed and widened, and a large one is narrowed by
    further passes.  Only the final, bounded bracket is resolved value by value.  A value that
    repeats without bound cannot hurt: its bracket shrinks to that one value.
    """
    exprs = exprs or {name: as_double(df, name) for name in names}
    exprs = {name: F.when(F.isnotnull(e) & ~F.isnan(e), e) for name, e in exprs.items()}
    counts = counts or scalars(df, {name: F.count(exprs[name]) for name in names})  # known to some callers
    small = [name for name in names if 0 < counts[name] <= direct_limit]
    together = DIRECT_COLUMNS if any(counts[name] > 50_000 for name in small) else 50
    direct = scalars(df, {name: F.percentile(exprs[name], list(map(float, probs))) for name in small}, together)

    ranks = lambda name, p: (name, math.floor(p * (counts[name] - 1)), math.ceil(p * (counts[name] - 1)))
    wanted = {ranks(name, p) for name in names for p in probs if counts[name] > direct_limit}
    found = _order_statistics(df, exprs, counts, sorted(wanted), bracket_limit) if wanted else {}

    out: dict[str, list[float | None]] = {}
    for name in names:
        n = counts[name]
        if n == 0:
            out[name] = [None] * len(probs)
        elif name in direct:
            out[name] = list(direct[name])
        else:
            out[name] = []
            for p in probs:
                low, high = found[ranks(name, p)]
                h = p * (n - 1)
                out[name].append(low + (high - low) * (h - math.floor(h)))
    return out


def order_statistics(
    df: DataFrame, value: Column, ranks: Sequence[int], bracket_limit: int = BRACKET_LIMIT
) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the ascending order of one numeric expression."""
    exprs = {"v": F.when(F.isnotnull(value) & ~F.isnan(value), value)}
    counts = scalars(df, {"v": F.count(exprs["v"])})
    got = _order_statistics(df, exprs, counts, [("v", r, r) for r in ranks], bracket_limit)
    return {rank: v for (_, rank, _), (v, _) in got.items()}


def _order_statistics(df, exprs, counts, targets, bracket_limit):
    """(column, rank, same or next rank) -> the two values."""
    for name, low, high in targets:
        if not 0 <= low <= high < counts[name]:
            raise ValueError(f"ranks {low} and {high} lie outside the {counts[name]} values of '{name}'")
    columns = {name: f"x{i}" for i, name in enumerate(exprs)}
    data = df.select(*[expr.alias(columns[name]) for name, expr in exprs.items()])
    found: dict[tuple[str, int, int], tuple[float, float]] = {}
    # per target: bracket ends, rows below the bracket, rows inside it, widening of the next bracket
    open_ = {t: (None, None, 0, counts[t[0]], 1) for t in targets}
    while open_:
        ends = _bracket_ends(data, columns, open_)
        brackets = {(t[0], *ends[t]) for t in open_}
        tallies = scalars(data, {
            (b, part): expr
            for b in brackets
            for part, expr in (
                ("below", F.count_if(F.col(columns[b[0]]) < F.lit(b[1]))),
                ("inside", F.count(_within(F.col(columns[b[0]]), b[1], b[2]))),
            )
        }, per_pass=100)
        narrow, last = {}, {}
        for t, (old_lo, old_hi, old_below, old_size, widen) in open_.items():
            lo, hi = ends[t]
            below, size = tallies[(t[0], lo, hi), "below"], tallies[(t[0], lo, hi), "inside"]
            if not (below <= t[1] and t[2] < below + size):
                narrow[t] = (old_lo, old_hi, old_below, old_size, widen * 4)
            elif lo == hi:
                found[t] = (float(lo), float(lo))
            elif size <= bracket_limit or size == old_size:
                last[t] = (lo, hi, below, size)
            else:
                narrow[t] = (lo, hi, below, size, 1)
        for group in chunks(list(last), 60):
            inside = data.select(*[
                _within(F.col(columns[t[0]]), last[t][0], last[t][1]).alias(f"p{i}") for i, t in enumerate(group)
            ])
            inside = inside.where(F.coalesce(*[F.col(f"p{i}") for i in range(len(group))]).isNotNull())
            # half a step up keeps the share clear of rounding at the wanted rank
            share = lambda t, rank: f"{(rank - last[t][2] + 0.5) / last[t][3]!r}D"
            row = inside.agg(*[
                F.expr(f"percentile_disc(array({share(t, t[1])}, {share(t, t[2])})) WITHIN GROUP (ORDER BY p{i})")
                for i, t in enumerate(group)
            ]).first()
            found.update({t: (float(pair[0]), float(pair[1])) for t, pair in zip(group, row)})
        open_ = narrow
    return found


def _bracket_ends(data, columns, open_):
    """One sketch per distinct (column, bracket) answers for every target that lies in it."""
    shared: dict[tuple, list] = {}
    for t, (lo, hi, _, _, _) in open_.items():
        shared.setdefault((t[0], lo, hi), []).append(t)
    out = {}
    groups = min(SKETCH_GROUPS, shuffle_partitions(data.sparkSession))
    for batch in chunks(list(shared), 60):
        sizes = [open_[shared[b][0]][3] for b in batch]
        places = data.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
        partial = places.groupBy("g").agg(*[
            F.call_function("kll_sketch_agg_double", _within(F.col(columns[b[0]]), b[1], b[2]), F.lit(_sketch(n)[1])).alias(f"k{i}")
            for i, (b, n) in enumerate(zip(batch, sizes))
        ])
        lists = partial.agg(*[F.collect_list(f"k{i}").alias(f"k{i}") for i in range(len(batch))])
        row = lists.select(*[
            F.call_function("kll_sketch_get_quantile_double", F.reduce(
                F.slice(f"k{i}", 2, groups), F.col(f"k{i}")[0], lambda x, y: F.call_function("kll_sketch_merge_double", x, y)),
                F.array(*[F.lit(p) for t in shared[b] for p in _around(t[1] - open_[t][2], t[2] - open_[t][2], n, open_[t][4])]))
            for i, (b, n) in enumerate(zip(batch, sizes))
        ]).first()
        for b, ends in zip(batch, row):
            out.update({t: (ends[2 * i], ends[2 * i + 1]) for i, t in enumerate(shared[b])})
    return out


def _sketch(size: int) -> tuple:
    return next(s for s in SKETCH_SIZES if size <= s[0])


def _within(value: Column, lo, hi) -> Column:
    if lo is None:
        return value
    return F.when((value >= F.lit(lo)) & (value <= F.lit(hi)), value)


def _around(first: int, last: int, size: int, widen: int) -> list[float]:
    """Sketch positions that enclose two ranks of ``size`` values despite the sketch's rank error."""
    margin = widen * (_sketch(size)[2] + 1.5 / max(size, 1))
    steps = max(size - 1, 1)
    return [max(0.0, first / steps - margin), min(1.0, last / steps + margin)]
