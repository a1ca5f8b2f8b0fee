"""Detail of one column, type counts and the readiness score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.frames import (
    as_double, col, is_datetime, is_numeric, normalise, per_column, require_columns, scalars, type_of,
)
from tabprofile.functions.sampling import unit_hash
from tabprofile.functions.stats import correlation, exact_quantiles, kurtosis, skewness

HISTOGRAM_BINS = 20
# Fixed value: strings with a longer mean length are text, the others categories.
TEXT_LENGTH = 10
LISTED_VALUES = 10
SAMPLED_VALUES = 5


def edges_reached(value: Column, low: float, high: float, bins: int, strict: bool) -> Column:
    """How many inner edges of ``bins`` equal-width bins lie below the value (or at it, if not strict).

    Comparing with the edges themselves, rather than dividing, puts values on an edge in the same
    bin as an edge-based definition does.
    """
    step = (high - low) / bins
    inner = [F.lit(low + i * step) for i in range(1, bins)]
    tests = [(value > e) if strict else (value >= e) for e in inner]
    return sum((t.cast("int") for t in tests), F.lit(0))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``bin, low, high, count`` of equal-width bins over the value range, empty bins included.

    The last bin includes the maximum; a constant column gets a range one wide around it.  No rows
    for a column without values.
    """
    df = normalise(df)
    value = as_double(df, column)
    ends = scalars(df, {"low": F.min(value), "high": F.max(value)})
    low, high = ends["low"], ends["high"]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    counts = (
        df.where(value.isNotNull())
        .groupBy(edges_reached(value, low, high, bins, strict=False).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    step = (high - low) / bins
    edges = df.sparkSession.createDataFrame(
        [(i, low + i * step, high if i == bins - 1 else low + (i + 1) * step) for i in range(bins)],
        "bin int, low double, high double")
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, deviation, extremes, quartiles, skew and kurtosis; nulls for a column without values."""
    df = normalise(df)
    value = lambda c: as_double(df, c)
    present = lambda c, e: F.when(F.count(value(c)) > 0, e)
    moments = per_column(df, columns, {
        "mean": lambda c: F.avg(value(c)),
        "std": lambda c: present(c, F.coalesce(F.stddev_samp(value(c)), F.lit(0.0))),
        "min": lambda c: F.min(value(c)),
        "max": lambda c: F.max(value(c)),
        "skew": lambda c: present(c, skewness(value(c))),
        "kurtosis": lambda c: present(c, kurtosis(value(c))),
    })
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    quartiles = df.sparkSession.createDataFrame(
        [(c, *found[c]) for c in columns], "column string, p25 double, median double, p75 double")
    return moments.join(F.broadcast(quartiles), "column")


def target_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pairwise-complete Pearson of each numeric column with a numeric target; null where undefined."""
    df = normalise(df)
    y = as_double(df, target)
    names = [c for c in columns if c != target and is_numeric(type_of(df, c))]
    return per_column(df, names, {"correlation": lambda c: correlation(as_double(df, c), y, missing=None)})


def ranked_values(df: DataFrame, column: str) -> DataFrame:
    """``kind, rank, value, count``: the ten most frequent values, and the ten rarest if there are more."""
    df = normalise(df)
    counts = (
        df.where(col(column).isNotNull())
        .groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    )
    def head(kind: str, *order: Column) -> DataFrame:
        best = counts.orderBy(*order).limit(LISTED_VALUES)
        listed = best.agg(F.collect_list(F.struct("value", "count")).alias("v"))
        # collecting does not promise an order: sort the ten entries again
        sign = -1 if kind == "top" else 1
        entries = F.array_sort(F.transform("v", lambda e: F.struct((e["count"] * sign).alias("o"), e["value"], e["count"])))
        return listed.select(F.lit(kind).alias("kind"), F.posexplode(entries).alias("i", "e")).select(
            "kind", (F.col("i") + 1).alias("rank"), F.col("e.value").alias("value"), F.col("e.count").alias("count"))
    top = head("top", F.desc("count"), F.asc("value"))
    rare = head("rare", F.asc("count"), F.asc("value"))
    many = counts.limit(LISTED_VALUES + 1).count() > LISTED_VALUES
    return top.unionByName(rare) if many else top


def random_values(df: DataFrame, column: str, key: str, size: int = SAMPLED_VALUES) -> DataFrame:
    """A few non-null values chosen by the hash of the row key."""
    present = df.where(col(column).isNotNull())
    return present.orderBy(unit_hash(key), col(key)).limit(size).select(col(column).cast("string").alias("value"))


@dataclass(frozen=True)
class ColumnDetail:
    """Parts that do not apply to the column's type are ``None``."""

    column: str
    is_numeric: bool
    histogram: DataFrame | None = None
    stats: DataFrame | None = None
    target_correlation: DataFrame | None = None
    values: DataFrame | None = None
    random_values: DataFrame | None = None


def column_detail(df: DataFrame, column: str, key: str, target: str | None = None) -> ColumnDetail:
    require_columns(df, [column])
    if not is_numeric(type_of(df, column)):
        return ColumnDetail(column, False, values=ranked_values(df, column), random_values=random_values(df, column, key))
    related = target in df.columns and target != column and is_numeric(type_of(df, target)) if target else False
    return ColumnDetail(
        column, True,
        histogram=histogram(df, column),
        stats=column_stats(df, [column]),
        target_correlation=target_correlation(df, [column], target) if related else None,
    )


def feature_type_counts(df: DataFrame) -> DataFrame:
    """``kind, columns`` for boolean, datetime, numeric, text and categorical columns."""
    df = normalise(df)

    def kind(name: str) -> Column:
        dtype = type_of(df, name)
        if dtype.typeName() == "boolean":
            return F.max(F.lit("boolean"))
        if is_datetime(dtype):
            return F.max(F.lit("datetime"))
        if is_numeric(dtype):
            return F.max(F.lit("numeric"))
        text = col(name).cast("string") if dtype.typeName() not in ("array", "map", "struct") else F.to_json(F.struct(col(name)))
        return F.when(F.avg(F.char_length(text)) > TEXT_LENGTH, "text").otherwise("categorical")

    kinds = per_column(df, df.columns, {"kind": kind})
    known = F.explode(F.array(*[F.lit(k) for k in ("numeric", "categorical", "datetime", "text", "boolean")]))
    # a zero row per kind keeps kinds without columns in the result
    zeros = kinds.limit(1).select(known.alias("kind"), F.lit(0).alias("n"))
    return kinds.select(F.coalesce("kind", F.lit("categorical")).alias("kind"), F.lit(1).alias("n")).unionByName(
        zeros).groupBy("kind").agg(F.sum("n").alias("columns"))


def dtype_groups(column_profile: DataFrame) -> DataFrame:
    """Columns and the worst null rate per display class of the profile's types."""
    d = F.lower("dtype")
    label = (
        F.when(d.contains("int") | d.contains("float"), "Numeric")
        .when(d.contains("date"), "Date/time")
        .when(d.contains("bool"), "Boolean")
        .otherwise("Categorical / text")
    )
    return column_profile.groupBy(label.alias("kind")).agg(
        F.count(F.lit(1)).alias("columns"), F.max("null_rate").alias("worst_null_rate"))


def column_summary(column_profile: DataFrame) -> DataFrame:
    """Missing and distinct share in percent, one decimal, beside the distinct count."""
    return column_profile.select(
        "column", "dtype",
        F.round(F.col("null_rate") * 100, 1).alias("missing_pct"),
        F.round(F.try_divide(F.col("n_unique"), F.greatest("row_count", F.lit(1))) * 100, 1).alias("unique_pct"),
        "n_unique",
    )


def ml_readiness(quality: DataFrame, flags: DataFrame, column_count: int, wide: bool) -> DataFrame:
    """A heuristic score in [0, 1] from completeness, uniqueness, leakage flags and width."""
    high = flags.where(F.col("severity") == "high").agg(F.count(F.lit(1))).scalar()
    share = F.least(high / F.lit(max(column_count, 1)), F.lit(1.0))
    score = (
        0.4 * F.col("completeness") + 0.3 * F.col("uniqueness") + 0.2 * (1 - share)
        + 0.1 * (1 - (0.5 if wide else 0.0))
    )
    return quality.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("ml_readiness"))
