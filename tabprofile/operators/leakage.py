"""Columns that may give the target away, and rules of thumb over column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.frames import (
    as_double, col, distinct_counts, is_nested, is_numeric, long_form, normalise, per_column, type_of, union_all,
)
from tabprofile.functions.stats import correlation

# Thresholds and name fragments of the rules.
LEAKY_CORRELATION = 0.95
LEAKY_PURITY = 0.98
LEAKY_NAMES = ("future_", "post_", "outcome_", "result_", "_after", "leak")
ID_NAMES = ("id", "uuid", "guid", "key", "index")
IMBALANCE = 0.15
TARGET_UNIQUE_SHARE = 0.5
NAME_REASON = "column name suggests it may be derived from or occur after the target event"

_FLAGS = "column string, position int, rule string, reason string, severity string, score double"


def _no_flags(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], _FLAGS)


def name_flags(df: DataFrame, target: str) -> DataFrame:
    rows = [
        (c, i, "name", NAME_REASON, "medium", None)
        for i, c in enumerate(df.columns)
        if c != target and any(f in c.strip().lower() for f in LEAKY_NAMES)
    ]
    return df.sparkSession.createDataFrame(rows, _FLAGS)


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """Pearson of each other numeric column with a numeric target, one pass."""
    df = normalise(df)
    names = [c for c in df.columns if c != target and is_numeric(type_of(df, c))]
    y = as_double(df, target)
    return per_column(df, names, {"score": lambda c: correlation(as_double(df, c), y, missing=None)})


def target_purity(df: DataFrame, target: str) -> DataFrame:
    """How well each column's values determine a non-numeric target: ``column, position, n_unique, rows, score``.

    Per value, the largest share of one target among the rows with a target, weighted by the
    value's share of all rows.  Rows collapse to (column, value, target) counts before any shuffle.
    """
    df = normalise(df)
    names = [c for c in df.columns if c != target and not is_nested(type_of(df, c))]
    rows = df.agg(F.count(F.lit(1))).scalar()
    per_value = []
    for frame in long_form(df, names, {"target": col(target).cast("string")}):
        cells = frame.groupBy("column", "value", "target").agg(F.count(F.lit(1)).alias("n"))
        per_value.append(cells.groupBy("column", "value").agg(
            F.sum("n").alias("size"),
            F.coalesce(F.max(F.when(F.col("target").isNotNull(), F.col("n"))), F.lit(0)).alias("best"),
            F.sum(F.when(F.col("target").isNotNull(), F.col("n"))).alias("labelled"),
        ).groupBy("column").agg(
            F.sum(F.coalesce(F.try_divide(F.col("best"), F.col("labelled")), F.lit(0.0)) * F.col("size")).alias("w"),
            F.count(F.lit(1)).alias("n_unique"),
        ))
    place = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    return union_all(per_value).withColumn("rows", rows).select(
        "column", F.element_at(place, F.col("column")).alias("position"), "n_unique", "rows",
        F.try_divide(F.col("w"), F.col("rows")).alias("score"))


def leakage_flags(df: DataFrame, target: str) -> DataFrame:
    """All leakage flags: suspicious names (medium), near-perfect correlation or purity (high).

    A heuristic, not a guarantee.  Without the target column there are no flags.
    """
    if target not in df.columns:
        return _no_flags(df)
    flags = [name_flags(df, target)]
    if is_numeric(type_of(df, target)):
        if any(c != target and is_numeric(type_of(df, c)) for c in df.columns):
            flags.append(target_correlations(df, target).where(F.abs("score") >= LEAKY_CORRELATION).select(
                "column", "position", F.lit("correlation").alias("rule"),
                F.format_string("near-perfect correlation with target (%.3f)", "score").alias("reason"),
                F.lit("high").alias("severity"), "score"))
    elif len(df.columns) > 1:
        pure = (F.col("score") >= LEAKY_PURITY) & (F.col("n_unique") > 1) & (F.col("n_unique") < F.col("rows"))
        flags.append(target_purity(df, target).where(pure).select(
            "column", "position", F.lit("purity").alias("rule"),
            F.format_string("category values map almost 1:1 to a single target value (purity=%.3f)", "score").alias("reason"),
            F.lit("high").alias("severity"), "score"))
    return union_all(flags)


def is_identifier(name: Column, dtype: Column, n_unique: Column, rows: Column) -> Column:
    """Near-unique and not a float; columns named like identifiers need only half distinct values."""
    ratio = F.coalesce(F.try_divide(n_unique, rows), F.lit(0.0))
    named = name.rlike("(?i)" + "|".join(ID_NAMES))
    return ~F.lower(dtype).contains("float") & F.when(named, ratio > 0.5).otherwise(ratio > 0.98)


def identifier_columns(column_profile: DataFrame) -> DataFrame:
    test = is_identifier(F.col("column"), F.col("dtype"), F.col("n_unique"), F.col("row_count"))
    return column_profile.where(test).select("column", "n_unique")


def minority_share(column_profile: DataFrame) -> DataFrame:
    """``column, minority_ratio``: smallest over all listed counts, else from a 0..1 mean; null if neither."""
    counts = F.transform("top_values", lambda e: e["count"])
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    mean = F.col("numeric.mean")
    ratio = F.when(
        F.col("top_values").isNotNull() & ~F.col("is_pii"), F.try_divide(F.array_min(counts), total)
    ).when((mean >= 0) & (mean <= 1), F.least(mean, 1 - mean))
    return column_profile.select("column", ratio.alias("minority_ratio"))


def class_minority(df: DataFrame, target: str) -> DataFrame:
    """The exact share of the rarest class, over all classes."""
    counts = normalise(df).where(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.try_divide(F.min("n"), F.sum("n")).alias("minority_ratio"))


def target_guard(df: DataFrame, targets: list[str]) -> DataFrame:
    """Whether each column is too varied to be a classification target (no type is exempt)."""
    counted = distinct_counts(normalise(df), targets)
    rows = df.agg(F.count(F.lit(1))).scalar()
    share = F.coalesce(F.try_divide(F.col("n_unique"), rows), F.lit(0.0))
    every = df.sparkSession.createDataFrame([(c,) for c in targets], "column string")  # a column without values has no count
    counted = every.join(counted, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)).cast("bigint"))
    return counted.select("column", "n_unique", (share > TARGET_UNIQUE_SHARE).alias("rejected"))
