"""Column information content, target dependence, drift between two datasets and quality issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import (
    as_double, col, is_nested, is_string, long_form, normalise, numeric_columns, per_column, scalars, small_or_same, type_of,
    union_all, value_counts,
)
from tabprofile.functions.sampling import ordered_totals
from tabprofile.operators.association import pearson
from tabprofile.operators.columns import edges_reached
from tabprofile.operators.profile import column_basics

# Thresholds of the quality rules.
NEAR_CONSTANT_SHARE = 0.95
HIGH_CARDINALITY_SHARE = 0.5
SPARSE_NULL_RATE = 0.5
MIXED_SHARE = (0.05, 0.95)
HIGH_CORRELATION = 0.95


def entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shannon entropy (nats) of each column's values."""
    df = normalise(df)
    sums = []
    for f in value_counts(df, columns):
        sums.append(f.groupBy("column").agg(
            F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("n").cast("double").alias("total")))
    found = union_all(sums).select(
        "column", F.greatest(F.lit(0.0), F.log("total") - F.col("nlogn") / F.col("total")).alias("entropy"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # a column without values has no sums
    return every.join(found, "column", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))


def _contingency(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    frames = [
        f.select("column", F.col("value").cast("string").alias("value"), "target")
        for f in long_form(normalise(df), columns, {"target": col(target).cast("string")})
    ]
    return union_all(frames).where(F.col("target").isNotNull()).groupBy("column", "value", "target").agg(
        F.count(F.lit(1)).cast("double").alias("n"))


def information_gain(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Target entropy minus the entropy left once the column's value is known (nats)."""
    cells = _contingency(df, columns, target)
    by_value = cells.groupBy("column", "value").agg(F.sum("n").alias("nv"), F.sum(F.col("n") * F.log("n")).alias("cell"))
    known = by_value.groupBy("column").agg(
        F.sum("nv").alias("total"), F.sum(F.col("nv") * F.log("nv") - F.col("cell")).alias("left"))
    prior = cells.groupBy("column", "target").agg(F.sum("n").alias("nt")).groupBy("column").agg(
        F.sum(F.col("nt") * F.log("nt")).alias("t"))
    h = F.log("total") - F.col("t") / F.col("total")
    return known.join(prior, "column").select(
        "column", F.greatest(F.lit(0.0), h - F.col("left") / F.col("total")).alias("information_gain"))


def chi_square(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson's chi-square statistic of each column against the target, and its degrees of freedom.

    Uses N * (sum n_ij^2 / (r_i c_j) - 1), which needs only the cells that occur.
    """
    cells = _contingency(df, columns, target)
    values = cells.groupBy("column", "value").agg(F.sum("n").alias("r"))
    targets = cells.groupBy("column", "target").agg(F.sum("n").alias("c"))
    # a column has few targets, so a shuffle by them would fill few tasks
    joined = cells.join(values, ["column", "value"]).join(small_or_same(targets), ["column", "target"])
    terms = joined.groupBy("column").agg(F.sum(F.col("n") ** 2 / (F.col("r") * F.col("c"))).alias("s"), F.sum("n").alias("total"))
    shape = values.groupBy("column").agg(F.count(F.lit(1)).alias("rows")).join(
        targets.groupBy("column").agg(F.count(F.lit(1)).alias("cols")), "column")
    return terms.join(shape, "column").select(
        "column", (F.col("total") * (F.col("s") - 1)).alias("chi2"),
        ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("degrees"))


def anova_f(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """One-way F statistic of each numeric column over the target's classes."""
    df = normalise(df).where(col(target).isNotNull())
    means = scalars(df, {c: F.avg(as_double(df, c)) for c in columns})
    shifted = df.select(col(target).alias("t"), *[(as_double(df, c) - F.lit(means[c])).alias(f"x{i}") for i, c in enumerate(columns)])
    groups = shifted.groupBy("t").agg(*[
        e for i in range(len(columns))
        for e in (F.count(f"x{i}").alias(f"n{i}"), F.sum(f"x{i}").alias(f"s{i}"), F.sum(F.col(f"x{i}") ** 2).alias(f"q{i}"))
    ])
    # one row per class and column, so that all columns share the scan and the grouping
    parts = [F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{i}").alias(p) for p in "nsq"]) for i, c in enumerate(columns)]
    sums = groups.select(F.explode(F.array(*parts)).alias("p")).select("p.*").groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.try_divide(F.col("s") ** 2, F.col("n"))).alias("b"))
    between, within = F.col("b") - F.try_divide(F.col("s") ** 2, F.col("n")), F.col("q") - F.col("b")
    found = sums.select("column", F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k"))).alias("f"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # a table without classes has no sums
    return every.join(found, "column", "left")


def population_stability(before: DataFrame, after: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Stability index over equal-width bins of the earlier data; empty cells count as one half row."""
    before, after = normalise(before), normalise(after)
    ends = scalars(before, {"low": F.min(as_double(before, column)), "high": F.max(as_double(before, column))})
    if ends["low"] is None:
        raise ValueError(f"the earlier data has no value of '{column}' to place bins by")

    def shares(df: DataFrame, side: str) -> DataFrame:
        v = as_double(df, column)
        b = edges_reached(v, float(ends["low"]), float(ends["high"]), bins, strict=False)
        return df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))

    both = shares(before, "a").unionByName(shares(after, "b")).groupBy("bin").pivot("side", ["a", "b"]).agg(F.sum("n"))
    every = before.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(both, "bin", "left").select(
        *[F.when(F.coalesce(F.col(s), F.lit(0)) == 0, 0.5).otherwise(F.col(s).cast("double")).alias(s) for s in "ab"])
    whole = Window.partitionBy(F.lit(0))  # one row per bin
    p = filled.select(*[(F.col(s) / F.sum(s).over(whole)).alias(s) for s in "ab"])
    return p.agg(F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))).alias("psi")).select(
        F.lit(column).alias("column"), "psi")


def kolmogorov_smirnov(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Largest gap between the two cumulative distributions, over value counts summed in order."""
    before, after = normalise(before), normalise(after)
    sides = [
        df.select(as_double(df, column).alias("value"), F.lit(a).alias("a"), F.lit(1 - a).alias("b"))
        for df, a in ((before, 1), (after, 0))
    ]
    counts = union_all(sides).where(F.col("value").isNotNull()).groupBy("value").agg(
        F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    totals = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).first()
    if not totals["na"] or not totals["nb"]:
        return before.sparkSession.createDataFrame([(column, None)], "column string, ks double")
    weight = F.col("a") / F.lit(totals["na"]) - F.col("b") / F.lit(totals["nb"])
    gaps = ordered_totals(counts, [], ["value"], weight, "before")
    return gaps.agg(F.max(F.abs(F.col("before") + weight)).alias("ks")).select(F.lit(column).alias("column"), "ks")


def drift_summary(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and deviation of each numeric column in both datasets, and the shift in deviations."""
    facts = []
    for df, side in ((normalise(before), "before"), (normalise(after), "after")):
        facts.append(per_column(df, columns, {
            f"mean_{side}": (lambda d: lambda c: F.avg(as_double(d, c)))(df),
            f"std_{side}": (lambda d: lambda c: F.stddev_samp(as_double(d, c)))(df),
        }).drop("position"))
    return facts[0].join(facts[1], "column").withColumn(
        "mean_shift", F.try_divide(F.col("mean_after") - F.col("mean_before"), F.col("std_before")))


def schema_changes(before: DataFrame, after: DataFrame) -> list[tuple[str, str]]:
    """New, removed and retyped columns."""
    old, new = ({f.name: f.dataType for f in d.schema.fields} for d in (before, after))
    return (
        [(c, "new") for c in new if c not in old]
        + [(c, "removed") for c in old if c not in new]
        + [(c, "retyped") for c in new if c in old and old[c] != new[c]]
    )


def quality_issues(df: DataFrame) -> DataFrame:
    """``column, issue, value`` for each rule a column breaks."""
    df = normalise(df)
    plain = [c for c in df.columns if not is_nested(type_of(df, c))]
    # one count per value tells distinct values, the most frequent one and how many there are
    counted = union_all([f.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("best"), F.sum("n").alias("present")) for f in value_counts(df, plain)]) if plain else None
    p = column_basics(df)
    if counted is None:
        p = p.withColumns({"n_unique": F.lit(0).cast("bigint"), "best": F.lit(None).cast("bigint"), "present": F.lit(None).cast("bigint")})
    else:
        p = p.join(counted, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("bigint")))
    share, unique = F.try_divide("best", "present"), F.try_divide("n_unique", "row_count")
    texts = [c for c in df.columns if is_string(type_of(df, c))]
    rules = [
        (F.col("n_unique") <= 1, "constant", F.col("n_unique").cast("double")),
        ((F.col("n_unique") > 1) & (share >= NEAR_CONSTANT_SHARE), "near_constant", share),
        (F.col("column").isin(texts) & (unique > HIGH_CARDINALITY_SHARE), "high_cardinality", unique),
        (F.col("null_rate") > SPARSE_NULL_RATE, "sparse", F.col("null_rate")),
    ]
    found = p.select("column", F.explode(F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(issue).alias("issue"), value.alias("value"))) for test, issue, value in rules
    ]))).alias("i")).select("column", "i.issue", "i.value")
    if texts:
        mixed = per_column(df, texts, {
            "value": lambda c: F.avg(F.when(col(c).isNotNull(), col(c).try_cast("double").isNotNull().cast("double")))
        }).where((F.col("value") > MIXED_SHARE[0]) & (F.col("value") < MIXED_SHARE[1]))
        found = found.unionByName(mixed.select("column", F.lit("mixed_types").alias("issue"), "value"))
    numeric = numeric_columns(df)
    if len(numeric) > 1:
        place = F.create_map(*[F.lit(x) for i, c in enumerate(numeric) for x in (c, i)])
        pairs = pearson(df, numeric).where(
            (F.element_at(place, F.col("col_a")) < F.element_at(place, F.col("col_b"))) & (F.abs("value") >= HIGH_CORRELATION))
        found = found.unionByName(pairs.select(
            F.col("col_b").alias("column"), F.concat(F.lit("correlated_with_"), "col_a").alias("issue"), "value"))
    return found
