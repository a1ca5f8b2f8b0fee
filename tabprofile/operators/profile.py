"""Dataset and column profiles as long tables: one row per column, one row per dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import (
    as_double, col, display_type, distinct_counts, fetched, is_nested, is_string, normalise, numeric_columns,
    per_column, type_of, union_all, value_counts,
)
from tabprofile.functions.stats import exact_quantiles
from tabprofile.operators.association import pearson
from tabprofile.operators.pii import REDACTED, PiiColumn, detect_pii, redact
from tabprofile.operators.rows import sample_rows

# Thresholds of the profile.
WIDE_COLUMNS = 50
CLUSTER_CORRELATION = 0.8
STRONG_CORRELATION = 0.6
TOP_VALUES = 10

_SUMMARY = "struct<mean:double,std:double,min:double,p25:double,p50:double,p75:double,max:double>"
_TOP = "array<struct<value:string,count:bigint>>"


def is_wide(df: DataFrame) -> bool:
    return len(df.columns) > WIDE_COLUMNS


def table_profile(df: DataFrame) -> DataFrame:
    """Row count, column count and whether the table is wide."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(is_wide(df)).alias("is_wide_dataset"))


def memory_bytes(df: DataFrame) -> DataFrame:
    """Logical bytes per column: fixed width per value, text by its encoded length."""
    widths = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4, "float": 4}

    def size(name: str) -> Column:
        dtype = type_of(df, name)
        if is_string(dtype):
            return F.coalesce(F.sum(F.octet_length(col(name))), F.lit(0)).cast("bigint")
        if is_nested(dtype):
            return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(col(name))))), F.lit(0)).cast("bigint")
        return (F.count(F.lit(1)) * widths.get(dtype.typeName(), 8)).cast("bigint")

    return per_column(df, df.columns, {"bytes": size})


def column_basics(df: DataFrame) -> DataFrame:
    """``column, position, dtype, row_count, null_count, null_rate`` in one pass without a shuffle."""
    df = normalise(df)
    return per_column(df, df.columns, _basics(df))


def _basics(df: DataFrame) -> dict:
    rows = F.count(F.lit(1))
    nulls = lambda c: F.count_if(col(c).isNull())
    return {
        "dtype": lambda c: display_type(type_of(df, c), nulls(c) > 0),
        "row_count": lambda c: rows,
        "null_count": nulls,
        "null_rate": lambda c: F.coalesce(F.try_divide(nulls(c), rows), F.lit(0.0)),
    }


_MOMENTS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Mean, sample deviation, extremes and quartiles of each numeric column, over its non-null values.

    Quartiles are exact and interpolated; ``approximate`` takes them from one mergeable sketch.
    """
    df = normalise(df)
    names = list(columns if columns is not None else numeric_columns(df))
    moments = per_column(df, names, {k: (lambda c, f=f: f(as_double(df, c))) for k, f in _MOMENTS.items()})
    return moments.join(F.broadcast(_quartiles(df, names, approximate)), "column")


def _quartiles(df: DataFrame, names: Sequence[str], approximate: bool, counts: dict[str, int] | None = None) -> DataFrame:
    if approximate:
        return per_column(df, names, {
            "q": lambda c: F.percentile_approx(as_double(df, c), [0.25, 0.5, 0.75], 10_000)
        }).select("column", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    found = exact_quantiles(df, names, [0.25, 0.5, 0.75], counts=counts)
    return df.sparkSession.createDataFrame([(name, *found[name]) for name in names], "column string, p25 double, p50 double, p75 double")


def top_values(df: DataFrame, columns: Sequence[str], k: int = TOP_VALUES) -> DataFrame:
    """``column, rank, value, count``: the k most frequent values; equal counts in value order.

    The rank filter is applied within each map task before rows move, so a column with as many
    values as rows sends only its best k per task.
    """
    return _top_of(value_counts(df, columns), k)


def _top_of(counts: Sequence[DataFrame], k: int = TOP_VALUES) -> DataFrame:
    place = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = [
        f.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        .select("column", "rank", F.col("value").cast("string").alias("value"), F.col("n").alias("count"))
        for f in counts
    ]
    return union_all(ranked)


def _top_arrays(counts: Sequence[DataFrame]) -> DataFrame:
    lists = _top_of(counts).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("t"))
    return lists.select("column", F.transform("t", lambda e: F.struct(e["value"], e["count"])).cast(_TOP).alias("top_values"))


def column_profile(
    df: DataFrame,
    pii: dict[str, PiiColumn] | None = None,
    exact_distinct: bool = True,
    approximate_quartiles: bool = False,
) -> DataFrame:
    """One row per column with type, null rate, distinct count, privacy kind and its summary.

    Numeric columns carry a numeric summary, others their most frequent values.  In a wide table
    numeric columns carry no summary (the clusters do) and list values only when they have few.
    Columns of personal data show the redaction text instead of values.
    """
    df = normalise(df)
    pii = detect_pii(df) if pii is None else pii
    spark = df.sparkSession
    wide = is_wide(df)
    numeric = [c for c in numeric_columns(df) if c not in pii]
    flat = [c for c in df.columns if c not in numeric and c not in pii and not is_nested(type_of(df, c))]

    summarised = numeric if numeric and not wide else []
    # types, gaps and moments come from one pass
    stats = {**_basics(df), **{k: (lambda c, f=f: f(as_double(df, c)) if c in summarised else F.lit(None).cast("double")) for k, f in _MOMENTS.items()}}
    profile = fetched(per_column(df, df.columns, stats))
    counted = [c for c in df.columns if c not in pii]  # a redacted column shows one value
    listed = [*flat, *(numeric if wide else [])]
    uniques = spark.createDataFrame([], "column string, n_unique bigint, is_approx boolean")
    tops = spark.createDataFrame([], f"column string, top_values {_TOP}")
    if counted and exact_distinct:
        # distinct counts and top values read the same counts per value
        counts = value_counts(df, counted)
        uniques = union_all([f.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")) for f in counts]).withColumn("is_approx", F.lit(False))
        if listed:
            tops = _top_arrays([f.where(F.col("column").isin(listed)) for f in counts])
        found = fetched(uniques.join(tops, "column", "left"))
        uniques, tops = found.select("column", "n_unique", "is_approx"), found.where(F.col("column").isin(listed)).select("column", "top_values")
    elif counted:
        uniques = distinct_counts(df, counted, exact=False)
        if listed:
            tops = _top_arrays(value_counts(df, listed))
    masked = spark.createDataFrame([(c, pii[c].pii_type) for c in pii], "column string, pii_type string")
    profile = profile.join(uniques, "column", "left").join(F.broadcast(masked), "column", "left").join(tops, "column", "left")

    summary = F.lit(None).cast(_SUMMARY)
    if summarised:
        rows = {r["column"]: r for r in profile.select("column", "row_count", "null_count").collect()}
        quartiles = _quartiles(df, summarised, approximate_quartiles, {c: rows[c]["row_count"] - rows[c]["null_count"] for c in summarised})
        profile = profile.join(F.broadcast(quartiles), "column", "left")
        fields = F.struct("mean", "std", "min", "p25", "p50", "p75", "max").cast(_SUMMARY)
        summary = F.when(F.col("column").isin(summarised), fields)
    profile = profile.withColumn("numeric", summary)

    is_masked = F.col("pii_type").isNotNull()
    few = F.col("column").isin(flat) | (F.coalesce("n_unique", F.lit(0)) <= TOP_VALUES)
    redacted_top = F.array(F.struct(F.lit(REDACTED).alias("value"), F.col("row_count").alias("count"))).cast(_TOP)
    return fetched(profile.select(
        "column", "position", "dtype", "row_count", "null_rate",
        F.when(is_masked, F.least("row_count", F.lit(1))).otherwise(F.coalesce("n_unique", F.lit(0)))
        .cast("bigint").alias("n_unique"),
        F.coalesce("is_approx", F.lit(False)).alias("is_approx"),
        is_masked.alias("is_pii"), "pii_type", "numeric",
        F.when(is_masked, redacted_top).when(few, F.col("top_values")).alias("top_values"),
    ))


def strong_pairs(df: DataFrame, pii: dict[str, PiiColumn] | None = None) -> DataFrame:
    """Numeric column pairs with |r| at or above the threshold, in column order."""
    df = normalise(df)
    names = numeric_columns(df, exclude=pii or {})
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, correlation double")
    order = {n: i for i, n in enumerate(names)}
    position = lambda c: F.element_at(F.create_map(*[F.lit(x) for n, i in order.items() for x in (n, i)]), F.col(c))
    return (
        pearson(df, names)
        .where((position("col_a") < position("col_b")) & (F.abs("value") >= STRONG_CORRELATION))
        .select(F.col("col_a").alias("a"), F.col("col_b").alias("b"), F.bround("value", 3).alias("correlation"))
    )


def correlation_clusters(
    df: DataFrame, pii: dict[str, PiiColumn] | None = None, threshold: float = CLUSTER_CORRELATION
) -> DataFrame:
    """Greedy clusters of correlated numeric columns with the summary of each cluster's first column.

    The matrix is one distributed pass; the walk over it touches only columns, never rows.
    """
    df = normalise(df)
    names = numeric_columns(df, exclude=pii or {})
    schema = "cluster int, representative string, members array<string>, size int"
    if not names:
        return df.sparkSession.createDataFrame([], schema + ", numeric " + _SUMMARY)
    close: dict[str, set[str]] = {}
    if len(names) > 1:
        for row in pearson(df, names).where(F.abs("value") >= threshold).collect():
            close.setdefault(row["col_a"], set()).add(row["col_b"])
    rest, rows = list(names), []
    while rest:
        first, rest = rest[0], rest[1:]
        members = [first, *[c for c in rest if c in close.get(first, ())]]
        rest = [c for c in rest if c not in members]
        rows.append((len(rows), first, members, len(members)))
    clusters = df.sparkSession.createDataFrame(rows, schema)
    summaries = numeric_summary(df, [r[1] for r in rows]).select(
        F.col("column").alias("representative"),
        F.struct("mean", "std", "min", "p25", "p50", "p75", "max").cast(_SUMMARY).alias("numeric"))
    return clusters.join(summaries, "representative", "left").select(
        "cluster", "representative", "members", "size", "numeric")


def quality(df: DataFrame) -> DataFrame:
    """Completeness, duplicate rows, uniqueness and their mean, each rounded to four digits.

    Equal rows collapse before the shuffle, and the counts of nulls come from the same grouped
    rows, so one grouping answers everything.
    """
    df = normalise(df)
    keys = [(F.to_json(col(c)) if is_nested(type_of(df, c)) else col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    nulls = sum((F.sum(F.when(F.col(f"c{i}").isNull(), F.col("n")).otherwise(0)) for i in range(len(keys))), F.lit(0))
    facts = grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.coalesce(nulls, F.lit(0)).alias("nulls"),
    ).select(
        "rows",
        (1 - F.coalesce(F.try_divide(F.col("nulls"), F.col("rows") * len(keys)), F.lit(0.0))).alias("complete"),
        (F.col("rows") - F.col("unique_rows")).alias("copies"),
    )
    rate = F.coalesce(F.try_divide(F.col("copies"), F.col("rows")), F.lit(0.0))
    return facts.select(
        F.round("complete", 4).alias("completeness"),
        F.col("copies").alias("duplicate_row_count"),
        F.round(rate, 4).alias("duplicate_row_rate"),
        F.round(1 - rate, 4).alias("uniqueness"),
        F.round((F.col("complete") + 1 - rate) / 2, 4).alias("overall"),
    )


@dataclass(frozen=True)
class Profile:
    """All parts of a dataset profile.  Every field but ``pii`` is a small Spark table."""

    pii: dict[str, PiiColumn]
    table: DataFrame
    columns: DataFrame
    quality: DataFrame
    memory: DataFrame
    strong_pairs: DataFrame | None
    clusters: DataFrame | None
    sample_rows: DataFrame
    wide: bool


def profile(df: DataFrame, key: str | None = None) -> Profile:
    """The whole profile of a dataset; personal data is found first and never shown."""
    df = normalise(df)
    pii = detect_pii(df)
    wide = is_wide(df)
    return Profile(
        pii=pii,
        table=table_profile(df),
        columns=column_profile(df, pii),
        quality=quality(df),
        memory=memory_bytes(df),
        strong_pairs=None if wide else strong_pairs(df, pii),
        clusters=correlation_clusters(df, pii) if wide else None,
        sample_rows=sample_rows(redact(df, pii), key if key not in pii else None),
        wide=wide,
    )
