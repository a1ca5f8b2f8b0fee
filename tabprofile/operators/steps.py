"""Feature steps that need no training/test separation, and application of a whole plan."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import (
    as_double, col, is_datetime, normalise, require_columns, scalars, small_or_same, type_of, value_counts,
)
from tabprofile.functions.sampling import with_row_index
from tabprofile.operators.columns import edges_reached
from tabprofile.operators.pii import parsed_timestamp
from tabprofile.plans.spec import FeatureStep

# Up to this many categories codes are a literal map; beyond it they are a table to join.
MAX_CODE_MAP = 5_000
DRY_RUN_ROWS = 200


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest of equals; columns without values are absent."""
    best = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    found: dict[str, object] = {}
    for counts in value_counts(df, columns):
        rows = counts.withColumn("r", F.row_number().over(best)).where("r = 1").select("column", "value").collect()
        found.update({r["column"]: r["value"] for r in rows})
    return found


def impute_most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    df = normalise(df)
    require_columns(df, columns)
    best = modes(df, columns)
    return df.withColumns({
        c: F.coalesce(col(c), F.lit(best[c]).cast(type_of(df, c))) for c in columns if c in best
    })


def impute_constant(df: DataFrame, columns: Sequence[str], fill_value: object = 0) -> DataFrame:
    df = normalise(df)
    require_columns(df, columns)
    return df.withColumns({c: F.coalesce(col(c), F.lit(fill_value).cast(type_of(df, c))) for c in columns})


def encode_onehot(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """One byte column per value, in value order, after the other columns; a missing value has none set.

    The values of all columns come from one pass.  They become columns, so the driver has to know them all; ``limit`` makes more than so
    many values of a column an error.
    """
    df = normalise(df)
    require_columns(df, columns)
    flags: dict[str, Column] = {}
    found: dict[str, list] = {c: [] for c in columns}
    for counts in value_counts(df, columns):
        for r in counts.select("column", "value").collect():
            found[r["column"]].append(r["value"])
    for c in columns:
        values = found[c]
        if limit is not None and len(values) > limit:
            raise ValueError(f"'{c}' has more than {limit} values; one-hot encoding would add a column for each")
        for v in sorted(values):
            flags[f"{c}_{v}"] = F.when(col(c) == F.lit(v), 1).otherwise(0).cast("byte")
    kept = [col(c) for c in df.columns if c not in columns]
    return df.select(*kept, *[e.alias(n) for n, e in flags.items()])


def encode_ordinal(df: DataFrame, columns: Sequence[str], map_limit: int = MAX_CODE_MAP) -> DataFrame:
    """Position of the value's text in alphabetical order; a missing value counts as the text ``nan``."""
    df = normalise(df)
    require_columns(df, columns)
    for c in columns:
        text = F.coalesce(col(c).cast("string"), F.lit("nan"))
        distinct = df.select(text.alias("__text")).distinct()
        few = distinct.limit(map_limit + 1).collect()
        if len(few) <= map_limit:
            codes = F.create_map(*[F.lit(x) for i, t in enumerate(sorted(r[0] for r in few)) for x in (t, float(i))])
            df = df.withColumn(c, F.element_at(codes, text)) if few else df.withColumn(c, F.lit(None).cast("double"))
        else:
            table = with_row_index(distinct, ["__text"], "__code").select("__text", F.col("__code").cast("double").alias("__code"))
            joined = df.withColumn("__text", text).join(small_or_same(table), "__text", "left")
            df = joined.select(*[F.col("__code").alias(c) if o == c else col(o) for o in df.columns])
    return df


def bin_equal_width(df: DataFrame, columns: Sequence[str], n_bins: int = 5) -> DataFrame:
    """Replace each value by its equal-width bin, counted from 0, bins closed on the right."""
    df = normalise(df)
    require_columns(df, columns)
    ends = scalars(df, {(c, k): f(as_double(df, c)) for c in columns for k, f in (("low", F.min), ("high", F.max))})
    binned = {}
    for c in columns:
        low, high = ends[c, "low"], ends[c, "high"]
        if low is None:
            bin_of = F.lit(None).cast("int")
        elif low == high:
            bin_of = F.lit(math.ceil(n_bins / 2) - 1)
        else:
            bin_of = edges_reached(as_double(df, c), low, high, n_bins, strict=True)
        binned[c] = F.when(col(c).isNotNull(), bin_of).cast("int")
    return df.withColumns(binned)


def datetime_decompose(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Year, month, day and weekday (Monday = 0) in place of a date or a text that reads as one."""
    require_columns(df, columns)
    parts: dict[str, Column] = {}
    for c in columns:
        moment = col(c) if is_datetime(type_of(df, c)) else parsed_timestamp(col(c).cast("string"))
        parts |= {
            f"{c}_year": F.year(moment), f"{c}_month": F.month(moment),
            f"{c}_day": F.dayofmonth(moment), f"{c}_dayofweek": F.weekday(moment),
        }
    kept = [col(c) for c in df.columns if c not in columns]
    return df.select(*kept, *[e.alias(n) for n, e in parts.items()])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def custom_transform(df: DataFrame, function, dry_run_rows: int = DRY_RUN_ROWS) -> DataFrame:
    """Run a user's DataFrame function on a few rows first; only then, lazily, on everything."""
    trial = function(df.limit(dry_run_rows))
    if not isinstance(trial, DataFrame):
        raise ValueError("a custom step must return a DataFrame")
    trial.write.format("noop").mode("overwrite").save()
    result = function(df)
    if result.schema != trial.schema:
        raise ValueError("a custom step must return the same columns whatever the rows")
    return result


def apply_step(df: DataFrame, step: FeatureStep) -> DataFrame:
    if step.op == "impute":
        strategy = step.params.get("strategy", "mean")
        if strategy == "most_frequent":
            return impute_most_frequent(df, step.columns)
        if strategy == "constant":
            return impute_constant(df, step.columns, step.params.get("fill_value", 0))
        raise ValueError(f"unknown imputation '{strategy}'")
    if step.op == "encode":
        method = step.params.get("method", "onehot")
        if method == "onehot":
            return encode_onehot(df, step.columns)
        if method == "ordinal":
            return encode_ordinal(df, step.columns)
        raise ValueError(f"unknown encoding '{method}'")
    if step.op == "bin":
        return bin_equal_width(df, step.columns, step.params.get("n_bins", 5))
    if step.op == "datetime_decompose":
        return datetime_decompose(df, step.columns)
    if step.op == "drop":
        return drop_columns(df, step.columns)
    if step.op == "custom":
        if step.function is None:
            raise ValueError("a custom step needs a function")
        return custom_transform(df, step.function)
    raise ValueError(f"step '{step.op}' is fitted during training and cannot be applied here")


@dataclass(frozen=True)
class PlanResult:
    """``deferred`` steps learn from data and wait for the training rows."""

    valid: bool
    data: DataFrame | None
    deferred: list[FeatureStep] = field(default_factory=list)
    feedback: str | None = None


def apply_plan(df: DataFrame, steps: Sequence[FeatureStep], target: str | None = None) -> PlanResult:
    """Apply the plan in order.  A step that fails makes the plan invalid instead of raising."""
    deferred = [s for s in steps if s.is_fitted]
    data = normalise(df)
    try:
        for step in steps:
            if not step.is_fitted:
                data = apply_step(data, step)
    except Exception as problem:
        return PlanResult(False, None, feedback=f"applying the plan failed: {problem}")
    if target is not None:
        if target not in data.columns or data.where(col(target).isNotNull()).limit(1).count() == 0:
            return PlanResult(False, None, feedback=f"the plan lost or fully emptied the target column '{target}'")
    return PlanResult(True, data, deferred)
