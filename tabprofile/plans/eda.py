"""Suggested feature steps from column facts.

The facts of all columns come from a fixed number of aggregations; the rules then look at one short
record per column, never at rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.frames import as_double, fetched, is_datetime, is_numeric, is_string, normalise, scalars, type_of
from tabprofile.functions.stats import skewness
from tabprofile.operators import leakage as L
from tabprofile.operators import outliers as O
from tabprofile.operators.pii import PiiColumn, date_share, detect_pii
from tabprofile.operators.profile import column_profile, is_wide, strong_pairs
from tabprofile.plans.insights import profile_insights, selection_advice
from tabprofile.plans.spec import FeatureStep, TaskSpec

# Thresholds of the rules.
IDENTIFIER_MIN_ROWS = 20
TARGET_ENCODING_ABOVE = 20
HIGH_SKEW = 1.0
OUTLIER_HEAVY = 0.02
DATE_NAMES = ("date", "time", "timestamp", "_at", "_dt")
DATE_SHARE = 0.9
SELECTION_ADVICE_FROM = 15


@dataclass(frozen=True)
class ColumnFacts:
    column: str
    position: int
    numeric: bool
    datetime: bool
    identifier: bool
    null_rate: float
    n_unique: int
    skew: float
    outlier_rate: float


def column_facts(df: DataFrame, profile: DataFrame | None = None) -> list[ColumnFacts]:
    """One record per column."""
    df = normalise(df)
    profile = column_profile(df, pii={}) if profile is None else profile
    numeric = [c for c in df.columns if is_numeric(type_of(df, c))]
    named = [c for c in df.columns if is_string(type_of(df, c)) and any(h in c.lower() for h in DATE_NAMES)]
    shares = date_share(df, named)
    skews = scalars(df, {c: skewness(as_double(df, c)) for c in numeric}) if numeric else {}
    rates = {r["column"]: r["outlier_rate"] for r in O.outlier_rate(df, numeric).collect()} if numeric else {}
    rows = profile.select(
        "column", "position", "null_rate", "n_unique", "row_count",
        L.is_identifier(F.col("column"), F.col("dtype"), F.col("n_unique"), F.col("row_count")).alias("identifier")).collect()
    return sorted((
        ColumnFacts(
            r["column"], r["position"], r["column"] in numeric,
            is_datetime(type_of(df, r["column"])) or (shares.get(r["column"]) or 0.0) > DATE_SHARE,
            bool(r["identifier"]) and r["row_count"] > IDENTIFIER_MIN_ROWS,
            r["null_rate"], r["n_unique"], skews.get(r["column"]) or 0.0, rates.get(r["column"]) or 0.0)
        for r in rows
    ), key=lambda f: f.position)


def suggest_steps(
    facts: list[ColumnFacts], task: TaskSpec, flags: list[dict] = (), pii: dict[str, PiiColumn] | None = None
) -> list[FeatureStep]:
    """Steps in column order: leakage drops first, one scale step last."""
    known = {f.column for f in facts}
    reserved = {task.target_column, task.time_column}
    steps: list[FeatureStep] = []

    def add(op: str, columns, rationale: str, **params) -> None:
        steps.append(FeatureStep(op, columns, params, rationale, "eda"))

    leaky: list[str] = []
    for flag in flags:
        c = flag["column"]
        if flag["severity"] == "high" and c in known and c not in reserved and c not in leaky:
            leaky.append(c)
            add("drop", [c], f"'{c}' may reveal the target ({flag['reason']}); a heuristic flag, not a proof")

    kept: list[str] = []
    heavy = False
    for f in facts:
        c = f.column
        if c in reserved or c in leaky or c in (pii or {}):
            continue
        if f.datetime and not f.numeric:
            add("datetime_decompose", [c], f"'{c}' holds dates; its parts carry more signal than the raw value")
        elif f.identifier:
            add("drop", [c], f"'{c}' is almost unique per row, like an identifier")
        elif f.numeric:
            if f.null_rate > 0:
                strategy = "median" if abs(f.skew) > HIGH_SKEW else "mean"
                shape = "skewed" if strategy == "median" else "roughly symmetric"
                add("impute", [c], f"'{c}' is missing in {f.null_rate:.0%} of rows and {shape}", strategy=strategy)
            heavy = heavy or f.outlier_rate > OUTLIER_HEAVY
            kept.append(c)
        else:
            if f.null_rate > 0:
                add("impute", [c], f"'{c}' is missing in {f.null_rate:.0%} of rows", strategy="most_frequent")
            if f.n_unique > TARGET_ENCODING_ABOVE:
                if task.target_column:
                    add("encode", [c], f"'{c}' has {f.n_unique} categories, too many for a column each",
                        method="target", target_column=task.target_column)
                else:
                    add("encode", [c], f"'{c}' has {f.n_unique} categories, too many for a column each", method="ordinal")
            elif f.n_unique > 1:
                add("encode", [c], f"'{c}' has {f.n_unique} categories, few enough for a column each", method="onehot")
    if kept:
        method = "robust" if heavy else "standard"
        add("scale", kept, "numeric features differ in scale" + (" and some have many outliers" if heavy else ""), method=method)
    return steps


def resampling_suggestion(profile: DataFrame, task: TaskSpec, minority: DataFrame | None = None) -> dict:
    """Interpolated over-sampling when the smallest class is rare; ``minority`` as in :func:`profile_insights`."""
    ratio = None
    if task.is_classification:
        row = (L.minority_share(profile.where(F.col("column") == task.target_column)) if minority is None else minority).first()
        ratio = row["minority_ratio"] if row else None
    rare = ratio is not None and ratio < L.IMBALANCE
    return {
        "suggested": rare, "method": "smote" if rare else "none", "minority_ratio": ratio,
        "reason": f"the smallest class has only {ratio:.0%} of the rows" if rare else None,
    }


def steps_table(spark, steps: list[FeatureStep]) -> DataFrame:
    rows = [
        (i, s.op, list(s.columns), {k: str(v) for k, v in s.params.items()}, s.rationale, s.source) for i, s in enumerate(steps)
    ]
    return spark.createDataFrame(
        rows, "position int, op string, columns array<string>, params map<string,string>, rationale string, source string")


@dataclass(frozen=True)
class EdaReport:
    steps: list[FeatureStep]
    resampling: dict
    profile: DataFrame
    insights: DataFrame


def run_eda(df: DataFrame, task: TaskSpec, profile: DataFrame | None = None, flags: DataFrame | None = None) -> EdaReport:
    """Insights, suggested steps and class balancing for a task."""
    df = normalise(df)
    task.validate(df)
    pii = detect_pii(df)
    profile = column_profile(df, pii) if profile is None else profile
    flags = L.leakage_flags(df, task.target_column) if flags is None else flags
    listed = [r.asDict() for r in flags.orderBy("position").collect()]  # at most two rows per column
    plain = column_profile(df, pii={}) if pii else profile
    wide = is_wide(df)
    minority = fetched(L.class_minority(df, task.target_column)) if task.is_classification else None
    insights = profile_insights(profile, task, None if wide else strong_pairs(df, pii), wide, minority)
    others = sum(c != task.target_column for c in df.columns)
    if others >= SELECTION_ADVICE_FROM:
        insights = insights.unionByName(selection_advice(df.sparkSession, others))
    return EdaReport(
        steps=suggest_steps(column_facts(df, plain), task, listed, pii),
        resampling=resampling_suggestion(profile, task, minority),
        profile=profile,
        insights=insights,
    )


def column_insights(steps: DataFrame, flags: DataFrame, column: str) -> DataFrame:
    """``kind, detail, note`` of the plan steps and leakage flags that mention a column."""
    planned = steps.where(F.array_contains("columns", column)).select(
        F.lit("step").alias("kind"), F.col("op").alias("detail"), F.col("rationale").alias("note"))
    flagged = flags.where(F.col("column") == column).select(
        F.lit("leakage").alias("kind"), F.col("severity").alias("detail"), F.col("reason").alias("note"))
    return planned.unionByName(flagged)
