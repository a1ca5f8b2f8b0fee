"""Short findings as rows ``id, category, tone, subject, value, message``.

Each rule is a filtered projection of a small table (column profile, flags or results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import union_all
from tabprofile.operators.leakage import IMBALANCE, is_identifier, minority_share
from tabprofile.plans.spec import LOWER_IS_BETTER, TaskSpec

# Thresholds of the rules.
HIGH_NULL_RATE = 0.30
IDENTIFIER_MIN_ROWS = 20
CLOSE_RACE = 0.02
UNSTABLE = 0.15
CONCENTRATED = 0.5
CONCERNS = ("data_quality", "imbalance", "leakage")

SCHEMA = "id string, category string, tone string, subject string, value double, message string"


def _row(rows: DataFrame, id_: Column | str, category: str, tone: Column | str, subject: Column, value: Column, message: Column) -> DataFrame:
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    return rows.select(
        text(id_).alias("id"), F.lit(category).alias("category"), text(tone).alias("tone"), subject.cast("string").alias("subject"),
        value.cast("double").alias("value"), message.alias("message"))


def profile_insights(
    profile: DataFrame, task: TaskSpec, pairs: DataFrame | None = None, wide: bool = False, minority: DataFrame | None = None
) -> DataFrame:
    """Privacy, width, gaps, identifiers, strong correlation and class imbalance.

    ``minority`` is the share of the rarest class over all classes; without it, the classes that the profile lists have to do.
    """
    nothing = F.lit(None)
    out = []
    masked = profile.where("is_pii").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    out.append(_row(masked, "pii_redacted", "privacy", "info", nothing, F.col("n"),
                    F.format_string("%d column(s) hold personal data and are redacted", "n")))
    if wide:
        columns = profile.agg(F.count(F.lit(1)).alias("n"))
        out.append(_row(columns, "wide_dataset", "scale", "info", nothing, F.col("n"),
                        F.format_string("%d columns; numeric ones are summarised by clusters", "n")))
    gaps = profile.where("null_rate > 0").agg(
        F.max_by("column", F.struct("null_rate", -F.col("position"))).alias("c"), F.max("null_rate").alias("r"))
    out.append(_row(gaps.where(F.col("r") > HIGH_NULL_RATE), "high_null_rate", "data_quality", "warning", F.col("c"), F.col("r"),
                    F.format_string("'%s' is missing in %.0f%% of rows", "c", F.col("r") * 100)))
    identifier = is_identifier(F.col("column"), F.col("dtype"), F.col("n_unique"), F.col("row_count"))
    last = profile.where(
        identifier & ~F.col("is_pii") & (F.col("column") != task.target_column) & (F.col("row_count") > IDENTIFIER_MIN_ROWS)
    ).agg(F.max_by("column", "position").alias("c")).where("c is not null")
    out.append(_row(last, "likely_identifier", "data_quality", "warning", F.col("c"), nothing,
                    F.format_string("'%s' is almost unique per row and looks like an identifier", "c")))
    if pairs is not None:
        top = pairs.agg(F.max_by(F.struct("a", "b", "correlation"), F.abs("correlation")).alias("p")).where("p is not null")
        out.append(_row(top, "strong_correlation", "correlation", "info", F.concat_ws(",", "p.a", "p.b"), F.col("p.correlation"),
                        F.format_string("'%s' and '%s' are strongly correlated (r=%.2f)", "p.a", "p.b", "p.correlation")))
    if task.is_classification:
        shares = minority_share(profile) if minority is None else minority.select(F.lit(task.target_column).alias("column"), "minority_ratio")
        ratio = shares.where((F.col("column") == task.target_column) & (F.col("minority_ratio") < IMBALANCE))
        out.append(_row(ratio, "class_imbalance", "imbalance", "warning", F.col("column"), F.col("minority_ratio"),
                        F.format_string("the smallest class has %.0f%% of the rows; accuracy alone misleads", F.col("minority_ratio") * 100)))
    return union_all(out)


def leakage_insight(flags: DataFrame) -> DataFrame:
    """The first flag of the worst severity."""
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    worst = flags.agg(F.max_by(F.struct("column", "reason", "severity"), F.struct(rank.alias("r"), (-F.col("position")).alias("p"))).alias("w"))
    worst = worst.where("w is not null")
    return _row(worst, "leakage_flag", "leakage", F.when(F.col("w.severity") == "high", "danger").otherwise("warning"),
                F.col("w.column"), F.lit(None), F.format_string("'%s' may leak the target: %s", "w.column", "w.reason"))


def model_insights(results: DataFrame, metric: str) -> DataFrame:
    """Per run: close race or clear winner, stability of the best model, and its top feature.

    ``results`` has ``run_id, position, candidate_name, status, metrics, cv_folds, cv_metrics,
    importance``.
    """
    lower = metric in LOWER_IS_BETTER
    scored = results.where(F.col("status") == "succeeded").withColumn("score", F.col("metrics")[metric]).where("score is not null")
    order = Window.partitionBy("run_id").orderBy(F.asc("score") if lower else F.desc("score"), "position")
    # only two rows per run and task take part in the ranking, however many candidates a run has
    leading = scored.withColumn("place", F.row_number().over(order)).where("place <= 2")
    second = leading.where("place = 2").select("run_id", F.col("score").alias("next_score"), F.col("candidate_name").alias("next_name"))
    best = leading.where("place = 1").join(second, "run_id", "left")
    run = F.col("run_id")
    delta = F.abs(F.col("score") - F.col("next_score"))
    gap = F.when(F.col("next_score") == 0, 0.0).otherwise(F.try_divide(delta, F.abs("next_score")))
    close = gap < CLOSE_RACE
    race = best.where("next_score is not null").select(
        run, F.when(close, "close_race").otherwise("clear_winner").alias("id"), F.lit("model_performance").alias("category"),
        F.when(close, "info").otherwise("success").alias("tone"), F.col("candidate_name").alias("subject"), delta.alias("value"),
        F.when(close, F.format_string("'%s' and '%s' perform almost alike", "candidate_name", "next_name"))
        .otherwise(F.format_string("'%s' leads '%s' by %.3f", "candidate_name", "next_name", delta)).alias("message"))
    cv = F.col("cv_metrics")[metric]
    spread = F.when(cv["mean"] == 0, 0.0).otherwise(F.try_divide(cv["std"], F.abs(cv["mean"])))
    shaky = spread > UNSTABLE
    stable = best.where((F.col("cv_folds") > 0) & cv.isNotNull()).select(
        run, F.when(shaky, "cv_unstable").otherwise("cv_stable").alias("id"), F.lit("model_performance").alias("category"),
        F.when(shaky, "warning").otherwise("success").alias("tone"), F.col("candidate_name").alias("subject"), cv["std"].alias("value"),
        F.format_string("scores vary by %.3f over %d folds", cv["std"], F.col("cv_folds")).alias("message"))
    top = F.element_at("importance", 1)
    heavy = top["importance"] > CONCENTRATED
    drivers = best.where(F.size("importance") > 0).select(
        run, F.when(heavy, "importance_concentrated").otherwise("top_driver").alias("id"), F.lit("feature_importance").alias("category"),
        F.when(heavy, "warning").otherwise("info").alias("tone"), top["feature"].alias("subject"), top["importance"].alias("value"),
        F.format_string("'%s' carries %.0f%% of the decisions", top["feature"], top["importance"] * 100).alias("message"))
    return union_all([race, stable, drivers])


def all_clear(insights: DataFrame, leakage_checked: bool) -> DataFrame:
    """One reassuring row when the leakage check is done and nothing of concern was found."""
    worries = insights.agg(F.count_if(F.col("category").isin(*CONCERNS)).alias("n"))
    quiet = worries.where((F.col("n") == 0) & F.lit(leakage_checked))
    return _row(quiet, "no_major_concerns", "data_quality", "success", F.lit(None), F.lit(None),
                F.lit("no major data-quality or leakage concerns were found"))


def selection_advice(spark, columns: int) -> DataFrame:
    return spark.createDataFrame(
        [("rfe_recommended", "modeling", "info", None, float(columns), f"{columns} candidate features; consider feature selection")], SCHEMA)
