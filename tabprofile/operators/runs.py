"""Reports over tables of runs, candidate results, tuning trials and stage events.

``runs``: run_id, filename, status, created_at, finished_at, metric, source_run_id, row_count, …
``results``: run_id, position, candidate_name, status, metrics, cv_metrics, duration_seconds, …
``trials``: run_id, candidate_name, trial, score.  ``events``: run_id, node, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import col, normalise
from tabprofile.functions.sampling import ordered_best, ordered_totals
from tabprofile.plans.spec import LOWER_IS_BETTER

# Shares, ratios and sizes of the reports.
SHOWN_ALL = 6
SHOWN_OTHERS = 5
NAMED = 8
CONTENDER = 0.02
HIGH_COST = 2.0
MEDIUM_COST = 1.3
IMBALANCE_RATIO = 3.0
TERMINAL = ("succeeded", "failed")
FINISHED = ("succeeded", "failed", "timed_out")
STATUS_ORDER = ("succeeded", "failed", "timed_out", "running", "pending")
HIGHER_IS_BETTER = ("accuracy", "f1", "roc_auc", "precision", "recall", "r2")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def stage_timeline(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run and stage its place, last completion and duration since the previous stage.

    Repeats of a stage keep its first place and its latest time.  Events collapse to one row per
    stage before anything is ordered.
    """
    stages = events.groupBy("run_id", "node").agg(F.min("ts").alias("first_at"), F.max("ts").alias("completed_at"))
    placed = stages.join(runs.select("run_id", "created_at"), "run_id")
    order = Window.partitionBy("run_id").orderBy("first_at", "node")  # one row per stage of the run
    before = F.coalesce(F.lag("completed_at").over(order), F.col("created_at"))
    gap = F.greatest(_seconds(F.col("completed_at")) - _seconds(before), F.lit(0.0))
    return placed.select(
        "run_id", "node", F.row_number().over(order).alias("place"), "completed_at", F.round(gap, 1).alias("duration_seconds"))


def stages_done(events: DataFrame) -> DataFrame:
    """Per run the distinct stages in the order they were first seen."""
    firsts = events.groupBy("run_id", "node").agg(F.min("ts").alias("first_at"))
    return firsts.groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first_at", "node"))), lambda e: e["node"]).alias("stages"))


def _score(metric: str) -> Column:
    return F.col("metrics")[metric]


def best_models(results: DataFrame, metric: str, default_metric: str) -> DataFrame:
    """The best succeeded candidate per run; the earliest of equals.

    A run none of whose candidates has the metric is judged by the default one, with a note.
    """
    ok = results.where(F.col("status") == "succeeded")

    def side(name: str) -> tuple[Column, Column]:
        s = F.col("metrics")[name]
        rank = F.struct((-s if name in LOWER_IS_BETTER else s).alias("s"), (-F.col("position")).alias("p"))
        return F.when(s.isNotNull(), rank), s

    wanted, fallback = side(metric), side(default_metric)
    pick = lambda x: F.max_by(F.struct("candidate_name", "position", x[1].alias("score")), x[0])
    best = ok.groupBy("run_id").agg(pick(wanted).alias("w"), pick(fallback).alias("f"))
    fell = F.col("w").isNull()
    chosen = F.coalesce("w", "f")
    return best.where(chosen.isNotNull()).select(
        "run_id", chosen["candidate_name"].alias("candidate_name"), chosen["score"].alias("score"),
        F.when(fell, default_metric).otherwise(metric).alias("metric"),
        F.when(fell, f"metric '{metric}' unavailable; used '{default_metric}'").alias("note"))


def run_list(runs: DataFrame, best: DataFrame) -> DataFrame:
    """Runs, newest first, with the best model's score on the run's metric."""
    scores = best.select("run_id", F.round("score", 4).alias("best_score"))
    return runs.join(scores, "run_id", "left").select(
        "run_id", "filename", "status", "created_at", "metric", "source_run_id", "best_score").orderBy(F.desc("created_at"), "run_id")


def dataset_list(runs: DataFrame) -> DataFrame:
    """Runs that brought their own data, newest first."""
    return runs.where(F.col("source_run_id").isNull()).select(
        "run_id", "filename", "status", "created_at", "row_count", "column_count", "quality_score",
    ).orderBy(F.desc("created_at"), "run_id")


def leaderboard(results: DataFrame, metric: str) -> DataFrame:
    """Rank per run by the cross-validated mean where any candidate of the run has one, else by the metric."""
    cv = F.col("cv_metrics")[metric]["mean"]
    has_cv = results.groupBy("run_id").agg(F.max(cv.isNotNull()).alias("_cv"))
    scored = results.join(has_cv, "run_id").withColumn("rank_score", F.when(F.col("_cv"), cv).otherwise(_score(metric)))
    sign = 1 if metric in LOWER_IS_BETTER else -1
    keyed = scored.select(
        "run_id", "candidate_name", "position", "rank_score",
        F.col("rank_score").isNull().alias("_absent"), (F.col("rank_score") * sign).alias("_key"))
    ranked = ordered_totals(keyed, ["run_id"], ["_absent", "_key", "position"], F.lit(1).cast("bigint"), "_before")
    return ranked.select("run_id", "candidate_name", "rank_score", (F.col("_before") + 1).alias("rank"))


def leaderboard_top(results: DataFrame, best: DataFrame, metric: str) -> DataFrame:
    """The champion first, then the next few by metric; everyone when the run has few candidates."""
    sizes = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    marked = results.join(best.select("run_id", F.col("candidate_name").alias("champion")), "run_id", "left").join(sizes, "run_id")
    is_best = F.coalesce(F.col("candidate_name") == F.col("champion"), F.lit(False))
    s = _score(metric)
    order = Window.partitionBy("run_id").orderBy(
        is_best.desc(), s.asc_nulls_last() if metric in LOWER_IS_BETTER else s.desc_nulls_last(), "position")
    limit = F.when(F.col("champion").isNotNull(), SHOWN_OTHERS + 1).otherwise(SHOWN_OTHERS)
    shown = marked.select("*", is_best.alias("is_champion"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= SHOWN_ALL)
    return shown.where((F.col("n") <= SHOWN_ALL) | (F.col("rank") <= limit)).select(
        "run_id", "rank", "candidate_name", s.alias("score"), "is_champion")


def experiment_stats(results: DataFrame, best: DataFrame, metric: str) -> DataFrame:
    """Trials, models, best score (cross-validated first), mean and total time per run."""
    champion = best.select("run_id", F.col("candidate_name").alias("champion"))
    joined = results.join(champion, "run_id", "left")
    mine = F.col("candidate_name") == F.col("champion")
    duration = F.coalesce("duration_seconds", F.lit(0.0))
    return joined.groupBy("run_id").agg(
        F.sum(F.when(F.coalesce("trials_done", F.lit(0)) == 0, 1).otherwise(F.col("trials_done"))).alias("trials"),
        F.count(F.lit(1)).alias("models"),
        F.max(F.when(mine, F.coalesce(F.col("cv_metrics")[metric]["mean"], _score(metric)))).alias("best_score"),
        F.avg(duration).alias("mean_seconds"), F.sum(duration).alias("total_seconds"))


def trial_curve(trials: DataFrame, lowest: bool = False) -> DataFrame:
    """Add the best score so far to each trial of each candidate."""
    return ordered_best(trials, ["run_id", "candidate_name"], ["trial"], "score", "best_score", lowest)


def trial_curve_names(results: DataFrame, best: DataFrame) -> DataFrame:
    """The series each candidate's curve belongs to: the champion and seven more by name, the rest together."""
    marked = results.where(F.col("trials_done") > 1).join(
        best.select("run_id", F.col("candidate_name").alias("champion")), "run_id", "left")
    first = F.coalesce(F.col("candidate_name") == F.col("champion"), F.lit(False))
    named = marked.withColumn("_first", ~first)
    ranked = ordered_totals(named, ["run_id"], ["_first", "position"], F.lit(1).cast("bigint"), "_before")
    return ranked.select("run_id", "candidate_name", F.when(F.col("_before") < NAMED, F.col("candidate_name")).otherwise("Other").alias("series"))


def experiment_shares(results: DataFrame, best: DataFrame, metric: str) -> DataFrame:
    """``run_id, share, label, n``: counts by model, status, outcome and time bucket."""
    joined = results.join(
        best.select("run_id", F.col("candidate_name").alias("champion"), F.col("score").alias("top")), "run_id", "left")
    placed = ordered_totals(joined, ["run_id"], ["position"], F.lit(1).cast("bigint"), "_before")
    trials = F.when(F.coalesce("trials_done", F.lit(0)) == 0, 1).otherwise(F.col("trials_done"))
    model = F.when(F.col("_before") < NAMED, F.col("candidate_name")).otherwise("Other")
    s = _score(metric)
    near = F.abs(s - F.col("top")) / F.abs(F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))) <= CONTENDER
    better = s < F.col("top") if metric in LOWER_IS_BETTER else s > F.col("top")
    outcome = F.when(F.coalesce(F.col("candidate_name") == F.col("champion"), F.lit(False)), "Champion").when(
        F.coalesce(near | better, F.lit(False)), "Close contender").otherwise("Trailed")
    d = F.col("duration_seconds")
    bucket = F.when(d < 30, "< 30s").when(d <= 120, "30s - 2m").when(d > 120, "> 2m")
    entries = F.array(
        F.struct(F.lit("model").alias("share"), model.alias("label"), trials.cast("bigint").alias("n")),
        F.struct(F.lit("status").alias("share"), F.col("status").alias("label"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("outcome").alias("share"), outcome.alias("label"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("time").alias("share"), bucket.alias("label"), F.lit(1).cast("bigint").alias("n")),
    )
    return placed.select("run_id", F.inline(entries)).where("label is not null").groupBy("run_id", "share", "label").agg(
        F.sum("n").alias("n"))


def _champions(results: DataFrame, best: DataFrame, metric: str) -> DataFrame:
    b = best.select("run_id", F.col("candidate_name"))
    return results.join(b, ["run_id", "candidate_name"]).select(
        "run_id", F.col("candidate_name").alias("champion"), _score(metric).alias("champion_score"),
        F.col("duration_seconds").alias("champion_seconds"))


def model_rationale(results: DataFrame, best: DataFrame, metric: str) -> DataFrame:
    """Why each other succeeded candidate was not chosen: score behind and cost of its time."""
    lower = metric in LOWER_IS_BETTER
    others = results.where(F.col("status") == "succeeded").join(_champions(results, best, metric), "run_id").where(
        F.col("candidate_name") != F.col("champion"))
    s = _score(metric)
    delta = s - F.col("champion_score") if lower else F.col("champion_score") - s
    both = (F.coalesce("champion_seconds", F.lit(0.0)) != 0) & (F.coalesce("duration_seconds", F.lit(0.0)) != 0)
    ratio = F.when(both, F.try_divide("duration_seconds", "champion_seconds"))
    impact = F.when(ratio > HIGH_COST, "High Cost").when(ratio > MEDIUM_COST, "Medium Cost").otherwise("Marginal gain")
    side = F.when((delta >= 0) == F.lit(lower), "Higher").otherwise("Lower")
    reason = F.when(delta.isNotNull(), side).otherwise("Did not outperform")
    return others.select("run_id", "candidate_name", delta.alias("delta"), ratio.alias("time_ratio"), reason.alias("reason"),
                         (F.coalesce(ratio, F.lit(0.0)) > MEDIUM_COST).alias("slower"), impact.alias("impact"))


def champion_delta(results: DataFrame, best: DataFrame, metric: str) -> DataFrame:
    """How far the champion leads the best other candidate (negative when it trails)."""
    lower = metric in LOWER_IS_BETTER
    s = _score(metric)
    others = results.where((F.col("status") == "succeeded") & s.isNotNull()).join(
        _champions(results, best, metric), "run_id").where(F.col("candidate_name") != F.col("champion"))
    runner = others.groupBy("run_id").agg(
        F.first("champion").alias("champion"), F.first("champion_score").alias("score"),
        F.max_by("candidate_name", F.struct((-s if lower else s).alias("s"), (-F.col("position")).alias("p"))).alias("runner_up"),
        (F.min(s) if lower else F.max(s)).alias("next"))
    delta = F.col("next") - F.col("score") if lower else F.col("score") - F.col("next")
    return runner.select("run_id", "champion", "runner_up", delta.alias("delta"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class, with the ratio of the largest to the smallest and whether it is notable."""
    counts = normalise(df).where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    # collected per table, not per class: three numbers
    facts = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"))
    ratio = F.try_divide(F.col("most"), F.col("least"))
    total = facts.select("total").scalar()
    return counts.select(
        "label", "n", F.try_divide("n", total).alias("share"), facts.select(ratio).scalar().alias("imbalance_ratio"),
        (facts.select(ratio).scalar() >= IMBALANCE_RATIO).alias("imbalanced"))


def class_distribution_of_profile(profile: DataFrame, target: str) -> DataFrame:
    """The same from a profile alone: listed values, or a null-free 0/1 column's mean."""
    one = profile.where(F.col("column") == target)
    mean, rows = F.col("numeric.mean"), F.col("row_count")
    positives = F.round(mean * rows).cast("bigint")
    coded = (F.col("n_unique") == 2) & (F.col("numeric.min") == 0) & (F.col("numeric.max") == 1) & (F.col("null_rate") == 0)
    both = F.array(
        F.struct(F.lit("1").alias("value"), positives.alias("count")),
        F.struct(F.lit("0").alias("value"), (rows - positives).alias("count")))
    entries = F.when(F.col("top_values").isNotNull(), F.col("top_values")).when(coded, both)
    return one.select(F.explode(entries).alias("e")).select(F.col("e.value").alias("label"), F.col("e.count").alias("n"))


def home_stats(runs: DataFrame, best: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """All runs, the best completed score on a higher-is-better metric, and the active runs."""
    joined = runs.join(best.select("run_id", F.col("score").alias("best_score")), "run_id", "left")
    counts = (F.col("status") == "completed") & F.col("metric").isin(*HIGHER_IS_BETTER)
    return joined.agg(
        F.count(F.lit(1)).alias("runs"), F.max(F.when(counts, F.col("best_score"))).alias("best_score"),
        F.count_if(F.col("status").isin(*active)).alias("active"))


def run_summary(runs: DataFrame, events: DataFrame, traces: DataFrame, results: DataFrame, best: DataFrame, now: Column) -> DataFrame:
    """One row per run: elapsed time, call count, stages, settings, profile figures and the champion."""
    calls = traces.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"))
    trained = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("status") == "failed").alias("failures"),
        F.max("cv_folds").alias("cv_folds"), F.max(F.coalesce("trials_done", F.lit(0)) > 1).alias("tuned"))
    elapsed = _seconds(F.coalesce(F.col("finished_at"), now)) - _seconds(F.col("created_at"))
    out = (
        runs.join(calls, "run_id", "left").join(stages_done(events), "run_id", "left").join(trained, "run_id", "left")
        .join(best.select("run_id", F.col("candidate_name").alias("champion")), "run_id", "left")
    )
    return out.select(
        "run_id", "filename", "status", F.round(elapsed, 1).alias("elapsed_seconds"), F.coalesce("calls", F.lit(0)).alias("calls"),
        "stages", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("failures", F.lit(0)).alias("failures"),
        F.coalesce("cv_folds", F.lit(0)).alias("cv_folds"), F.coalesce("tuned", F.lit(False)).alias("tuned"),
        "row_count", "column_count", "quality_score", "champion")


def training_progress(results: DataFrame, trials: DataFrame, lowest: bool = False) -> DataFrame:
    """Finished share, running candidates, and trials done and best score over each run's candidates."""
    tried = trials.groupBy("run_id", "candidate_name").agg((F.min if lowest else F.max)("score").alias("best"))
    joined = results.join(tried, ["run_id", "candidate_name"], "left")
    done = F.count_if(F.col("status").isin(*FINISHED))
    share = F.round(F.try_divide(done * 100, F.count(F.lit(1)))).cast("int")
    return joined.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidates"), done.alias("finished"), share.alias("percent"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "running", F.col("candidate_name")))).alias("running"),
        F.sum(F.coalesce("trials_done", F.lit(0))).alias("trials_done"), F.sum(F.coalesce("trials_total", F.lit(0))).alias("trials_total"),
        (F.min if lowest else F.max)("best").alias("best_score"))


def mark_timed_out(results: DataFrame) -> DataFrame:
    """What has not ended when waiting stops counts as timed out."""
    open_ = ~F.col("status").isin(*TERMINAL)
    note = "still training when the waiting limit was reached; no longer tracked"
    return results.withColumns({
        "status": F.when(open_, "timed_out").otherwise(F.col("status")),
        "error": F.when(open_, note).otherwise(F.col("error")),
    })
