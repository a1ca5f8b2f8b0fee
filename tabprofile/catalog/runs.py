"""Reports over run tables.  Users of ``events`` stand for runs, event types for stages or candidates."""

from pyspark.sql import functions as F

from tabprofile.catalog.registry import joined, query, read, rounded
from tabprofile.operators import runs as R
from tabprofile.sources import sinks, traces


def events(spark, d):
    return read(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("node"), "ts", "event_id", "value")


def run_table(spark, d):
    e = read(spark, d, "events")
    errors = F.count_if(F.col("event_type") == "error")
    buys = F.count_if(F.col("event_type") == "purchase")
    per_run = e.groupBy(F.col("user_id").alias("run_id")).agg(
        F.date_trunc("day", F.min("ts")).alias("created_at"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("event_type").alias("column_count"), (F.avg("value") / 100).alias("quality_score"),
        errors.alias("errors"), buys.alias("buys"))
    status = F.when(F.col("errors") > F.col("buys"), "failed").when(F.col("errors") < F.col("buys"), "completed").otherwise("running")
    return per_run.select(
        "run_id", F.concat(F.lit("data_"), F.col("run_id").cast("string")).alias("filename"), status.alias("status"), "created_at",
        F.when(F.col("errors") != F.col("buys"), F.col("last")).alias("finished_at"),
        F.when(F.col("quality_score") > 0.48, "f1").otherwise("rmse").alias("metric"),
        F.when(F.col("quality_score") > 0.5, F.col("run_id") - 1).alias("source_run_id"), "row_count", "column_count", "quality_score")


RUNS = """runs AS (SELECT run_id, 'data_' || run_id::VARCHAR AS filename,
  CASE WHEN errors > buys THEN 'failed' WHEN errors < buys THEN 'completed' ELSE 'running' END AS status, created_at,
  CASE WHEN errors <> buys THEN last END AS finished_at, CASE WHEN quality_score > 0.48 THEN 'f1' ELSE 'rmse' END AS metric,
  CASE WHEN quality_score > 0.5 THEN run_id - 1 END AS source_run_id, row_count, column_count, quality_score FROM
 (SELECT user_id AS run_id, date_trunc('day', min(ts)) AS created_at, max(ts) AS last, count(*) AS row_count,
   count(DISTINCT event_type) AS column_count, avg(value) / 100 AS quality_score,
   count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY user_id))"""

_NODES = ["click", "error", "purchase", "signup", "view"]


def results(spark, d):
    e = read(spark, d, "events")
    g = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("candidate_name")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev"),
        F.sum("value").alias("total"))
    status = F.when((F.col("candidate_name") == "error") & (F.col("n") > 12), "failed").when(
        (F.col("candidate_name") == "signup") & (F.col("n") > 14), "running").otherwise("succeeded")
    place = F.array_position(F.array(*[F.lit(n) for n in _NODES]), F.col("candidate_name")).cast("int") - 1
    scored = F.create_map(F.lit("f1"), F.col("mean") / 100, F.lit("rmse"), F.col("dev"))
    cv = F.create_map(F.lit("f1"), F.struct((F.col("mean") / 110).alias("mean"), (F.col("dev") / 1000).alias("std")))
    none = F.lit(None).cast("map<string,double>")
    return g.select(
        "run_id", place.alias("position"), "candidate_name", status.alias("status"),
        F.when(status == "failed", "no luck").alias("error"),
        F.when(status == "succeeded", scored).otherwise(none).alias("metrics"), F.lit(5).alias("cv_folds"),
        F.when((status == "succeeded") & (F.col("candidate_name") != "view"), cv).alias("cv_metrics"),
        (F.col("total") / 10).alias("duration_seconds"), F.col("n").cast("int").alias("trials_done"),
        (F.col("n") + 3).cast("int").alias("trials_total"),
        F.array(F.struct(F.concat(F.lit("f_"), "candidate_name").alias("feature"), (F.col("mean") / 100).alias("importance"))).alias("importance"))


RESULTS = """results AS (SELECT run_id, candidate_name, list_position(['click', 'error', 'purchase', 'signup', 'view'], candidate_name) - 1 AS position,
  status, CASE WHEN status = 'succeeded' THEN mean / 100 END AS f1, CASE WHEN status = 'succeeded' THEN dev END AS rmse,
  CASE WHEN status = 'succeeded' AND candidate_name <> 'view' THEN mean / 110 END AS cv_mean,
  CASE WHEN status = 'succeeded' AND candidate_name <> 'view' THEN dev / 1000 END AS cv_std,
  total / 10 AS duration_seconds, n AS trials_done, n + 3 AS trials_total, mean / 100 AS importance FROM
 (SELECT *, CASE WHEN candidate_name = 'error' AND n > 12 THEN 'failed' WHEN candidate_name = 'signup' AND n > 14 THEN 'running' ELSE 'succeeded' END AS status FROM
  (SELECT user_id AS run_id, event_type AS candidate_name, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS dev,
    sum(value) AS total FROM events GROUP BY 1, 2))),
best AS (SELECT run_id, candidate_name, f1 AS score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, position) AS r FROM results
  WHERE status = 'succeeded') WHERE r = 1)"""


def best(spark, d):
    return R.best_models(results(spark, d), "f1", "f1")


@query("stage_timeline", f"""
WITH {RUNS}, s AS (SELECT user_id AS run_id, event_type AS node, min(ts) AS first_at, max(ts) AS completed_at FROM events GROUP BY 1, 2),
o AS (SELECT s.run_id, node, row_number() OVER w AS place, completed_at,
  coalesce(lag(completed_at) OVER w, created_at) AS before FROM s JOIN runs ON runs.run_id = s.run_id WINDOW w AS (PARTITION BY s.run_id ORDER BY first_at, node))
SELECT run_id, node, place::INT AS place, round(greatest((epoch_us(completed_at) - epoch_us(before)) / 1e6, 0), 1) AS duration_seconds FROM o""")
def stage_timeline(spark, d):
    return R.stage_timeline(events(spark, d), run_table(spark, d)).select("run_id", "node", "place", "duration_seconds")


@query("stages_done", """
SELECT run_id, string_agg(node, ',' ORDER BY first_at, node) AS stages FROM
 (SELECT user_id AS run_id, event_type AS node, min(ts) AS first_at FROM events GROUP BY 1, 2) GROUP BY run_id""")
def stages_done(spark, d):
    return R.stages_done(events(spark, d)).select("run_id", joined("stages").alias("stages"))


@query("best_model", f"WITH {RESULTS} SELECT run_id, candidate_name, round(score, 9) AS score FROM best")
def best_model(spark, d):
    return best(spark, d).select("run_id", "candidate_name", rounded("score", 9).alias("score"))


@query("best_model_fallback", f"""
WITH {RESULTS} SELECT run_id, candidate_name, round(rmse, 9) AS score, 'rmse' AS metric FROM
 (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rmse, position) AS r FROM results WHERE status = 'succeeded') WHERE r = 1""")
def best_model_fallback(spark, d):
    return R.best_models(results(spark, d), "precision", "rmse").select("run_id", "candidate_name", rounded("score", 9).alias("score"), "metric")


@query("run_list", f"""
WITH {RUNS}, {RESULTS} SELECT runs.run_id, filename, status, metric, source_run_id, round(score, 4) AS best_score,
  strftime(created_at, '%Y-%m-%d') AS created FROM runs LEFT JOIN best ON best.run_id = runs.run_id""")
def run_list(spark, d):
    return R.run_list(run_table(spark, d), best(spark, d)).select(
        "run_id", "filename", "status", "metric", "source_run_id", "best_score", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("dataset_list", f"""
WITH {RUNS} SELECT run_id, filename, status, row_count, column_count, round(quality_score, 10) AS quality_score FROM runs WHERE source_run_id IS NULL""")
def dataset_list(spark, d):
    return R.dataset_list(run_table(spark, d)).drop("created_at").withColumn("quality_score", rounded("quality_score", 10))


def _stored_traces(spark, d, name):
    path = sinks.scratch_path(spark, name)
    calls = read(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("turn").cast("double").alias("timestamp"), F.col("role").alias("node"),
        F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("").alias("system_prompt"), F.col("text").alias("user_prompt"),
        F.lit("").alias("response"), F.lit(None).cast("string").alias("error"))
    calls.write.mode("overwrite").json(path)
    return traces.read_traces(spark, path)


@query("trace_scan", """
SELECT conv_id::VARCHAR AS run_id, turn::DOUBLE AS timestamp, role AS node, text AS user_prompt FROM conversations""")
def trace_scan(spark, d):
    return _stored_traces(spark, d, "trace_scan").select("run_id", "timestamp", "node", "user_prompt")


@query("trace_calls", "SELECT conv_id::VARCHAR AS run_id, count(*) AS calls FROM conversations GROUP BY 1")
def trace_calls(spark, d):
    return traces.calls_per_run(_stored_traces(spark, d, "trace_calls"))


@query("leaderboard", f"""
WITH {RESULTS}, v AS (SELECT *, CASE WHEN max(cv_mean) OVER (PARTITION BY run_id) IS NOT NULL THEN cv_mean ELSE f1 END AS s FROM results)
SELECT run_id, candidate_name, round(s, 9) AS rank_score, row_number() OVER (PARTITION BY run_id ORDER BY s DESC NULLS LAST, position) AS rank FROM v""")
def leaderboard(spark, d):
    return R.leaderboard(results(spark, d), "f1").select("run_id", "candidate_name", rounded("rank_score", 9).alias("rank_score"), "rank")


@query("leaderboard_top", f"""
WITH {RESULTS} SELECT r.run_id, r.candidate_name, round(f1, 9) AS score, coalesce(r.candidate_name = b.candidate_name, FALSE) AS is_champion,
 row_number() OVER (PARTITION BY r.run_id ORDER BY coalesce(r.candidate_name = b.candidate_name, FALSE) DESC, f1 DESC NULLS LAST, position)::INT AS rank
FROM results r LEFT JOIN best b ON b.run_id = r.run_id""")
def leaderboard_top(spark, d):
    return R.leaderboard_top(results(spark, d), best(spark, d), "f1").select(
        "run_id", "candidate_name", rounded("score", 9).alias("score"), "is_champion", "rank")


@query("experiment_stats", f"""
WITH {RESULTS} SELECT r.run_id, sum(CASE WHEN trials_done = 0 THEN 1 ELSE trials_done END)::BIGINT AS trials, count(*) AS models,
 round(max(CASE WHEN r.candidate_name = b.candidate_name THEN coalesce(cv_mean, f1) END), 9) AS best_score,
 round(avg(duration_seconds), 4) AS mean_seconds, round(sum(duration_seconds), 4) AS total_seconds
FROM results r LEFT JOIN best b ON b.run_id = r.run_id GROUP BY r.run_id""")
def experiment_stats(spark, d):
    return R.experiment_stats(results(spark, d), best(spark, d), "f1").select(
        "run_id", "trials", "models", rounded("best_score", 9).alias("best_score"), rounded("mean_seconds", 4).alias("mean_seconds"),
        rounded("total_seconds", 4).alias("total_seconds"))


def _trials(spark, d):
    return events(spark, d).select("run_id", F.col("node").alias("candidate_name"), F.col("event_id").alias("trial"), F.col("value").alias("score"))


@query("trial_curve", """
SELECT user_id AS run_id, event_type AS candidate_name, event_id AS trial, value AS score,
 max(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS best_score FROM events""")
def trial_curve(spark, d):
    return R.trial_curve(_trials(spark, d))


@query("trial_series", f"""
WITH {RESULTS} SELECT r.run_id, r.candidate_name, r.candidate_name AS series FROM results r WHERE trials_done > 1""")
def trial_series(spark, d):
    return R.trial_curve_names(results(spark, d), best(spark, d))


@query("experiment_shares", f"""
WITH {RESULTS}, j AS (SELECT r.*, b.candidate_name AS champion, b.score AS top FROM results r LEFT JOIN best b ON b.run_id = r.run_id)
SELECT run_id, 'model' AS share, candidate_name AS label, sum(CASE WHEN trials_done = 0 THEN 1 ELSE trials_done END)::BIGINT AS n FROM j GROUP BY ALL
UNION ALL SELECT run_id, 'status', status, count(*) FROM j GROUP BY ALL
UNION ALL SELECT run_id, 'outcome', CASE WHEN candidate_name = champion THEN 'Champion'
  WHEN abs(f1 - top) / abs(CASE WHEN top = 0 THEN 1 ELSE top END) <= 0.02 OR f1 > top THEN 'Close contender' ELSE 'Trailed' END, count(*) FROM j GROUP BY ALL
UNION ALL SELECT run_id, 'time', CASE WHEN duration_seconds < 30 THEN '< 30s' WHEN duration_seconds <= 120 THEN '30s - 2m' ELSE '> 2m' END, count(*) FROM j GROUP BY ALL""")
def experiment_shares(spark, d):
    return R.experiment_shares(results(spark, d), best(spark, d), "f1")


@query("model_rationale", f"""
WITH {RESULTS}, c AS (SELECT r.run_id, r.candidate_name AS champion, f1 AS cf, duration_seconds AS cd FROM results r JOIN best b USING (run_id, candidate_name)),
j AS (SELECT r.run_id, candidate_name, cf - f1 AS delta, CASE WHEN cd <> 0 AND duration_seconds <> 0 THEN duration_seconds / cd END AS ratio
 FROM results r JOIN c ON c.run_id = r.run_id WHERE status = 'succeeded' AND candidate_name <> champion)
SELECT run_id, candidate_name, round(delta, 9) AS delta, round(ratio, 9) AS time_ratio,
 CASE WHEN delta IS NULL THEN 'Did not outperform' WHEN delta >= 0 THEN 'Lower' ELSE 'Higher' END AS reason, coalesce(ratio, 0) > 1.3 AS slower,
 CASE WHEN ratio > 2 THEN 'High Cost' WHEN ratio > 1.3 THEN 'Medium Cost' ELSE 'Marginal gain' END AS impact FROM j""")
def model_rationale(spark, d):
    return R.model_rationale(results(spark, d), best(spark, d), "f1").select(
        "run_id", "candidate_name", rounded("delta", 9).alias("delta"), rounded("time_ratio", 9).alias("time_ratio"), "reason", "slower", "impact")


@query("champion_delta", f"""
WITH {RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, position) AS k FROM results WHERE status = 'succeeded' AND f1 IS NOT NULL)
SELECT a.run_id, a.candidate_name AS champion, b.candidate_name AS runner_up, round(a.f1 - b.f1, 9) AS delta FROM r a JOIN r b ON a.run_id = b.run_id AND a.k = 1 AND b.k = 2""")
def champion_delta(spark, d):
    return R.champion_delta(results(spark, d), best(spark, d), "f1").select("run_id", "champion", "runner_up", rounded("delta", 9).alias("delta"))


@query("class_distribution", """
WITH c AS (SELECT quality::VARCHAR AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT label, n, round(n / sum(n) OVER (), 9) AS share, round(max(n) OVER () / min(n) OVER ()::DOUBLE, 9) AS imbalance_ratio,
 max(n) OVER () / min(n) OVER ()::DOUBLE >= 3 AS imbalanced FROM c""")
def class_distribution(spark, d):
    return R.class_distribution(read(spark, d, "labels"), "quality").select(
        "label", "n", rounded("share", 9).alias("share"), rounded("imbalance_ratio", 9).alias("imbalance_ratio"), "imbalanced")


@query("class_distribution_profile", "SELECT toxic::VARCHAR AS label, count(*) AS n FROM labels GROUP BY 1")
def class_distribution_profile(spark, d):
    from tabprofile.operators.profile import column_profile

    return R.class_distribution_of_profile(column_profile(read(spark, d, "labels")), "toxic")


@query("home_stats", f"""
WITH {RUNS}, {RESULTS} SELECT count(*) AS runs, round(max(CASE WHEN status = 'completed' AND metric = 'f1' THEN score END), 9) AS best_score,
 count(*) FILTER (status = 'running') AS active FROM runs LEFT JOIN best ON best.run_id = runs.run_id""")
def home_stats(spark, d):
    return R.home_stats(run_table(spark, d), best(spark, d), ("running",)).select("runs", rounded("best_score", 9).alias("best_score"), "active")


@query("run_summary", f"""
WITH {RUNS}, {RESULTS}, st AS (SELECT run_id, string_agg(node, ',' ORDER BY first_at, node) AS stages FROM
 (SELECT user_id AS run_id, event_type AS node, min(ts) AS first_at FROM events GROUP BY 1, 2) GROUP BY run_id),
t AS (SELECT run_id, count(*) AS candidates, count(*) FILTER (status = 'failed') AS failures, max(trials_done) > 1 AS tuned FROM results GROUP BY 1),
c AS (SELECT conv_id AS run_id, count(*) AS calls FROM conversations GROUP BY 1)
SELECT runs.run_id, filename, status, round((epoch_us(coalesce(finished_at, TIMESTAMP '2024-02-01')) - epoch_us(created_at)) / 1e6, 1) AS elapsed_seconds,
 coalesce(calls, 0) AS calls, stages, candidates, failures, 5 AS cv_folds, tuned, row_count, b.candidate_name AS champion
FROM runs LEFT JOIN st USING (run_id) LEFT JOIN t USING (run_id) LEFT JOIN c ON c.run_id::VARCHAR = runs.run_id::VARCHAR LEFT JOIN best b ON b.run_id = runs.run_id""")
def run_summary(spark, d):
    calls = _stored_traces(spark, d, "run_summary")
    runs = run_table(spark, d)
    named = lambda df: df.withColumn("run_id", F.col("run_id").cast("string"))
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    out = R.run_summary(named(runs), named(events(spark, d)), calls, named(results(spark, d)), named(best(spark, d)), now)
    return out.select(
        F.col("run_id").cast("bigint").alias("run_id"), "filename", "status", "elapsed_seconds", "calls", joined("stages").alias("stages"),
        "candidates", "failures", "cv_folds", "tuned", "row_count", "champion")


@query("training_progress", f"""
WITH {RESULTS}, t AS (SELECT user_id AS run_id, event_type AS candidate_name, max(value) AS best FROM events GROUP BY 1, 2)
SELECT r.run_id, count(*) AS candidates, count(*) FILTER (status IN ('succeeded', 'failed', 'timed_out')) AS finished,
 round(count(*) FILTER (status IN ('succeeded', 'failed', 'timed_out')) * 100.0 / count(*))::INT AS percent,
 coalesce(string_agg(r.candidate_name, ',' ORDER BY r.candidate_name) FILTER (status = 'running'), '') AS running,
 sum(trials_done)::BIGINT AS trials_done, sum(trials_total)::BIGINT AS trials_total, max(best) AS best_score
FROM results r LEFT JOIN t USING (run_id, candidate_name) GROUP BY r.run_id""")
def training_progress(spark, d):
    out = R.training_progress(results(spark, d), _trials(spark, d))
    return out.withColumn("running", joined("running"))


@query("mark_timed_out", f"""
WITH {RESULTS} SELECT run_id, candidate_name, CASE WHEN status IN ('succeeded', 'failed') THEN status ELSE 'timed_out' END AS status FROM results""")
def mark_timed_out(spark, d):
    return R.mark_timed_out(results(spark, d)).select("run_id", "candidate_name", "status")


@query("insights_model", f"""
WITH {RESULTS}, r AS (SELECT *, row_number() OVER w AS k, lead(f1) OVER w AS nf FROM results WHERE status = 'succeeded' AND f1 IS NOT NULL
  WINDOW w AS (PARTITION BY run_id ORDER BY f1 DESC, position)), b AS (SELECT * FROM r WHERE k = 1)
SELECT run_id, CASE WHEN g < 0.02 THEN 'close_race' ELSE 'clear_winner' END AS id, candidate_name AS subject, round(f1 - nf, 9) AS value FROM
 (SELECT *, CASE WHEN nf = 0 THEN 0 ELSE abs(f1 - nf) / abs(nf) END AS g FROM b WHERE nf IS NOT NULL)
UNION ALL SELECT run_id, CASE WHEN cv_std / abs(cv_mean) > 0.15 THEN 'cv_unstable' ELSE 'cv_stable' END, candidate_name, round(cv_std, 9) FROM b WHERE cv_mean IS NOT NULL
UNION ALL SELECT run_id, CASE WHEN importance > 0.5 THEN 'importance_concentrated' ELSE 'top_driver' END, 'f_' || candidate_name, round(importance, 9) FROM b""")
def insights_model(spark, d):
    from tabprofile.plans.insights import model_insights

    return model_insights(results(spark, d), "f1").select("run_id", "id", "subject", rounded("value", 9).alias("value"))
