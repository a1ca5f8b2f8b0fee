"""Splits, class balance, metrics, training, selection, tuning and explanation."""

from functools import lru_cache

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabprofile.catalog.registry import query, read, rounded, unit_sql
from tabprofile.operators import metrics as M
from tabprofile.operators import resample as B
from tabprofile.operators import split as S
from tabprofile.plans.models import build_estimator
from tabprofile.plans import explain as X
from tabprofile.plans import training as T
from tabprofile.plans.spec import CandidateModel, FeatureStep, TaskSpec

_U = unit_sql("o_orderkey")


def _orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")


@query("split_random", f"SELECT o_orderkey, {_U} < 0.8 AS is_train FROM orders")
def split_random(spark, d):
    return S.split_random(_orders(spark, d), "o_orderkey").select("o_orderkey", "is_train")


@query("split_stratified", f"""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_U}, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.8 + 0.5) AS is_train FROM orders""")
def split_stratified(spark, d):
    return S.split_stratified(_orders(spark, d), "o_orderstatus", "o_orderkey").select("o_orderkey", "is_train")


@query("split_time", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, {_U}, o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8) AS is_train FROM orders""")
def split_time(spark, d):
    return S.split_time(_orders(spark, d), "o_orderdate", "o_orderkey").select("o_orderkey", "is_train")


_UF = unit_sql("o_orderkey", "fold")


@query("cv_folds", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_UF}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, len(list_filter(range(1, 5), lambda i: r > floor(n * i / 5.0)))::INT AS fold FROM r""")
def cv_folds(spark, d):
    return S.stratified_folds(_orders(spark, d), "o_orderstatus", "o_orderkey", 5).select("o_orderkey", "fold")


@query("cv_folds_plain", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_UF}, o_orderkey) AS r, (SELECT count(*) FROM orders) AS n FROM orders)
SELECT o_orderkey, len(list_filter(range(1, 4), lambda i: r > floor(n * i / 4.0)))::INT AS fold FROM r""")
def cv_folds_plain(spark, d):
    return S.plain_folds(_orders(spark, d), "o_orderkey", 4).select("o_orderkey", "fold")


@query("cv_folds_time", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, {_U}, o_orderkey) AS r, (SELECT count(*) FROM orders) AS n FROM orders)
SELECT o_orderkey, len(list_filter(range(0, 3), lambda i: r > n - (3 - i) * (n // 4)))::INT AS fold FROM r""")
def cv_folds_time(spark, d):
    return S.time_folds(_orders(spark, d), "o_orderdate", "o_orderkey", 3).select("o_orderkey", "fold")


_OVER = unit_sql("doc_id", "over")
_UNDER = unit_sql("doc_id", "under")


@query("resample_over", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_OVER}, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels),
m AS (SELECT max(n) AS m FROM r)
SELECT doc_id, quality, m // n + (r <= m % n)::INT AS copies FROM r, m""")
def resample_over(spark, d):
    return B.random_oversample(read(spark, d, "labels"), "quality", "doc_id").groupBy("doc_id", "quality").agg(
        F.count(F.lit(1)).alias("copies"))


@query("resample_under", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_UNDER}, doc_id) AS r FROM labels)
SELECT doc_id, quality FROM r WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def resample_under(spark, d):
    return B.random_undersample(read(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality")


@query("resample_smote", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS synthetic, TRUE AS within FROM c""")
def resample_smote(spark, d):
    df = read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    out = B.smote(df, "label", "vec_id", "x")
    width = range(64)
    ranges = df.groupBy("label").agg(F.array(*[F.min(F.col("x")[i]) for i in width]).alias("lo"), F.array(*[F.max(F.col("x")[i]) for i in width]).alias("hi"))
    inside = F.forall(F.arrays_zip("x", "lo", "hi"), lambda e: (e["x"] >= e["lo"] - 1e-12) & (e["x"] <= e["hi"] + 1e-12))
    return out.join(ranges, "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_synthetic").alias("synthetic"), F.bool_and(inside & (F.size("x") == 64)).alias("within"))


@query("ridge_coefficients", """
WITH s AS (SELECT count(*) AS n, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab,
  covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS b_y FROM lineitem),
p AS (SELECT aa + 100.0 / n AS aa, bb + 100.0 / n AS bb, ab, ay, b_y FROM s)
SELECT round((ay * bb - b_y * ab) / (aa * bb - ab * ab), 3) AS quantity, round((b_y * aa - ay * ab) / (aa * bb - ab * ab), 3) AS discount FROM p""")
def ridge_coefficients(spark, d):
    df = read(spark, d, "lineitem").select(
        array_to_vector(F.array("l_quantity", "l_discount")).alias("features"), F.col("l_extendedprice").alias("label"))
    n, deviation = df.agg(F.count("label"), F.stddev_pop("label")).first()
    found = build_estimator("Ridge", {"alpha": 100.0}, n, label_deviation=deviation).fit(df).coefficients
    return spark.createDataFrame([(round(float(found[0]), 3), round(float(found[1]), 3))], "quantity double, discount double")


# Predictions made by simple rules, so that the metrics have something to measure.
_CODES = {"A": 0.0, "N": 1.0, "R": 2.0}


def _scored_classes(spark, d):
    code = F.create_map(*[F.lit(x) for k, v in _CODES.items() for x in (k, v)])
    guess = F.when(F.col("l_quantity") > 30, code[F.col("l_returnflag")]).when(F.col("l_linestatus") == "F", 0.0).otherwise(2.0)
    return read(spark, d, "lineitem").select(code[F.col("l_returnflag")].alias("label"), guess.alias("prediction"))


_SCORED = """s AS (SELECT CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END AS label,
 CASE WHEN l_quantity > 30 THEN CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END WHEN l_linestatus = 'F' THEN 0.0 ELSE 2.0 END AS prediction FROM lineitem),
k AS (SELECT c, count(*) FILTER (label = c) AS actual, count(*) FILTER (prediction = c) AS guessed, count(*) FILTER (label = c AND prediction = c) AS hits
 FROM s, (VALUES (0.0), (1.0), (2.0)) t(c) GROUP BY c)"""


@query("metric_classification", f"""
WITH {_SCORED} SELECT round(sum(hits) / sum(actual)::DOUBLE, 6) AS accuracy,
 round(sum(actual * CASE WHEN actual + guessed > 0 THEN 2.0 * hits / (actual + guessed) ELSE 0 END)::DOUBLE / sum(actual), 6) AS f1 FROM k""")
def metric_classification(spark, d):
    return M.classification_metrics(_scored_classes(spark, d)).select(rounded("accuracy").alias("accuracy"), rounded("f1").alias("f1"))


@query("metric_prec_recall", f"""
WITH {_SCORED} SELECT round(sum(actual * CASE WHEN guessed > 0 THEN hits / guessed::DOUBLE ELSE 0 END) / sum(actual), 6) AS precision,
 round(sum(actual * CASE WHEN actual > 0 THEN hits / actual::DOUBLE ELSE 0 END) / sum(actual), 6) AS recall FROM k""")
def metric_prec_recall(spark, d):
    return M.classification_metrics(_scored_classes(spark, d)).select(rounded("precision").alias("precision"), rounded("recall").alias("recall"))


@query("metric_auc", """
WITH s AS (SELECT (l_returnflag = 'R')::INT AS label, l_discount + l_quantity * CASE WHEN l_returnflag = 'R' THEN 0.002 ELSE 0.001 END AS score FROM lineitem),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
 / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE, 6) AS roc_auc FROM r""")
def metric_auc(spark, d):
    r = F.col("l_returnflag") == "R"
    scored = read(spark, d, "lineitem").select(
        r.cast("int").alias("label"), (F.col("l_discount") + F.col("l_quantity") * F.when(r, 0.002).otherwise(0.001)).alias("score"))
    return M.roc_auc(scored).select(rounded("roc_auc").alias("roc_auc"))


@query("metric_regression", """
WITH s AS (SELECT l_extendedprice AS y, l_quantity * 2000.0 AS p FROM lineitem)
SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM s""")
def metric_regression(spark, d):
    scored = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000.0).alias("prediction"))
    out = M.regression_metrics(scored)
    return out.select(rounded("rmse", 4).alias("rmse"), rounded("mae", 4).alias("mae"), rounded("r2").alias("r2"))


# ---- models ---------------------------------------------------------------------------------

PRICE_TASK = TaskSpec("regression", "charge", "rmse")
FLAG_TASK = TaskSpec("classification", "expensive", "roc_auc")
BAND_TASK = TaskSpec("classification", "band", "f1")
STEPS = [
    FeatureStep("scale", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], {"method": "standard"}),
    FeatureStep("encode", ["l_returnflag"], {"method": "target"}),
]


def _lines(spark, d):
    """Order lines with their full charge: a number, a yes/no and a band to predict."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return read(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_shipdate",
        charge.alias("charge"), (charge > 60000).alias("expensive"),
        F.when(charge > 70000, "high").when(charge > 30000, "middle").otherwise("low").alias("band"))


def _prepared(spark, d, task):
    others = {"charge", "expensive", "band", "l_shipdate"} - {task.target_column, task.time_column}
    return T.prepare(_lines(spark, d).drop(*others), task)


def _trained(spark, d, task, estimator, params, **options):
    prepared = _prepared(spark, d, task)
    result = T.train_candidate(prepared, CandidateModel(estimator, estimator, params), STEPS, T.Options(**{"cv_folds": None, **options}))
    if result.status != "succeeded":
        raise RuntimeError(result.error)
    return prepared, result


def _metric_rows(spark, result):
    return spark.createDataFrame([(result.candidate_name, m, float(v)) for m, v in sorted(result.metrics.items())],
                                 "candidate_name string, metric string, value double")


def _register_training(name, task, estimator, params):
    @query(name)
    def run(spark, d):
        return _metric_rows(spark, _trained(spark, d, task, estimator, params)[1])


_register_training("train_logistic", FLAG_TASK, "LogisticRegression", {"max_iter": 50})
_register_training("train_logistic_multiclass", BAND_TASK, "LogisticRegression", {"max_iter": 50})
_register_training("train_linear", PRICE_TASK, "LinearRegression", {})
_register_training("train_ridge", PRICE_TASK, "Ridge", {"alpha": 1.0})
_register_training("train_forest_classifier", FLAG_TASK, "RandomForestClassifier", {"n_estimators": 10, "max_depth": 5, "random_state": 0})
_register_training("train_forest_regressor", PRICE_TASK, "RandomForestRegressor", {"n_estimators": 10, "max_depth": 5, "random_state": 0})
_register_training("train_boosting_classifier", FLAG_TASK, "GradientBoostingClassifier", {"n_estimators": 5, "max_depth": 3, "random_state": 0})
_register_training("train_boosting_multiclass", BAND_TASK, "GradientBoostingClassifier", {"n_estimators": 3, "max_depth": 3, "random_state": 0})
_register_training("train_boosting_regressor", PRICE_TASK, "GradientBoostingRegressor", {"n_estimators": 5, "max_depth": 3, "random_state": 0})


@query("train_forecast")
def train_forecast(spark, d):
    """A regression whose split and folds follow time."""
    task = TaskSpec("forecasting", "charge", "mae", time_column="l_shipdate")
    return _metric_rows(spark, _trained(spark, d, task, "Ridge", {"alpha": 1.0})[1])


@query("cv_metrics")
def cv_metrics(spark, d):
    prepared = _prepared(spark, d, FLAG_TASK)
    _, found, note = T.cross_validate(prepared, prepared.features, STEPS, "LogisticRegression", {"max_iter": 20}, folds=3)
    if found is None:
        raise RuntimeError(note)
    return T.summarise_folds(found)


_RIDGE_FOLDS = f"""WITH t AS (SELECT o_orderkey, o_custkey::DOUBLE AS a, dayofyear(o_orderdate)::DOUBLE AS b, o_totalprice AS y FROM orders WHERE {_U} < 0.8),
r AS (SELECT *, row_number() OVER (ORDER BY {_UF}, o_orderkey) AS r, count(*) OVER () AS n FROM t),
f AS (SELECT a, b, y, len(list_filter(range(1, 3), lambda i: r > floor(n * i / 3.0)))::INT AS fold FROM r),
m AS (SELECT k.fold, count(*) AS n, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, avg(y) AS y0, avg(a) AS a0, avg(b) AS b0
  FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold),
p AS (SELECT *, aa + 1000.0 / n AS pa, bb + 1000.0 / n AS pb FROM m),
w AS (SELECT *, (ya * pb - yb * ab) / (pa * pb - ab * ab) AS wa, (yb * pa - ya * ab) / (pa * pb - ab * ab) AS wb FROM p),
e AS (SELECT fold, f.y, y0 + wa * (f.a - a0) + wb * (f.b - b0) AS g FROM f JOIN w USING (fold)),
s AS (SELECT fold, sqrt(avg((y - g) ** 2)) AS rmse, avg(abs(y - g)) AS mae, 1 - avg((y - g) ** 2) / var_pop(y) AS r2 FROM e GROUP BY fold)"""


@query("cv_ridge", f"""{_RIDGE_FOLDS} SELECT metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM (
 SELECT 'rmse' AS metric, rmse AS value FROM s UNION ALL SELECT 'mae', mae FROM s UNION ALL SELECT 'r2', r2 FROM s) GROUP BY metric""")
def cv_ridge(spark, d):
    prepared, _ = _plain_model(spark, d)
    _, found, note = T.cross_validate(prepared, prepared.features, [], "Ridge", {"alpha": 1000.0}, folds=3)
    if found is None:
        raise RuntimeError(note)
    return T.summarise_folds(found).select("metric", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"))


@query("tune_history")
def tune_history(spark, d):
    prepared = _prepared(spark, d, PRICE_TASK)
    _, history, note = T.tune(prepared, prepared.features, STEPS, "Ridge", {"alpha": 1.0}, trials=3)
    if note:
        raise RuntimeError(note)
    return spark.createDataFrame([(t.trial, t.score, t.best_score) for t in history], "trial int, score double, best_score double")


@query("feature_selection")
def feature_selection(spark, d):
    info = T.select_features(_prepared(spark, d, PRICE_TASK), STEPS)
    if info["note"]:
        raise RuntimeError(info["note"])
    return spark.createDataFrame([(f, True) for f in info["selected_features"]], "feature string, selected boolean")


@query("train_candidates")
def train_candidates(spark, d):
    prepared = _prepared(spark, d, FLAG_TASK)
    candidates = [
        CandidateModel("Logistic Regression", "LogisticRegression", {"max_iter": 20}),
        CandidateModel("Random Forest", "RandomForestClassifier", {"n_estimators": 5, "max_depth": 4, "random_state": 0}),
        CandidateModel("Unknown", "NoSuchEstimator", {}),
    ]
    results = T.train_all(prepared, candidates, STEPS, T.Options(cv_folds=None, resampling="random_undersample"))
    return T.results_table(spark, "r", results).select("position", "candidate_name", "status", F.to_json("metrics").alias("metrics"))


_RICH = "(c_acctbal > 8500)"


@query("train_pipeline", f"""
WITH c AS (SELECT {_RICH} AS rich, count(*) AS n, floor(count(*) * 0.8 + 0.5)::BIGINT AS fit FROM customer GROUP BY 1), s AS (SELECT sum(fit)::BIGINT AS fit, sum(n - fit)::BIGINT AS test FROM c)
SELECT name AS candidate_name, 'succeeded' AS status, fit AS train_rows, test AS test_rows, 'smote' AS resampling, 3 AS cv_folds, 3 AS trials,
  TRUE AS baseline_first, TRUE AS never_worse, TRUE AS ranked FROM s, (VALUES ('Logistic Regression'), ('Random Forest')) t(name)""")
def train_pipeline(spark, d):
    """The whole job: split, search, cross-validation, interpolated over-sampling, fit, evaluation, importance."""
    df = read(spark, d, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") / 1000 + F.col("c_custkey") % 7).alias("noisy"), F.expr(_RICH).alias("rich"))
    task = TaskSpec("classification", "rich", "f1")
    prepared = T.prepare(df, task, key="c_custkey")
    baseline = {"Logistic Regression": ("LogisticRegression", {"maxIter": 10}), "Random Forest": ("RandomForestClassifier", {"numTrees": 5, "maxDepth": 4, "seed": 0})}
    steps = [FeatureStep("encode", ("c_mktsegment",), {"method": "target"}), FeatureStep("scale", ("noisy",))]
    options = T.Options(cv_folds=3, resampling="smote", tuning_trials=3)
    results = T.train_all(prepared, [CandidateModel(n, e, p) for n, (e, p) in baseline.items()], steps, options)
    counts = prepared.data.groupBy("is_train").count().collect()
    train, test = (sum(r["count"] for r in counts if bool(r["is_train"]) is side) for side in (True, False))
    rows = [
        (r.candidate_name, r.status if r.status == "succeeded" else str(r.error), train, test, r.resampling_applied, r.cv_folds, len(r.trials),
         bool(r.trials) and r.trials[0].params == baseline[r.candidate_name][1], all(t.best_score >= r.trials[0].score for t in r.trials),
         abs(sum(v for _, v in r.feature_importance) - 1) < 0.01)
        for r in results]
    return spark.createDataFrame(rows, "candidate_name string, status string, train_rows long, test_rows long, resampling string, cv_folds int, "
                                       "trials int, baseline_first boolean, never_worse boolean, ranked boolean")


@query("feature_importance")
def feature_importance(spark, d):
    _, result = _trained(spark, d, FLAG_TASK, "RandomForestClassifier", {"n_estimators": 10, "max_depth": 5, "random_state": 0})
    return spark.createDataFrame(result.feature_importance, "feature string, importance double")


@query("score_batch")
def score_batch(spark, d):
    prepared, result = _trained(spark, d, BAND_TASK, "LogisticRegression", {"max_iter": 20})
    return result.model.score(prepared.test).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.map_values("probabilities")[0]).alias("mean_first"))


# A two-feature least-squares fit has a closed form in SQL, so its attributions can be checked.
PLAIN_TASK = TaskSpec("regression", "o_totalprice", "rmse")


@lru_cache(maxsize=4)
def _plain_model(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey"), F.dayofyear("o_orderdate").alias("day"), "o_totalprice")
    prepared = T.prepare(df, PLAIN_TASK, key="o_orderkey")
    model, _, _ = T.fit_model(prepared, prepared.train, prepared.features, [], "LinearRegression", {})
    return prepared, model


_OLS = f"""o AS (SELECT o_orderkey, o_custkey::DOUBLE AS a, dayofyear(o_orderdate)::DOUBLE AS b, o_totalprice AS y, {_U} < 0.8 AS is_train FROM orders),
m AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, avg(y) AS y0, avg(a) AS a0, avg(b) AS b0 FROM o WHERE is_train),
w AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb, y0, a0, b0 FROM m),
c AS (SELECT avg(a) AS ma, avg(b) AS mb FROM o)"""


@query("shap_linear", f"""
WITH {_OLS} SELECT 'o_custkey' AS feature, round(avg(abs(wa * (a - ma))), 3) AS mean_abs, 0.0::DOUBLE AS mean_signed FROM o, w, c
UNION ALL SELECT 'day', round(avg(abs(wb * (b - mb))), 3), 0.0 FROM o, w, c""")
def shap_linear(spark, d):
    prepared, model = _plain_model(spark, d)
    impact = X.global_impact(X.attributions(model, prepared.data, prepared.data, "o_orderkey"))
    return impact.select("feature", rounded("mean_abs", 3).alias("mean_abs"), F.abs(rounded("mean_signed", 3)).alias("mean_signed"))


@query("shap_rows", f"""
WITH {_OLS} SELECT o_orderkey AS key, CASE WHEN abs(wa * (a - ma)) >= abs(wb * (b - mb)) THEN 'o_custkey' ELSE 'day' END AS top,
 round(greatest(abs(wa * (a - ma)), abs(wb * (b - mb))), 1) AS size, round(y0 + wa * (ma - a0) + wb * (mb - b0), 3) AS base FROM o, w, c""")
def shap_rows(spark, d):
    prepared, model = _plain_model(spark, d)
    rows = X.row_impact(X.by_row(model, prepared.data, prepared.data, "o_orderkey"))
    first = F.col("contributions")[0]
    return rows.select("key", first["feature"].alias("top"), rounded(F.abs(first["phi"]), 1).alias("size"), rounded("base", 3).alias("base"))


@query("local_example", f"""
WITH {_OLS}, t AS (SELECT * FROM o WHERE NOT is_train), tr AS (SELECT avg(a) AS ma, avg(b) AS mb FROM o WHERE is_train),
x AS (SELECT * FROM t ORDER BY {unit_sql('o_orderkey', '7-')}, o_orderkey LIMIT 1)
SELECT o_orderkey AS key, y AS actual, round(y0 + wa * (a - a0) + wb * (b - b0), 3) AS prediction,
 CASE WHEN abs(wa * (a - ma)) >= abs(wb * (b - mb)) THEN 'o_custkey' ELSE 'day' END AS top, (SELECT count(*) FROM t) AS test_size FROM x, w, tr""")
def local_example(spark, d):
    prepared, model = _plain_model(spark, d)
    out = X.local_example(model, prepared, seed=7)
    return out.select("key", "actual", rounded("prediction", 3).alias("prediction"), F.col("contributions")[0]["feature"].alias("top"), "test_size")


def _forest_points(spark, d):
    prepared, result = _trained(spark, d, FLAG_TASK, "RandomForestClassifier", {"n_estimators": 10, "max_depth": 4, "random_state": 0})
    return result.model, X.explain_model(result.model, prepared)


@query("shap_tree_sums", "SELECT count(*) AS explained, count(*) AS adding_up, 'tree' AS method FROM lineitem")
def shap_tree_sums(spark, d):
    """Rows whose base and attributions add up to the probability that Spark's own forest gives them, among all rows."""
    prepared, result = _trained(spark, d, FLAG_TASK, "RandomForestClassifier", {"n_estimators": 10, "max_depth": 4, "random_state": 0})
    found = X.by_row(result.model, prepared.data, prepared.data, prepared.key)
    scored = result.model.score_codes(prepared.data).select(F.col(prepared.key).alias("key"), "score")
    total = F.aggregate("contributions", F.col("base"), lambda s, e: s + e["phi"])
    return found.join(scored, "key").agg(
        F.count(F.lit(1)).alias("explained"), F.count_if(F.abs(total - F.col("score")) < 1e-9).alias("adding_up"),
        F.lit(X.method_of(result.model)).alias("method"))


@query("shap_tree")
def shap_tree(spark, d):
    return _forest_points(spark, d)[1]["impact"]


@query("shap_points")
def shap_points(spark, d):
    return X.dependence_points(_forest_points(spark, d)[1]["points"])


@query("shap_fidelity")
def shap_fidelity(spark, d):
    prepared, result = _trained(spark, d, FLAG_TASK, "LogisticRegression", {"max_iter": 20})
    found = X.explain_model(result.model, prepared)
    return spark.createDataFrame([(found["method"], found["fidelity"])], "method string, fidelity double")
