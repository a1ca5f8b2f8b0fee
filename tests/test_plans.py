"""Steps, splits, balancing, preprocessing, training and explanation."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabprofile import session
from tabprofile.functions import sampling
from tabprofile.operators import metrics, resample, split, steps
from tabprofile.plans import eda, explain, models, preprocess, training
from tabprofile.plans.preprocess import fit_preprocessor
from tabprofile.plans.spec import CandidateModel, FeatureStep, TaskSpec, approve, complete_plan
from tabprofile.sources.loading import load_dataset


def frame(spark, **data):
    return spark.createDataFrame(pd.DataFrame(data))


# ---- plan -----------------------------------------------------------------------------------

def test_specs_reject_nonsense(spark):
    with pytest.raises(ValueError):
        TaskSpec("clustering", "y")
    with pytest.raises(ValueError):
        TaskSpec("regression", "y", time_column="y")
    with pytest.raises(ValueError):
        TaskSpec("regression", "absent").validate(spark.range(2))
    with pytest.raises(ValueError):
        TaskSpec("regression", "id").validate(spark.range(2), cv_folds=1)


def test_plan_completion_and_approval():
    mine = [FeatureStep("drop", ["a"])]
    found = [FeatureStep("impute", ["a"]), FeatureStep("impute", ["b"])]
    assert [s.columns for s in complete_plan(mine, found)] == [("a",), ("b",)]
    assert approve(found, [1]) == [found[1]]


def test_apply_plan_defers_fitted_steps(spark):
    df = frame(spark, num=[1.0, None, 3.0], cat=["x", "y", "x"], junk=[1, 2, 3], target=[1.0, 2.0, 3.0])
    plan = [FeatureStep("impute", ["num"], {"strategy": "mean"}), FeatureStep("drop", ["junk"]), FeatureStep("scale", ["num"]),
            FeatureStep("encode", ["cat"], {"method": "target"})]
    out = steps.apply_plan(df, plan, "target")
    assert out.valid and out.data.columns == ["num", "cat", "target"] and [s.op for s in out.deferred] == ["impute", "scale", "encode"]
    lost = steps.apply_plan(df, [FeatureStep("drop", ["target"])], "target")
    assert not lost.valid and "target" in lost.feedback
    bad = steps.apply_plan(df, [FeatureStep("bin", ["absent"])], "target")
    assert not bad.valid


def test_bins_match_edges(spark):
    values = np.round(np.random.default_rng(1).random(500), 2)
    out = steps.bin_equal_width(frame(spark, k=range(500), v=values), ["v"], 4).orderBy("k").toPandas()["v"]
    assert out.tolist() == pd.cut(pd.Series(values), bins=4, labels=False).tolist()
    assert steps.bin_equal_width(frame(spark, v=[2.0] * 3), ["v"]).first()["v"] == 2


def test_onehot_and_ordinal(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, c string")
    assert steps.encode_onehot(df, ["c"]).columns == ["k", "c_a", "c_b"]
    assert [tuple(r) for r in steps.encode_onehot(df, ["c"]).orderBy("k").collect()] == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]
    with pytest.raises(ValueError):
        steps.encode_onehot(df, ["c"], limit=1)
    for limit in (1, 100):
        assert [r["c"] for r in steps.encode_ordinal(df, ["c"], limit).orderBy("k").collect()] == [1.0, 0.0, 2.0]


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert sorted(r["c"] for r in steps.impute_most_frequent(df, ["c"]).collect()) == ["a", "a", "b"]
    empty = spark.createDataFrame([(None,)], "c string")
    assert steps.impute_most_frequent(empty, ["c"]).first()["c"] is None


def test_custom_step_is_checked(spark):
    assert steps.custom_transform(spark.range(500), lambda d: d.withColumn("x", F.col("id") * 2)).count() == 500
    with pytest.raises(ValueError):
        steps.custom_transform(spark.range(5), lambda d: 7)


def test_eda_finds_what_each_column_needs(spark):
    n = 300
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({
        "record_id": range(n), "visit_date": [f"2022-01-{1 + i % 28:02d}" for i in range(n)], "plan": rng.choice(list("abc"), n),
        "merchant": [f"m{i % 60}" for i in range(n)], "amount": np.where(rng.random(n) < 0.1, np.nan, rng.exponential(size=n)),
        "churned": (rng.random(n) < 0.05).astype(int)}))
    report = eda.run_eda(df, TaskSpec("classification", "churned"))
    found = [(s.op, s.columns, s.params.get("strategy") or s.params.get("method")) for s in report.steps]
    assert found == [("drop", ("record_id",), None), ("datetime_decompose", ("visit_date",), None), ("encode", ("plan",), "onehot"),
                     ("encode", ("merchant",), "target"), ("impute", ("amount",), "median"), ("scale", ("amount",), "robust")]
    assert report.resampling["method"] == "smote"
    assert "class_imbalance" in {r["id"] for r in report.insights.collect()}


# ---- splits and balance ---------------------------------------------------------------------

def test_splits_partition_the_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.timestamp_seconds("id").alias("t"))
    s = split.split(df, "y", "classification", "id")
    assert {(r["y"], r["is_train"]): r["count"] for r in s.groupBy("y", "is_train").count().collect()} == {
        (0, True): 720, (0, False): 180, (1, True): 80, (1, False): 20}
    t = split.split(df, "y", "classification", "id", "t")
    assert t.where("is_train").agg(F.max("id")).first()[0] == 799
    lone = df.withColumn("y", F.when(F.col("id") == 0, 9).otherwise(F.col("y")))
    assert 700 < split.split(lone, "y", "classification", "id").where("is_train").count() < 900


def test_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 3).alias("y"), F.timestamp_seconds("id").alias("t"))
    sizes = [r["count"] for r in split.stratified_folds(df, "y", "id", 5).groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 103
    timed = split.time_folds(df, "t", "id", 4)
    assert {r["fold"]: r["count"] for r in timed.groupBy("fold").count().collect()} == {0: 23, 1: 20, 2: 20, 3: 20, 4: 20}
    assert split.fold_count(df.limit(1), 5) == 0 and split.fold_count(df, 5, "y") == 5


def test_over_and_under_sampling_equalise(spark):
    df = spark.range(110).select("id", (F.col("id") < 17).cast("int").alias("y"))
    sizes = lambda d: {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}
    assert sizes(resample.random_oversample(df, "y", "id")) == {0: 93, 1: 93}
    assert sizes(resample.random_undersample(df, "y", "id")) == {0: 17, 1: 17}


def test_smote_stays_between_rows_of_the_class(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"id": range(120), "y": [0] * 80 + [1] * 30 + [2] * 10, "a": rng.normal(size=120), "b": rng.normal(size=120)})
    data.loc[data.y == 1, ["a", "b"]] += 100
    out = resample.smote(spark.createDataFrame(data), "y", "id", ["a", "b"]).toPandas()
    assert out.groupby("y").size().tolist() == [80, 80, 80]
    made = out[out.is_synthetic & (out.y == 1)]
    real = data[data.y == 1]
    assert len(made) == 50 and made["a"].between(real["a"].min(), real["a"].max()).all()


def test_smote_of_a_single_row_falls_back(spark):
    df = spark.createDataFrame([(i, 1.0 if i == 0 else 0.0, [float(i)]) for i in range(20)], "id int, y double, x array<double>")
    out, applied, note = resample.resample(df, "y", "id", "smote", "x")
    assert applied == "random_oversample" and note and out.count() == 38


# ---- preprocessing --------------------------------------------------------------------------

def test_test_rows_get_training_statistics(spark):
    train = frame(spark, id=range(4), a=[1.0, 2.0, 3.0, None], label=[0.0, 1.0, 0.0, 1.0])
    test = frame(spark, id=[9, 10], a=[None, 100.0])
    prep = fit_preprocessor(train, ["a"], "label", "id", [FeatureStep("impute", ["a"], {"strategy": "mean"})])
    assert [r["f"][0] for r in prep.transform(test, "f").orderBy("id").collect()] == [2.0, 100.0]


def test_scaling_matches_population_statistics(spark):
    a = np.array([1.0, 2.0, 4.0, 9.0])
    train = frame(spark, id=range(4), a=a, b=a, c=a, flat=[3.0] * 4, label=[0.0, 1.0, 0.0, 1.0])
    prep = fit_preprocessor(train, ["a", "b", "c", "flat"], "label", "id", [
        FeatureStep("scale", ["a", "flat"], {"method": "standard"}), FeatureStep("scale", ["b"], {"method": "minmax"}),
        FeatureStep("scale", ["c"], {"method": "robust"})])
    got = np.array([r["f"] for r in prep.transform(train, "f", as_array=True).orderBy("id").collect()])
    assert np.allclose(got[:, 0], (a - a.mean()) / a.std()) and np.allclose(got[:, 1], (a - 1) / 8)
    assert np.allclose(got[:, 2], (a - np.median(a)) / (np.quantile(a, 0.75) - np.quantile(a, 0.25))) and np.allclose(got[:, 3], 0)


def test_encoding_never_sees_the_own_label(spark):
    n = 400
    data = pd.DataFrame({"id": range(n), "c": [f"v{i}" for i in range(n)], "label": np.random.default_rng(0).integers(0, 2, n).astype(float)})
    df = spark.createDataFrame(data)
    prep = fit_preprocessor(df, ["c"], "label", "id")
    seen = prep.transform_training(df, "id", "x", as_array=True).select("id", F.col("x")[0].alias("e")).toPandas().sort_values("id")
    # every category occurs once, so its out-of-fold value can only be the other folds' mean
    assert seen["e"].nunique() <= 5 and abs(np.corrcoef(seen["e"], data["label"])[0, 1]) < 0.2
    unseen = prep.transform(frame(spark, id=[1], c=["new"]), "x", as_array=True).first()["x"][0]
    assert unseen == pytest.approx(data["label"].mean())


def test_nothing_to_train_on_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.0, [1])], "id int, label double, l array<int>")
    with pytest.raises(ValueError):
        fit_preprocessor(df, ["l"], "label", "id")


# ---- metrics and models ---------------------------------------------------------------------

def test_metrics_of_known_predictions(spark):
    df = frame(spark, label=[0.0, 0.0, 1.0, 1.0], prediction=[0.0, 1.0, 1.0, 1.0], score=[0.1, 0.6, 0.6, 0.9])
    found = metrics.evaluate(df, "classification", True)
    assert found["accuracy"] == 0.75 and found["f1"] == pytest.approx(0.5 * 2 / 3 + 0.5 * 0.8) and found["roc_auc"] == pytest.approx(0.875)
    assert metrics.regression_metrics(frame(spark, label=[2.0, 2.0], prediction=[1.0, 3.0])).first()["r2"] is None


def test_estimator_factory():
    given = {"n_estimators": 7, "bad name": 1, "unheard_of": 2, "max_features": "sqrt", "maxDepth": 99, "min_samples_leaf": "x"}
    forest = models.build_estimator("RandomForestClassifier", given, 100)
    assert forest.getNumTrees() == 7 and forest.getFeatureSubsetStrategy() == "sqrt" and forest.getMaxDepth() == 30
    _, note = models.resolve_parameters("RandomForestClassifier", given)
    assert note.endswith("bad name, min_samples_leaf, unheard_of")
    assert models.resolve_parameters("Ridge", {"alpha": 2.0, "fit_intercept": False}) == ({"alpha": 2.0, "fitIntercept": False}, None)
    assert models.build_estimator("Ridge", {"alpha": 5.0}, 50, label_deviation=2.0).getRegParam() == pytest.approx(0.2)
    assert type(models.build_estimator("GradientBoostingClassifier", {}, 10, 3)).__name__ == "OneVsRest"
    with pytest.raises(ValueError):
        models.build_estimator("Nothing", {}, 1)
    for name, space in models.SEARCH_SPACES.items():
        if name not in models.OPTIONAL:
            found, note = models.resolve_parameters(name, models.suggest(name, 1))
            assert len(found) == len(space) > 0 and note is None
    names = [c.estimator for c in models.fill_candidates([CandidateModel("x", "Ridge")], TaskSpec("regression", "y"))]
    assert names[0] == "Ridge" and names.count("Ridge") == 1 and "RandomForestRegressor" in names
    assert models.suggest("Ridge", 3) == models.suggest("Ridge", 3)


@pytest.fixture(scope="module")
def churn(spark):
    rng = np.random.default_rng(1)
    n = 300
    data = pd.DataFrame({"id": range(n), "tenure": rng.normal(size=n), "spend": rng.normal(size=n), "tickets": rng.integers(0, 5, n), "region": rng.choice(list("ab"), n)})
    data["churned"] = np.where(data.tenure + 0.5 * data.tickets + rng.normal(size=n) * 0.3 > 1, "yes", "no")
    return training.prepare(spark.createDataFrame(data), TaskSpec("classification", "churned", "roc_auc"), key="id")


def test_candidates_succeed_or_report_why(spark, churn, tmp_path):
    plan = [FeatureStep("scale", ["tenure", "spend"]), FeatureStep("encode", ["region"], {"method": "target"})]
    results = training.train_all(churn, [
        CandidateModel("lr", "LogisticRegression"), CandidateModel("none", "Nothing")], plan,
        training.Options(cv_folds=3, tuning_trials=2, resampling="smote"))
    good, bad = results
    assert good.status == "succeeded" and good.metrics["roc_auc"] > 0.8 and good.cv_folds == 3 and good.resampling_applied == "smote"
    assert good.trials[0].trial == 0 and good.trials[-1].best_score >= good.trials[0].score
    assert bad.status == "failed" and "Nothing" in bad.error
    assert good.feature_importance[0][0] in ("tenure", "tickets") and sum(v for _, v in good.feature_importance) <= 1.001
    assert training.results_table(spark, "r1", results).count() == 2 and training.trials_table(spark, "r1", results).count() == 2

    good.model.save(str(tmp_path / "m"), churn.data)
    loaded = training.FittedModel.load(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(1, 3.0, None, 4, "zz"), (2, -3.0, 0.0, 0, "a")], "id int, tenure double, spend double, tickets int, region string")
    scored = {r["id"]: r for r in loaded.score(new).collect()}
    assert scored[1]["prediction"] == "yes" and scored[2]["prediction"] == "no" and scored[1]["probabilities"]["yes"] > 0.9
    assert training.load_input_schema(spark, str(tmp_path / "m")) == {"tenure": "numeric", "spend": "numeric", "tickets": "numeric", "region": "text"}


def test_changing_test_rows_leaves_the_model_alone(spark, churn):
    fit = lambda rows: training.fit_model(churn, rows, ["tenure", "spend"], [FeatureStep("scale", ["tenure"])], "LogisticRegression", {})[0]
    moved = churn.data.withColumn("tenure", F.when(F.col("is_train"), F.col("tenure")).otherwise(99.0))
    assert fit(churn.train).preprocessor.export() == fit(moved.where("is_train")).preprocessor.export()


def test_selection_skips_few_features(churn):
    assert not training.select_features(churn, [])["enabled"]


def test_selection_keeps_informative_features(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({f"x{i}": rng.normal(size=120) for i in range(6)})
    data["y"] = 3 * data.x0 - 2 * data.x1
    data["k"] = range(120)
    prepared = training.prepare(spark.createDataFrame(data), TaskSpec("regression", "y"), key="k")
    info = training.select_features(prepared, [])
    assert info["enabled"] and info["basic_model"] == "Ridge" and {"x0", "x1"} <= set(info["selected_features"])


def _numbers(spark, n=400, time=False):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, 6)) * [1, 100, 0.01, 1, 5, 1] + [0, 1e6, 3, -2, 0, 7]
    y = 3 * x[:, 0] + 0.05 * x[:, 1] - 200 * x[:, 2] + rng.normal(size=n)
    data = pd.DataFrame({"id": np.arange(n), "y": y, **{f"x{i}": x[:, i] for i in range(6)}, "flat": 4.0})
    data.loc[::7, "x0"] = None
    data.loc[::11, "x3"] = None
    if time:
        data["at"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10_000, n), unit="h")
    return spark.createDataFrame(data)


def _fold_by_fold(data, features, penalty, time):
    """Each fold prepared and solved on its own: x0 filled by its mean, all but x2 and x5 scaled."""
    out = {}
    folds = sorted(set(data["fold"]))[1 if time else 0:]
    for i, f in enumerate(folds):
        train, test = data[data["fold"] < f if time else data["fold"] != f], data[data["fold"] == f]

        def ready(rows):
            x = np.zeros((len(rows), len(features)))
            for k, c in enumerate(features):
                v = rows[c].to_numpy(float)
                base = train[c].to_numpy(float)
                if c == "x0":
                    v, base = (np.where(np.isnan(u), np.nanmean(base), u) for u in (v, base))
                if c not in ("x2", "x5"):
                    v = (v - np.nanmean(base)) / (np.nanstd(base) or 1.0)
                x[:, k] = np.where(np.isnan(v), 0.0, v)
            return x

        x, y = ready(train), train["label"].to_numpy()
        xc = x - x.mean(0)
        w = np.linalg.lstsq(np.r_[xc, np.sqrt(penalty) * np.eye(len(features))], np.r_[y - y.mean(), np.zeros(len(features))], rcond=None)[0]
        error = test["label"].to_numpy() - (y.mean() + (ready(test) - x.mean(0)) @ w)
        out |= {(i, "rmse"): np.sqrt((error ** 2).mean()), (i, "mae"): np.abs(error).mean(), (i, "r2"): 1 - (error ** 2).mean() / test["label"].var(ddof=0)}
    return out


@pytest.mark.parametrize("time", [False, True])
@pytest.mark.parametrize("estimator, params", [("Ridge", {"alpha": 50.0}), ("Ridge", {}), ("LinearRegression", {})])
def test_folds_from_sums_equal_separate_fits(spark, monkeypatch, estimator, params, time):
    task = TaskSpec("regression", "y", "rmse", time_column="at" if time else None)
    prepared = training.prepare(_numbers(spark, time=time), task, key="id")
    steps = [FeatureStep("impute", ("x0",), {"strategy": "mean"}), FeatureStep("scale", ("x0", "x1", "x3", "x4", "flat"), {"method": "standard"})]
    features = [f for f in prepared.features if f.startswith("x")] + (["flat"] if estimator == "Ridge" else [])
    rounds = training._rounds(prepared, 3)
    used, found, note = training.cross_validate(prepared, features, steps, estimator, params, rounds=rounds)
    assert used == 3 and note is None
    monkeypatch.setattr(training, "closed_form", lambda *a: None)
    _, plain, _ = training.cross_validate(prepared, features, steps, estimator, params, rounds=rounds)
    got, near = ({(r.fold, r.metric): r.value for r in f.collect()} for f in (found, plain))
    want = _fold_by_fold(rounds[0].toPandas(), features, params.get("alpha", 1.0) if estimator == "Ridge" else 0.0, time)
    assert got.keys() == want.keys() == near.keys() and len(got) == 9
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-8) and got[k] == pytest.approx(near[k], rel=1e-3)  # Spark iterates


def test_elimination_from_sums_equals_separate_fits(spark, monkeypatch):
    prepared = training.prepare(_numbers(spark), TaskSpec("regression", "y", "rmse"), key="id")
    steps = [FeatureStep("scale", tuple(f"x{i}" for i in range(6)), {"method": "standard"})]
    read = []
    monkeypatch.setattr(training, "fold_sums", lambda *a, f=training.fold_sums: read.append(1) or f(*a))
    quick = training.select_features(prepared, steps)
    monkeypatch.setattr(training, "closed_form", lambda *a: None)
    plain = training.select_features(prepared, steps)
    assert quick["note"] is None and len(read) == 1 and quick["selected_features"] == plain["selected_features"]
    assert [k for k, _ in quick["history"]] == [k for k, _ in plain["history"]]
    assert [s for _, s in quick["history"]] == pytest.approx([s for _, s in plain["history"]], rel=1e-4)


def test_plans_beyond_sums_are_fitted_fold_by_fold(spark):
    df = _numbers(spark)
    median = [FeatureStep("impute", ("x0",), {"strategy": "median"})]
    assert training.closed_form(df, ["x0", "x1"], median, "Ridge", {}) is None
    assert training.closed_form(df, ["x0"], [], "Ridge", {"tol": 1}) is None and training.closed_form(df, ["x0"], [], "LogisticRegression", {}) is None
    assert training.closed_form(df, ["x0"], [], "Ridge", {"alpha": 2}) == 2.0
    empty = training.prepare(df.withColumn("x5", F.lit(None).cast("double")), TaskSpec("regression", "y", "rmse"), key="id")
    used, found, note = training.cross_validate(empty, ["x0", "x1", "x5"], [FeatureStep("impute", ("x5",), {"strategy": "mean"})], "Ridge", {}, folds=3)
    assert used == 3 and note is None and found.count() == 9


def test_frame_without_a_key_gets_a_stored_one(spark):
    data = pd.DataFrame({"x": np.arange(40.0), "y": np.arange(40.0) * 2})
    prepared = training.prepare(spark.createDataFrame(data), TaskSpec("regression", "y"))
    assert prepared.features == ["x"] and prepared.data.select(prepared.key).distinct().count() == 40


# ---- explanation ----------------------------------------------------------------------------

def test_linear_attributions_add_up(churn):
    model = training.fit_model(churn, churn.train, ["tenure", "spend", "tickets"], [], "LogisticRegression", {})[0]
    long = explain.attributions(model, churn.test, churn.train, "id")
    sums = long.groupBy("key").agg((F.first("base") + F.sum("phi") - F.first("output")).alias("gap"))
    assert sums.agg(F.max(F.abs("gap"))).first()[0] < 1e-9
    assert explain.global_impact(long).first()["feature"] in ("tenure", "tickets")
    assert explain.fidelity(long, model) == pytest.approx(1.0)


def test_sampled_attributions_add_up(churn):
    model = training.fit_model(churn, churn.train, ["tenure", "spend", "tickets"], [], "RandomForestClassifier", {"n_estimators": 5, "random_state": 0})[0]
    found = explain.explain_model(model, churn, rows=20)
    assert found["method"] == "tree" and found["fidelity"] == pytest.approx(1.0)
    assert explain.row_impact(found["points"]).count() == 20
    assert explain.dependence_points(found["points"], 2).select("feature").distinct().count() == 2
    example = explain.local_example(model, churn, seed=3).first()
    assert example["test_size"] == churn.test.count() and len(example["contributions"]) == 3


def test_a_stream_is_scored_as_it_is(spark, churn, tmp_path):
    plan = [FeatureStep("encode", ["region"], {"method": "target"})]
    model = training.fit_model(churn, churn.train, ["tenure", "region"], plan, "LogisticRegression", {})[0]
    churn.test.select("id", "tenure", "region").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, tenure double, region string").parquet(str(tmp_path / "in"))
    query = model.score(stream).select("id", "prediction").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    batch = model.score(churn.test).select("id", "prediction")
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == churn.test.count()


# ---- penalties ------------------------------------------------------------------------------

def two_features(spark, rows=200):
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(0, 10, rows), rng.normal(0, 0.3, rows)], axis=1)
    return x, rng


def fitted(spark, name, params, x, y):
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    return models.build_estimator(name, params, len(y), label_deviation=float(np.std(y))).fit(rows)


def test_ridge_equals_closed_form(spark):
    x, rng = two_features(spark)
    y = 3 * x[:, 0] - 40 * x[:, 1] + rng.normal(0, 5, len(x)) + 7
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + 100 * np.eye(2), centred.T @ (y - y.mean()))
    assert np.allclose(fitted(spark, "Ridge", {"alpha": 100.0}, x, y).coefficients.toArray(), want, rtol=1e-3)


@pytest.mark.parametrize("c", [0.05, 1.0])
def test_logistic_equals_newton(spark, c):
    x, rng = two_features(spark)
    y = (rng.uniform(size=len(x)) < 1 / (1 + np.exp(-(0.2 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        penalty = np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + penalty, c * z.T @ (p - y) + penalty @ w)
    got = fitted(spark, "LogisticRegression", {"C": c, "max_iter": 500, "tol": 1e-10}, x, y)
    assert np.allclose(got.coefficients.toArray(), w[:2], atol=1e-3)


# ---- loading --------------------------------------------------------------------------------

def test_json_by_line_array_and_one_object(spark, tmp_path):
    for name, text in (("l", '\n{"a": 1}\n{"a": 2}\n{"a": 3}\n'), ("r", '[{"a": 1},\n {"a": 2},\n {"a": 3}]'), ("o", '{\n"a": 1\n}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert [load_dataset(spark, str(tmp_path / f"{n}.json")).count() for n in "lro"] == [3, 3, 1]


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('t,n\n"He said ""hi"", then left",1\n"two\nlines",2\n')
    assert [tuple(r) for r in load_dataset(spark, str(tmp_path / "q.csv")).orderBy("n").collect()] == [('He said "hi", then left', 1), ("two\nlines", 2)]


def test_csv_windows_text(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("naïve €,n\n“quoted” €5 –,1\n".encode("windows-1252"))
    df = load_dataset(spark, str(tmp_path / "w.csv"))
    assert df.columns == ["naïve €", "n"] and df.first()[0] == "“quoted” €5 –"


def test_content_key_does_not_depend_on_layout(spark):
    rows = [(i % 40, None if i % 7 == 0 else float(i % 9), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    first, second = (sorted(tuple(r) for r in training.content_key(d, "k").select("k", "a").collect()) for d in (df.repartition(3), df.orderBy("b").repartition(7)))
    assert first == second and len({k for k, _ in first}) == 300


def test_rows_without_a_key_are_stored_and_hashed_once(spark, monkeypatch):
    """A regression's rows are keyed, split and hashed for their folds in one pass; the folds are those of a hash taken anew, and scores are not stored."""
    stored, real = [], training.materialise
    monkeypatch.setattr(training, "materialise", lambda d: stored.append(d) or real(d))
    prepared = training.prepare(frame(spark, x=[float(i % 90) for i in range(300)], y=[float(i % 7) for i in range(300)]), TaskSpec("regression", "y", "rmse"))
    assert len(stored) == 1 and prepared.features == ["x"]
    hashed, unit = [], sampling.unit_hash
    monkeypatch.setattr(sampling, "unit_hash", lambda *a: hashed.append(a) or unit(*a))
    placed, tests = training._rounds(prepared, 3)
    assert not hashed and len(tests) == 3 and placed.columns == [c for c in prepared.data.columns if c != training.FOLD_UNIT] + ["fold"]
    want = training.S.plain_folds(prepared.train, prepared.key, 3)
    assert sorted(placed.select(prepared.key, "fold").collect()) == sorted(want.select(prepared.key, "fold").collect())
    model = training.fit_model(prepared, prepared.train, ["x"], [], "Ridge", {})[0]
    before = len(stored)
    assert set(training.evaluate_model(model, prepared.test, prepared.task)) == {"rmse", "mae", "r2"} and len(stored) == before


def test_rows_of_a_fold_are_prepared_once_for_all_trials(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = frame(spark, id=range(300), a=rng.normal(size=300), c=rng.choice(list("xyz"), 300))
    df = df.withColumn("y", F.col("a") * 2 + F.length("c"))
    prepared = training.prepare(df, TaskSpec("regression", "y", "rmse"), key="id")
    plan = [FeatureStep("encode", ["c"], {"method": "target"})]
    made, real = [], training.fit_preprocessor
    monkeypatch.setattr(training, "fit_preprocessor", lambda *a: made.append(1) or real(*a))
    _, history, note = training.tune(prepared, prepared.features, plan, "Ridge", {"alpha": 1.0}, trials=3)
    assert note is None and len(history) == 3 and len(made) == training.TUNING_FOLDS
    for trial in history:  # the same scores as with rows of its own
        _, found, _ = training.cross_validate(prepared, prepared.features, plan, "Ridge", trial.params, folds=3)
        assert found.where("metric = 'rmse'").agg(F.avg("value")).first()[0] == pytest.approx(trial.score, rel=1e-9)


def test_candidates_share_their_training_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = frame(spark, id=range(200), a=rng.normal(size=200), b=rng.normal(size=200)).withColumn("y", (F.col("a") + F.col("b") > 0.5).cast("int"))
    prepared = training.prepare(df, TaskSpec("classification", "y", "f1"), key="id")
    made, real = [], training.fit_preprocessor
    monkeypatch.setattr(training, "fit_preprocessor", lambda *a: made.append(1) or real(*a))
    found = training.train_all(prepared, [CandidateModel("l", "LogisticRegression", {}), CandidateModel("r", "RandomForestClassifier", {"n_estimators": 3})],
                               [], training.Options(cv_folds=None, resampling="smote"))
    assert [r.status for r in found] == ["succeeded"] * 2 and len(made) == 1 and {r.resampling_applied for r in found} == {"smote"}


def test_learners_get_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(training, "VALUES_PER_TASK", 30)
    df = frame(spark, id=range(400), a=[float(i) for i in range(400)], b=1.5).withColumn("y", F.col("a") * 2)
    prepared = training.prepare(df, TaskSpec("regression", "y", "rmse"), key="id")
    sizes, real = [], training.build_estimator

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, rows):
            sizes.extend(r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect())
            return self.inner.fit(rows)

    monkeypatch.setattr(training, "build_estimator", lambda *a, **k: Spy(real(*a, **k)))
    training.fit_model(prepared, prepared.train, ["a", "b"], [], "Ridge", {})
    assert len(sizes) > 20 and max(sizes) <= 30


def test_classes_share_the_passes_of_an_encoding(spark, monkeypatch):
    """The sums of all classes come from one grouping, and a row's fold is computed once; figures are those of classes on their own."""
    df = frame(spark, id=range(300), c=[None if i % 11 == 0 else "abcdef"[i * i % 6] for i in range(300)], label=[float(i % 7 % 3) for i in range(300)])
    alone = [preprocess.fit_encoding(df, "c", (F.col("label") == k).cast("double"), preprocess.encoding_fold("id"), k) for k in (0.0, 1.0, 2.0)]
    stored, real = [], preprocess.materialise
    monkeypatch.setattr(preprocess, "materialise", lambda d: stored.append(d) or real(d))
    prep = fit_preprocessor(df, ["c"], "label", "id", classes=[0.0, 1.0, 2.0])
    assert len(stored) == 1
    for a, b in zip(alone, prep.encodings, strict=True):
        assert (a.label, a.prior, a.fold_priors) == (b.label, b.prior, b.fold_priors)
        assert sorted(a.table.collect()) == sorted(b.table.collect()) and sorted(a.folds.collect()) == sorted(b.folds.collect())
    hashed, fold = [], preprocess.encoding_fold
    monkeypatch.setattr(preprocess, "encoding_fold", lambda key: hashed.append(key) or fold(key))
    seen = prep.transform_training(df, "id", "x", as_array=True)
    assert hashed == ["id"] and seen.columns == [*df.columns, "x"]
    folds = [{(r.v, r.f): r.e for r in e.folds.collect()} for e in prep.encodings]
    for r in seen.withColumn("f", fold("id")).collect():
        assert r.x == [t.get((r.c, r.f), e.fold_priors[r.f]) for t, e in zip(folds, prep.encodings)]


def test_folds_that_a_search_has_fitted_are_not_fitted_again(spark, monkeypatch):
    rows = [(i, float(i % 7), float(i * 3 % 11), float(i % 7 + i * 3 % 11 + i % 2)) for i in range(90)]
    prepared = training.prepare(spark.createDataFrame(rows, "id long, a double, b double, y double"), TaskSpec("regression", "y", "rmse"), key="id")
    fits, fit = [], training.fit_model
    monkeypatch.setattr(training, "fit_model", lambda *a, **k: fits.append(1) or fit(*a, **k))
    result = training.train_candidate(
        prepared, CandidateModel("linear", "LinearRegression", {"regParam": 0.1}), [], training.Options(cv_folds=3, tuning_trials=2))
    assert result.status == "succeeded" and result.cv_folds == 3 and len(result.trials) == 2
    assert len(fits) == 2 * 3 + 1  # each trial in each fold, and the model itself
    assert result.cv_metrics["rmse"][0] == pytest.approx(result.trials[-1].best_score)
    forests = [models.build_estimator("RandomForestRegressor", {"max_depth": d, "random_state": 0}, 90) for d in (4, 12)]
    assert [f.getCacheNodeIds() for f in forests] == [False, True]


def test_content_keys_are_stored_short_and_their_shuffle_goes(spark, monkeypatch):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    df = spark.createDataFrame([(float(i % 40), "xyz"[i % 3], float(i % 5)) for i in range(300)], "a double, s string, y double")
    before = shuffled()
    with session.shuffles_dropped(spark):
        session.materialise(df.repartition(3, "a"))
    until = time.monotonic() + 5
    while (left := shuffled() - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    asked, real = [], training.materialise
    monkeypatch.setattr(training, "materialise", lambda df: asked.append(spark.conf.get(session._CLEANUP)) or real(df))
    prepared = training.prepare(df, TaskSpec("regression", "y", "rmse"))
    assert asked == ["true"] and spark.conf.get(session._CLEANUP, "false") == "false"
    assert spark.read.parquet(*prepared.data.inputFiles()).schema["_row"].dataType.typeName() == "struct"
    content = F.md5(F.to_json(F.struct("a", "s", "y")))
    counts = {r[0]: r[1] for r in df.groupBy(content).count().collect()}
    wanted = {f"{h}-{k}" for h, n in counts.items() for k in range(1, n + 1)}
    found = [r[0] for r in prepared.data.select("_row").collect()]
    assert len(found) == 300 and set(found) == wanted
    placed, _ = training._rounds(prepared, 3)
    assert {r[0] for r in placed.select("_row").collect()} == {r[0] for r in prepared.train.select("_row").collect()}
