"""Shapley values of trees against sums over all sets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabprofile.plans import trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).round(2)
    y = x[:, 0] * 2 + np.where(x[:, 1] > 0, x[:, 2], -x[:, 3]) + (x[:, 4] > 0.5)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), float(y[i] > 0.3), float(np.digitize(y[i], [-1, 1]))) for i in range(400)]
    return spark.createDataFrame(rows, "key bigint, x array<double>, y double, two double, three double").withColumn("features", array_to_vector("x")).cache()


def expectation(nodes, at, x, known, outputs):
    """The tree's value when only the ``known`` features of ``x`` are."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return np.atleast_1d(outputs(node)).astype(float)
    sides = [nodes[node["leftChild"]], nodes[node["rightChild"]]]
    f, t = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    if f in known:
        return expectation(nodes, node["leftChild"] if x[f] <= t else node["rightChild"], x, known, outputs)
    return sum(s["rawCount"] / node["rawCount"] * expectation(nodes, s["id"], x, known, outputs) for s in sides)


def brute(trees_, weights, outputs, x):
    d = len(x)
    value = {s: sum(w * expectation(t, 0, x, s, outputs) for t, w in zip(trees_, weights)) for k in range(d + 1) for s in combinations(range(d), k)}
    phi = []
    for f in range(d):
        others = [g for g in range(d) if g != f]
        phi.append(sum(
            factorial(k) * factorial(d - k - 1) / factorial(d) * (value[tuple(sorted((*s, f)))] - value[s])
            for k in range(d) for s in combinations(others, k)))
    return np.array(phi).T, value[()]


CASES = {
    "forest of two": (lambda: C.RandomForestClassifier(numTrees=6, maxDepth=5, seed=1), "two", lambda n: (np.array(n["impurityStats"]) / sum(n["impurityStats"]))[1:]),
    "forest of three": (lambda: C.RandomForestClassifier(numTrees=4, maxDepth=4, seed=1), "three", lambda n: np.array(n["impurityStats"]) / sum(n["impurityStats"])),
    "forest of numbers": (lambda: R.RandomForestRegressor(numTrees=5, maxDepth=6, seed=2), "y", lambda n: n["prediction"]),
    "boosted numbers": (lambda: R.GBTRegressor(maxIter=6, maxDepth=4, seed=3), "y", lambda n: n["prediction"]),
    "boosted two": (lambda: C.GBTClassifier(maxIter=5, maxDepth=3, seed=3), "two", lambda n: 2 * n["prediction"]),
    "one tree": (lambda: R.DecisionTreeRegressor(maxDepth=5), "y", lambda n: n["prediction"]),
}


@pytest.mark.parametrize("tabulated", [trees.TABULATED, 2])
@pytest.mark.parametrize("name", CASES)
def test_equals_sums_over_all_sets(spark, data, monkeypatch, name, tabulated):
    monkeypatch.setattr(trees, "TABULATED", tabulated)
    estimator, label, outputs = CASES[name]
    model = estimator().setLabelCol(label).fit(data)
    stored = trees._stored_trees(spark, model)
    weights = model.treeWeights if name.startswith("boosted") else [1 / len(stored)] * len(stored)
    found, base = trees.tree_attributions(model, data.where("key < 12"))
    for row in found.collect():
        phi, value = brute(stored, weights, outputs, row.x)
        assert row.phi == pytest.approx(phi[0] if len(phi) == 1 else np.abs(phi).mean(axis=0), abs=1e-9)
        assert base == pytest.approx(value.mean(), abs=1e-9)


@pytest.mark.parametrize("name", [n for n in CASES if "three" not in n])
def test_adds_up_to_the_model(spark, data, name):
    estimator, label, _ = CASES[name]
    model = estimator().setLabelCol(label).fit(data)
    found, base = trees.tree_attributions(model, data.select("key", "x"))
    scored = model.transform(data)
    if name == "boosted two":
        p = vector_to_array("probability")[1]
        scored = scored.select("key", F.log(p / (1 - p)).alias("model"))
    else:
        scored = scored.select("key", (vector_to_array("probability")[1] if "forest of two" == name else F.col("prediction")).alias("model"))
    gap = found.join(scored, "key").select(F.max(F.greatest(
        F.abs(F.aggregate("phi", F.lit(base), lambda s, p: s + p) - F.col("model")), F.abs(F.col("output") - F.col("model"))))).first()[0]
    assert gap < 1e-9


def test_one_against_the_rest(spark, data):
    rest = C.OneVsRest(classifier=C.GBTClassifier(maxIter=2, maxDepth=2, seed=3), labelCol="three").fit(data)
    found, base = trees.tree_attributions(rest, data.where("key < 5"))
    parts = [trees.tree_attributions(m, data.where("key < 5")) for m in rest.models]
    want = np.abs([[r.phi for r in p.orderBy("key").collect()] for p, _ in parts]).mean(axis=0)
    assert np.allclose([r.phi for r in found.orderBy("key").collect()], want) and base == pytest.approx(np.mean([b for _, b in parts]))
    assert found.where("output IS NOT NULL").count() == 0


def test_long_paths_and_single_leaves(spark):
    rng = np.random.default_rng(5)
    share = rng.uniform(0.1, 1, 14)
    met = rng.integers(0, 2, (3, 14)).astype(float)
    for row in met:  # the sum of Shapley values is the product when all is known less that when nothing is
        assert trees._shapley(row[None], share).sum() == pytest.approx(row.prod() - share.prod(), abs=1e-12)
    ensemble = trees.Ensemble([trees.Leaf(*(np.zeros(0) for _ in range(4)), np.array([3.5]))], 2)
    phi, total = ensemble.explain(np.zeros((4, 2)))
    assert not phi.any() and (total == 3.5).all() and ensemble.base == 3.5
