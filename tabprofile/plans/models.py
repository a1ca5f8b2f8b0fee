"""Candidate estimators, their parameters and search spaces in Spark ML terms."""

from __future__ import annotations

import importlib.util
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.base import Estimator

from tabprofile.plans.spec import CandidateModel, TaskSpec

CLASSIFIERS = {
    "LogisticRegression": C.LogisticRegression,
    "RandomForestClassifier": C.RandomForestClassifier,
    "GradientBoostingClassifier": C.GBTClassifier,
}
REGRESSORS = {
    "LinearRegression": R.LinearRegression,
    "Ridge": R.LinearRegression,
    "RandomForestRegressor": R.RandomForestRegressor,
    "GradientBoostingRegressor": R.GBTRegressor,
}
# Estimators of other libraries, usable where their Spark package is installed.
OPTIONAL = {
    "XGBClassifier": ("xgboost.spark", "SparkXGBClassifier"),
    "XGBRegressor": ("xgboost.spark", "SparkXGBRegressor"),
    "LGBMClassifier": ("synapse.ml.lightgbm", "LightGBMClassifier"),
    "LGBMRegressor": ("synapse.ml.lightgbm", "LightGBMRegressor"),
}

# Customary parameter names and what Spark ML calls them.
_FOREST = {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
           "subsample": "subsamplingRate", "max_features": "featureSubsetStrategy", "random_state": "seed"}
_BOOSTED = {**_FOREST, "n_estimators": "maxIter", "learning_rate": "stepSize"}
_LINEAR = {"max_iter": "maxIter", "tol": "tol", "fit_intercept": "fitIntercept"}
PARAMETER_NAMES = {
    "LogisticRegression": _LINEAR, "LinearRegression": _LINEAR, "Ridge": _LINEAR,
    "RandomForestClassifier": _FOREST, "RandomForestRegressor": _FOREST,
    "GradientBoostingClassifier": _BOOSTED, "GradientBoostingRegressor": _BOOSTED,
}
MAX_SPARK_DEPTH = 30
#: Depth from which a forest keeps the node of each row and tree instead of walking down from the root at every level.
KEPT_NODES_DEPTH = 8


def importable(estimator: str) -> bool:
    if estimator not in OPTIONAL:
        return True
    try:
        return importlib.util.find_spec(OPTIONAL[estimator][0]) is not None
    except ModuleNotFoundError:
        return False


def default_candidates(task: TaskSpec) -> list[CandidateModel]:
    """One candidate with its library's default parameters for every importable family of the task; none for forecasting."""
    if task.task_type == "forecasting":
        return []
    own = CLASSIFIERS if task.is_classification else REGRESSORS
    other = [name for name in OPTIONAL if name.endswith("Classifier") == task.is_classification]
    found = [CandidateModel(_title(name), name) for name in own]
    return found + [CandidateModel(_title(name), name, library=OPTIONAL[name][0].split(".")[0]) for name in other if importable(name)]


def _title(estimator: str) -> str:
    family = estimator.removesuffix("Classifier").removesuffix("Regressor")
    return "".join(f" {c}" if c.isupper() and i and family[i - 1].islower() else c for i, c in enumerate(family))


def fill_candidates(proposed: Sequence[CandidateModel], task: TaskSpec) -> list[CandidateModel]:
    """The proposed candidates, then a default one for each family of the task that they leave out."""
    names = frozenset(c.estimator for c in proposed)
    return list(proposed) + [c for c in default_candidates(task) if c.estimator not in names]


#: Parameters that are turned into a penalty rather than set.
PENALTIES = {"Ridge": {"alpha"}, "LogisticRegression": {"C", "penalty", "l1_ratio"}}


def resolve_parameters(estimator: str, params: dict[str, Any]) -> tuple[dict[str, Any], str | None]:
    """Parameters under Spark's names, and a note on those that the estimator has not or cannot take.

    Names are looked up among the estimator's own parameters, as they are or by their customary name; values pass its type checks.
    Estimators of other packages check theirs themselves.
    """
    if estimator in OPTIONAL:
        return dict(params), None
    if estimator not in {**CLASSIFIERS, **REGRESSORS}:
        raise ValueError(f"unknown estimator '{estimator}'")
    blank = {**CLASSIFIERS, **REGRESSORS}[estimator]()
    usable, unusable = {}, []
    for given, value in params.items():
        name = PARAMETER_NAMES[estimator].get(given, given)
        if given in PENALTIES.get(estimator, ()):
            usable[given] = value
        elif not isinstance(name, str) or not blank.hasParam(name):
            unusable.append(str(given))
        elif value is not None:
            if name == "featureSubsetStrategy":
                value = str(value)
            if name == "maxDepth":
                value = min(int(value), MAX_SPARK_DEPTH)
            try:
                usable[name] = blank.getParam(name).typeConverter(value)
            except (TypeError, ValueError):
                unusable.append(str(given))
    return usable, f"parameters without effect on {estimator}: {', '.join(sorted(unusable))}" if unusable else None


def build_estimator(
    name: str, params: dict[str, Any], rows: int, n_classes: int | None = None, label_deviation: float = 1.0
) -> Estimator:
    """A Spark ML estimator over ``features`` and ``label``; see :func:`resolve_parameters` for names.

    ``alpha`` and ``C`` weigh the penalty against the sum of losses over ``rows``, on features as they are.  Spark weighs it against the
    mean loss, and for least squares of a label divided by its (population) deviation.
    """
    params, _ = resolve_parameters(name, params)
    if name in OPTIONAL:
        return _optional(name, params)
    estimator = {**CLASSIFIERS, **REGRESSORS}[name](featuresCol="features", labelCol="label", predictionCol="prediction")
    for given, value in params.items():
        if given not in PENALTIES.get(name, ()):
            estimator.set(estimator.getParam(given), value)
    if name.startswith("RandomForest") and estimator.getMaxDepth() >= KEPT_NODES_DEPTH:
        estimator.setCacheNodeIds(True).setCheckpointInterval(-1)
    if name == "Ridge":
        strength = float(params.get("alpha", 1.0)) / max(rows, 1) * label_deviation
        estimator.setStandardization(False).setElasticNetParam(0.0).setRegParam(strength)
    if name == "LinearRegression" and "regParam" not in params:
        estimator.setRegParam(0.0)
    if name == "LogisticRegression":
        estimator.setStandardization(False)
        if "regParam" not in params:
            kind = params.get("penalty", "l2")
            share = {"l1": 1.0, "elasticnet": float(params.get("l1_ratio") or 0.5)}.get(kind, 0.0)
            strength = 0.0 if kind in (None, "none") else 1.0 / (float(params.get("C", 1.0)) * max(rows, 1))
            estimator.setElasticNetParam(share).setRegParam(strength)
    if name == "GradientBoostingClassifier" and (n_classes or 0) > 2:
        return C.OneVsRest(classifier=estimator, featuresCol="features", labelCol="label", predictionCol="prediction")
    return estimator


def _optional(name: str, params: dict[str, Any]) -> Estimator:
    module, cls = OPTIONAL[name]
    if not importable(name):
        raise ValueError(f"estimator '{name}' needs the package '{module}'")
    made = getattr(importlib.import_module(module), cls)
    names = {"features_col": "features", "label_col": "label"} if name.startswith("XGB") else {"featuresCol": "features", "labelCol": "label"}
    return made(**names, **params)


#: Ranges searched, in the parameters of Spark's learners: kind, low, high.  Depths stay where a level still fits a few passes.
_SEARCHED = {
    "regParam": ("log", 1e-6, 10.0), "elasticNetParam": ("float", 0.0, 1.0), "alpha": ("log", 1e-2, 1e4),
    "numTrees": ("int", 20, 160), "maxDepth": ("int", 4, 14), "minInstancesPerNode": ("int", 1, 64),
    "maxIter": ("int", 20, 120), "stepSize": ("log", 0.03, 0.5), "subsamplingRate": ("float", 0.5, 1.0),
}
_SEARCHED_BY = {
    "LogisticRegression": ("regParam", "elasticNetParam"), "LinearRegression": ("regParam", "elasticNetParam"), "Ridge": ("alpha",),
    "RandomForest": ("numTrees", "maxDepth", "minInstancesPerNode", "subsamplingRate"),
    "GradientBoosting": ("maxIter", "stepSize", "maxDepth", "subsamplingRate"),
}
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    name: {p: _SEARCHED[p] for p in searched}
    for name in (*CLASSIFIERS, *REGRESSORS) for family, searched in _SEARCHED_BY.items() if name.startswith(family)
}
# the boosted learners of other packages share two names only
SEARCH_SPACES |= {name: {"max_depth" if name.startswith("XGB") else "maxDepth": ("int", 3, 9), "learning_rate" if name.startswith("XGB") else "learningRate": ("log", 0.03, 0.5)} for name in OPTIONAL}


def suggest(estimator: str, trial: int, seed: int = 0) -> dict[str, Any]:
    """The parameters of one search trial, the same on every run."""
    rng = np.random.default_rng([seed, trial])
    out: dict[str, Any] = {}
    for name, (kind, low, high) in SEARCH_SPACES.get(estimator, {}).items():
        if kind == "int":
            out[name] = int(rng.integers(low, high + 1))
        elif kind == "log":
            out[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
        else:
            out[name] = float(rng.uniform(low, high))
    return out


def metric_for(task: TaskSpec, n_classes: int | None = None) -> str:
    """The task's metric where it applies, else F1 or RMSE."""
    if task.is_classification:
        if task.metric == "roc_auc":
            return "roc_auc" if n_classes == 2 else "f1"
        return task.metric if task.metric in ("accuracy", "f1", "precision", "recall") else "f1"
    return task.metric if task.metric in ("rmse", "mae", "r2") else "rmse"
