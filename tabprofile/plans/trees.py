"""Exact Shapley values of tree ensembles over any number of rows.

The value of a set of known features is the ensemble's expectation when every split on an unknown feature sends a row both ways, in the
shares of the training rows that took them.  A leaf then is a product over the features on its path: known features count 1 or 0, unknown
ones their share.  The Shapley weights of such a product are the integral of a polynomial in one variable, which a few Gauss-Legendre nodes
give exactly, and a row enters only by which of the path's conditions it meets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprofile.session import storage_root

#: Features on a path up to which all patterns of met conditions are tabulated once; longer paths are integrated row by row.
TABULATED = 10
#: Rows that are integrated together.
ROWS = 4096


@dataclass
class Leaf:
    """A path: its distinct features, the interval (low, high] that the path leaves each, their shares, and the leaf's outputs."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def _class_shares(stats: list[float]) -> np.ndarray:
    total = sum(stats)
    return np.array(stats) / total if total else np.zeros(len(stats))


def _paths(nodes: dict[int, Any], outputs) -> Iterator[Leaf]:
    """The leaves of one tree; ``outputs`` gives a leaf's values."""
    stack = [(nodes[0], {})]
    while stack:
        node, limits = stack.pop()
        if node["leftChild"] < 0:
            found = list(limits.items())
            yield Leaf(
                np.array([f for f, _ in found], np.int64), *(np.array([v[k] for _, v in found], float) for k in range(3)), np.atleast_1d(outputs(node)))
            continue
        split = node["split"]
        if split["numCategories"] != -1:
            raise ValueError("splits on categories are not numbers")
        feature, at = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        for side in ("leftChild", "rightChild"):
            child = nodes[node[side]]
            low, high, share = limits.get(feature, (-np.inf, np.inf, 1.0))
            share *= child["rawCount"] / node["rawCount"]
            narrowed = (low, min(high, at), share) if side == "leftChild" else (max(low, at), high, share)
            stack.append((child, {**limits, feature: narrowed}))


def _stored_trees(spark: SparkSession, model) -> list[dict[int, Any]]:
    """Nodes by id of each tree, as Spark stores them; their number is bounded by the model's own parameters."""
    path = f"{storage_root(spark)}/tabprofile-{uuid.uuid4().hex}.model"
    model.write().save(path)
    found = spark.read.parquet(f"{path}/data")
    if "nodeData" not in found.columns:
        found = found.select(F.lit(0).alias("treeID"), F.struct(*found.columns).alias("nodeData"))
    trees: dict[int, dict[int, Any]] = {}
    for row in found.toLocalIterator():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    return [trees[k] for k in sorted(trees)]


def leaves_of(spark: SparkSession, model) -> list[Leaf]:
    """All leaves of a fitted tree model with what they add to its outputs.

    Forests and trees of classes give a probability for each class; boosted trees of two classes the log-odds of the second, of more
    classes (one model against the rest each) the log-odds of each; regressions the prediction.
    """
    parts = getattr(model, "models", None)
    if parts is not None:
        out = []
        for i, part in enumerate(parts):
            for leaf in leaves_of(spark, part):
                leaf.value = np.where(np.arange(len(parts)) == i, leaf.value[0], 0.0)
                out.append(leaf)
        return out
    trees = _stored_trees(spark, model)
    boosted = type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    classes = getattr(model, "numClasses", 0)
    if boosted:
        factor = 2.0 if classes else 1.0
        return [leaf for nodes, w in zip(trees, weights) for leaf in _paths(nodes, lambda n, w=w: factor * w * n["prediction"])]
    if classes:
        keep = slice(1, 2) if classes == 2 else slice(None)
        return [leaf for nodes, w in zip(trees, weights) for leaf in _paths(nodes, lambda n, w=w: w * _class_shares(n["impurityStats"])[keep])]
    return [leaf for nodes, w in zip(trees, weights) for leaf in _paths(nodes, lambda n, w=w: w * n["prediction"])]


def can_flatten(model) -> bool:
    return all(hasattr(m, "featureImportances") and type(m).__module__.startswith("pyspark.ml.") for m in (getattr(model, "models", None) or [model]))


def _shapley(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values (rows x features) of products that are ``met`` (0 or 1) for a known and ``share`` for an unknown feature.

    With d features the weight of a set of s known ones is s! (d - 1 - s)! / d!, the integral of t^s (1 - t)^(d-1-s); so the sum over sets
    is the integral of the product of t * met + (1 - t) * share over the other features, a polynomial of degree d - 1.
    """
    d = len(share)
    nodes, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
    out = np.zeros(met.shape)
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factor = t * met + (1 - t) * share
        out += w * factor.prod(axis=1, keepdims=True) / factor
    return out * (met - share)


class Ensemble:
    """Leaves grouped by path length, with the tabulated Shapley values of every pattern of met conditions."""

    def __init__(self, leaves: list[Leaf], width: int):
        self.width, self.outputs = width, len(leaves[0].value)
        self.base = sum((leaf.value * leaf.share.prod() for leaf in leaves), np.zeros(self.outputs))
        self.constant = sum((leaf.value for leaf in leaves if not len(leaf.features)), np.zeros(self.outputs))
        self.leaves = [leaf for leaf in leaves if len(leaf.features)]
        self.tables = [self._table(leaf) for leaf in self.leaves]

    @staticmethod
    def _table(leaf: Leaf) -> np.ndarray | None:
        d = len(leaf.features)
        if d > TABULATED:
            return None
        patterns = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
        return _shapley(patterns.astype(float), leaf.share)

    def explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shapley values (outputs x rows x features) and outputs (outputs x rows)."""
        phi, total = np.zeros((self.outputs, len(x), self.width)), np.repeat(self.constant[:, None], len(x), axis=1)
        columns = np.ascontiguousarray(x.T)
        for leaf, table in zip(self.leaves, self.tables):
            d = len(leaf.features)
            met = np.stack([(columns[f] > lo) & (columns[f] <= hi) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)])
            if table is None:
                part = _shapley(met.T.astype(float), leaf.share).T
                full = met.all(axis=0)
            else:
                pattern = (1 << np.arange(d)) @ met
                part, full = table.T[:, pattern], pattern == (1 << d) - 1
            for k in np.flatnonzero(leaf.value):
                total[k] += leaf.value[k] * full
                for f, p in zip(leaf.features, part):
                    phi[k, :, f] += leaf.value[k] * p
        return phi, total


def tree_attributions(model, rows: DataFrame) -> tuple[DataFrame, float]:
    """``key, x, phi, output`` for rows of ``key, x``, and the base value.

    One output: signed values that add up with the base to ``output``.  Several: the mean size over the outputs, no single output, and
    the mean of the bases.  Rows stay where they are; the tables that tasks need come from the model alone.
    """
    spark = rows.sparkSession
    leaves = leaves_of(spark, model)
    width = int(model.numFeatures if getattr(model, "models", None) is None else model.models[0].numFeatures)
    base = Ensemble(leaves, width).base
    shared = spark.sparkContext.broadcast(leaves)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ensemble = Ensemble(shared.value, width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                phi, total = ensemble.explain(x)
                single = ensemble.outputs == 1
                values = phi[0] if single else np.abs(phi).mean(axis=0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))
                out = pa.array(total[0]) if single else pa.nulls(part.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("x"), lists, out], ["key", "x", "phi", "output"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.select("key", "x").mapInArrow(run, f"key {kind}, x array<double>, phi array<double>, output double")
    return found, float(base[0] if len(base) == 1 else base.mean())
