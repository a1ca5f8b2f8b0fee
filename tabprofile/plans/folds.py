"""Cross-validation of least squares without fitting once per fold.

Sums of products of the columns, their gaps and the label, kept per fold, are all that a linear fit needs: a round's training sums are those
of its folds added up, and mean filling and scaling are linear in them.  So the data are read once for the sums of all folds, whatever the
number of rounds, penalties or sets of columns, and once more where rows have to be predicted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.frames import as_double, is_numeric, normalise, scalars, type_of
from tabprofile.plans.spec import FeatureStep, settings

#: Columns up to which the sums are a moderate matrix for the driver; wider frames are fitted fold by fold.
MAX_COLUMNS = 1_000


@dataclass(frozen=True)
class Linear:
    """A fit in shifted terms: ``intercept + sum of a * (x - shift)``, with ``gap`` in place of a missing value's term."""

    intercept: float
    slopes: np.ndarray
    gaps: np.ndarray
    weights: np.ndarray


@dataclass(frozen=True)
class FoldSums:
    """Per fold the products of 1, the shifted columns (0 where missing), the gap marks, and the shifted label, in this order."""

    columns: list[str]
    shifts: np.ndarray
    label_shift: float
    products: np.ndarray
    means_filled: np.ndarray
    scaled: np.ndarray

    def _training(self, folds: Sequence[int] | None) -> np.ndarray:
        return self.products.sum(axis=0) if folds is None else self.products[list(folds)].sum(axis=0)

    def fit(self, folds: Sequence[int] | None, penalty: float, chosen: Sequence[int] | None = None) -> Linear:
        """Least squares with ``penalty`` on the squared weights of the prepared columns, over the rows of ``folds``."""
        p = len(self.columns)
        sums, at = self._training(folds), np.arange(p) if chosen is None else np.asarray(chosen)
        n, z, q = sums[0, 0], 1 + at, 1 + p + at
        gaps, total, squares = sums[0, q], sums[0, z], sums[z, z]
        present = n - gaps
        mean = np.divide(total, present, out=np.zeros(len(at)), where=present > 0)
        fill = np.where(self.means_filled[at], mean, 0.0)
        # filled columns have their mean over all rows, which the fill leaves as it is; others over the rows that have a value
        rows = np.where(self.means_filled[at], n, present)
        variance = np.divide(squares + np.where(self.means_filled[at], gaps * fill ** 2, 0.0), rows, out=np.zeros(len(at)), where=rows > 0) - mean ** 2
        deviation = np.sqrt(np.maximum(variance, 0.0))
        flat = deviation <= 1e-12 * np.maximum(np.abs(self.shifts[at]), np.abs(mean))
        spread = np.where(self.scaled[at] & ~flat, deviation, 1.0)
        # what stands for a gap, counted from the shift: the fill, the center (0 after scaling), or a plain 0
        gap = np.where(self.means_filled[at], fill, np.where(self.scaled[at], mean, -self.shifts[at])) / spread
        turn = np.zeros((len(at), len(sums)))
        turn[np.arange(len(at)), z], turn[np.arange(len(at)), q] = 1 / spread, gap
        center, y = turn @ sums[:, 0] / n, sums[0, -1] / n
        square = turn @ sums @ turn.T - n * np.outer(center, center)
        toward = turn @ sums[:, -1] - n * center * y
        if penalty > 0:
            weights = np.linalg.solve(square + penalty * np.eye(len(at)), toward)
        else:
            scale = np.sqrt(np.maximum(np.diag(square), 0.0))
            scale[scale == 0] = 1.0
            weights = np.linalg.lstsq(square / np.outer(scale, scale), toward / scale, rcond=1e-12)[0] / scale
        slopes, filled = np.zeros(p), np.zeros(p)
        slopes[at], filled[at] = weights / spread, weights * gap
        return Linear(float(self.label_shift + y - weights @ center), slopes, filled, weights)

    def squared_error(self, model: Linear, fold: int) -> tuple[float, float, float]:
        """Rows of a fold, their sum of squared errors and of squared deviations of the label, without reading them again."""
        sums = self.products[fold]
        v = np.r_[self.label_shift - model.intercept, -model.slopes, -model.gaps, 1.0]
        n = sums[0, 0]
        return n, float(v @ sums @ v), float(sums[-1, -1] - sums[0, -1] ** 2 / n)


def closed_form(df: DataFrame, features: Sequence[str], steps: Sequence[FeatureStep], estimator: str, params: dict) -> float | None:
    """The penalty of a fit that :class:`FoldSums` can make, or None if the plan or the learner needs more.

    Columns have to be numeric; they may be filled by their mean and scaled by their deviation.
    """
    if estimator not in ("Ridge", "LinearRegression") or set(params) - ({"alpha"} if estimator == "Ridge" else set()):
        return None
    df = normalise(df)
    if not features or len(features) > MAX_COLUMNS or not all(is_numeric(type_of(df, c)) for c in features):
        return None
    kinds = {op: set(settings(steps, op, features).values()) for op in ("impute", "scale", "encode")}
    if kinds["impute"] - {"mean"} or kinds["scale"] - {"standard"} or "target" in kinds["encode"]:
        return None
    return float(params.get("alpha", 1.0)) if estimator == "Ridge" else 0.0


def fold_sums(placed: DataFrame, features: Sequence[str], steps: Sequence[FeatureStep], folds: int) -> FoldSums | None:
    """Sums of all folds of ``placed`` (``fold``, ``label`` and the features); None where a fold's rest has a column without values."""
    columns = list(features)
    data = normalise(placed)
    value = lambda c: F.when(F.abs(as_double(data, c)) < float("inf"), as_double(data, c))
    facts = scalars(data, {("y", "mean"): F.avg("label"), **{(c, "mean"): F.avg(value(c)) for c in columns}})
    shifts = np.array([facts[c, "mean"] or 0.0 for c in columns])
    label_shift, width = float(facts["y", "mean"] or 0.0), 2 * len(columns) + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, width, width))
        for batch in batches:
            fold, y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack(x).astype(float)
            missing = np.isnan(x)
            basis = np.column_stack([np.ones(len(x)), np.where(missing, 0.0, x - shifts), missing.astype(float), y - label_shift])
            for f in range(folds):
                rows = basis[fold == f]
                sums[f] += rows.T @ rows
        for f in range(folds):
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array([f] * width, pa.int32()), "i": pa.array(range(width), pa.int32()), "row": pa.array(list(map(list, sums[f])), pa.list_(pa.float64()))})

    rows = data.select(F.col("fold").cast("int"), F.col("label").cast("double"), *[value(c).alias(f"x{k}") for k, c in enumerate(columns)])
    cells = rows.mapInArrow(products, "fold int, i int, row array<double>").select("fold", "i", F.posexplode("row").alias("j", "v"))
    found = cells.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((folds, width, width))
    out[tuple(found.column(c).to_numpy() for c in ("fold", "i", "j"))] = found.column("v").to_numpy()
    filled, scaled = (settings(steps, op, columns) for op in ("impute", "scale"))
    return FoldSums(
        columns, shifts, label_shift, out, np.array([c in filled for c in columns], bool), np.array([c in scaled for c in columns], bool))


def predictions(data: DataFrame, sums: FoldSums, models: dict[int, Linear]) -> Column:
    """The prediction of each row by the model of its fold; null for folds without one."""
    data = normalise(data)
    last = max(models) + 1
    of = lambda pick: F.array(*[F.lit(float(pick(models[f]))) if f in models else F.lit(None).cast("double") for f in range(last)])[F.col("fold")]
    total = of(lambda m: m.intercept)
    for k, c in enumerate(sums.columns):
        x = F.when(F.abs(as_double(data, c)) < float("inf"), as_double(data, c)) - F.lit(float(sums.shifts[k]))
        total = total + F.coalesce(x * of(lambda m: m.slopes[k]), of(lambda m: m.gaps[k]))
    return F.when(F.col("fold") < last, total)
