"""Prediction metrics as aggregations over (label, prediction, score) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.sampling import ordered_totals


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and the class-weighted F1, precision and recall, from the confusion counts alone."""
    cells = confusion(scored, label, prediction)
    # every cell counts towards its true class and, once more, towards its predicted class
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hits")),
    )))
    per_class = sides.groupBy("c").agg(*[F.sum(s).alias(s) for s in ("actual", "guessed", "hits")])
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    f1 = zero(F.try_divide(2 * F.col("hits"), F.col("actual") + F.col("guessed")))
    precision, recall = zero(F.try_divide("hits", "guessed")), zero(F.try_divide("hits", "actual"))
    weighted = lambda e: F.try_divide(F.sum(F.col("actual") * e), F.sum("actual"))
    return per_class.agg(
        F.try_divide(F.sum("hits"), F.sum("actual")).alias("accuracy"), weighted(f1).alias("f1"),
        weighted(precision).alias("precision"), weighted(recall).alias("recall"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve from rank sums over distinct scores; null unless both classes occur."""
    counts = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("pos"), F.count_if(F.col(label) != 1).cast("double").alias("neg"))
    ordered = ordered_totals(counts, [], ["score"], F.col("neg"), "below")
    return ordered.agg(F.try_divide(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R squared."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return scored.agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).alias("r2"))


def evaluate(scored: DataFrame, task_type: str, binary: bool = False) -> dict[str, float]:
    """The task's metrics as numbers; the area under the curve only for two classes."""
    if task_type != "classification":
        row = regression_metrics(scored).first()
        return {k: v for k, v in row.asDict().items() if v is not None}
    found = classification_metrics(scored).first().asDict()
    if binary:
        found["roc_auc"] = roc_auc(scored).first()["roc_auc"]
    return {k: float(v) for k, v in found.items() if v is not None}
