"""Training/test splits and cross-validation folds as a column, driven by hashes of a row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.frames import col
from tabprofile.functions.sampling import hash_segments, time_segments, unit_hash

TRAIN_SHARE = 0.8


def _share(n: Column, share: float) -> Column:
    return F.floor(n * F.lit(share) + 0.5)


def split_random(df: DataFrame, key: str, share: float = TRAIN_SHARE, name: str = "is_train") -> DataFrame:
    """Each row decides for itself by the hash of its key: no shuffle, and stable as rows are added."""
    return df.withColumn(name, unit_hash(key) < share)


def split_stratified(
    df: DataFrame, target: str, key: str, share: float = TRAIN_SHARE, name: str = "is_train", unit: str | None = None
) -> DataFrame:
    """The first part of every class in hash order, exact to the row; ``unit`` names a column that holds the hash already."""
    return hash_segments(df, [target], key, [_share(F.col("n"), share)], name="_part", unit=unit).withColumn(
        name, F.col("_part") == 0).drop("_part")


def split_time(df: DataFrame, time_column: str, key: str, share: float = TRAIN_SHARE, name: str = "is_train") -> DataFrame:
    """The earliest rows train, the latest test; rows of the boundary moment are divided by hash.

    Shares are of the rows with a time.  Rows without one follow the latest and test.
    """
    quota = int(df.where(col(time_column).isNotNull()).count() * share)
    return time_segments(df, time_column, key, [quota], "_part").withColumn(name, F.col("_part") == 0).drop("_part")


def split(df: DataFrame, target: str, task_type: str, key: str, time_column: str | None = None, unit: str | None = None) -> DataFrame:
    """Chronological with a time column; stratified when every class has two rows; else random."""
    if time_column and time_column in df.columns:
        return split_time(df, time_column, key)
    if task_type == "classification":
        smallest = df.groupBy(col(target)).count().agg(F.min("count")).first()[0]
        if smallest is not None and smallest >= 2:
            return split_stratified(df, target, key, unit=unit)
    return split_random(df, key)


def fold_count(df: DataFrame, requested: int, target: str | None = None, time_column: str | None = None) -> int:
    """How many folds the rows allow; 0 when not even two are possible."""
    if target is None or time_column:
        n = df.count()
        folds = min(requested, n - 1 if time_column else n)
    else:
        facts = df.groupBy(col(target)).count().agg(F.min("count").alias("least"), F.sum("count").alias("n")).first()
        folds = min(requested, facts["least"] or 0, facts["n"] or 0)
    return folds if folds >= 2 else 0


def stratified_folds(df: DataFrame, target: str, key: str, folds: int, name: str = "fold", unit: str | None = None) -> DataFrame:
    """Folds whose class sizes differ by at most one row; ``unit`` names a column that holds the hash already."""
    quotas = [F.floor(F.col("n") * (i + 1) / folds) for i in range(folds - 1)]
    return hash_segments(df, [target], key, quotas, salt="fold", name=name, unit=unit)


def plain_folds(df: DataFrame, key: str, folds: int, name: str = "fold", unit: str | None = None) -> DataFrame:
    """Folds whose sizes differ by at most one row."""
    quotas = [F.floor(F.col("n") * (i + 1) / folds) for i in range(folds - 1)]
    return hash_segments(df, [], key, quotas, salt="fold", name=name, unit=unit)


def time_folds(df: DataFrame, time_column: str, key: str, folds: int, name: str = "fold") -> DataFrame:
    """Expanding windows: fold f is tested by a model of all rows with a smaller number.

    Fold 0 only ever trains; folds 1..``folds`` have equal size and end with the latest row.
    """
    n = df.count()
    size = n // (folds + 1)
    return time_segments(df, time_column, key, [n - (folds - i) * size for i in range(folds)], name)


def assign_folds(
    df: DataFrame, key: str, folds: int, target: str | None = None, time_column: str | None = None, unit: str | None = None
) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The frame with a ``fold`` column, and (training, testing) tests for each round."""
    fold = F.col("fold")
    if time_column:
        placed = time_folds(df, time_column, key, folds)
        return placed, [(fold < f, fold == f) for f in range(1, folds + 1)]
    placed = stratified_folds(df, target, key, folds, unit=unit) if target else plain_folds(df, key, folds, unit=unit)
    return placed, [(fold != f, fold == f) for f in range(folds)]
