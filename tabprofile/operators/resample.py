"""Class balancing of training rows.  Every choice is by hash of a row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.frames import col, small_or_same
from tabprofile.functions.sampling import hash_segments, unit_hash, with_point_id
from tabprofile.operators.neighbours import nearest_neighbours
from tabprofile.session import materialise

SMOTE_NEIGHBOURS = 5


def class_sizes(df: DataFrame, target: str) -> dict[object, int]:
    """Rows per class; one entry per class of a classification target."""
    return {r[0]: r[1] for r in df.where(col(target).isNotNull()).groupBy(col(target)).count().collect()}


def random_oversample(df: DataFrame, target: str, key: str) -> DataFrame:
    """Repeat rows until every class has the size of the largest; sizes come out exact.

    Each row repeats ``size_wanted div size`` times; the remainder goes to the first rows of the
    class in hash order.  ``copy`` numbers the copies of a row.
    """
    largest = max(class_sizes(df, target).values())
    marked = hash_segments(
        df.where(col(target).isNotNull()), [target], key, [F.lit(largest) % F.col("n")], "over", "_later")
    sizes = df.where(col(target).isNotNull()).groupBy(col(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    repeats = F.floor(F.lit(largest) / F.col("_n")) + F.when(F.col("_later") == 0, 1).otherwise(0)
    return (
        marked.join(small_or_same(sizes), col(target) == F.col("_class"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), (repeats - 1).cast("int"))))
        .drop("_later", "_class", "_n")
    )


def random_undersample(df: DataFrame, target: str, key: str) -> DataFrame:
    """Keep as many rows of each class as the smallest class has."""
    smallest = min(class_sizes(df, target).values())
    kept = hash_segments(df.where(col(target).isNotNull()), [target], key, [F.lit(smallest)], "under", "_later")
    return kept.where(F.col("_later") == 0).drop("_later")


def smote(df: DataFrame, target: str, key: str, features: Sequence[str] | str, neighbours: int | None = None) -> DataFrame:
    """Add interpolated rows until every class has the size of the largest.

    ``features`` is a list of numeric columns or one array column.  A synthetic row lies between a
    row of the class and one of its k nearest neighbours in that class, both chosen by hash.  The
    result holds ``key`` (null for synthetic rows), ``target``, the features and ``is_synthetic``.
    """
    as_array = isinstance(features, str)
    x = col(features) if as_array else F.array(*[col(f).cast("double") for f in features])
    base = materialise(df.where(col(target).isNotNull()).select(col(key).alias("k"), col(target).alias("t"), x.alias("x")))
    sizes = class_sizes(base, "t")
    k = min(neighbours or SMOTE_NEIGHBOURS, min(sizes.values()) - 1)
    if k < 1:
        raise ValueError("interpolation needs at least two rows in every class")
    made = _between_neighbours(base, sizes, k)
    rows = base.select("k", "t", "x", F.lit(False).alias("is_synthetic")).unionByName(made)
    shown = [col("x").alias(features)] if as_array else [F.col("x")[i].alias(f) for i, f in enumerate(features)]
    return rows.select(F.col("k").alias(key), F.col("t").alias(target), *shown, "is_synthetic")


def _between_neighbours(base: DataFrame, sizes: dict[object, int], k: int) -> DataFrame:
    """The synthetic rows of all classes below the largest, from one neighbour search.

    Each class is moved away from the others along an extra dimension by more than the data's
    extent, so that a row's nearest rows are always of its own class.
    """
    largest = max(sizes.values())
    small = sorted((c for c, n in sizes.items() if n < largest), key=str)
    rows = base.where(F.col("t").isin(small)) if small else base.limit(0)
    far = rows.select(F.array_max(F.transform("x", lambda v: F.abs(v))).alias("m"), F.size("x").alias("w")).agg(
        F.max(F.col("m") * F.col("w"))).first()[0]
    class_at = F.create_map(*[F.lit(v) for i, c in enumerate(small or [None]) for v in (c if small else 0, float(i))])
    shelf = F.element_at(class_at, F.col("t")) * F.lit(4.0 * (far or 0.0) + 1.0)
    points = with_point_id(rows.groupBy("t", "x").agg(
        F.min("k").alias("k"), F.count(F.lit(1)).alias("n")), "k").select("id", "t", "x", "n")
    near = nearest_neighbours(points.select("id", F.concat("x", F.array(shelf)).alias("x"), "n"), k)
    # each of the k slots of a point names one neighbour; copies of a neighbour fill several slots
    slots = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other", "copies"))).alias("s"))
    slots = slots.select("id", F.flatten(F.transform("s", lambda e: F.array_repeat(e["other"], e["copies"].cast("int")))).alias("s"))
    n = F.col("n").cast("bigint")
    counts = F.create_map(*[F.lit(v) for c in small or [0] for v in (c, sizes.get(c, 0))])
    extra = hash_segments(rows, ["t"], "k", [(F.lit(largest) - n) % n], "smote", "_later")
    placed = extra.join(points.select("t", "x", "id"), ["t", "x"])
    size = F.element_at(counts, F.col("t"))
    times = F.floor((F.lit(largest) - size) / size) + F.when(F.col("_later") == 0, 1).otherwise(0)
    drawn = (
        placed.withColumn("times", times).where("times > 0")
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .withColumn("tag", F.concat_ws(":", F.col("k").cast("string"), F.col("draw").cast("string")))
        .join(slots, "id")
        .withColumn("slot", F.floor(unit_hash("tag", "neighbour") * F.size("s")).cast("int"))
        .select("t", "x", "tag", F.col("s")[F.col("slot")].alias("other"))
    )
    there = points.select(F.col("id").alias("other"), F.col("x").alias("y"))
    return drawn.join(there, "other").withColumn("u", unit_hash("tag", "step")).select(
        F.lit(None).cast(base.schema["k"].dataType).alias("k"), "t",
        F.transform(F.arrays_zip("x", "y"), lambda e: e["x"] + F.col("u") * (e["y"] - e["x"])).alias("x"),
        F.lit(True).alias("is_synthetic"))


def resample(df: DataFrame, target: str, key: str, method: str, features: str) -> tuple[DataFrame, str | None, str | None]:
    """(rows, method that ran, note).  Interpolation falls back to repetition for a one-row class."""
    if method == "none":
        return df, None, None
    note = None
    if method == "smote" and min(class_sizes(df, target).values()) < 2:
        method = "random_oversample"
        note = "interpolation needs at least 2 rows of the smallest class; rows were repeated instead"
    if method == "smote":
        return smote(df, target, key, features).drop("is_synthetic"), "smote", note
    if method == "random_oversample":
        return random_oversample(df, target, key).drop("copy"), method, note
    if method == "random_undersample":
        return random_undersample(df, target, key), method, note
    raise ValueError(f"unknown resampling method '{method}'")
