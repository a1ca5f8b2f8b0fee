"""Operator 7: mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.sampling import ordered_totals
from tabprofile.llm.common import WORD

#: Weights that sources take in turn, in code point order of their names.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, n_docs, target`` from ``source, source_size, n_docs``: one row per source.

    ``share`` times all sizes is dealt by weight; a source stops at ``most`` times its size and the excess goes to the others by
    weight.  Sources reach their limit in the order of limit / weight, so the level at which the dealing ends follows from running
    sums in that order.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(turn) - 1) % n + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(0))
    stepped = (
        sizes.withColumn("_weight", weight).withColumn("_limit", limit).withColumn("_ratio", F.col("_limit") / F.col("_weight"))
        .withColumn("_spent", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum(F.col("source_size") * F.lit(float(share))).over(everyone) - F.col("_spent")) / F.col("_weights"))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everyone)["_level"]
    return stepped.select("source", "source_size", "n_docs", F.coalesce(F.least("_limit", F.col("_weight") * level), F.col("_limit")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix",
        keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes it).

    A document expects ``target / source_size`` copies.  Expectations are summed up within a source in order of size, one offset
    in [0, 1) drawn from the source's name is added, and a document is taken once per whole number that the sum crosses on it.
    Order by size makes the words taken follow the target closely.  The order is total (size, doc_id, then a hash of text and the
    kept columns), so reruns agree; a large source is ranked in slices, never in one task.

    Null source is a source of its own, last in order; null and empty texts have size 0 and are sampled like others; rows that
    repeat are separate documents; a source without words has target 0; an empty table gives no rows.
    """
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    sized = docs.select(
        *kept, F.col("doc_id").cast("bigint").alias("_doc"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), F.xxhash64("text", *keep).alias("_tie"))
    named = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    ranked = ordered_totals(sized.withColumn("_source", named), ["_source"], ["size", "_doc", "_tie"], F.lit(1).cast("bigint"), "_before")
    targets = source_targets(
        ranked.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, share, most
    ).withColumnRenamed("source", "_name")
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_name")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 13), 16, 10).cast("double")
    offset = digits / F.lit(float(16 ** 13))
    up_to = F.floor(F.col("_rate") * (F.col("_before") + 1) + F.col("_offset"))
    copies = up_to - F.floor(F.col("_rate") * F.col("_before") + F.col("_offset"))
    return joined.withColumn("_rate", rate).withColumn("_offset", offset).select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", copies.cast("bigint").alias("copies"))
