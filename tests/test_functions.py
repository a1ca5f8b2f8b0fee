"""Core helpers: statistics, quantiles, hashing, splits of hot groups, ordered sums."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprofile.functions import frames, sampling, stats


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_normalise_turns_nan_into_null(spark):
    df = frames.normalise(frame(spark, a=[1.0, float("nan"), 3.0]))
    assert df.where("a is null").count() == 1


def test_moments_match_pandas(spark):
    values = pd.Series(np.random.default_rng(1).gamma(2.0, 3.0, 500))
    row = frame(spark, v=values).agg(stats.skewness(F.col("v")), stats.kurtosis(F.col("v"))).first()
    assert row[0] == pytest.approx(values.skew()) and row[1] == pytest.approx(values.kurt())


@pytest.mark.parametrize("values", [[5.0] * 6, [1.0], [1.0, 2.0], []])
def test_moments_of_degenerate_columns_are_zero(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert list(df.agg(stats.skewness(F.col("v")), stats.kurtosis(F.col("v"))).first()) == [0.0, 0.0]


def test_correlation_of_constant_is_the_default(spark):
    df = frame(spark, a=[1.0, 1.0, 1.0], b=[1.0, 2.0, 3.0])
    assert df.agg(stats.correlation(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert df.agg(stats.correlation(F.col("a"), F.col("b"), None)).first()[0] is None


@pytest.mark.parametrize("direct", [0, 10**9])
def test_quantiles_are_exact_with_hot_values_and_ties(spark, direct):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({
        "smooth": rng.normal(size=4000), "hot": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(size=4000)),
        "few": rng.integers(0, 3, 4000).astype(float), "one": 2.5,
    })
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = stats.exact_quantiles(spark.createDataFrame(data), list(data), probs, direct_limit=direct, bracket_limit=20)
    for c in data:
        assert found[c] == pytest.approx(data[c].quantile(probs).tolist(), abs=1e-12)


def test_quantiles_of_empty_column_are_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert stats.exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_order_statistics_pick_actual_values(spark):
    df = frame(spark, v=[float(v) for v in random.Random(2).sample(range(1000), 1000)])
    assert stats.order_statistics(df, F.col("v"), [0, 499, 999], bracket_limit=10) == {0: 0.0, 499: 499.0, 999: 999.0}


def test_unit_hash_is_uniform_and_stable(spark):
    df = spark.range(20000).select(sampling.unit_hash("id").alias("u"))
    assert 0.49 < df.agg(F.avg("u")).first()[0] < 0.51
    again = spark.range(20000).repartition(7).select(sampling.unit_hash("id").alias("u"))
    assert df.exceptAll(again).count() == 0


def test_hash_segments_are_exact_for_a_dominant_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2990, "warm").alias("g"))
    out = sampling.hash_segments(df, ["g"], "id", [F.floor(F.col("n") * 0.8)])
    sizes = {(r["g"], r["segment"]): r["count"] for r in out.groupBy("g", "segment").count().collect()}
    assert sizes == {("hot", 0): 2000, ("hot", 1): 500, ("warm", 0): 392, ("warm", 1): 98, (None, 0): 8, (None, 1): 2}


def test_hash_sample_has_the_exact_size(spark):
    df = spark.range(5000)
    assert sampling.hash_sample(df, "id", 37).count() == 37
    assert sampling.hash_sample(df, "id", 9999).count() == 5000


def test_ordered_totals_match_a_running_sum(spark):
    data = pd.DataFrame({"g": ["a"] * 700 + ["b"] * 50, "o": range(750), "w": np.arange(750) % 7})
    out = sampling.ordered_totals(spark.createDataFrame(data), ["g"], ["o"], F.col("w"), "before").toPandas()
    want = data.groupby("g")["w"].cumsum() - data["w"]
    assert out.sort_values("o")["before"].tolist() == want.tolist()


def test_ordered_best_matches_a_running_maximum(spark):
    data = pd.DataFrame({"g": ["a"] * 300 + ["b"] * 5, "o": range(305), "v": np.random.default_rng(0).normal(size=305)})
    out = sampling.ordered_best(spark.createDataFrame(data), ["g"], ["o"], "v", "best").toPandas().sort_values("o")
    assert out["best"].tolist() == data.groupby("g")["v"].cummax().tolist()


def test_row_index_counts_from_zero(spark):
    out = sampling.with_row_index(spark.range(1000).repartition(5), ["id"])
    assert out.where(F.col("id") != F.col("_row_index")).count() == 0


def test_time_segments_divide_a_crowded_moment(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 300, F.timestamp_seconds("id")).otherwise(
        F.timestamp_seconds(F.lit(10_000))).alias("ts"))
    out = sampling.time_segments(df, "ts", "id", [200, 600])
    assert {r[0]: r[1] for r in out.groupBy("segment").count().collect()} == {0: 200, 1: 400, 2: 400}
    assert out.where("segment = 0").agg(F.max("id")).first()[0] == 199


def test_distinct_counts_by_type(spark):
    df = spark.createDataFrame([(1, "a", True, [1]), (2, "a", True, [1]), (2, None, False, [2])], "i int, s string, b boolean, l array<int>")
    found = {r["column"]: r["n_unique"] for r in frames.distinct_counts(df, df.columns).collect()}
    assert found == {"i": 2, "s": 1, "b": 2, "l": 2}


def test_approximate_distinct_is_flagged(spark):
    rows = frames.distinct_counts(spark.range(1000), ["id"], exact=False).collect()
    assert rows[0]["is_approx"] and abs(rows[0]["n_unique"] - 1000) < 100
