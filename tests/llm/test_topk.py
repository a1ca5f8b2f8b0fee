import math

import numpy as np
from pyspark.sql import functions as F

from tabprofile.llm import topk


def brute(rows, k):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in vectors if i % 5 == 0}.items():
        scores = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q), key=lambda s: (-s[0], s[1]))
        out += [(q, rank + 1, i, s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.choice([-1, -0.5, 0, 0, 0, 0.25, 1.003], 12)]) for i in range(60)]
    rows += [(i + 60, rows[10][1]) for i in range(30)]  # ties
    rows += [(200, None), (205, [1.0, None]), (210, [float("nan")] * 12), (215, [float("inf")] + [0.0] * 11), (None, rows[0][1]), (220, [1.0, 2.0]), (225, []), (230, [5.0] * 14)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS ids", "2 AS rank", "3 AS score", "4 AS values").repartition(4)
    got = topk.top_k(topk.quantized(df), F.col("vec_id") % 5 == 0, 5)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(exact, 5)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(topk.quantized(df), F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(topk.quantized(df.where("false")), F.col("vec_id") == 0, 5).count() == 0
