import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.llm import negatives


def brute(rows, is_anchor, k=5, percent=80):
    """Rows of the contract from (vec_id, label, vector of integers)."""
    out = set()
    for q in sorted({r[0] for r in rows if is_anchor(r[0])}):
        _, label, v = min((r for r in rows if r[0] == q), key=lambda r: (r[1], r[2]))
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i, lab == label) for i, lab, w in rows if i != q))
        for s, i, same in [x for x in scores if x[2]][:k]:
            window = [x for x in scores if not x[2] and percent * -s <= 100 * -x[0] <= 100 * -s][:k]
            out |= {(q, i, rank + 1, j, -s, -t) for rank, (t, j, _) in enumerate(window)}
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CELL_ROWS", 6), ("BLOCK_ROWS", 16), ("PROBE_ROWS", 12), ("ANCHOR_ROWS", 3)):
        monkeypatch.setattr(negatives, name, value)


def clustered(seed, n, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    near = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, width)) * 0.25
    return [(i, int(rng.integers(0, 4)), [int(x) for x in np.floor(near[i] * 64)]) for i in range(n)]


def test_equals_brute_force(spark, small):
    rows = clustered(1, 300)
    rows += [(400 + i, i % 2, rows[10][2]) for i in range(80)]  # ties over many blocks
    rows += [(500, 9, rows[5][2]), (505, 8, rows[6][2]), (506, 8, [-x for x in rows[6][2]]), (510, 1, [3, 4]), (515, 2, []), (520, 0, [0] * 12), (525, 3, [10 ** 12] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vector array<bigint>").repartition(4)
    got = negatives.mine(df.selectExpr("*", "1 AS score", "2 AS cell", "3 AS block", "4 AS low"), F.col("vec_id") % 5 == 0)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 5 == 0)


def test_walks_leave_cells_out(spark, small):
    df = spark.createDataFrame(clustered(2, 400), "vec_id bigint, label bigint, vector array<bigint>")
    index = negatives.build_multi_index(df)
    walks = negatives.Walks(index.codes, index.cells, index.within)
    rows = df.collect()
    assert index.cells[:, 3].sum() == 400
    seen = 0
    for r in rows[:40]:
        v = np.array(r.vector, float)
        scores = sorted((float(np.dot(v, w.vector)) for w in rows), reverse=True)
        walk = walks.of(np.array(r.vector))
        bounds = [b for b, _ in walk]
        assert bounds == sorted(bounds, reverse=True) and len(bounds) == len(index.cells)
        assert bounds[0] >= scores[0] and max(walk.own) >= scores[0]
        reached = walk.down_to(scores[4])
        assert index.cells[reached, 3].sum() >= 5
        seen += len(reached)
    assert seen < 0.5 * 40 * len(index.cells)


def test_rows_that_take_no_part_and_repeats(spark, small):
    rows = clustered(3, 60)
    odd = [(None, 1, [1.0] * 12), (61, None, [1.0] * 12), (62, 1, None), (63, 1, [1.0, None]), (65, 1, [float("nan")] * 12), (70, 1, [float("inf")] * 12)]
    again = rows[:3] + [(0, 3, rows[7][2]), (5, rows[5][1], rows[9][2])]
    as_floats = [(i, lab, [x / 256 for x in v]) for i, lab, v in rows + again]
    df = spark.createDataFrame(as_floats + odd, "vec_id bigint, label int, embedding array<float>")
    got = negatives.mine(negatives.labelled(df), F.col("vec_id") % 5 == 0).collect()
    exact = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in as_floats]
    # rows that repeat an id are separate candidates
    assert sorted(set(map(tuple, got))) == brute(exact, lambda i: i % 5 == 0)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, 1, [1]), (1, 1, [2]), (2, 2, [2])], "vec_id bigint, label bigint, vector array<bigint>")
    assert negatives.mine(df.where("false"), F.col("vec_id") == 0).collect() == []
    assert [tuple(r) for r in negatives.mine(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 2, 2)]
    assert negatives.mine(df.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []
