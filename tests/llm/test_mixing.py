import fixtures
import numpy as np

from tabprofile.llm.mixing import mix


def level(sizes, weights, share, most):
    """Targets by dealing again and again until no source is above its limit."""
    target, total = {}, share * sum(sizes.values())
    open_ = dict(weights)
    while open_:
        left = total - sum(target.values())
        dealt = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if dealt[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | dealt
        for s in over:
            target[s] = most * sizes[s]
            del open_[s]
    return target


def test_targets_and_taken_words(spark):
    rng = np.random.default_rng(2)
    docs = []
    for k, source in enumerate(["a", "b", "c", None, "é", "Z"]):
        for i in range([400, 60, 200, 90, 20, 1][k]):
            docs.append((len(docs), " ".join(["w"] * int(rng.integers(0, 40))) if i else None, "en", source))
    docs += [(7, "x y z", "en", "a"), (7, "x y z", "en", "a"), (None, "p q", "en", "b"), (None, None, "en", None)]
    df = fixtures.frame(spark, docs, 4)
    rows = mix(df, keep=("doc_id", "source")).collect()
    assert len(rows) == len(docs)
    sizes, taken = {}, {}
    for r in rows:
        assert 0 <= r.copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 80
    again = mix(df.repartition(7), keep=("doc_id", "source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_empty_table_and_empty_texts(spark):
    df = fixtures.frame(spark, [(1, None), (2, ""), (3, " \n")])
    assert [(r.size, r.target, r.copies) for r in mix(df).collect()] == [(0, 0.0, 0)] * 3
    assert mix(df.where("false")).count() == 0


def test_plan_has_no_python(spark):
    plan = mix(fixtures.frame(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
