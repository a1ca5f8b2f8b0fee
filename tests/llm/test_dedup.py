import hashlib

import fixtures
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprofile.llm import graphs, minhash, suffixes
from tabprofile.llm.graphs import components
from tabprofile.llm.minhash import keep_one, near_duplicates
from tabprofile.session import materialise


@pytest.mark.parametrize("hot", [64, 2])
def test_repeats_equal_brute_force(spark, hot):
    docs = fixtures.corpus()
    got = suffixes.remove_repeats(fixtures.frame(spark, docs, 5), 100, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = []
    for (d, _), (raw, gone) in zip(docs, fixtures.plain_repeats(docs)):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_repeats_in_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    text = fixtures.corpus()[-3][1] or "x" * 5000
    docs = [(1, text), (2, "y" + text[1000:4000] + "z" * 400)]
    batch_like = spark.createDataFrame([(i, t) for i, t in docs], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(batch_like).collect()}
    assert got == {d: int(g.sum()) for (d, _), (_, g) in zip(docs, fixtures.plain_repeats(docs))}


def test_repeats_within_one_run(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(50)]
    docs = [(i, " ".join(f"{w} " * int(rng.integers(2, 25)) for w in rng.choice(words, 8, replace=False))) for i in range(60)]
    docs += [(100, " theashed" * 13 + " wheror" * 30), (101, "".join(rng.choice(list("ab"), 3000)))]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(fixtures.frame(spark, docs)).collect()}
    want = {d: (int(g.sum()), bytes(np.frombuffer(raw, np.uint8)[~g])) for (d, _), (raw, g) in zip(docs, fixtures.plain_repeats(docs))}
    assert got == want


@pytest.mark.parametrize("others", [0, 1])
def test_mark_of_a_crowded_anchor_outlives_an_earlier_place(others):
    # a crowded batch left its marked run of anchor 7; a batch that is not crowded has the same run earlier, and perhaps another one
    runs = [(9, 5, suffixes._BY_STRING), (1, 5, suffixes._JUDGE), (2, 6, suffixes._JUDGE)][: 2 + others]
    cols = {"id": [r[0] for r in runs], "hash": [0] * len(runs), "start": [0] * len(runs), "count": [50] * len(runs), "anchor": [7] * len(runs),
            "digest": np.array([r[1] for r in runs], "<u8"), "state": [r[2] for r in runs]}
    packed = pd.DataFrame({k: [suffixes._pack(k, np.array(v))] for k, v in cols.items()})
    found = suffixes._gather(64)(packed)
    states = dict(zip(found["id"], found["state"]))
    assert states == {1: suffixes._BY_STRING, 9: suffixes._REPEATS} | ({2: suffixes._BY_STRING} if others else {})


@pytest.mark.parametrize("collide", [False, True])
def test_texts_that_meet_in_a_hash_stay(spark, monkeypatch, collide):
    """Two rows without an id whose texts have the same 32-bit hash, and rows whose hashes are all alike: no text goes that stands nowhere else."""
    rng = np.random.default_rng(21)
    if collide:
        monkeypatch.setattr(suffixes, "_text_hash", lambda: F.lit(7).cast("bigint"))
    texts = ["".join(rng.choice(list("abcdefghijklmnop "), 150)) for _ in range(4)]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (3, texts[3])]
    kept = sorted(bytes(r.kept).decode() for r in suffixes.remove_repeats(fixtures.frame(spark, docs)).collect())
    assert kept == sorted([*texts, ""])


@pytest.mark.parametrize("turn", range(3))
def test_copies_of_texts_that_meet_in_a_hash_go_in_any_order(spark, monkeypatch, turn):
    """Whichever of two texts with one id and hash comes first, of each one copy stays."""
    rng = np.random.default_rng(22)
    monkeypatch.setattr(suffixes, "_text_hash", lambda: F.lit(7).cast("bigint"))
    texts = ["".join(rng.choice(list("abcdefghijklmnop "), 150)) for _ in range(3)]
    docs = [(5, t) for t in texts[turn:] + texts[:turn] for _ in range(2)]
    kept = sorted(bytes(r.kept).decode() for r in suffixes.remove_repeats(fixtures.frame(spark, docs, 1)).collect())
    assert kept == sorted([*texts, "", "", ""])


def test_a_row_given_twice_keeps_its_text_once(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(400)]
    phrase = " ".join(rng.choice(words, 14))
    docs = [(i, " ".join(rng.choice(words, 30)) + f" {phrase} " + " ".join(rng.choice(words, 30))) for i in range(12)]
    docs += docs[:6] + docs[:2]
    for hot in (64, 1):
        got = {}
        for r in suffixes.remove_repeats(fixtures.frame(spark, docs, 5), 100, hot).collect():
            got.setdefault(r.doc_id, []).append((r.n_removed, bytes(r.kept)))
        want = {}
        for (d, _), (raw, gone) in zip(docs, fixtures.plain_repeats(docs)):
            want.setdefault(d, []).append((int(gone.sum()), bytes(np.frombuffer(raw, np.uint8)[~gone])))
        assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_repeats_of_the_given_table(spark, scale):
    df = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()}
    assert got == {d: (int(g.sum()), bytes(np.frombuffer(raw, np.uint8)[~g])) for (d, _), (raw, g) in zip(docs, fixtures.plain_repeats(docs))}


def test_blocks_of_a_long_text_find_every_string():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 105, 5000).astype(np.uint8)
    text, start, count, *_ = suffixes.find_runs(data, np.array([2000, 50, 2950]), 100)
    covered = sorted((t, s + k) for t, s, n in zip(text.tolist(), start.tolist(), count.tolist()) for k in range(n))
    assert covered == [(0, i) for i in range(1901)] + [(2, i) for i in range(2851)]


def test_merged_transforms_find_common_prefixes():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[2000:2300] = text[100:400]
    sizes = np.full(20, 200)
    starts = np.arange(20) * 200
    symbols = suffixes.symbol_ranks(text, 25)
    shards = [suffixes.shard_transform(symbols, starts[a:a + 5], sizes[a:a + 5], 25) for a in range(0, 20, 5)]
    places, prefix = suffixes.merge_transforms(shards, 4)
    raw = text.tobytes()
    group = {}
    for p, new in zip(places.tolist(), np.cumsum(prefix < 4).tolist()):
        if p >= 0 and p % 200 <= 100:
            group.setdefault(new, set()).add(raw[p:p + 100])
    assert all(len(g) == 1 for g in group.values())
    assert len(group) == len(set().union(*group.values()))


def test_symbol_ranks_are_exact():
    text = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcxbc" * 3, np.uint8)
    ranks = suffixes.symbol_ranks(text, 25)
    grams = [text[i:i + 25].tobytes().ljust(25, b"\0") for i in range(len(text))]
    assert all((ranks[i] == ranks[j]) == (grams[i] == grams[j]) for i in range(len(text)) for j in range(i))


@pytest.mark.parametrize("top", [5, 1 << 20, 1 << 31])
def test_ranks_of_pairs_and_keys(top):
    rng = np.random.default_rng(13)
    a, b = rng.integers(0, top, 3000), rng.integers(0, top, 3000)
    want = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)[1].ravel()
    assert (suffixes.pair_ranks(a, b) == want).all() and (suffixes.dense_ranks(suffixes._pair(a, b)) == want).all()
    assert len(suffixes.pair_ranks(a[:0], b[:0])) == 0


@pytest.mark.parametrize("options", [{}, {"region": 8}, {"percent": 80}])
def test_groups_equal_brute_force(spark, options):
    docs = fixtures.family()
    got = near_duplicates(fixtures.frame(spark, docs, 4), **options).drop("hash").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, fixtures.plain_components(docs, options.get("percent", 85))))


def test_one_of_each_group_stays(spark):
    docs = fixtures.family(seed=9)
    kept = keep_one(fixtures.frame(spark, docs, 4), 80).collect()
    with_words = sorted(map(str, fixtures.plain_components(docs, 80, by_group=True)))
    assert sorted(str(r.doc_id) for r in kept if fixtures.words_of(r.text)) == with_words
    assert len([r for r in kept if not fixtures.words_of(r.text)]) == len({(d, t) for d, t in docs if not fixtures.words_of(t)})


def test_large_regions_of_boilerplate_equal_brute_force(spark):
    """A thousand texts share half or four fifths of their words, so labels are alike; two hundred are near copies at little over the threshold."""
    rng = np.random.default_rng(12)
    docs = []
    for own in (60, 25):
        boilerplate = [f"b{own}x{k}" for k in range(110 if own == 25 else 60)]
        for i in range(500):
            words = [f"w{own}x{i}x{k}" for k in range(own)]
            docs.append((len(docs), " ".join(boilerplate + words)))
            if i % 5 == 0:  # some words cut off the end
                changed = words[: -int(rng.integers(10, 18))]
                docs.append((len(docs), " ".join(boilerplate + changed)))
    got = near_duplicates(fixtures.frame(spark, docs, 4), region=8).drop("hash").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, fixtures.plain_components(docs, 85)))


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_sorted_orders_find_common_prefixes(spark, monkeypatch, ranges):
    """At every depth, what neighbours lead to are the nodes that share so long a prefix of some tree's label, wherever ranges end."""
    monkeypatch.setattr(minhash, "shuffle_partitions", lambda spark: ranges)
    rng = np.random.default_rng(3)
    minima = rng.integers(0, 3, (150, minhash.TREES * minhash.DEPTH)).astype("<u4")
    minima[40:80, :6] = 1  # one long run in the first tree
    minima[:, 12:] += (np.arange(150, dtype="<u4") * 10)[:, None]  # only the first two trees have common prefixes
    forest = minhash._forest(spark.createDataFrame([(i, bytes(m.tobytes())) for i, m in enumerate(minima)], "node bigint, minima binary").repartition(5)).cache()
    for depth in range(minhash.LEAST, minhash.DEPTH + 1):
        links = []
        for tree in range(minhash.TREES):
            prefix = [tuple(m[tree * minhash.DEPTH: tree * minhash.DEPTH + depth]) for m in minima]
            links += [(i, j) for i in range(150) for j in range(i) if prefix[i] == prefix[j]]
        want = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        assert {r.node: r.root for r in components(minhash._runs(forest, depth)).collect()} == want


@pytest.mark.parametrize("options", [{}, {"region": 8}])
def test_links_are_stored_before_their_forests(spark, monkeypatch, options):
    """What finds links and what makes forests of them never share a task, which would hold two Python workers and leave both with its executor."""
    plans, real = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or real(links))
    near_duplicates(fixtures.frame(spark, fixtures.family(), 4), **options).count()
    assert len(plans) >= 2 and not any(python in plan for plan in plans for python in ("MapInArrow", "InPandas"))


def test_a_row_repeated_very_often(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(7, text)] * 20_000 + [(8, text + " more"), (9, text), (None, None), (None, None)]
    got = near_duplicates(fixtures.frame(spark, docs, 6)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(7, 7, True, 20_000), (8, 7, False, 1), (9, 7, False, 1), (None, None, True, 2)}


def test_unlinked_texts_with_null_or_repeated_ids_stay(spark):
    docs = [(d, " ".join(f"{w}{d}{k}{i}" for i in range(9))) for d, w in ((None, "x"), (7, "y")) for k in range(3)] + [(8, "a b c d e f")] * 2
    kept = keep_one(fixtures.frame(spark, docs, 4), 80).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, set(docs)))


def test_empty_tables(spark):
    empty = fixtures.frame(spark, [(1, "a")]).where("false")
    assert near_duplicates(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 7) % 50) for i in range(50)] + [(5, 5), (3, 2)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {2000 + i: 2000 for i in range(50)}


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_components_of_hubs_and_long_paths(spark, monkeypatch, held):
    """Links that fit a task need two steps whatever their paths; more of them meet in stars, with hubs that lie below and above their neighbours."""
    steps = []
    monkeypatch.setattr(graphs, "TASK_LINKS", held)
    monkeypatch.setattr(graphs, "HUB_SHARE", 8)
    monkeypatch.setattr(graphs, "materialise", lambda df: steps.append(df) or materialise(df))
    links = [(i + 1, i) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000 + i) for i in range(300)] + [(4007, 301)]
    rows = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    found = {r.node: r.root for r in components(rows).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)} | {i: 301 for i in (301, *range(4000, 4300), 5000)}
    assert len(steps) == 2 if held > len(links) else len(steps) > 2


def test_forest_keeps_components():
    rng = np.random.default_rng(17)
    a, b = rng.integers(0, 400, (2, 300))
    a, b = a[a != b], b[a != b]
    want = {n: min(g) for g in _groups(zip(a.tolist(), b.tolist())) for n in g if n != min(g)}
    assert dict(zip(*(x.tolist() for x in graphs._forest(a, b)))) == want


def _groups(links):
    groups = []
    for a, b in links:
        met = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in met] + [set().union({a, b}, *met)]
    return groups
