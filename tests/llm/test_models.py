import collections
import dataclasses
import math

import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.llm import crf, indexing, masked_lm, quality_rules
from tabprofile.llm import queries as llm

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_languages_of_held_out_documents(spark, tables):
    got = llm.op2_language(spark, FOLDER).join(tables[0].select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == tables[0].count() and len(held) > 100
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_switching_text_is_labelled_word_by_word(tables):
    rows = [(r.text, r.lang) for r in tables[0].where("lang in ('en', 'de')").limit(200).collect()]
    model = crf.train(rows)
    en, de = (crf.words_of(next(t for t, lang in rows[150:] if lang == k))[:30] for k in ("en", "de"))
    scores = model.rows([en + de])
    found = crf.chained(scores, np.array([60]), model.transitions, model.starts).argmax(axis=1)
    assert (found == np.repeat([model.languages.index("en"), model.languages.index("de")], 30)).mean() > 0.9


@pytest.mark.parametrize("bound", [32_000, 70])
def test_every_language_is_learned(spark, monkeypatch, bound):
    monkeypatch.setattr(crf, "TRAIN_ALL", bound)
    rng = np.random.default_rng(7)
    words = [["".join(rng.choice(list("abcdefghijklmnoprstu"), 6)) for _ in range(30)] for _ in range(70)]
    rows = [(i, " ".join(rng.choice(words[i % 70], 200)), f"l{i % 70:02}") for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = crf.learn(docs, F.col("doc_id") < 280)
    assert model.languages == sorted({r[2] for r in rows})
    found = crf.predict_languages(docs.where("doc_id >= 280").drop("lang"), model).collect()
    assert len(found) == 140 and all(r.lang_pred == f"l{r.doc_id % 70:02}" for r in found)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, move, first = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    total, single = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(first[path[0]] + sum(scores[0, t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, k in enumerate(path):
            single[t, k] += p
    got = crf.forward_backward(scores, np.array([4]), move, first)
    assert np.allclose(got[0], single / total)


def test_language_edge_cases(spark):
    model = crf.train([("the of and is " * 5, "en"), ("der die und das " * 5, "de")] * 5)
    docs = [(1, None), (2, ""), (3, "123 ### \n"), (4, "the of and"), (4, "the of and"), (None, "der die das"), (5, "und der " * 40_000)]
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0.5) for r in crf.predict_languages(fixtures.frame(spark, docs), model).collect())
    assert got == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", "en", True), ("4", "en", True), ("5", "de", True), ("None", "de", True)]
    nothing = crf.learn(fixtures.frame(spark, docs).where("false"), F.lit(True))
    assert {r.lang_pred for r in crf.predict_languages(fixtures.frame(spark, docs), nothing).collect()} == {"und"}
    assert crf.predict_languages(fixtures.frame(spark, docs).where("false"), model).count() == 0


def plain_counts(text):
    w = fixtures.words_of(text)
    seen = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k:k + 8]), []).append(k)
    repeated = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if fixtures.words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_plain_ones(tables):
    texts = [r.text for r in tables[0].limit(300).collect()] + [None, "", "a b c d e f g h " * 3, "x\n\nx\n x\nx", " é ß #|", "a " * 50]
    for t in texts:
        assert quality_rules.statistics(t)[0] == plain_counts(t)


def test_rules_keep_good_documents(spark, tables):
    got = llm.op5_quality_rules(spark, FOLDER).join(tables[1], "doc_id").where(~F.col("base_failed")).collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98


def test_trees_are_monotonic_where_asked():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(2000, 2))
    y = (np.sin(8 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 2000) > 0.5).astype(float)
    trees = quality_rules.grow(x, y, [-1, 0])
    line = np.linspace(0, 1, 200)
    for other in (0.1, 0.5, 0.9):
        assert (np.diff(trees.score(np.stack([line, np.full(200, other)], axis=1))) <= 1e-12).all()
    free = quality_rules.grow(x, y, [0, 0])
    assert ((free.score(x) > 0.5) == (y > 0.5)).mean() > 0.85


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)]])
def test_models_without_enough_labels(spark, labels):
    docs = fixtures.frame(spark, [(1, None), (2, "word " * 30), (None, "### " * 30), (2, "")])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert quality_rules.apply_rules(docs, quality_rules.learn_rules(docs, table)).count() == 4
    assert all(0 <= r.score <= 1 for r in indexing.score_quality(docs, indexing.learn_quality(docs, table)).collect())
    assert indexing.score_quality(docs.where("false"), indexing.learn_quality(docs.where("false"), table)).count() == 0
    assert quality_rules.apply_rules(docs.where("false"), quality_rules.learn_rules(docs.where("false"), table)).count() == 0


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = llm.op8_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert np.mean([r.predicted for r in got if r.quality == 1]) > 0.97
    assert docs.count() == 10_000


def test_word_vectors_sum_neighbours():
    words, counts = indexing.word_classes([b"aa bb ###", b"", b"CC dd"])
    assert counts.tolist() == [3, 0, 2] and len(set(words.tolist())) == 5


def test_pseudo_likelihood_prefers_the_language_of_the_corpus(spark, tables):
    model = masked_lm.learn_model(tables[0], 1)
    plain = masked_lm.learn_model(tables[0], 0)
    total = [masked_lm.score_documents(tables[0], m).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first() for m in (plain, model)]
    assert total[0][1] == total[1][1] == sum(len(fixtures.words_of(r.text)) for r in tables[0].select("text").collect())
    assert total[1][0] > 0.85 * total[0][0]  # nearer to zero


def test_window_gradient_equals_differences():
    rng = np.random.default_rng(0)
    w = masked_lm.Weights.fresh(1)
    w = masked_lm.Weights(*[a.astype(np.float64) for a in w.arrays()])
    tokens = rng.integers(0, 1024, 12)
    near = masked_lm.windows(tokens, np.array([5, 7]))
    before = [a.copy() for a in w.arrays()]
    sums = [np.full(a.shape, 1e12) for a in w.arrays()]  # steps of g * RATE / 1e6
    masked_lm.train_step(w, sums, near, tokens)
    for k, (a, b) in enumerate(zip(before, w.arrays())):
        at = np.unravel_index(np.abs(a - b).argmax(), a.shape)
        slope = (a - b)[at] * 1e6 / masked_lm.RATE
        values = []
        for shift in (1e-4, -1e-4):
            moved = [x.copy() for x in before]
            moved[k][at] += shift
            values.append(-masked_lm.log_probabilities(masked_lm.Weights(*moved), near, tokens).mean())
        assert abs((values[0] - values[1]) / 2e-4 - slope) < 1e-3 * max(1, abs(slope))


def test_scoring_edge_cases(spark):
    docs = fixtures.frame(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c " * 70_000)])
    got = masked_lm.score_documents(docs, masked_lm.learn_model(docs, 1)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 2, 70_000]
    assert all((r.per_token is None) == (r.n_tokens == 0) and r.log_likelihood <= 0 for r in got)
    assert masked_lm.score_documents(docs.where("false"), masked_lm.learn_model(docs.where("false"), 1)).count() == 0


def test_every_token_is_learned_and_words_of_a_class_are_told_apart(spark, monkeypatch):
    # more words than tokens: "sword" is much rarer than "aword" of the same ending and case
    texts = [" ".join(f"x{i:03d}q" for i in range(k, k + 60)) for k in range(0, 600, 60) for _ in range(3)] + ["aword " * 2] * 1 + ["sword"]
    docs = fixtures.frame(spark, list(enumerate(texts)))
    learned, average = [], masked_lm._average
    monkeypatch.setattr(masked_lm, "_average", lambda pdf: learned.append(int(pdf["n"].sum())) or average(pdf))
    model = masked_lm.learn_model(docs, 1)
    words = sum(len(t.split()) for t in texts)
    assert learned[-1] == words  # the last call sums over all tasks
    counts = collections.Counter(w for t in texts for w in t.split())
    whole, kind, _ = masked_lm.word_hashes([w.encode() for w in counts])
    tokens = model.vocabulary.tokens(whole, kind)
    totals = collections.Counter()
    for t, n in zip(tokens, counts.values()):
        totals[t] += n
    share = {w: 0.0 if t < masked_lm.WHOLE else math.log(n / (totals[t] + 1)) for (w, n), t in zip(counts.items(), tokens)}
    assert {"aword", "sword"} <= {w for w, v in share.items() if v < 0}
    flat = masked_lm.Shares(model.shares.hashes[:0], model.shares.logs[:0], model.shares.table, model.shares.unseen)
    asked = fixtures.frame(spark, [(1, "aword x001q sword sword"), (2, "never aword"), (None, None)])
    got = [{r.doc_id: r for r in masked_lm.score_documents(asked, m).collect()} for m in (model, dataclasses.replace(model, shares=flat))]
    assert got[0][1].log_likelihood == pytest.approx(got[1][1].log_likelihood)  # sent to all tasks, or joined
    for key, text in ((1, "aword x001q sword sword"), (2, "never aword")):
        whole, kind, n = masked_lm.word_hashes([text.encode()])
        tokens = model.vocabulary.tokens(whole, kind)
        logs = masked_lm.log_probabilities(model.weights, masked_lm.windows(tokens, n), tokens)
        own = [share.get(w, -math.log(totals[t] + 1)) for w, t in zip(text.split(), tokens)]
        assert got[0][key].log_likelihood == pytest.approx(logs.sum() + sum(own), rel=1e-6)
