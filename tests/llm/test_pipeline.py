import corpus_pipeline
import fixtures
import numpy as np
import pytest
from tokenizers import Tokenizer

from tabprofile.llm.common import default_tokenizer
from tabprofile.session import materialise

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark):
    """The stages' results over a corpus with junk, near copies, shared passages and null columns."""
    docs = [(i, t, ("en", "de")[i % 2] if i % 7 else None, ("a", "b", None)[i % 3]) for i, (_, t) in enumerate(fixtures.corpus(n=60) + fixtures.family()[:120])]
    given = materialise(fixtures.frame(spark, docs).select(*COLUMNS))
    found = [given]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialise(stage(spark, found[-1], "")))
    return found


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_stay(stages):
    assert [s.columns for s in stages[:-1]] == [COLUMNS] * 5
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixture", "packing"]


def test_language_drops_only_texts_without_letters(stages):
    with_letters = [r for r in rows(stages[0]) if any(c.isalpha() for c in r[1] or "")]
    assert sorted(map(str, rows(stages[1]))) == sorted(map(str, with_letters))


def test_nothing_is_dropped_for_want_of_languages(spark):
    docs = [(1, "eins zwei", None, "a"), (2, None, None, "a"), (3, "12 ...", None, "b"), (None, "drei é", None, None), (4, "", None, "b")]
    given = fixtures.frame(spark, docs).select(*COLUMNS)
    assert sorted(r.text for r in corpus_pipeline.language(spark, given, "").collect()) == ["drei é", "eins zwei"]


def test_one_of_each_group(stages):
    given = rows(stages[1])
    groups = fixtures.plain_components([(r[0], r[1]) for r in given], 80)
    assert sorted(r[0] for r in rows(stages[2])) == sorted({g[2] for g in groups})
    assert set(rows(stages[2])) <= set(given)


def test_passages_are_cut(stages):
    given = rows(stages[2])
    want = {}
    for r, (raw, gone) in zip(given, fixtures.plain_repeats([(r[0], r[1]) for r in given])):
        want[r[0]] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
    assert {r[0]: r[1] for r in rows(stages[3])} == want
    assert all(r[4] == len(r[1]) for r in rows(stages[3]))


def test_mixture_repeats_rows(stages):
    given, taken = rows(stages[3]), rows(stages[4])
    assert set(taken) <= set(given)
    assert max(taken.count(r) for r in set(taken)) <= 2
    sizes = [len(fixtures.words_of(r[1])) for r in given]
    # each of the three sources comes within its largest document of its target
    assert abs(sum(len(fixtures.words_of(r[1])) for r in taken) - 1.5 * sum(sizes)) <= 3 * max(sizes)


def test_all_tokens_are_packed(stages):
    plain = Tokenizer.from_file(default_tokenizer())
    want = sum(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows(stages[4]))
    assert stages[5].selectExpr("sum(length)").first()[0] == want


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], fixtures.SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""))
    assert docs.count() == 0
