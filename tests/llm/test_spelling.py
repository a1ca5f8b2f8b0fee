import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import frame
from pyspark.sql import functions as F

from tabprofile.llm import spelling


def plain_counts(docs, every=97):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run if h % every else run[: h % len(run)] + run[h % len(run) + 1:]] += 1
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    out, form = [], {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out.append([w, form[w], w, n, len(close), counts[best] if form[w] is not None else None])
    for row in out:
        while form[row[2]] is not None:
            row[2] = form[row[2]]
    return sorted(map(tuple, out))


def texts(seed=7):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcÀé÷z", k=rng.randint(1, 9))) for _ in range(60)]
    docs = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.08)), 59)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("ABCz") + w[at + 1:]])
            words.append(w)
        docs.append((i, rng.choice([" ", ", ", "1", "Ā"]).join(words)))
    return docs + [(None, "Straße straße STRASSE"), (200, None), (201, ""), (202, "12 ..."), (7, docs[7][1]), (7, docs[7][1]), (203, ("q" * 300 + " ") * 3 + ("q" * 299 + "r ") * 7 + ("q" * 299 + " ") * 20), (204, "ab" * 9000)]


@pytest.mark.parametrize("every", [97, 5])
def test_counts(spark, monkeypatch, every):
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    got = spelling.word_counts(frame(spark, texts()), every).collect()
    assert {r.word: r.n for r in got} == plain_counts(texts(), every) and len({r.word for r in got}) == len(got)


@pytest.mark.parametrize("squeeze", [False, True])
def test_variants_equal_brute_force(spark, monkeypatch, squeeze):
    monkeypatch.setattr(spelling, "LONG", 8)
    if squeeze:  # tiny filters pass nearly everything, and the join has to drop it; segments and pieces are small
        monkeypatch.setattr(spelling, "MAX_FILTER_BYTES", 600)
        monkeypatch.setattr(spelling, "SEGMENT_BYTES", 64)
        monkeypatch.setattr(spelling, "PROBES", 50)
    counts = spelling.word_counts(frame(spark, texts()), 5)
    got = spelling.variants(counts, (F.length("word") >= 5) & (F.col("n") >= 3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants({w: n for w, n in plain_counts(texts(), 5).items() if len(w) >= 5 and n >= 3})
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # some chains are longer than one step


def test_long_chain_ties_and_odd_rows(spark):
    chain = {"aaaaa" + "b" * k: 3 * 2 ** k for k in range(8)}
    rows = list(chain.items()) + [("zzzzz", 5), ("zzzzy", 10), ("zzzzx", 10), ("zzzzz", 0), (None, 4), ("", 9), ("k", 1), ("ÿà", 2)]
    df = spark.createDataFrame(rows, "word string, n bigint")
    merged = Counter()
    for w, n in rows:
        if w is not None:
            merged[w] += n
    assert sorted(map(tuple, spelling.variants(df).collect()), key=lambda r: r[0]) == plain_variants(merged)
    assert spelling.variants(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(df, factor=1)


def test_filters_hold_every_word_and_few_others(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcdefgh", k=rng.choice([5, 6, 45]))) for _ in range(3000)}
    filters = spelling.build_filters(spark.createDataFrame([(w,) for w in words], "word string"))
    for length, _, codes in spelling._by_length(sorted(words)):
        assert len(filters.maybe(spelling._shard(length), spelling._hashes(codes))) == len(codes)
        other = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
        assert len(filters.maybe(spelling._shard(length), other)) < 400
