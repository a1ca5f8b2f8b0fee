import zlib

import fixtures
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabprofile.llm import common
from tabprofile.llm.common import Encoder, default_tokenizer
from tabprofile.llm.packing import best_fill, fill_sequences, pack
from tabprofile.llm.tokens import decode_many, decode_ranks, encode_many, encode_ranks, read_tokens, token_digest, write_tokens
from tabprofile.sources.sinks import scratch_path


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def fast():
    return Encoder(open(default_tokenizer(), encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab' s.!\n\t é0|<>endoftxA  "), max_size=60) | st.text(max_size=30))
def test_pieces_give_the_ids_of_the_whole_text(plain, fast, text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(fast.encode([text])[0], fast.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_special_token_inside_a_text(plain, fast):
    text = "a <|endoftext|> b<|endoftext|>"
    assert np.frombuffer(fast.encode([text, None])[0], fast.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'.,&é\n\n\n 0"), max_size=12), max_size=8))
def test_lines_give_the_ids_of_the_whole_text(plain, fast, parts):
    text = " ".join(parts)
    assert np.frombuffer(fast.encode([text])[0], fast.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_known_lines_are_not_encoded_again(plain):
    """Words meet in new pairs wherever lines end; the library is asked once for each of them."""
    enc = Encoder(open(default_tokenizer(), encoding="utf-8").read())
    words = [f"wörd{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    enc.encode(["x " + " ".join(words) + "\n" + "\n".join(words)])
    asked = []
    enc._whole = lambda texts: asked.extend(texts) or [np.array(plain.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    encode_all = enc._encode_all
    enc._encode_all = lambda new, *where: asked.extend(new) or encode_all(new, *where)
    text = "x " + " ".join(f"{a}\n{b}" for a, b in zip(words[1:], words))
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not [a for a in asked if a != "x"]


def test_a_claim_releases_what_others_hold(monkeypatch):
    given_back, released = [], []
    monkeypatch.setattr(common, "_CLAIMED", {})
    monkeypatch.setattr(common, "give_back", lambda: given_back.append(1))
    common.claim("a", lambda: released.append("a"))
    common.claim("a", lambda: released.append("a"))
    common.powers(8)
    common.claim("b", lambda: released.append("b"))
    assert released == ["a"] and list(common._CLAIMED) == ["b"] and len(given_back) == 3 and common._powers.cache_info().currsize == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_coding_round_trip(ranks):
    control, data = encode_ranks(np.array(ranks, "<u4"))
    assert len(control) == -(-len(ranks) // 4)
    assert decode_ranks(control, data, len(ranks)).tolist() == ranks


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300) | st.integers(0, 2**17), max_size=9), max_size=9))
def test_documents_are_coded_together_as_alone(docs):
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.array([r for d in docs for r in d], "<u4")
    control, data = encode_many(flat, sizes)
    assert list(zip(control.to_pylist(), data.to_pylist())) == [encode_ranks(np.array(d, "<u4")) for d in docs]
    assert decode_many(b"".join(control.to_pylist()), b"".join(data.to_pylist()), sizes).tolist() == flat.tolist()


def expected(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 0]


def test_digest_equals_whole_encoding(spark, plain):
    docs = fixtures.corpus(n=60)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_digest(fixtures.frame(spark, docs), default_tokenizer()).collect())
    want = sorted((-1 if d is None else d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in docs for i in [expected(plain, t)])
    assert sorted((d, n, c) for d, _, n, c in got) == want
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: (r[0], r[1])):
        assert start == at
        at += n


def test_files_are_ordered_and_ranks_follow_frequency(spark, plain):
    docs = [(i, t) for i, (_, t) in enumerate(fixtures.corpus(n=30))]
    path = scratch_path(spark, "test")
    write_tokens(fixtures.frame(spark, docs), path, default_tokenizer(), partitions=3)
    placed = spark.read.parquet(f"{path}/data").selectExpr("shard", "doc_id", "_metadata.file_path AS f", "monotonically_increasing_id() AS m").collect()
    by_file = {}
    for r in sorted(placed, key=lambda r: r.m):
        by_file.setdefault((r.shard, r.f), []).append(r.doc_id)
    files = sorted(by_file.items(), key=lambda p: (p[0][0], p[1][0]))
    assert [d for _, docs_ in files for d in docs_] == sorted(r.doc_id for r in placed)
    counts = np.bincount(np.concatenate([expected(plain, t) for _, t in docs]))
    ranked = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ranked == sorted(np.flatnonzero(counts), key=lambda i: (-counts[i], i))
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in read_tokens(spark, path).collect()}
    assert back == {d: expected(plain, t) for d, t in docs}


def test_empty_tables(spark):
    empty = fixtures.frame(spark, [(1, "a")]).where("false")
    assert token_digest(empty, default_tokenizer()).count() == 0
    assert pack(empty, default_tokenizer()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(0, 30))
def test_best_fill_is_the_largest_sum(lengths, room):
    counts = np.bincount(lengths, minlength=max(room, 13) + 1)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    used = best_fill(counts, room)
    assert sum(k * v for k, v in used.items()) == max(sums)
    assert all(counts[k] >= v for k, v in used.items())


def test_patterns_fill_exactly():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 64, 20_000), minlength=65)
    before = counts.copy()
    patterns = fill_sequences(counts, 64)
    used = np.zeros_like(counts)
    for p, times in patterns:
        assert sum(k * v for k, v in p.items()) == 64
        for k, v in p.items():
            used[k] += v * times
    assert (used + counts == before).all()
    assert (np.arange(65) * counts).sum() < 0.2 * (np.arange(65) * before).sum()


@pytest.mark.parametrize("pool", [16, 32768])
def test_every_id_is_in_one_piece(spark, plain, pool):
    docs = [(i, t) for i, (_, t) in enumerate(fixtures.corpus(n=60))] + [(3, fixtures.corpus()[3][1]), (None, "x y")]
    rows = pack(fixtures.frame(spark, docs, 2), default_tokenizer(), pool=pool).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for d, text in docs:
        if d == 3:
            continue  # stands twice
        parts = sorted(by_doc[d], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist()
        assert ids == expected(plain, text) and all(r.doc_tokens == len(ids) for r in parts)
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
    assert sum(r.length for r in by_doc[3]) == 2 * len(expected(plain, docs[3][1]))
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        total = sum(r.length for r in parts)
        assert total <= 1024 and total & total - 1 == 0  # a power of two needs no padding


def test_words_are_remembered_once_whatever_follows_them():
    """Signs and line feeds behind words are pieces of their own, and ids are those of the library on whole texts."""
    enc = Encoder(open(default_tokenizer(), encoding="utf-8").read())
    words = [f"{a}{b}on" for a in ("wort", "été", "Straße", "lun") for b in "abcdefghij"]
    texts = ["; ".join(words)] + [f"{w}, x {w}. x {w}.\n{v} x {w}\n{v},\n{v}" for w, v in zip(words, words[1:])]
    odd = ["a., b", "(a), b. c", ", a", ". a\nb", "a\n\nb, c", "a, b\n", "a\n b. c", "1, 2. 3", "²., x", "a \x01, b", "it's, we'll. x", "a, b.", "\na. b", "a,\nb", "a,b. c,", "", " a, b", "a . b , c"]
    for many in (texts, odd):
        assert enc.encode(many) == enc._whole(many)
    spaced = {p for p in enc.later if not p.startswith("\x01")}
    assert not {f"{w}{s}" for w in words for s in (",", ".")} & spaced
    assert not any("\n" in p and p.split("\n")[0] in words for p in spaced)
