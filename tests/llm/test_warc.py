import base64
import glob
import gzip
import hashlib

import pytest

from tabprofile.llm import warc


def plain(rows):
    """Rows of the contract from (page_id, url, html)."""
    payloads = [(h or "").encode() for _, _, h in rows]
    least = -(1 << 63)
    out = []
    for (page, url, _), body in zip(rows, payloads):
        keeper = max((p if p is not None else least) for (p, _, _), b in zip(rows, payloads) if b == body)
        first = (least if page is None else page) == keeper
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, url, len(body), digest, "response" if first else "revisit", None if first else keeper))
    return sorted(out, key=repr)


PAGES = [
    (1, "http://www.example.com/a", "<p>one</p>"), (2, "https://example.org:8443/B?x=1#top", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "", ""), (5, "no url", None),
    (6, "http://[broken", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (None, "http://www.example.com/a", "<p>one</p>"), (None, None, "only null"), (7, "http://x.y/\r\nWARC-Type: %0d é", "ü\0\r\n\r\n"),
    (11, "http://x.y/a%20b%", "percent"), (8, "http://x.y/same", "twice"), (8, "http://x.y/same", "twice"), (9, "http://x.y/same", "thrice"), (9, "http://x.y/same", "other"), (10, "http://x.y/long", "z" * 3_000_000)]
PAGES += [(100 + i, "http://hot.example.com/one", f"text {i % 7}") for i in range(60)]


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "a")
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' AS page", "'y' AS digest", "1 AS keeper", "2 AS n").repartition(3)
    warc.write_archives(df, folder, records=20)
    return df, folder


def test_round_trip_through_the_index(spark, archives, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 3)
    monkeypatch.setattr(warc, "SHARD_CAPTURES", 9)
    df, folder = archives
    index = warc.build_index(warc.captures(spark, folder))
    assert len(index.top) > 5 and index.blocks.where("kind = 1").count() > 20
    got = warc.read_ranges(warc.lookup(index, df)).collect()
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain(PAGES)
    texts = {(p, u): (h or "").encode() for p, u, h in PAGES if p != 9}
    assert all(r.payload == texts[r.page_id, r.url] for r in got if r.record_type == "response" and r.page_id != 9)
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_lookup_finds_what_is_asked(spark, archives):
    _, folder = archives
    index = warc.build_index(warc.captures(spark, folder))
    asked = spark.createDataFrame([("http://www.example.com/a", 1), ("http://www.example.com/a", 2), ("http://aaa/", 1), ("http://zzz.zzz/", None), ("https://WWW.example.com:443/a#x", 1)], "url string, page_id bigint")
    got = warc.lookup(index, asked).collect()
    assert [(r.key, r.page) for r in got] == [("com,example,www)/a", 1)]
    alone = warc.read_ranges(warc.lookup(index, asked), with_payload=False).collect()
    assert [(r.page_id, r.record_type, r.payload) for r in alone] == [(1, "revisit", None)]


def test_archives_are_gzip_files_of_whole_records(archives):
    total = 0
    for path in glob.glob(archives[1] + "/part-*"):
        with open(path, "rb") as file:
            content = file.read()
        whole = gzip.decompress(content)
        found = list(warc.members(content))
        assert b"".join(raw for _, _, raw in found) == whole
        assert [o for o, _, _ in found] == [0, *[o + n for o, n, _ in found[:-1]]] and len(found) <= 20
        total += len(found)
    assert total == len(PAGES)


def test_long_member_ends_with_the_separator():
    raw = bytes(17 << 20)
    packed = warc.member(raw) + warc.member(b"next")
    assert warc.member(raw).endswith(b"\0")
    assert [(len(r), packed[o: o + n] != b"") for o, n, r in warc.members(packed)] == [(len(raw), True), (4, True)]


def test_damage_is_noticed(spark, tmp_path):
    record = warc.record_bytes(1, "http://a/", b"text", None, False, "1970-01-01T00:00:00Z").replace(b"text", b"tex_")
    (tmp_path / "a").write_bytes(warc.member(record))
    places = warc.captures(spark, str(tmp_path))
    with pytest.raises(Exception, match="damaged"):
        warc.read_ranges(places).collect()
    (tmp_path / "a").write_bytes(warc.member(record)[:-12])
    with pytest.raises(Exception, match="ends within"):
        warc.captures(spark, str(tmp_path)).collect()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    index = warc.build_index(warc.captures(spark, str(tmp_path / "w")))
    assert warc.read_ranges(warc.lookup(index, df)).count() == 0


@pytest.mark.parametrize("url, key", [
    (None, ""), ("", ""), ("http://www.Example.com", "com,example,www)/"), ("https://u:p@a.b:8080/x?q#f", "b,a:8080)/x?q"), ("plain", ")plain"), ("http://[x", ")http://[x"), ("http://a:99999/", ")http://a:99999/")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key
