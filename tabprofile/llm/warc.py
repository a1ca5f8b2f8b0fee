"""Operator 13: web archives with a two-level capture index, and range reads through it.

Archives are plain files of gzip members, one member a record, so that a record is read by file, offset and length alone.  The index
lists captures by reversed-host URL key in compressed blocks; every shard of it has a sparse directory of its blocks' first keys, and the
first keys of the shards are the top.  A lookup searches top, directory and block by halving and then reads one range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprofile.session import materialise, shuffle_partitions

#: Records in one archive file at most; a file is read whole when it is indexed.
ARCHIVE_RECORDS = 20_000
#: Captures in one compressed block of the index, and at most in one of its shards.
BLOCK_CAPTURES = 512
SHARD_CAPTURES = 1 << 20
#: Bytes that a reader fetches at once; one longer record is fetched whole.
WINDOW_BYTES = 4 << 20
#: Members end with this byte, see :func:`member`.
_END = b"\0"
_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
_NO_ID = -(1 << 63)

CAPTURE = "key string, page bigint, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels from the last to the first, port, path and query; null gives ``""``.

    Scheme, fragment, user and default ports are left out, letters are lower-case in the host only.  What does not parse as a URL with a
    host is its own key behind ``)``.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return ")" + url
    port = f":{port}" if port not in (None, 80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + query


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def member(record: bytes) -> bytes:
    """A record as one gzip member that ends with a zero byte.

    A member ends with the length of what it holds, whose last byte is 0 below 16 MiB.  A longer record is followed by an empty member,
    which readers skip.  Spark's text writer puts :data:`_END` behind every row, so rows leave that byte out.
    """
    packed = gzip.compress(record, 1, mtime=0)
    return packed if packed.endswith(_END) else packed + gzip.compress(b"", 1, mtime=0)


def _page_uri(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


_UNSAFE = re.compile(r"[\x00-\x20\x7f%]")


def _target(url: str) -> list[str]:
    """Header lines of a URL.  One with blanks or controls is percent-encoded, and a line says so; any other stands as it is."""
    if not re.search(r"[\x00-\x20\x7f]", url):
        return [f"WARC-Target-URI: {url}"]
    return ["WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url), "X-Target-URI-Encoded: yes"]


def record_bytes(page: int | None, url: str | None, payload: bytes, revisits: int | None, is_revisit: bool, date: str) -> bytes:
    """A ``response`` record, or a ``revisit`` record that holds only the HTTP headers of its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_page_uri(page)}", f"WARC-Date: {date}"]
    head += [] if url is None else _target(url)
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    head += [f"WARC-Refers-To: {_page_uri(revisits)}", f"WARC-Profile: {_PROFILE}"] if is_revisit else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _keepers(pages: DataFrame) -> DataFrame:
    """``pages`` with ``keeper``, the largest id among rows of equal payload, and null where no other row has that payload.

    Only digests and ids are grouped, and only digests of several rows are kept, as a table whose size Spark knows: a small one is
    broadcast, and beside a large one Spark splits the rows of a payload that many pages share (skew join).
    """
    keyed = pages.withColumn("digest", F.sha2("payload", 256))
    known = keyed.groupBy("digest").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(materialise(known), "digest", "left").drop("digest")


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", records: int = ARCHIVE_RECORDS) -> None:
    """Write one WARC record per row of ``page_id, url, html`` to gzip files below ``folder``, a path for Spark.

    The payload is the html in UTF-8, null counts as empty.  Of rows with equal payloads that with the largest ``page_id`` becomes a
    ``response``, the others become ``revisit`` records that refer to it; null is the smallest id, and rows that repeat the largest id
    are all responses.  A null ``url`` has no target header.  Other columns are left out, whatever their names.  A record is made whole in
    its task, so a very long html has to fit there.  An empty table makes no record.

    Files come from Spark's own writer: a lost executor's files are never seen, and tasks that are run again write the same bytes.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("page", "url", "payload", "keeper")]
            for at in range(0, batch.num_rows, 64):
                out = []
                for page, url, payload, keeper in zip(*(c.slice(at, 64).to_pylist() for c in columns)):
                    out.append(member(record_bytes(page, url, payload, keeper, keeper is not None and page != keeper, date))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    # bytes pass through the string type unchanged, and rows of a task go to its file in their order
    _keepers(rows).select("page", "url", "payload", "keeper").mapInArrow(run, "member binary").select(
        F.col("member").cast("string").alias("value")).write.option("lineSep", _END.decode()).option("compression", "none").option(
        "maxRecordsPerFile", records).text(folder)


# ---------------------------------------------------------------- reading


def _head(raw: bytes) -> tuple[dict[str, str], int]:
    """The named fields of an unpacked record and where its block starts."""
    stop = raw.index(b"\r\n\r\n")
    lines = raw[:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:]), stop + 4


def _page(fields: dict[str, str], name: str) -> int | None:
    uri = fields.get(name, "<urn:page:>").removeprefix("<urn:page:").removesuffix(">")
    return int(uri) if uri else None


def _url(fields: dict[str, str]) -> str | None:
    url = fields.get("WARC-Target-URI")
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url) if "X-Target-URI-Encoded" in fields else url


def parse_record(raw: bytes) -> tuple[int | None, str | None, str, str, int, int | None, bytes | None]:
    """:data:`RECORD` of one unpacked record; a revisit has no payload."""
    fields, at = _head(raw)
    http, _, payload = raw[at: at + int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    return (
        _page(fields, "WARC-Record-ID"), _url(fields), kind, fields["WARC-Payload-Digest"].removeprefix("sha1:"), size,
        _page(fields, "WARC-Refers-To"), None if kind == "revisit" else payload)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and unpacked bytes of each record; an empty member belongs to the record before it."""
    at, view, held = 0, memoryview(content), None
    while at < len(content):
        unpack = zlib.decompressobj(31)
        data, stop = [], at
        while not unpack.eof:
            step = view[stop: stop + (1 << 20)]
            if not len(step):
                raise ValueError("an archive ends within a record")
            data.append(unpack.decompress(step))
            stop += len(step)
        stop -= len(unpack.unused_data)
        data = b"".join(data)
        if data:
            if held:
                yield held
            held = at, stop - at, data
        elif held:
            held = held[0], stop - held[0], held[2]
        at = stop
    if held:
        yield held


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """:data:`CAPTURE` of every record of the archives below ``folder``: each file is read once from start to end by one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, content = batch.column("path")[row].as_py(), batch.column("content")[row].as_py()
                found = []
                for offset, length, raw in members(content):
                    fields, _ = _head(raw)
                    found.append((url_key(_url(fields)), _page(fields, "WARC-Record-ID"), path, offset, length))
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["key", "page", "file", "offset", "length"])

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    return files.mapInArrow(run, CAPTURE)


# ---------------------------------------------------------------- the index


@dataclass
class CaptureIndex:
    """``blocks`` holds the shards' directories and blocks (kind 0 and 1), ``top`` the first (key, page) of each shard in order."""

    blocks: DataFrame
    top: list[tuple[str, int, int]]


def build_index(found: DataFrame) -> CaptureIndex:
    """Sort :data:`CAPTURE` rows by key and page into shards of compressed blocks.

    Shards are ranges of (key, page, file, offset), so a URL with any number of captures is cut as well.  They number as many as Spark's
    shuffle partitions, more where a shard would pass :data:`SHARD_CAPTURES`.  A block is a zlib text of up to :data:`BLOCK_CAPTURES`
    lines; a shard's directory has the first key of each block and goes with the shard.  The driver sees one row per shard.
    """
    spark = found.sparkSession
    found = materialise(found)
    shards = max(shuffle_partitions(spark), -(-found.count() // SHARD_CAPTURES))
    order = [F.col("key"), F.coalesce("page", F.lit(_NO_ID)), F.col("file"), F.col("offset")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, lines, n = TaskContext.get().partitionId(), [], [], 0
        names = ["shard", "kind", "block", "data"]

        def rows(kind: int, block: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names)

        def block() -> pa.RecordBatch:
            first.append(lines[0][:2])
            return rows(1, len(first) - 1, zlib.compress("\n".join(map(json.dumps, lines)).encode(), 1))

        for batch in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append((key, _NO_ID if page is None else page, file, offset, length))
                if len(lines) == BLOCK_CAPTURES:
                    yield block()
                    lines = []
        if lines:
            yield block()
        if first:
            yield rows(0, -1, zlib.compress(json.dumps(first).encode(), 1))

    blocks = materialise(found.repartitionByRange(int(shards), *order).sortWithinPartitions(*order).mapInArrow(
        run, "shard int, kind int, block int, data binary"))
    top = []
    for row in blocks.where("kind = 0").mapInArrow(_heads, "shard int, key string, page bigint").toLocalIterator():
        top.append((row["key"], row["page"], row["shard"]))
    return CaptureIndex(blocks, sorted(top, key=lambda t: t[2]))


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firsts = [json.loads(zlib.decompress(d.as_py()))[0] for d in batch.column("data")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), pa.array([f[0] for f in firsts], pa.string()), pa.array([f[1] for f in firsts], pa.int64())],
            ["shard", "key", "page"])


def lookup(index: CaptureIndex, wanted: DataFrame) -> DataFrame:
    """:data:`CAPTURE` of each capture that ``wanted`` (``url, page_id``) asks for; what is not in the index gives no row.

    Each asked row is sent to its shard by the top, searches the shard's directory and then one block.  A task gets directory, blocks and
    asked rows of a shard in this order; it keeps one shard's compressed blocks and the block unpacked last.  Rows asked for more than
    once are asked once.  Captures that repeat key and page are all found, also where a border of blocks or shards parts them: the search
    starts at the last border before the wanted pair and goes on while the pair lasts.
    """
    spark = wanted.sparkSession
    if not index.top:
        return spark.createDataFrame([], CAPTURE)
    top = spark.sparkContext.broadcast(index.top)  # one entry per shard

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = top.value
        firsts = [t[:2] for t in names]
        for batch in batches:
            out = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("page").to_pylist()):
                pair = url_key(url), _NO_ID if page is None else page
                last = max(bisect_right(firsts, pair) - 1, 0)
                while True:
                    out.append((names[last][2], pair[0], pair[1]))
                    if last == 0 or firsts[last] < pair:
                        break
                    last -= 1  # the shard begins with the pair: the one before may end with it
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()))], ["shard", "key", "page"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, firsts, packed, opened, lines = None, [], {}, None, []
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("shard", "kind", "block", "data", "key", "page"))
            for at, kind, block, data, key, page in zip(*columns):
                if at != shard:
                    shard, firsts, packed, opened = at, [], {}, None
                if kind == 0:
                    firsts = [tuple(f) for f in json.loads(zlib.decompress(data))]
                elif kind == 1:
                    packed[block] = data
                elif firsts:
                    pair = key, page
                    last = max(bisect_right(firsts, pair) - 1, 0)
                    while last and firsts[last] == pair:
                        last -= 1
                    while last < len(firsts) and firsts[last] <= pair:
                        if opened != last:
                            opened, lines = last, [json.loads(x) for x in zlib.decompress(packed[last]).split(b"\n")]
                            heads = [(x[0], x[1]) for x in lines]
                        stop = bisect_right(heads, pair)
                        start = stop
                        while start and heads[start - 1] == pair:
                            start -= 1
                        out += lines[start: stop]
                        last += 1
            if out:
                columns = list(zip(*out))
                columns[1] = [None if p == _NO_ID else p for p in columns[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["key", "page", "file", "offset", "length"])

    asked = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("bigint").alias("page")).mapInArrow(
        route, "shard int, key string, page bigint").distinct()
    stored = index.blocks.withColumns({"key": F.lit(None).cast("string"), "page": F.lit(None).cast("bigint")})
    asked = asked.select("shard", F.lit(2).alias("kind"), F.lit(0).alias("block"), F.lit(None).cast("binary").alias("data"), "key", "page")
    return stored.unionByName(asked).repartition(max(len(index.top), 1), "shard").sortWithinPartitions(
        "shard", "kind", "block", "key", "page").mapInArrow(search, CAPTURE)


def read_ranges(places: DataFrame, with_payload: bool = True) -> DataFrame:
    """:data:`RECORD` of each place (``file, offset, length``), by reads of just those ranges.

    Places are dealt out by file and window of :data:`WINDOW_BYTES` and sorted, so that neighbours share a read.  Files are opened by
    pyarrow's file systems (local and shared folders, HDFS, object stores) in the task.  ``with_payload=False`` leaves payloads null.
    """
    def flush(system, path: str, group: list[tuple[int, int]]) -> list[tuple]:
        start = group[0][0]
        with system.open_input_file(path) as file:
            data = file.read_at(max(o + n for o, n in group) - start, start)
        out = []
        for offset, length in group:
            for _, _, raw in members(data[offset - start: offset - start + length]):
                record = parse_record(raw)
                if record[2] == "response" and base32_sha1(record[6]) != record[3]:
                    raise ValueError(f"damaged record in {path} at {offset}")
                out.append(record if with_payload else (*record[:6], None))
        return out

    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, object, str] | None = None
        for batch in batches:
            group: list[tuple[int, int]] = []
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for i, (file, offset, length) in enumerate(places):
                if known is None or known[0] != file:
                    known = file, *pafs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", file))
                group.append((offset, length))
                after = places[i + 1] if i + 1 < len(places) else None
                if after is None or after[0] != file or after[1] + after[2] - group[0][0] > WINDOW_BYTES:
                    found = flush(known[1], known[2], group)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
                    group = []

    dealt = places.select("file", "offset", "length").withColumn("window", F.floor(F.col("offset") / F.lit(WINDOW_BYTES)))
    return dealt.repartition("file", "window").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, RECORD)
