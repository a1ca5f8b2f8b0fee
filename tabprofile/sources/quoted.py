"""Reading CSV whose quoted fields hold line breaks, range by range in parallel.

Whether a line starts inside a quoted field depends on everything before it, but only through that one bit.  So every range of a file first
reports how it would leave either state, the ranges' reports are chained to tell each its opening state, and then the ranges are rewritten
side by side: one record a line, breaks within fields replaced by characters that the data do not use.  A record that crosses the border of
two ranges leaves a fragment in each; the few fragments are joined on their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprofile.session import storage_root

#: Characters that may stand in for breaks and mark fragments: controls that text has no use for.
SPARE = [chr(c) for c in (*range(1, 9), *range(14, 32))]


def opens(line: bytes, separator: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of ``line``, given whether one is at its start.

    A field is quoted if a quote is its first character; doubled quotes within are text, and what follows the closing quote up to the next
    separator belongs to the field, as do quotes within a field that does not start with one.
    """
    at = 0
    if not inside and b'"' not in line:
        return False
    while True:
        if not inside:
            if line[at: at + 1] != b'"':
                at = line.find(separator, at) + 1
                if not at:
                    return False
                continue
            at += 1
        quote = line.find(b'"', at)
        while quote >= 0 and line[quote + 1: quote + 2] == b'"':
            quote = line.find(b'"', quote + 2)
        if quote < 0:
            return True
        inside = False
        at = line.find(separator, quote + 1) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """The lines of a task in their order, each with the range it lies in."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "line")))


@contextmanager
def _same_ranges(spark: SparkSession) -> Iterator[None]:
    """Files are cut into the same ranges within, whatever executors come or go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(before or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _opening_states(spark: SparkSession, path: str, separator: bytes) -> dict[tuple[str, int], tuple[bool, bool]]:
    """Whether each range starts inside a quoted field, and whether its file's first line ends with a carriage return.

    The driver sees a row per range, one for many megabytes of text.
    """

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, returns = None, [False, True], False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), *(pa.array([e]) for e in (*ends, returns))],
                ["file", "start", "outside", "inside", "returns"])

        for file, start, line in _ranges(batches):
            if key != (file, start):
                if key:
                    yield out()
                key, ends, returns = (file, start), [False, True], line.endswith(b"\r")
            if b'"' in line:
                ends = [opens(line, separator, e) for e in ends]
        if key:
            yield out()

    states, file, inside, returns = {}, None, False, False
    found = _lines(spark, path).mapInArrow(report, "file string, start bigint, outside boolean, inside boolean, returns boolean")
    for row in sorted(found.collect(), key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            file, inside, returns = row["file"], False, row["returns"]
        states[file, row["start"]] = inside, returns
        inside = row["inside"] if inside else row["outside"]
    return states


def spare_characters(spark: SparkSession, path: str) -> list[str]:
    """Those of :data:`SPARE` that occur nowhere in the text."""
    used = spark.read.text(path, lineSep="\n").agg(*[F.coalesce(F.bool_or(F.contains("value", F.lit(c))), F.lit(False)).alias(f"c{i}") for i, c in enumerate(SPARE)]).first()
    return [c for c, is_used in zip(SPARE, used) if not is_used]


def rewrite(spark: SparkSession, path: str, separator: str, header: str) -> tuple[list[str], str, str, str]:
    """Rewrite CSV below ``path`` as text with one record a line: (folders, comment mark, stand-in for line feed, for carriage return).

    Every file of the result starts with ``header`` in place of the first record of the files read; lines that begin with the comment mark
    are fragments, and belong to no record there.
    """
    spare = spare_characters(spark, path)
    if len(spare) < 3:
        raise ValueError("no characters are left to stand in for line breaks")
    mark, feed, carriage = (c.encode() for c in spare[:3])
    sep, first_line = separator.encode(), header.encode()
    folder = f"{storage_root(spark)}/tabprofile-{uuid.uuid4().hex}.csv"

    def records(lines: Iterator[tuple[str, int, bytes]], states) -> Iterator[bytes]:
        key, held, inside, begun, head, returns = None, [], False, True, False, False

        def closed(kind: bytes) -> bytes:
            """The lines held as one record, or as a fragment of a kind."""
            text = feed.join(held)
            if not kind:
                return (text[:-1] if text.endswith(b"\r") else text).replace(b"\r", carriage)
            return mark + mark.join([kind, key[0].encode(), str(key[1]).encode(), b"1" if not begun else b"0", text.replace(b"\r", carriage)])

        for file, start, line in lines:
            if key != (file, start):
                if held:
                    yield closed(b"head" if head else b"tail")
                key, held = (file, start), []
                inside, returns = states[key]
                # the first record of a file is its header; a range that starts within a record begins with the rest of it
                begun, head = start > 0, inside
            # where lines end with both characters, a break within a field is read as a line feed
            held.append(line[:-1] if returns and line.endswith(b"\r") else line)
            if inside or b'"' in line:
                inside = opens(line, sep, inside)
            if inside:
                continue
            if head:
                yield closed(b"head")
            elif held[0].strip() or len(held) > 1:
                if begun:
                    yield closed(b"")
                begun = True
            held, head = [], False
        if held:
            yield closed(b"head" if head else b"tail")

    with _same_ranges(spark):
        shared = spark.sparkContext.broadcast(_opening_states(spark, path, sep))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, size = [first_line], 0
            for record in records(_ranges(batches), shared.value):
                out.append(record)
                size += len(record)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

        _lines(spark, path).mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{folder}/records")

    sign, nth = F.lit(mark.decode()), lambda n: F.substring_index(F.substring_index("value", mark.decode(), n + 2), mark.decode(), -1)
    parts = spark.read.text(f"{folder}/records", lineSep="\n").where(F.startswith("value", sign)).select(
        nth(1).alias("file"), nth(2).cast("bigint").alias("start"), (nth(0) == "tail").alias("tail"), (nth(3) == "1").alias("header"),
        F.substring_index("value", mark.decode(), -1).alias("text"))
    in_file = Window.partitionBy("file").orderBy("start", "tail")  # at most two rows of a range
    joined = parts.withColumn("nth", F.sum(F.col("tail").cast("int")).over(in_file)).groupBy("file", "nth").agg(
        F.array_sort(F.collect_list(F.struct("start", "tail", "text"))).alias("parts"), F.bool_or("header").alias("header"))
    whole = joined.where("NOT header").select(F.array_join(F.transform("parts", lambda p: p["text"]), feed.decode()).alias("value"))
    whole = whole.withColumn("value", F.when(F.endswith("value", F.lit(carriage.decode())), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
    lines = spark.createDataFrame([(header, 0)], "value string, place int").unionByName(whole.withColumn("place", F.lit(1)))
    lines = lines.coalesce(1).sortWithinPartitions("place").select("value")  # one row per border that a record crosses
    lines.write.option("lineSep", "\n").text(f"{folder}/joined")
    return [f"{folder}/records", f"{folder}/joined"], mark.decode(), feed.decode(), carriage.decode()
