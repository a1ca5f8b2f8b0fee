"""Operator 1: token ids as frequency ranks in byte-aligned variable-length coding.

Format.  A data set is a folder with two Parquet tables.  ``ranks`` has one row per id in use: ``rank`` (0 for the most
frequent id, ties to the smaller id) and ``id``.  ``data`` has one row per document: ``n_ids``, ``control`` with two bits per
id (its byte count less one; four ids a byte, lowest bits first) and ``data`` with the 1 to 4 low bytes of each rank.
Documents ascend by ``doc_id`` over the folders ``shard=0``, ``shard=1``, ... and within every file; the files of one shard,
where there are several, hold ranges that do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprofile.llm.common import documents, encoder, pieces, tokenizer_spec
from tabprofile.functions.frames import small_or_same
from tabprofile.session import materialise, shuffle_partitions
from tabprofile.sources.sinks import scratch_path

#: byte counts of the four ids that a control byte describes
_COUNTS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _in_quads(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ids of documents of ``sizes`` where each document begins a control byte of its own, and how many control bytes each has."""
    quads = -(-sizes // 4)
    shift = 4 * (np.cumsum(quads) - quads) - (np.cumsum(sizes) - sizes)
    return np.arange(sizes.sum()) + np.repeat(shift, sizes), quads


def _kept(more: np.ndarray, wide: int) -> np.ndarray:
    """Which of the ``wide`` low bytes of each rank are stored, byte by byte."""
    keep = np.ones((len(more), wide), bool)
    for k in range(1, wide):
        np.greater_equal(more, k, out=keep[:, k])
    return keep.reshape(-1)


def encode_many(ranks: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data bytes of documents of ``sizes`` ids whose ranks follow one another."""
    wide = 4 if len(ranks) and int(ranks.max()) > 0xFFFF else 2
    more = (ranks > 0xFF).astype(np.uint8)
    if wide == 4:
        more += ranks > 0xFFFF
        more += ranks > 0xFFFFFF
    at, quads = _in_quads(sizes)
    padded = np.zeros((int(quads.sum()), 4), np.uint8)
    padded.reshape(-1)[at] = more
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    low = ranks.astype(f"<u{wide}").view(np.uint8)
    ends = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[np.concatenate([[0], np.cumsum(sizes)])]
    return _binary(control, quads), _binary(low[_kept(more, wide)], sizes + np.diff(ends))


def decode_many(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The inverse of :func:`encode_many`: byte counts are looked up per control byte."""
    counts = _COUNTS[np.frombuffer(control, np.uint8)].reshape(-1)[_in_quads(sizes)[0]]
    wide = 2 if int(counts.max(initial=1)) <= 2 else 4
    out = np.zeros(len(counts) * wide, np.uint8)
    out[_kept(counts - np.uint8(1), wide)] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{wide}").astype("<u4", copy=False)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of one document's ranks."""
    control, data = encode_many(np.ascontiguousarray(ranks, "<u4"), np.array([len(ranks)]))
    return control[0].as_py(), data[0].as_py()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of :func:`encode_ranks`."""
    return decode_many(control, data, np.array([n]))


def _tokenise(spec, end_id: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        width = enc.dtype.itemsize
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in pieces(batches):
            coded = [c + tail for c in enc.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(c) // width for c in coded], pa.int64()), pa.array(coded, pa.binary()),
                pa.array([width] * len(coded), pa.int32()),
            ], ["doc_id", "n_ids", "raw", "width"])

    return run


_TOKENS = "doc_id bigint, n_ids bigint, raw binary, width int"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """``doc_id, n_ids, raw, width``: each text's ids as little-endian unsigned integers of ``width`` bytes, in the order of the rows.

    Null and empty texts give no ids but ``end_id``, which closes every document.
    """
    return documents(docs).mapInArrow(_tokenise(tokenizer_spec(docs.sparkSession, tokenizer), end_id), _TOKENS)


def _numbers(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def _tokenise_and_count(spec, end_id: int | None):
    """Rows of :func:`_tokenise`, and one more at a task's end whose ``raw`` is null and whose ``tally`` has its ids' counts."""
    tokenise = _tokenise(spec, end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in tokenise(batches):
            seen = np.bincount(_numbers(b"".join(batch.column("raw").to_pylist()), batch.column("width")[0].as_py()))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], [*batch.schema.names, "tally"])
        used = np.flatnonzero(total)
        tally = np.stack([used, total[used]]).astype("<i8").tobytes()
        nulls = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array([tally], pa.binary())], ["doc_id", "n_ids", "raw", "width", "tally"])

    return run


def _tallies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tally in batch.column("tally").to_pylist():
            used, times = np.frombuffer(tally, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(times)], ["id", "n"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, partitions: int | None = None) -> None:
    """Encode every whole text and write the two tables below ``path``.

    Texts are tokenised once into a shared table ordered by document; each task adds its own id counts to it, so that the count
    of all is one row per id and task; the rank table has one row per id of the vocabulary, whatever the corpus.

    Null ``doc_id`` comes first; rows of one ``doc_id`` stay separate, in one order; a null or
    empty text is a row with ``end_id`` alone; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    # ranges are drawn before texts are tokenised, for drawing them costs a pass
    ordered = documents(docs).repartitionByRange(partitions or shuffle_partitions(spark), "doc_id", F.xxhash64("text"))
    coding = _tokenise_and_count(tokenizer_spec(spark, tokenizer), end_id)
    stored = materialise(ordered.sortWithinPartitions("doc_id", "text").mapInArrow(coding, f"{_TOKENS}, tally binary").withColumn("shard", F.spark_partition_id()))
    tallies = stored.select("tally").where("tally IS NOT NULL").mapInArrow(_tallies, "id bigint, n bigint")
    counts = tallies.groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))
    spark.createDataFrame([(k, r["id"]) for k, r in enumerate(ranked)], "rank int, id bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(1 + max([0, *(r["id"] for r in ranked)]), "<u4")
    for k, r in enumerate(ranked):
        rank_of[r["id"]] = k
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in pieces(batches, column="raw"):
            # the width is the vocabulary's, so it is that of every row
            numbers = _numbers(b"".join(batch.column("raw").to_pylist()), batch.column("width")[0].as_py())
            control, data = encode_many(ranks[numbers], batch.column("n_ids").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_ids"), control, data, batch.column("shard")],
                                             ["doc_id", "n_ids", "control", "data", "shard"])

    coded = stored.where("raw IS NOT NULL").drop("tally").mapInArrow(run, "doc_id bigint, n_ids bigint, control binary, data binary, shard int")
    coded.sortWithinPartitions("shard", "doc_id").write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/data")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_ids, ids, shard`` of a written data set; ``ids`` are little-endian unsigned 32-bit integers."""
    ranked = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(len(ranked), "<u4")
    for r in ranked:
        id_of[r["rank"]] = r["id"]
    shared = spark.sparkContext.broadcast(id_of)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in pieces(batches, column="data"):
            sizes = batch.column("n_ids").to_numpy()
            ranks = decode_many(*(b"".join(batch.column(c).to_pylist()) for c in ("control", "data")), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_ids"), _binary(ids[ranks], 4 * sizes), batch.column("shard")],
                                             ["doc_id", "n_ids", "ids", "shard"])

    stored = _stored(spark, path).select("doc_id", "n_ids", "control", "data", "shard")
    return stored.mapInArrow(run, "doc_id bigint, n_ids bigint, ids binary, shard int")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, n_ids bigint, control binary, data binary, shard int").parquet(f"{path}/data")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs``, read the files back, and give each document's place, length and checksum."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    # documents ascend from shard to shard, so a shard starts after the ids of those before it
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = _stored(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = read_tokens(spark, path).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "shard")
    within = Window.partitionBy("shard").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(small_or_same(bases), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("within")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")
