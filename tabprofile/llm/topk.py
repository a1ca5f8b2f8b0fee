"""Operator 3: exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.session import shuffle_partitions

#: Vectors per stored block, and queries that share one pass over a block.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024


def quantized(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, vector``: each component x as floor(scale * x) in 64 bits.

    Rows whose vector is null or holds a null or non-finite component, or whose id is null, are left out.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")).alias("vector"))


def _blocks(vectors: DataFrame, rows: int, term_major: bool) -> DataFrame:
    """Vectors packed into rows of up to ``rows`` vectors: ids, and postings per term or whole rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
                lists = part.column("vector")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
                lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                width = int(lens.max(initial=0))
                dense = np.zeros((len(ids), width), "<i8")
                dense[np.arange(width) < lens[:, None]] = flat
                dense = dense.T if term_major else dense
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(dense).tobytes()], pa.binary()),
                    pa.array([width], pa.int32()), pa.array([int(ids[0])], pa.int64()),
                ], ["ids", "values", "width", "head"])

    return vectors.mapInArrow(run, "ids binary, values binary, width int, head bigint")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id: all above the k-th score, then the smallest ids at it."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, at = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        need = k - len(above)
        if len(at) > need:
            at = at[np.argpartition(ids[at], need - 1)[:need]]
        return np.concatenate([above, at])
    return np.arange(len(scores))


def _accumulate(rows: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    """Scores of every query row against ``n`` vectors: each non-zero query weight adds its term's weighted postings."""
    scores = np.zeros((len(rows), n), np.int64)
    for query, out in zip(rows, scores):
        for term in np.flatnonzero(query[: len(postings)]):
            places, weights = postings[term]
            if places is None:  # the term occurs in every vector
                out += query[term] * weights
            else:
                out[places] += query[term] * weights
    return scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other rows of each query row.

    Vectors and queries are packed into blocks, and every block of queries meets every block of vectors in some task: query blocks
    are copied to as many groups as there are tasks and joined on (query block, group), so neither side has to fit anywhere whole.
    Within a task the postings of a term are scattered into one dense score row per query; each pair of blocks keeps k rows per query
    by partition selection, and those are merged per query.

    Ties go to the smaller ``vec_id``.  A query with fewer than k others has fewer rows.  A query's own id is never its candidate;
    rows repeating another id are separate candidates, and query rows repeating an id share one list.  Missing components of shorter vectors are 0.  Scores are 64-bit integers.  An empty table gives no rows.
    """
    groups = shuffle_partitions(vectors.sparkSession)
    candidates = _blocks(vectors, BLOCK_ROWS, True).withColumn("group", F.pmod(F.xxhash64("head", "ids"), F.lit(groups)))
    asked = (
        _blocks(vectors.where(is_query), QUERY_ROWS, False)
        .select(F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.col("width").alias("q_width"))
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, postings, ids = None, [], np.empty(0)
            for row in range(batch.num_rows):
                raw, width = batch.column("values")[row].as_buffer(), batch.column("width")[row].as_py()
                key = batch.column("ids")[row].as_py(), raw.address
                if key != last:
                    ids = np.frombuffer(key[0], "<i8")
                    dense = np.frombuffer(raw, "<i8").reshape(width, len(ids))
                    postings = []
                    for weights in dense:
                        places = np.flatnonzero(weights)
                        postings.append((None, weights) if len(places) * 2 > len(ids) else (places, weights[places]))
                    last = key
                q_ids = np.frombuffer(batch.column("q_ids")[row].as_py(), "<i8")
                q_rows = np.frombuffer(batch.column("q_values")[row].as_py(), "<i8").reshape(len(q_ids), -1)
                found = []
                for at in range(0, len(q_ids), 128):
                    for q, scores in zip(q_ids[at: at + 128], _accumulate(q_rows[at: at + 128], postings, len(ids))):
                        own = ids == q
                        some = np.flatnonzero(~own) if own.any() else None
                        pick = _best(scores, ids, k) if some is None else some[_best(scores[some], ids[some], k)]
                        found.append((np.full(len(pick), q), ids[pick], scores[pick]))
                if found:
                    names = ["query_id", "vec_id", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names)

    near = candidates.join(asked, "group").select("ids", "values", "width", "q_ids", "q_values", "q_width").mapInArrow(
        run, "query_id bigint, vec_id bigint, score bigint")
    # Spark keeps the first k rows of each query in every task before it shuffles them
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
