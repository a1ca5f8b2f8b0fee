"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprofile.llm.common import default_tokenizer
from tabprofile.llm.crf import learn, predict_languages
from tabprofile.llm.indexing import learn_quality, score_quality
from tabprofile.llm.masked_lm import learn_model, score_documents
from tabprofile.llm.minhash import near_duplicates
from tabprofile.llm.mixing import mix
from tabprofile.llm.negatives import labelled, mine
from tabprofile.llm.packing import pack
from tabprofile.llm.quality_rules import apply_rules, learn_rules
from tabprofile.llm.spelling import variants, word_counts
from tabprofile.llm.suffixes import remove_repeats
from tabprofile.llm.tokens import token_digest
from tabprofile.llm.topk import quantized, top_k
from tabprofile.llm.warc import build_index, captures, lookup, read_ranges, write_archives
from tabprofile.session import storage_root

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_digest(_table(spark, folder, "documents"), default_tokenizer())


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    predicted = predict_languages(docs, learn(docs, ~held_out & F.col("doc_id").isNotNull()))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(quantized(_table(spark, folder, "embeddings")), F.col("vec_id") % 50 == 0, 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), t AS (SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


def op4_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"), 100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return apply_rules(docs, learn_rules(docs, _table(spark, folder, "labels")))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), 85, 5).drop("hash")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM d GROUP BY source
), r AS (SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size * 1.5::DOUBLE) OVER () - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, coalesce(least(lim, weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)), lim) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS o,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate * n + o) - floor(rate * (n - 1) + o)) * size)::BIGINT AS taken FROM p
"""


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = score_quality(docs, learn_quality(docs, _table(spark, folder, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_masked_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return score_documents(docs, learn_model(docs))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(_table(spark, folder, "documents"), default_tokenizer())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    counts = word_counts(_table(spark, folder, "documents"))
    return variants(counts, (F.length("word") >= 5) & (F.col("n") >= 3))


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(_table(spark, folder, "embeddings"))
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", wrong), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), t AS (SELECT vec_id, label, unnest(e) AS w, generate_subscripts(e, 1) AS i FROM v),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.w * c.w)::BIGINT AS score
  FROM t a JOIN t c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    archives = f"{storage_root(spark)}/tabprofile-{uuid.uuid4().hex}.warc"
    write_archives(pages, archives)
    places = lookup(build_index(captures(spark, archives)), pages)
    return read_ranges(places, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, ((i // 8) * 10 + 1)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM h
"""


_QUERIES: dict[str, Query] = {
    "op1_tokens": op1_tokens, "op2_language": op2_language, "op3_topk": op3_topk, "op4_suffixes": op4_suffixes, "op5_quality_rules": op5_quality_rules, "op6_minhash": op6_minhash, "op7_mixing": op7_mixing, "op8_quality": op8_quality, "op9_masked_lm": op9_masked_lm, "op10_packing": op10_packing,
    "op11_spelling": op11_spelling, "op12_negatives": op12_negatives, "op13_warc": op13_warc,
}
_SQL = {"op3_topk": OP3_SQL, "op7_mixing": OP7_SQL, "op12_negatives": OP12_SQL, "op13_warc": OP13_SQL}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
