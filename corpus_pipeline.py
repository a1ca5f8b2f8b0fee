"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again for the next.

Language identification drops documents without a language, near-duplicates leave one document of each group, repeated passages are cut
out of the others, sources are mixed to their weights, and the result is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprofile.llm.common import default_tokenizer
from tabprofile.llm.crf import learn, predict_languages
from tabprofile.llm.minhash import keep_one
from tabprofile.llm.mixing import mix
from tabprofile.llm.packing import pack
from tabprofile.llm.suffixes import remove_repeats
from tabprofile.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Mean word probability from which a document counts as written in its language.
LEAST_SCORE = 0.35


#: Rows of a batch that Spark reads from a file or exchanges with Python: documents are long, and batches are held on both sides.
BATCH_ROWS = "500"


def _small_batches(spark: SparkSession) -> None:
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        spark.conf.set(name, BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those of which no language explains the words.

    Where no row has a language, nothing can be learned and only documents without letters go, as do null and empty texts always.
    """
    _small_batches(spark)
    model = learn(docs, F.col("doc_id").isNotNull())
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = predict_languages(docs, model, COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group linked by four fifths of common shingles of five words."""
    _small_batches(spark)
    return keep_one(docs.select(*COLUMNS), percent=80, words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 100 bytes that stand earlier in the corpus out of every text; ``n_chars`` follows the text."""
    _small_batches(spark)
    cut = remove_repeats(docs.select(*COLUMNS), 100, as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the target weights of the sources ask for."""
    taken = mix(docs, keep=COLUMNS).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts in sequences of at most 1024."""
    _small_batches(spark)
    return pack(docs, default_tokenizer())


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing),
]

#: The stages learn models, follow links and pack, which SQL cannot state; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
