"""Reading the call logs that runs leave behind, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = (
    "run_id string, timestamp double, node string, provider string, model string, "
    "system_prompt string, user_prompt string, response string, error string"
)


def read_traces(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """All calls below ``folder``; one run reads only its own partition."""
    traces = spark.read.schema(TRACE_SCHEMA).json(folder)
    return traces if run_id is None else traces.where(F.col("run_id") == run_id)


def write_traces(traces: DataFrame, folder: str) -> None:
    traces.write.mode("append").partitionBy("run_id").json(folder)


def calls_per_run(traces: DataFrame) -> DataFrame:
    return traces.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"))
