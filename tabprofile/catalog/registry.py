"""Registration of queries, and the inputs they share in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is left out where SQL cannot express the operator."""

    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Sums differ in their last bits with the order of addition; compare rounded values."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def joined(array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), ",")


# Orders with gaps in a numeric, an integer and a text column.
def orders_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    return o.select(
        "o_orderkey",
        F.when(~((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)), F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(~((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000)), F.col("o_orderpriority")).alias("o_orderpriority"),
    )


ORDERS_WITH_GAPS = """(SELECT o_orderkey,
  CASE WHEN NOT (o_orderstatus = 'P' AND o_totalprice > 400000) THEN o_custkey END AS o_custkey,
  o_orderstatus,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN NOT (o_orderstatus = 'F' AND o_totalprice < 50000) THEN o_orderpriority END AS o_orderpriority
  FROM orders)"""


# Customers with text columns that look like personal data.
def contacts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    day = F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")
    return read(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lower("c_mktsegment"), k, F.lit("@example.com")).alias("mail_text"),
        F.concat(F.lit("+1 555 "), F.lpad(k, 7, "0")).alias("call_text"),
        F.concat(F.lit("123-45-"), F.lpad(k, 4, "0")).alias("tax_text"),
        F.concat(F.lit("4000 1234 5678 "), F.lpad(k, 4, "0")).alias("pay_text"),
        F.concat(F.lit("10.0."), F.col("c_nationkey").cast("string"), F.lit(".1")).alias("host_text"),
        F.concat(F.lit("2022-01-"), day).alias("day_text"),
        F.col("c_name").alias("full_name"),
        "c_mktsegment",
        "c_acctbal",
    )


CONTACTS = """(SELECT c_custkey,
  lower(c_mktsegment) || c_custkey::VARCHAR || '@example.com' AS mail_text,
  '+1 555 ' || lpad(c_custkey::VARCHAR, 7, '0') AS call_text,
  '123-45-' || lpad(c_custkey::VARCHAR, 4, '0') AS tax_text,
  '4000 1234 5678 ' || lpad(c_custkey::VARCHAR, 4, '0') AS pay_text,
  '10.0.' || c_nationkey::VARCHAR || '.1' AS host_text,
  '2022-01-' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') AS day_text,
  c_name AS full_name, c_mktsegment, c_acctbal FROM customer)"""


def unit_sql(key: str, salt: str = "") -> str:
    """The SQL twin of the hash that drives all random choices."""
    text = f"'{salt}' || {key}::VARCHAR" if salt else f"{key}::VARCHAR"
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0)"


def per_column_sql(columns: list[str], template: str) -> str:
    """One SELECT per column, joined by UNION ALL; ``{c}`` is the column and ``{i}`` its position."""
    return "\nUNION ALL\n".join(template.format(c=c, i=i) for i, c in enumerate(columns))


LINEITEM_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINEITEM = [*LINEITEM_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CONTACT_TEXTS = ["mail_text", "call_text", "tax_text", "pay_text", "host_text", "day_text", "full_name", "c_mktsegment"]
