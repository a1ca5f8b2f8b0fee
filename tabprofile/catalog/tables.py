"""Sources, row views, personal data and readiness."""

from pyspark.sql import functions as F

from tabprofile.catalog.registry import (
    CONTACT_TEXTS, CONTACTS, ORDERS_WITH_GAPS, contacts, orders_with_gaps, per_column_sql, query, read, rounded, unit_sql,
)
from tabprofile.operators import columns, leakage, pii, profile, rows
from tabprofile.sources import loading, sinks


@query("scan_parquet", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY ALL""")
def scan_parquet(spark, d):
    df = loading.load_dataset(spark, f"{d}/lineitem.parquet")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 2).alias("quantity"))


@query("sink_roundtrip", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS finished
FROM orders GROUP BY ALL""")
def sink_roundtrip(spark, d):
    path = sinks.scratch_path(spark, "sink_roundtrip")
    sinks.write_dataset(read(spark, d, "orders"), path)
    return loading.load_dataset(spark, path).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum("o_totalprice"), 2).alias("total"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


def _csv_totals(df):
    return df.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("p_retailprice"), 2).alias("price"),
        F.max("label").alias("label"))


_CSV_SQL = """SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price, max('café ' || p_name) AS label
FROM part GROUP BY ALL"""


def _part_labels(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", "p_brand", "p_retailprice", F.concat(F.lit("café "), "p_name").alias("label"))


@query("scan_csv_encoding", _CSV_SQL)
def scan_csv_encoding(spark, d):
    path = sinks.scratch_path(spark, "scan_csv_encoding")
    _part_labels(spark, d).write.mode("overwrite").csv(path, header=True, encoding="ISO-8859-1")
    return _csv_totals(loading.load_dataset(spark, path, format="csv"))


@query("scan_csv_delimiter", _CSV_SQL)
def scan_csv_delimiter(spark, d):
    path = sinks.scratch_path(spark, "scan_csv_delimiter")
    _part_labels(spark, d).write.mode("overwrite").csv(path, header=True, sep=";")
    return _csv_totals(loading.load_dataset(spark, path, format="csv"))


# Texts as JSON lines, as quoted CSV fields with quotes and line breaks, and in Windows text.
_TEXTS_SQL = """SELECT p_brand, count(*) AS n, sum(p_partkey)::BIGINT AS keys, max({label}) AS label, sum(length({label}))::BIGINT AS chars
FROM part GROUP BY ALL"""
_QUOTED = {"sql": """'He said "' || p_name || '", then' || chr(10) || 'left, ' || p_type""",
           "spark": ("He said \"", "\", then\nleft, ")}


def _texts(spark, d, before, between):
    return read(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit(before), "p_name", F.lit(between), "p_type").alias("label"))


def _text_totals(df):
    return df.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_partkey").cast("bigint").alias("keys"), F.max("label").alias("label"),
        F.sum(F.length("label")).cast("bigint").alias("chars"))


@query("scan_json_lines", _TEXTS_SQL.format(label=_QUOTED["sql"]))
def scan_json_lines(spark, d):
    path = sinks.scratch_path(spark, "scan_json_lines")
    _texts(spark, d, *_QUOTED["spark"]).write.json(path)
    return _text_totals(loading.load_dataset(spark, path, format="json"))


@query("scan_csv_quoted", _TEXTS_SQL.format(label=_QUOTED["sql"]))
def scan_csv_quoted(spark, d):
    path = sinks.scratch_path(spark, "scan_csv_quoted")
    _texts(spark, d, *_QUOTED["spark"]).write.csv(path, header=True, escape='"', quoteAll=True)
    return _text_totals(loading.load_dataset(spark, path, format="csv"))


@query("scan_csv_cp1252", _TEXTS_SQL.format(label="'“' || p_name || '” €5 – ' || p_type"))
def scan_csv_cp1252(spark, d):
    path = sinks.scratch_path(spark, "scan_csv_cp1252")
    # Spark writes no Windows text by default; these control characters are its bytes in ISO-8859-1
    _texts(spark, d, "\x93", "\x94 \x805 \x96 ").write.csv(path, header=True, encoding="ISO-8859-1")
    return _text_totals(loading.load_dataset(spark, path, format="csv"))


@query("training_frame_clean", f"""
SELECT o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey,
  CASE WHEN isinf(ratio) THEN NULL ELSE round(ratio, 6) END AS ratio, urgent::DOUBLE AS urgent,
  (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS target
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'Infinity'::DOUBLE ELSE o_totalprice / 1000 END AS ratio,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS urgent FROM {ORDERS_WITH_GAPS})
WHERE o_orderpriority IS NOT NULL""")
def training_frame_clean(spark, d):
    df = orders_with_gaps(spark, d).select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") == "P", F.lit(float("inf"))).otherwise(F.col("o_totalprice") / 1000).alias("ratio"),
        (F.col("o_orderstatus") == "F").alias("urgent"),
        F.col("o_orderpriority").alias("target"))
    frame = loading.training_frame(df, "target", "classification")
    return frame.data.select("o_orderkey", "o_custkey", rounded("ratio").alias("ratio"), "urgent", "target")


@query("training_target_parse", """
SELECT count(*) AS n, round(sum(target), 2) AS total FROM
 (SELECT try_cast(regexp_replace(trim(t), '[,$€£%]', '', 'g') AS DOUBLE) AS target FROM
  (SELECT CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE ' $' || printf('%.2f', o_totalprice) || ' ' END AS t FROM orders))
WHERE target IS NOT NULL""")
def training_target_parse(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(
        F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(" ")))
    df = read(spark, d, "orders").select("o_custkey", text.alias("target"))
    return loading.training_frame(df, "target", "regression").data.agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("target"), 2).alias("total"))


@query("row_search", """
SELECT * FROM part WHERE contains(lower(concat_ws(' ', p_partkey::VARCHAR, p_name, p_brand, p_type,
  p_size::VARCHAR, p_retailprice::VARCHAR)), 'red wid')""")
def row_search(spark, d):
    return rows.search(read(spark, d, "part"), "RED wid")


@query("text_search", """
SELECT doc_id, n_chars FROM documents WHERE contains(lower(concat_ws(' ', doc_id::VARCHAR, text, lang, source,
  n_chars::VARCHAR)), 'license')""")
def text_search(spark, d):
    return rows.search(read(spark, d, "documents"), "license").select("doc_id", "n_chars")


@query("row_sort", f"""
SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1)::BIGINT AS place
FROM {ORDERS_WITH_GAPS}""")
def row_sort(spark, d):
    from tabprofile.functions.sampling import with_row_index

    df = orders_with_gaps(spark, d).select("o_orderkey", "o_totalprice")
    # the order as a column, so that it can be compared: missing prices last, highest price first
    ranked = df.select("o_orderkey", "o_totalprice", F.col("o_totalprice").isNull().alias("absent"),
                       (-F.col("o_totalprice")).alias("down"))
    return with_row_index(ranked, ["absent", "down", "o_orderkey"], "place").select("o_orderkey", "o_totalprice", "place")


@query("sorted_top", f"""
SELECT o_orderkey, o_totalprice FROM {ORDERS_WITH_GAPS} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100""")
def sorted_top(spark, d):
    return rows.sort_rows(orders_with_gaps(spark, d), "o_totalprice", True, ["o_orderkey"]).limit(100).select(
        "o_orderkey", "o_totalprice")


@query("page_rows", """
SELECT *, (SELECT count(*) FROM part WHERE contains(lower(p_name), 'ring')) AS total_count
FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 25""")
def page_rows(spark, d):
    df = read(spark, d, "part")
    total = rows.search(df, "ring").agg(F.count(F.lit(1)).alias("total_count"))
    return rows.page(df, 2, 25, "p_partkey", "p_size", True, "ring").select("*", total.scalar().alias("total_count"))


@query("page_multi_sort", """
SELECT * FROM part WHERE p_retailprice > 950 ORDER BY p_size DESC NULLS LAST, p_name, p_partkey LIMIT 50""")
def page_multi_sort(spark, d):
    return rows.page(read(spark, d, "part"), 1, 50, "p_partkey", ["p_size", "p_name"], [True, False],
                     where=F.col("p_retailprice") > 950)


@query("page_duplicates", """
SELECT l_linenumber, l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_linenumber, l_returnflag, l_quantity) > 1 AS is_duplicate
FROM (SELECT l_linenumber, l_returnflag, l_quantity FROM lineitem ORDER BY l_quantity, l_linenumber, l_returnflag LIMIT 200)""")
def page_duplicates(spark, d):
    df = read(spark, d, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity")
    return rows.flag_duplicates(rows.page(df, 1, 200, "l_returnflag", ["l_quantity", "l_linenumber"], False))


_PII_SQL = per_column_sql(CONTACT_TEXTS, """
SELECT '{c}' AS "column", round(avg(regexp_matches({c}, '^[\\w.+-]+@[\\w-]+\\.[\\w.-]+$')::INT), 6) AS email_rate,
 round(avg(regexp_matches({c}, '^\\+?[\\d][\\d\\-\\s()]{{7,}}\\d$')::INT), 6) AS phone_number_rate,
 round(avg(regexp_matches({c}, '^\\d{{3}}-\\d{{2}}-\\d{{4}}$')::INT), 6) AS ssn_rate,
 round(avg(regexp_matches({c}, '^\\d{{4}}[\\s-]?\\d{{4}}[\\s-]?\\d{{4}}[\\s-]?\\d{{4}}$')::INT), 6) AS credit_card_rate,
 round(avg(regexp_matches({c}, '^(\\d{{1,3}}\\.){{3}}\\d{{1,3}}$')::INT), 6) AS ip_address_rate
FROM contacts""")


@query("pii_pattern_rates", f"WITH contacts AS {CONTACTS}\n{_PII_SQL}")
def pii_pattern_rates(spark, d):
    rates = pii.pattern_rates(contacts(spark, d))
    return rates.select("column", *[rounded(f"{k}_rate").alias(f"{k}_rate") for k in pii.TEXT_PATTERNS])


@query("pii_date_exception", f"""
WITH contacts AS {CONTACTS}
SELECT 'day_text' AS "column", round(avg(regexp_matches(day_text, '^\\+?[\\d][\\d\\-\\s()]{{7,}}\\d$')::INT), 6) AS phone_number_rate,
  round(avg((try_cast(day_text AS DATE) IS NOT NULL)::INT), 6) AS date_rate, NULL::VARCHAR AS pii_type FROM contacts
UNION ALL
SELECT 'call_text', round(avg(regexp_matches(call_text, '^\\+?[\\d][\\d\\-\\s()]{{7,}}\\d$')::INT), 6),
  round(avg((try_cast(call_text AS DATE) IS NOT NULL)::INT), 6), 'phone_number' FROM contacts""")
def pii_date_exception(spark, d):
    rates = pii.classify_rates(pii.pattern_rates(contacts(spark, d), ["day_text", "call_text"]))
    return rates.select("column", rounded("phone_number_rate").alias("phone_number_rate"),
                        rounded("date_rate").alias("date_rate"), "pii_type")


# The patterns as the detector states them, in the order in which they decide.
_PII_PATTERNS = list(pii.TEXT_PATTERNS.items())
_PII_TEXTS = [c for c in CONTACT_TEXTS if c != "full_name"]
_PII_RATES = per_column_sql(_PII_TEXTS, "SELECT '{c}' AS \"column\", {c} AS v FROM contacts")


@query("pii_columns", f"""
WITH contacts AS {CONTACTS}, v AS ({_PII_RATES}),
r AS (SELECT "column", avg((try_cast(v AS TIMESTAMP) IS NOT NULL)::INT) AS dates, """ + ", ".join(
    f"avg(regexp_matches(v, '{p}')::INT) AS {k}" for k, p in _PII_PATTERNS) + """ FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT 'full_name' AS "column", 'name' AS pii_type, 'name' AS detection_method
UNION ALL SELECT "column", CASE """ + " ".join(
    f"WHEN {k} > 0.8{' AND NOT dates > 0.8' if k == 'phone_number' else ''} THEN '{k}'" for k, _ in _PII_PATTERNS) + """ END AS pii_type, 'pattern' FROM r WHERE pii_type IS NOT NULL""")
def pii_columns(spark, d):
    df = contacts(spark, d)
    return pii.pii_report(df, pii.detect_pii(df))


@query("redact_frame", f"""
SELECT c_custkey, '[REDACTED]' AS mail_text, '[REDACTED]' AS call_text, '[REDACTED]' AS tax_text, '[REDACTED]' AS pay_text,
  '[REDACTED]' AS host_text, day_text, '[REDACTED]' AS full_name, c_mktsegment, c_acctbal FROM {CONTACTS}""")
def redact_frame(spark, d):
    df = contacts(spark, d)
    return pii.redact(df, pii.detect_pii(df))


@query("sample_rows_redacted", f"""
SELECT c_custkey, '[REDACTED]' AS mail_text, '[REDACTED]' AS full_name, c_mktsegment FROM {CONTACTS} ORDER BY c_custkey LIMIT 5""")
def sample_rows_redacted(spark, d):
    df = contacts(spark, d).select("c_custkey", "mail_text", "full_name", "c_mktsegment")
    return rows.sample_rows(pii.redact(df, pii.detect_pii(df)), "c_custkey")


@query("column_sample_capped", f"""
SELECT o_totalprice AS value FROM {ORDERS_WITH_GAPS} WHERE o_totalprice IS NOT NULL ORDER BY o_orderkey LIMIT 20""")
def column_sample_capped(spark, d):
    df = orders_with_gaps(spark, d)
    return rows.column_sample(pii.redact(df, pii.detect_pii(df)), "o_totalprice", 50, "o_orderkey")


@query("feature_type_counts", """
SELECT 'numeric' AS kind, 3::BIGINT AS columns UNION ALL SELECT 'datetime', 1 UNION ALL SELECT 'boolean', 0
UNION ALL SELECT 'text', (SELECT (avg(length(o_orderstatus)) > 10)::INT + (avg(length(o_orderpriority)) > 10)::INT FROM orders)
UNION ALL SELECT 'categorical', (SELECT (avg(length(o_orderstatus)) <= 10)::INT + (avg(length(o_orderpriority)) <= 10)::INT FROM orders)""")
def feature_type_counts(spark, d):
    return columns.feature_type_counts(read(spark, d, "orders"))


@query("ml_readiness", f"""
WITH o AS (SELECT *, o_totalprice * 2 AS doubled FROM {ORDERS_WITH_GAPS}),
q AS (SELECT 1 - (sum((o_custkey IS NULL)::INT) + sum((o_totalprice IS NULL)::INT) + sum((o_orderpriority IS NULL)::INT)
        + sum((doubled IS NULL)::INT)) / (7.0 * count(*)) AS c,
  1 - (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o))) / count(*)::DOUBLE AS u FROM o),
f AS (SELECT (abs(corr(o_totalprice, doubled)) >= 0.95)::INT AS high FROM o)
SELECT round(0.4 * round(c, 4) + 0.3 * round(u, 4) + 0.2 * (1 - high / 7.0) + 0.1, 4) AS ml_readiness FROM q, f""")
def ml_readiness(spark, d):
    df = orders_with_gaps(spark, d).withColumn("doubled", F.col("o_totalprice") * 2)
    flags = leakage.leakage_flags(df, "o_totalprice")
    return columns.ml_readiness(profile.quality(df), flags, len(df.columns), profile.is_wide(df))


_DISPLAY = "CASE WHEN dtype LIKE '%int%' OR dtype LIKE '%float%' THEN 'Numeric' WHEN dtype LIKE '%date%' THEN 'Date/time' ELSE 'Categorical / text' END"


@query("dtype_groups", f"""
WITH g AS {ORDERS_WITH_GAPS}, p AS (
 SELECT 'int64' AS dtype, avg((o_orderkey IS NULL)::INT) AS r FROM g UNION ALL SELECT 'float64', avg((o_custkey IS NULL)::INT) FROM g
 UNION ALL SELECT 'object', avg((o_orderstatus IS NULL)::INT) FROM g UNION ALL SELECT 'float64', avg((o_totalprice IS NULL)::INT) FROM g
 UNION ALL SELECT 'datetime64[ns]', avg((o_orderdate IS NULL)::INT) FROM g UNION ALL SELECT 'object', avg((o_orderpriority IS NULL)::INT) FROM g)
SELECT {_DISPLAY} AS kind, count(*) AS columns, round(max(r), 6) AS worst_null_rate FROM p GROUP BY ALL""")
def dtype_groups(spark, d):
    groups = columns.dtype_groups(profile.column_basics(orders_with_gaps(spark, d)))
    return groups.select("kind", "columns", rounded("worst_null_rate").alias("worst_null_rate"))


@query("random_samples", f"""
SELECT p_name AS value FROM (SELECT p_name, {unit_sql('p_partkey')} AS u, p_partkey FROM part WHERE p_name IS NOT NULL)
ORDER BY u, p_partkey LIMIT 5""")
def random_samples(spark, d):
    return columns.random_values(read(spark, d, "part"), "p_name", "p_partkey")
