"""Dataset and column profiles."""

from pyspark.sql import functions as F

from tabprofile.catalog.registry import (
    CONTACTS, LINEITEM, LINEITEM_NUMERIC, ORDERS, ORDERS_WITH_GAPS, contacts, joined, orders_with_gaps, per_column_sql,
    query, read, rounded,
)
from tabprofile.operators import columns, profile

LINEITEM_TYPES = dict(zip(LINEITEM, ["int64"] * 3 + ["int32"] + ["float64"] * 4 + ["object"] * 2 + ["datetime64[ns]"]))


@query("profile_table", "SELECT count(*) AS row_count, 11 AS column_count, FALSE AS is_wide_dataset FROM lineitem")
def profile_table(spark, d):
    return profile.table_profile(read(spark, d, "lineitem"))


@query("profile_memory", per_column_sql(ORDERS, """
SELECT '{c}' AS "column", CASE WHEN '{c}' IN ('o_orderstatus', 'o_orderpriority') THEN sum(octet_length({c}::VARCHAR::BLOB))
  ELSE count(*) * 8 END::BIGINT AS bytes FROM orders"""))
def profile_memory(spark, d):
    return profile.memory_bytes(read(spark, d, "orders")).select("column", "bytes")


@query("profile_columns", "SELECT * FROM (" + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", {i} AS position, '{LINEITEM_TYPES[c]}' AS dtype, round(avg(({c} IS NULL)::INT), 6) AS null_rate,
  count(DISTINCT {c}) AS n_unique, FALSE AS is_pii FROM lineitem""" for i, c in enumerate(LINEITEM)) + ")")
def profile_columns(spark, d):
    return profile.column_profile(read(spark, d, "lineitem")).select(
        "column", "position", "dtype", rounded("null_rate").alias("null_rate"), "n_unique", "is_pii")


@query("profile_columns_pii", f"WITH contacts AS {CONTACTS}\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", {u} AS n_unique, {kind} AS pii_type, {top} AS top_value FROM contacts"""
    for c, u, kind, top in [
        ("c_custkey", "count(DISTINCT c_custkey)", "NULL", "NULL"),
        ("mail_text", "least(count(*), 1)", "'email'", "'[REDACTED]'"),
        ("call_text", "least(count(*), 1)", "'phone_number'", "'[REDACTED]'"),
        ("tax_text", "least(count(*), 1)", "'phone_number'", "'[REDACTED]'"),
        ("pay_text", "least(count(*), 1)", "'phone_number'", "'[REDACTED]'"),
        ("host_text", "least(count(*), 1)", "'ip_address'", "'[REDACTED]'"),
        ("day_text", "count(DISTINCT day_text)", "NULL",
         "(SELECT day_text FROM contacts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
        ("full_name", "least(count(*), 1)", "'name'", "'[REDACTED]'"),
        ("c_mktsegment", "count(DISTINCT c_mktsegment)", "NULL",
         "(SELECT c_mktsegment FROM contacts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
        ("c_acctbal", "count(DISTINCT c_acctbal)", "NULL", "NULL"),
    ]))
def profile_columns_pii(spark, d):
    return profile.column_profile(contacts(spark, d)).select(
        "column", "n_unique", "pii_type", F.col("top_values")[0]["value"].alias("top_value"))


_NUMERIC = """
SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
 round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
 round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max FROM """


@query("profile_numeric", per_column_sql(LINEITEM_NUMERIC, _NUMERIC + "lineitem"))
def profile_numeric(spark, d):
    out = profile.numeric_summary(read(spark, d, "lineitem"))
    return out.select("column", *[rounded(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("profile_numeric_gaps", per_column_sql(["o_orderkey", "o_custkey", "o_totalprice"], _NUMERIC + ORDERS_WITH_GAPS))
def profile_numeric_gaps(spark, d):
    out = profile.numeric_summary(orders_with_gaps(spark, d))
    return out.select("column", *[rounded(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("profile_top_values", per_column_sql(["p_name", "p_brand", "p_type"], """
SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank, {c} AS value, count(*) AS "count"
 FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""))
def profile_top_values(spark, d):
    return profile.top_values(read(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@query("profile_strong_pairs", """
WITH p AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_quantity * 3 + l_tax AS scaled FROM lineitem),
r AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM p
 UNION ALL SELECT 'l_quantity', 'net', corr(l_quantity, net) FROM p UNION ALL SELECT 'l_quantity', 'scaled', corr(l_quantity, scaled) FROM p
 UNION ALL SELECT 'l_extendedprice', 'net', corr(l_extendedprice, net) FROM p
 UNION ALL SELECT 'l_extendedprice', 'scaled', corr(l_extendedprice, scaled) FROM p UNION ALL SELECT 'net', 'scaled', corr(net, scaled) FROM p)
SELECT a, b, round(r, 3) AS correlation FROM r WHERE abs(r) >= 0.6""")
def profile_strong_pairs(spark, d):
    df = read(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") * 3 + F.col("l_tax")).alias("scaled"))
    return profile.strong_pairs(df)


def wide_embeddings(spark, d):
    """A table of more than fifty columns: the vector's parts, a near copy of each of four parts, and the class."""
    e = F.col("embedding")
    return read(spark, d, "embeddings").select(
        *[e[i].cast("double").alias(f"e{i}") for i in range(64)],
        *[(e[i].cast("double") * 2 + e[i + 1].cast("double") * 0.5).alias(f"near{i}") for i in range(4)],
        F.concat(F.lit("class "), F.col("label").cast("string")).alias("name"), "label")


@query("profile_clusters")
def profile_clusters(spark, d):
    out = profile.correlation_clusters(wide_embeddings(spark, d))
    return out.select("cluster", "representative", joined("members").alias("members"), "size",
                      rounded("numeric.mean").alias("mean"), rounded("numeric.std").alias("std"))


_WIDE = [*[(f"e{i}", f"embedding[{i + 1}]::DOUBLE", "float64") for i in range(64)],
         *[(f"near{i}", f"embedding[{i + 1}]::DOUBLE * 2 + embedding[{i + 2}]::DOUBLE * 0.5", "float64") for i in range(4)],
         ("name", "'class ' || label::VARCHAR", "object"), ("label", "label", "int32")]


@query("profile_wide_columns", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", {i} AS position, '{t}' AS dtype, round(avg((v IS NULL)::INT), 6) AS null_rate, count(DISTINCT v) AS n_unique,
  CASE WHEN count(DISTINCT v) <= 10 THEN (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY {x})) END AS top_count
FROM (SELECT {x} AS v FROM embeddings)""" for i, (c, x, t) in enumerate(_WIDE)))
def profile_wide_columns(spark, d):
    return profile.column_profile(wide_embeddings(spark, d)).select(
        "column", "position", "dtype", rounded("null_rate").alias("null_rate"), "n_unique",
        F.col("top_values")[0]["count"].alias("top_count"))


@query("profile_quality", f"""
WITH g AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM {ORDERS_WITH_GAPS}),
f AS (SELECT count(*) AS n, (sum((o_custkey IS NULL)::INT) + sum((o_orderpriority IS NULL)::INT)) / (3.0 * count(*)) AS missing,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS copies FROM g)
SELECT round(1 - missing, 4) AS completeness, copies AS duplicate_row_count, round(copies / n::DOUBLE, 4) AS duplicate_row_rate,
  round(1 - copies / n::DOUBLE, 4) AS uniqueness, round((1 - missing + 1 - copies / n::DOUBLE) / 2, 4) AS overall FROM f""")
def profile_quality(spark, d):
    return profile.quality(orders_with_gaps(spark, d).select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("column_summary", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", {t} AS dtype, round(avg(({c} IS NULL)::INT) * 100, 1) AS missing_pct,
  round(count(DISTINCT {c}) / count(*)::DOUBLE * 100, 1) AS unique_pct, count(DISTINCT {c}) AS n_unique FROM {ORDERS_WITH_GAPS}"""
    for c, t in zip(ORDERS, ["'int64'", "'float64'", "'object'", "'float64'", "'datetime64[ns]'", "'object'"])))
def column_summary(spark, d):
    return columns.column_summary(profile.column_profile(orders_with_gaps(spark, d)))


@query("column_histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT (len(list_filter(range(1, 20), lambda i: l_extendedprice >= lo + i * ((hi - lo) / 20)))) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT r.i::INT AS bin, round(lo + r.i * ((hi - lo) / 20), 4) AS low,
  round(CASE WHEN r.i = 19 THEN hi ELSE lo + (r.i + 1) * ((hi - lo) / 20) END, 4) AS high, coalesce(n, 0) AS "count"
FROM range(0, 20) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = r.i""")
def column_histogram(spark, d):
    out = columns.histogram(read(spark, d, "lineitem"), "l_extendedprice")
    return out.select("bin", rounded("low", 4).alias("low"), rounded("high", 4).alias("high"), "count")


@query("column_stats", per_column_sql(["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"], """
SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}::DOUBLE), 4) AS median, round(stddev_samp({c}), 4) AS std,
 round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25,
 round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis FROM lineitem"""))
def column_stats(spark, d):
    out = columns.column_stats(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])
    return out.select("column", *[
        rounded(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "p25", "p75", "skew", "kurtosis")])


@query("column_target_corr", per_column_sql(["o_orderkey", "o_custkey"], """
SELECT '{c}' AS "column", round(corr({c}, o_totalprice), 6) AS correlation FROM """ + ORDERS_WITH_GAPS))
def column_target_corr(spark, d):
    out = columns.target_correlation(orders_with_gaps(spark, d), ORDERS, "o_totalprice")
    return out.select("column", rounded("correlation").alias("correlation"))


@query("column_top_rare", """
WITH c AS (SELECT p_name AS value, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1),
r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS t, row_number() OVER (ORDER BY n, value) AS b FROM c)
SELECT 'top' AS kind, t::INT AS rank, value, n AS "count" FROM r WHERE t <= 10
UNION ALL SELECT 'rare', b::INT, value, n FROM r WHERE b <= 10 AND (SELECT count(*) FROM c) > 10""")
def column_top_rare(spark, d):
    return columns.ranked_values(read(spark, d, "part"), "p_name")


@query("column_entropy", per_column_sql(["p_name", "p_brand", "p_type", "p_size"], """
SELECT '{c}' AS "column", round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM part GROUP BY {c})"""))
def column_entropy(spark, d):
    from tabprofile.operators import quality

    out = quality.entropy(read(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size"])
    return out.select("column", rounded("entropy").alias("entropy"))
