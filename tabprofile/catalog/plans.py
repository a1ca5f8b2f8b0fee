"""Suggested steps, insights, feature steps and preprocessing."""

from pyspark.sql import functions as F

from tabprofile.catalog.registry import CONTACTS, ORDERS_WITH_GAPS, contacts, joined, orders_with_gaps, query, read, rounded, unit_sql
from tabprofile.functions.sampling import unit_hash
from tabprofile.operators import leakage as L
from tabprofile.operators import profile as P
from tabprofile.operators import steps as S
from tabprofile.plans import eda, insights
from tabprofile.plans.preprocess import encoding_fold, fit_encoding, fit_preprocessor, impute_literals, scale_literals
from tabprofile.plans.spec import FeatureStep, TaskSpec


# Events with gaps in a skewed number and in a category.
def events_with_gaps(spark, d):
    return read(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "props",
        F.when(F.col("value") > 20, F.col("event_type")).alias("mark"))


EVENTS_WITH_GAPS = """(SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value, props,
  CASE WHEN value > 20 THEN event_type END AS mark FROM events)"""

EVENT_TASK = TaskSpec("regression", "user_id")


def _event_steps(spark, d):
    df = events_with_gaps(spark, d)
    return eda.suggest_steps(eda.column_facts(df), EVENT_TASK, [r.asDict() for r in L.leakage_flags(df, "user_id").collect()])


def _steps_of(spark, d, op):
    steps = [s for s in _event_steps(spark, d) if s.op == op]
    table = eda.steps_table(spark, steps)
    detail = F.coalesce(F.col("params")["strategy"], F.col("params")["method"])
    return table.select("op", joined("columns").alias("columns"), detail.alias("detail"))


@query("eda_datetime", f"""
SELECT 'datetime_decompose' AS op, 'ts' AS columns, NULL::VARCHAR AS detail FROM {EVENTS_WITH_GAPS} HAVING count(ts) > 0""")
def eda_datetime(spark, d):
    return _steps_of(spark, d, "datetime_decompose")


@query("eda_datetime_text", f"""
WITH c AS {CONTACTS}, f AS (SELECT day_text AS visit_date, call_text AS call_time FROM c)
SELECT 'visit_date' AS "column", avg((try_cast(visit_date AS DATE) IS NOT NULL)::INT) > 0.9 AS is_datetime FROM f
UNION ALL SELECT 'call_time', avg((try_cast(call_time AS DATE) IS NOT NULL)::INT) > 0.9 FROM f""")
def eda_datetime_text(spark, d):
    df = contacts(spark, d).select(F.col("day_text").alias("visit_date"), F.col("call_text").alias("call_time"))
    return spark.createDataFrame([(f.column, f.datetime) for f in eda.column_facts(df)], '`column` string, is_datetime boolean')


@query("eda_identifier_drops", f"""
SELECT 'drop' AS op, 'event_id' AS columns, NULL::VARCHAR AS detail FROM {EVENTS_WITH_GAPS}
HAVING count(DISTINCT event_id) / count(*)::DOUBLE > 0.5 AND count(*) > 20""")
def eda_identifier_drops(spark, d):
    return _steps_of(spark, d, "drop")


@query("eda_leakage_drops", """
SELECT 'drop' AS op, 'doubled' AS columns FROM orders HAVING abs(corr(o_totalprice * -3 + 7, o_totalprice)) >= 0.95""")
def eda_leakage_drops(spark, d):
    df = read(spark, d, "orders").select(
        "o_custkey", "o_totalprice", "o_orderpriority", (F.col("o_totalprice") * -3 + 7).alias("doubled"))
    report = eda.run_eda(df, TaskSpec("regression", "o_totalprice"))
    return eda.steps_table(spark, [s for s in report.steps if s.op == "drop"]).select("op", joined("columns").alias("columns"))


@query("eda_impute", f"""
SELECT 'impute' AS op, 'value' AS columns, CASE WHEN abs(skewness(value)) > 1 THEN 'median' ELSE 'mean' END AS detail FROM {EVENTS_WITH_GAPS}
HAVING count(*) > count(value)
UNION ALL SELECT 'impute', 'mark', 'most_frequent' FROM {EVENTS_WITH_GAPS} HAVING count(*) > count(mark)""")
def eda_impute(spark, d):
    return _steps_of(spark, d, "impute")


_ENCODE = """SELECT 'encode' AS op, '{c}' AS columns, CASE WHEN count(DISTINCT {c}) > 20 THEN 'target' ELSE 'onehot' END AS detail
FROM """ + EVENTS_WITH_GAPS + """ HAVING count(DISTINCT {c}) > 1"""


@query("eda_encode", " UNION ALL ".join(_ENCODE.format(c=c) for c in ("event_type", "props", "mark")))
def eda_encode(spark, d):
    return _steps_of(spark, d, "encode")


@query("eda_scale", f"""
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM {EVENTS_WITH_GAPS})
SELECT 'scale' AS op, 'value' AS columns, CASE WHEN avg((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INT) > 0.02 THEN 'robust' ELSE 'standard' END AS detail
FROM {EVENTS_WITH_GAPS}, q""")
def eda_scale(spark, d):
    return _steps_of(spark, d, "scale")


@query("eda_resampling", """
SELECT 'quality' AS "column", m < 0.15 AS suggested, CASE WHEN m < 0.15 THEN 'smote' ELSE 'none' END AS method, round(m, 6) AS minority_ratio
 FROM (SELECT least(avg(quality), 1 - avg(quality)) AS m FROM labels)
UNION ALL SELECT 'toxic', m < 0.15, CASE WHEN m < 0.15 THEN 'smote' ELSE 'none' END, round(m, 6) FROM (SELECT least(avg(toxic), 1 - avg(toxic)) AS m FROM labels)""")
def eda_resampling(spark, d):
    profile = P.column_profile(read(spark, d, "labels"))
    rows = []
    for c in ("quality", "toxic"):
        s = eda.resampling_suggestion(profile, TaskSpec("classification", c))
        rows.append((c, s["suggested"], s["method"], s["minority_ratio"]))
    out = spark.createDataFrame(rows, "`column` string, suggested boolean, method string, minority_ratio double")
    return out.withColumn("minority_ratio", rounded("minority_ratio"))


@query("eda_report")
def eda_report(spark, d):
    report = eda.run_eda(events_with_gaps(spark, d), EVENT_TASK)
    steps = eda.steps_table(spark, report.steps).select(
        F.lit("step").alias("kind"), F.col("op").alias("what"), joined("columns").alias("subject"), F.col("rationale").alias("note"))
    found = report.insights.select(F.lit("insight").alias("kind"), F.col("id").alias("what"), "subject", F.col("message").alias("note"))
    return steps.unionByName(found)


@query("column_ml_insights", f"""
SELECT 'step' AS kind, 'impute' AS detail FROM {EVENTS_WITH_GAPS} HAVING count(*) > count(value)
UNION ALL SELECT 'step', 'scale' FROM {EVENTS_WITH_GAPS} HAVING count(value) > 0""")
def column_ml_insights(spark, d):
    df = events_with_gaps(spark, d)
    steps = eda.steps_table(spark, _event_steps(spark, d))
    return eda.column_insights(steps, L.leakage_flags(df, "user_id"), "value").select("kind", "detail")


def _insight_frame(spark, d):
    df = orders_with_gaps(spark, d).select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 2).alias("twice"),
        F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("rest").alias("email_kind"),
        F.when(F.col("o_totalprice") > 450000, 1).otherwise(0).alias("large"))
    return df


_INSIGHTS = f"""i AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 END AS twice,
 CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END AS large FROM {ORDERS_WITH_GAPS})"""


@query("insights_profile", f"""
WITH {_INSIGHTS}
SELECT 'pii_redacted' AS id, NULL::VARCHAR AS subject, 1.0::DOUBLE AS value FROM i HAVING count(*) > 0
UNION ALL SELECT 'high_null_rate', 'twice', round(avg((twice IS NULL)::INT), 6) FROM i HAVING avg((twice IS NULL)::INT) > 0.3
UNION ALL SELECT 'likely_identifier', 'o_orderkey', NULL FROM i HAVING count(DISTINCT o_orderkey) / count(*)::DOUBLE > 0.5
UNION ALL SELECT 'strong_correlation', 'o_totalprice,twice', round(corr(o_totalprice, twice), 3) FROM i
UNION ALL SELECT 'class_imbalance', 'large', round(avg(large), 6) FROM i HAVING avg(large) < 0.15""")
def insights_profile(spark, d):
    df = _insight_frame(spark, d)
    pii = P.detect_pii(df)
    found = insights.profile_insights(P.column_profile(df, pii), TaskSpec("classification", "large"), P.strong_pairs(df, pii))
    return found.select("id", "subject", rounded("value").alias("value"))


@query("insights_leakage", """
SELECT 'leakage_flag' AS id, 'danger' AS tone, 'doubled' AS subject FROM orders HAVING abs(corr(o_totalprice * -3 + 7, o_totalprice)) >= 0.95""")
def insights_leakage(spark, d):
    df = read(spark, d, "orders").select(
        "o_custkey", "o_totalprice", F.col("o_custkey").alias("future_customer"), (F.col("o_totalprice") * -3 + 7).alias("doubled"))
    return insights.leakage_insight(L.leakage_flags(df, "o_totalprice")).select("id", "tone", "subject")


@query("insights_none", """
SELECT 'no_major_concerns' AS id, 'data_quality' AS category, 'success' AS tone FROM lineitem
HAVING abs(corr(l_quantity, l_tax)) < 0.95 AND abs(corr(l_discount, l_tax)) < 0.95 AND count(l_quantity) = count(*)""")
def insights_none(spark, d):
    df = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    task = TaskSpec("regression", "l_tax")
    found = insights.profile_insights(P.column_profile(df), task).unionByName(insights.leakage_insight(L.leakage_flags(df, "l_tax")))
    return insights.all_clear(found, True).select("id", "category", "tone")


# ---- steps that need no training/test separation -------------------------------------------

@query("impute_mode", f"""
WITH m AS (SELECT o_custkey AS k, count(*) AS n FROM {ORDERS_WITH_GAPS} WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, k LIMIT 1),
p AS (SELECT o_orderpriority AS k, count(*) AS n FROM {ORDERS_WITH_GAPS} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, k LIMIT 1)
SELECT o_orderkey, coalesce(o_custkey, (SELECT k FROM m)) AS o_custkey, coalesce(o_orderpriority, (SELECT k FROM p)) AS o_orderpriority FROM {ORDERS_WITH_GAPS}""")
def impute_mode(spark, d):
    return S.impute_most_frequent(orders_with_gaps(spark, d), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("impute_constant", f"SELECT o_orderkey, coalesce(o_custkey, -1) AS o_custkey, coalesce(o_totalprice, -1) AS o_totalprice FROM {ORDERS_WITH_GAPS}")
def impute_constant(spark, d):
    return S.impute_constant(orders_with_gaps(spark, d), ["o_custkey", "o_totalprice"], -1).select("o_orderkey", "o_custkey", "o_totalprice")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("encode_onehot", "SELECT o_orderkey, " + ", ".join(
    f"""CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END::TINYINT AS "o_orderpriority_{p}" """ for p in _PRIORITIES) + f" FROM {ORDERS_WITH_GAPS}")
def encode_onehot(spark, d):
    return S.encode_onehot(orders_with_gaps(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("encode_ordinal", f"""
SELECT o_orderkey, (dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1)::DOUBLE AS o_orderpriority FROM {ORDERS_WITH_GAPS}""")
def encode_ordinal(spark, d):
    return S.encode_ordinal(orders_with_gaps(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("encode_ordinal_many", """
SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS c_name FROM customer""")
def encode_ordinal_many(spark, d):
    return S.encode_ordinal(read(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"], map_limit=100)


@query("bin_equal_width", f"""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {ORDERS_WITH_GAPS})
SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN len(list_filter(range(1, 5), lambda i: o_totalprice > lo + i * ((hi - lo) / 5)))::INT END AS o_totalprice
FROM {ORDERS_WITH_GAPS}, s""")
def bin_equal_width(spark, d):
    return S.bin_equal_width(orders_with_gaps(spark, d), ["o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("datetime_decompose", """
SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day,
 (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek, year(o_orderdate)::INT AS text_year, month(o_orderdate)::INT AS text_month,
 day(o_orderdate)::INT AS text_day, (isodow(o_orderdate) - 1)::INT AS text_dayofweek FROM orders""")
def datetime_decompose(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy").alias("text"))
    return S.datetime_decompose(df, ["o_orderdate", "text"])


@query("drop_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def drop_columns(spark, d):
    return S.drop_columns(read(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "absent"])


@query("custom_transform", "SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price FROM orders")
def custom_transform(spark, d):
    out = S.custom_transform(read(spark, d, "orders"), lambda df: df.select("o_orderkey", F.log("o_totalprice").alias("log_price")))
    return out.select("o_orderkey", rounded("log_price").alias("log_price"))


PLAN = [
    FeatureStep("drop", ["o_custkey"]),
    FeatureStep("impute", ["o_orderpriority"], {"strategy": "constant", "fill_value": "none"}),
    FeatureStep("encode", ["o_orderpriority"], {"method": "ordinal"}),
    FeatureStep("datetime_decompose", ["o_orderdate"]),
    FeatureStep("impute", ["o_totalprice"], {"strategy": "median"}),
    FeatureStep("scale", ["o_totalprice"], {"method": "standard"}),
]


@query("apply_plan", f"""
SELECT o_orderkey, o_orderstatus, o_totalprice, (dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'none')) - 1)::DOUBLE AS o_orderpriority,
 year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day,
 (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek, 'impute,scale' AS deferred FROM {ORDERS_WITH_GAPS}""")
def apply_plan(spark, d):
    result = S.apply_plan(orders_with_gaps(spark, d), PLAN, "o_orderstatus")
    return result.data.withColumn("deferred", F.lit(",".join(s.op for s in result.deferred)))


# ---- steps learned from training rows ------------------------------------------------------

_TRAIN = f"{unit_sql('o_orderkey')} < 0.8"


def _with_split(spark, d):
    return orders_with_gaps(spark, d).withColumn("is_train", unit_hash("o_orderkey") < 0.8)


def _imputed(spark, d, strategy):
    df = _with_split(spark, d)
    fills = impute_literals(df.where("is_train"), {"o_custkey": strategy, "o_totalprice": strategy})
    return df.select("o_orderkey", *[rounded(F.coalesce(F.col(c).cast("double"), F.lit(v)), 4).alias(c) for c, v in fills.items()])


def _imputed_sql(f):
    return f"""WITH g AS (SELECT *, {_TRAIN} AS is_train FROM {ORDERS_WITH_GAPS}),
m AS (SELECT {f.format(c='o_custkey')} AS a, {f.format(c='o_totalprice')} AS b FROM g WHERE is_train)
SELECT o_orderkey, round(coalesce(o_custkey::DOUBLE, a), 4) AS o_custkey, round(coalesce(o_totalprice, b), 4) AS o_totalprice FROM g, m"""


@query("impute_mean", _imputed_sql("avg({c})"))
def impute_mean(spark, d):
    return _imputed(spark, d, "mean")


@query("impute_median", _imputed_sql("quantile_cont({c}::DOUBLE, 0.5)"))
def impute_median(spark, d):
    return _imputed(spark, d, "median")


def _scaled(spark, d, method):
    df = _with_split(spark, d)
    found = scale_literals(df.where("is_train"), {"o_custkey": method, "o_totalprice": method})
    return df.select("o_orderkey", *[rounded((F.col(c).cast("double") - a) / b).alias(c) for c, (a, b) in found.items()])


def _scaled_sql(center, spread):
    return f"""WITH g AS (SELECT *, {_TRAIN} AS is_train FROM {ORDERS_WITH_GAPS}),
m AS (SELECT {center.format(c='o_custkey')} AS a1, {spread.format(c='o_custkey')} AS s1, {center.format(c='o_totalprice')} AS a2,
 {spread.format(c='o_totalprice')} AS s2 FROM g WHERE is_train)
SELECT o_orderkey, round((o_custkey - a1) / s1, 6) AS o_custkey, round((o_totalprice - a2) / s2, 6) AS o_totalprice FROM g, m"""


@query("scale_standard", _scaled_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query("scale_minmax", _scaled_sql("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query("scale_robust", _scaled_sql("quantile_cont({c}::DOUBLE, 0.5)", "(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25))"))
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


_FOLD = f"floor({unit_sql('p_partkey', 'encode')} * 5)::INT"
_SMOOTH = """CASE WHEN n > 0 THEN n * gv / (n * gv + greatest(q / n - (s / n) * (s / n), 0)) * (s / n)
 + (1 - n * gv / (n * gv + greatest(q / n - (s / n) * (s / n), 0))) * gm ELSE gm END"""


@query("encode_target_oof", f"""
WITH y AS (SELECT p_partkey, p_brand AS v, {_FOLD} AS f, p_retailprice - (SELECT avg(p_retailprice) FROM part) AS y FROM part),
c AS (SELECT v, f, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM y GROUP BY 1, 2),
o AS (SELECT v, f, sum(n) OVER (PARTITION BY v) - n AS n, sum(s) OVER (PARTITION BY v) - s AS s, sum(q) OVER (PARTITION BY v) - q AS q FROM c),
g AS (SELECT a.f, avg(y.y) AS gm, var_pop(y.y) AS gv FROM (SELECT DISTINCT f FROM y) a JOIN y ON y.f <> a.f GROUP BY 1)
SELECT p_partkey, round({_SMOOTH} + (SELECT avg(p_retailprice) FROM part), 4) AS encoded FROM y JOIN o USING (v, f) JOIN g USING (f)""")
def encode_target_oof(spark, d):
    df = read(spark, d, "part")
    e = fit_encoding(df, "p_brand", F.col("p_retailprice"), encoding_fold("p_partkey"))
    keyed = df.select("p_partkey", F.col("p_brand").alias("v"), encoding_fold("p_partkey").alias("f"))
    return keyed.join(e.folds, ["v", "f"], "left").select("p_partkey", rounded("e", 4).alias("encoded"))


@query("encode_target_full", f"""
WITH m AS (SELECT avg(p_retailprice) AS m FROM part), y AS (SELECT p_brand AS v, p_retailprice - m AS y FROM part, m),
c AS (SELECT v, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM y GROUP BY 1), g AS (SELECT avg(y) AS gm, var_pop(y) AS gv FROM y)
SELECT v AS p_brand, round({_SMOOTH} + m, 4) AS encoded FROM c, g, m""")
def encode_target_full(spark, d):
    e = fit_encoding(read(spark, d, "part"), "p_brand", F.col("p_retailprice"), encoding_fold("p_partkey"))
    return e.table.select(F.col("v").alias("p_brand"), rounded("e", 4).alias("encoded"))


PREPROCESS = [
    FeatureStep("impute", ["o_custkey"], {"strategy": "median"}),
    FeatureStep("scale", ["o_custkey", "o_totalprice"], {"method": "standard"}),
    FeatureStep("encode", ["o_orderpriority"], {"method": "target"}),
]


@query("preprocess_train", f"""
WITH g AS (SELECT *, {_TRAIN} AS is_train, (o_orderstatus = 'F')::INT::DOUBLE AS y FROM {ORDERS_WITH_GAPS}), t AS (SELECT * FROM g WHERE is_train),
md AS (SELECT quantile_cont(o_custkey::DOUBLE, 0.5) AS md FROM t),
k AS (SELECT avg(coalesce(o_custkey, md)) AS a1, stddev_pop(coalesce(o_custkey, md)) AS s1, avg(o_totalprice) AS a2, stddev_pop(o_totalprice) AS s2 FROM t, md),
c AS (SELECT o_orderpriority AS v, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1),
p AS (SELECT avg(y) AS gm, var_pop(y) AS gv FROM t), e AS (SELECT v, {_SMOOTH} AS e FROM c, p)
SELECT o_orderkey, round((coalesce(o_custkey, md) - a1) / s1, 6) AS f0, round(coalesce((o_totalprice - a2) / s2, 0), 6) AS f1, round(coalesce(e, gm), 6) AS f2
FROM g CROSS JOIN md CROSS JOIN k CROSS JOIN p LEFT JOIN e ON e.v = g.o_orderpriority WHERE NOT is_train""")
def preprocess_train(spark, d):
    df = _with_split(spark, d).withColumn("label", (F.col("o_orderstatus") == "F").cast("int").cast("double"))
    prep = fit_preprocessor(df.where("is_train"), ["o_custkey", "o_totalprice", "o_orderpriority"], "label", "o_orderkey", PREPROCESS)
    out = prep.transform(df.where("not is_train"), "x", as_array=True)
    return out.select("o_orderkey", *[rounded(F.col("x")[i]).alias(f"f{i}") for i in range(3)])
