"""Correlation, missingness, outliers, leakage, heuristics, target dependence and drift."""

from itertools import combinations

from pyspark.sql import functions as F

from tabprofile.catalog.registry import (
    LINEITEM_NUMERIC, ORDERS, ORDERS_WITH_GAPS, joined, orders_with_gaps, per_column_sql, query, read, rounded,
)
from tabprofile.operators import association, leakage, outliers, profile, quality


def _matrix(df, digits=6):
    return df.select("col_a", "col_b", rounded("value", digits).alias("value"))


def _pairs_sql(names, expression, source, diagonal):
    """Both triangles and the diagonal; ``expression`` takes the two column names."""
    rows = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {expression.format(a=a, b=b)} AS v FROM {source}" for a, b in combinations(names, 2)]
    rows += [f"SELECT '{n}' AS col_a, '{n}' AS col_b, {diagonal.format(a=n)} AS v FROM {source}" for n in names]
    return f"""WITH upper_half AS ({' UNION ALL '.join(rows)}), clean AS (
 SELECT col_a, col_b, CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE round(v, 6) END::DOUBLE AS value FROM upper_half)
SELECT * FROM clean UNION ALL SELECT col_b AS col_a, col_a AS col_b, value FROM clean WHERE col_a <> col_b"""


@query("corr_pearson", _pairs_sql(LINEITEM_NUMERIC, "corr({a}, {b})", "lineitem", "corr({a}, {a})"))
def corr_pearson(spark, d):
    return _matrix(association.correlation_matrix(read(spark, d, "lineitem")))


_GAPS = ["o_orderkey", "o_custkey", "o_totalprice", "one"]
_WITH_ONE = f"(SELECT *, 1 AS one FROM {ORDERS_WITH_GAPS})"


def _with_constant(spark, d):
    return orders_with_gaps(spark, d).withColumn("one", F.lit(1))


@query("corr_pearson_gaps", _pairs_sql(_GAPS, "corr({a}, {b})", _WITH_ONE, "corr({a}, {a})"))
def corr_pearson_gaps(spark, d):
    return _matrix(association.correlation_matrix(_with_constant(spark, d)))


def _rank(a, b):
    return f"(rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0)"


def _spearman_sql(names, source):
    rows = []
    for a, b in combinations(names, 2):
        rows.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, corr(ra, rb) AS v FROM (SELECT {_rank(a, b)} AS ra, {_rank(b, a)} AS rb
 FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    rows += [f"SELECT '{n}' AS col_a, '{n}' AS col_b, corr({n}, {n}) AS v FROM {source}" for n in names]
    return f"""WITH upper_half AS ({' UNION ALL '.join(rows)}), clean AS (
 SELECT col_a, col_b, CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE round(v, 6) END::DOUBLE AS value FROM upper_half)
SELECT * FROM clean UNION ALL SELECT col_b AS col_a, col_a AS col_b, value FROM clean WHERE col_a <> col_b"""


@query("corr_spearman", _spearman_sql(_GAPS, _WITH_ONE))
def corr_spearman(spark, d):
    return _matrix(association.correlation_matrix(_with_constant(spark, d), "spearman"))


def _kendall_sql(names, source):
    rows = []
    for a, b in combinations(names, 2):
        rows.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
 sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b}))::DOUBLE / sqrt(sum((x.{a} <> y.{a})::INT)::DOUBLE * sum((x.{b} <> y.{b})::INT)::DOUBLE) AS v
 FROM {source} x, {source} y WHERE x.{a} IS NOT NULL AND x.{b} IS NOT NULL AND y.{a} IS NOT NULL AND y.{b} IS NOT NULL""")
    rows += [f"SELECT '{n}' AS col_a, '{n}' AS col_b, CASE WHEN min({n}) < max({n}) THEN 1.0 ELSE 0.0 END AS v FROM {source}" for n in names]
    return f"""WITH upper_half AS ({' UNION ALL '.join(rows)}), clean AS (
 SELECT col_a, col_b, CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE round(v, 6) END::DOUBLE AS value FROM upper_half)
SELECT * FROM clean UNION ALL SELECT col_b AS col_a, col_a AS col_b, value FROM clean WHERE col_a <> col_b"""


_CUSTOMER_GAPS = """(SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END AS c_nationkey, c_acctbal FROM customer)"""


def _customer_gaps(spark, d):
    return read(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("c_nationkey"), "c_acctbal")


@query("corr_kendall", _kendall_sql(["c_custkey", "c_nationkey", "c_acctbal"], _CUSTOMER_GAPS))
def corr_kendall(spark, d):
    return _matrix(association.correlation_matrix(_customer_gaps(spark, d), "kendall"))


def _information_sql(names, table, bins=10):
    edges = ", ".join(f"quantile_cont({n}::DOUBLE, [{', '.join(str(i / bins) for i in range(1, bins))}]) AS e_{n}" for n in names)
    codes = ", ".join(f"len(list_filter(e_{n}, lambda e: {n} > e)) AS b_{n}" for n in names)
    rows = [f"""SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT sum(n / t * ln(n * t / (na * nb))) FROM (SELECT n, sum(n) OVER () AS t,
 sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM
 (SELECT b_{a} AS a, b_{b} AS b, count(*)::DOUBLE AS n FROM codes GROUP BY 1, 2))) AS v""" for a, b in combinations(names, 2)]
    rows += [f"SELECT '{n}' AS col_a, '{n}' AS col_b, 1.0 AS v" for n in names]
    return f"""WITH edges AS (SELECT {edges} FROM {table}), codes AS (SELECT {codes} FROM {table}, edges),
upper_half AS ({' UNION ALL '.join(rows)}), clean AS (SELECT col_a, col_b, round(v, 6)::DOUBLE AS value FROM upper_half)
SELECT * FROM clean UNION ALL SELECT col_b AS col_a, col_a AS col_b, value FROM clean WHERE col_a <> col_b"""


_INFORMATION = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_mutual_info", _information_sql(_INFORMATION, "lineitem"))
def corr_mutual_info(spark, d):
    return _matrix(association.correlation_matrix(read(spark, d, "lineitem").select(*_INFORMATION), "mutual_info"))


def _neighbour_information_sql(names, source, k=3):
    scaled = ", ".join(f"{n} / (SELECT printf('%.10g', stddev_pop({n}))::DOUBLE FROM complete) AS {n}" for n in names)
    parts = [f"""SELECT '{a}' AS col_a, '{b}' AS col_b, (WITH d AS (SELECT i.rid AS i, j.rid AS j, abs(i.{a} - j.{a}) AS da, abs(i.{b} - j.{b}) AS db FROM scaled i, scaled j),
 r AS (SELECT i, min(greatest(da, db), {k})[{k}] AS r FROM d WHERE i <> j GROUP BY i),
 c AS (SELECT i, sum((CASE WHEN r > 0 THEN da < r ELSE da = 0 END)::INT)::BIGINT AS na, sum((CASE WHEN r > 0 THEN db < r ELSE db = 0 END)::INT)::BIGINT AS nb FROM d JOIN r USING (i) GROUP BY i)
 SELECT greatest(0, (SELECT max(psi) FROM h) + (SELECT psi FROM h WHERE n = {k}) - avg(x.psi + y.psi)) FROM c JOIN h x ON x.n = na JOIN h y ON y.n = nb) AS v"""
             for a, b in combinations(names, 2)]
    parts += [f"SELECT '{n}', '{n}', 1.0" for n in names]
    return f"""WITH complete AS (SELECT row_number() OVER () AS rid, {', '.join(f'{n}::DOUBLE AS {n}' for n in names)} FROM {source} WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)}),
 scaled AS (SELECT rid, {scaled} FROM complete),
 h AS (SELECT g AS n, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / g) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi FROM range(1, 1 + (SELECT count(*) FROM complete)) t(g)),
 upper_half AS ({' UNION ALL '.join(parts)}), clean AS (SELECT col_a, col_b, round(v, 6)::DOUBLE AS value FROM upper_half)
SELECT * FROM clean UNION ALL SELECT col_b AS col_a, col_a AS col_b, value FROM clean WHERE col_a <> col_b"""


@query("corr_neighbour_information", _neighbour_information_sql(["c_custkey", "c_nationkey", "c_acctbal"], _CUSTOMER_GAPS))
def corr_neighbour_information(spark, d):
    return _matrix(association.correlation_matrix(_customer_gaps(spark, d), "mutual_info_neighbours"))


_VARIANCES = ", ".join(f"('{c}', (SELECT var_samp({c}) FROM lineitem))" for c in LINEITEM_NUMERIC)


@query("corr_truncate", f"""
WITH top AS (SELECT c FROM (VALUES {_VARIANCES}) t(c, v) ORDER BY v DESC LIMIT 4), wide AS (
""" + _pairs_sql(LINEITEM_NUMERIC, "corr({a}, {b})", "lineitem", "corr({a}, {a})") + """)
SELECT * FROM wide WHERE col_a IN (SELECT c FROM top) AND col_b IN (SELECT c FROM top)""")
def corr_truncate(spark, d):
    return _matrix(association.correlation_matrix(read(spark, d, "lineitem"), limit=4))


@query("missing_per_column", per_column_sql(ORDERS, """
SELECT '{c}' AS "column", sum(({c} IS NULL)::INT)::BIGINT AS null_count, round(avg(({c} IS NULL)::INT), 6) AS null_rate FROM """ + ORDERS_WITH_GAPS))
def missing_per_column(spark, d):
    return association.missing_per_column(orders_with_gaps(spark, d)).select(
        "column", "null_count", rounded("null_rate").alias("null_rate"))


@query("missing_correlation", _pairs_sql(
    ["o_custkey", "o_totalprice", "o_orderpriority"], "corr(({a} IS NULL)::INT, ({b} IS NULL)::INT)", ORDERS_WITH_GAPS,
    "corr(({a} IS NULL)::INT, ({a} IS NULL)::INT)"))
def missing_correlation(spark, d):
    return _matrix(association.missing_correlation(orders_with_gaps(spark, d)))


# Event values are skewed to the right, so both fences and deviations flag some of them.
_EVENT_NUMBERS = ["event_id", "user_id", "value"]


def _events(spark, d):
    return read(spark, d, "events").select(*_EVENT_NUMBERS)


def _report(df):
    return df.select("method", "outlier_count", joined("affected_columns").alias("affected_columns"), joined("examples").alias("examples"))


def _outlier_sql(method, facts, tests):
    columns = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c WHERE EXISTS (SELECT 1 FROM hits WHERE h_{c})" for i, c in enumerate(tests))
    flags = ", ".join(f"coalesce({t}, FALSE) AS h_{c}" for c, t in tests.items())
    either = " OR ".join(f"h_{c}" for c in tests)
    return f"""WITH f AS (SELECT {facts} FROM events), hits AS (SELECT event_id, {flags} FROM events, f),
bad AS (SELECT event_id FROM hits WHERE {either})
SELECT '{method}' AS method, (SELECT count(*) FROM bad) AS outlier_count,
 coalesce((SELECT string_agg(c, ',' ORDER BY i) FROM ({columns})), '') AS affected_columns,
 coalesce((SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM bad ORDER BY event_id LIMIT 20)), '') AS examples"""


_Q = lambda c, p: f"quantile_cont({c}::DOUBLE, {p})"
_IQR_FACTS = ", ".join(f"{_Q(c, 0.25)} AS q1_{c}, {_Q(c, 0.75)} AS q3_{c}" for c in _EVENT_NUMBERS)
_IQR_TESTS = {c: f"({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))" for c in _EVENT_NUMBERS}
_Z_FACTS = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _EVENT_NUMBERS)
_Z_TESTS = {c: f"(abs(({c} - m_{c}) / s_{c}) > 3)" for c in _EVENT_NUMBERS}


@query("outliers_iqr", _outlier_sql("iqr", _IQR_FACTS, _IQR_TESTS))
def outliers_iqr(spark, d):
    return _report(outliers.outlier_report(_events(spark, d), "iqr", "event_id"))


@query("outliers_zscore", _outlier_sql("zscore", _Z_FACTS, _Z_TESTS))
def outliers_zscore(spark, d):
    return _report(outliers.outlier_report(_events(spark, d), "zscore", "event_id"))


@query("outlier_rows", f"""
WITH f AS (SELECT {_IQR_FACTS} FROM events)
SELECT event_id, value FROM events, f WHERE {' OR '.join(_IQR_TESTS.values())}""")
def outlier_rows(spark, d):
    return outliers.detect_outliers(_events(spark, d), "iqr", "event_id").select("event_id", "value")


@query("outlier_rate", f"""
WITH f AS (SELECT {_IQR_FACTS} FROM events)
{per_column_sql(_EVENT_NUMBERS, '''SELECT '{c}' AS "column", round(avg(({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c})
 OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))::INT), 6) AS outlier_rate FROM events, f''')}""")
def outlier_rate(spark, d):
    out = outliers.outlier_rate(_events(spark, d), _EVENT_NUMBERS)
    return out.select("column", rounded("outlier_rate").alias("outlier_rate"))


@query("outliers_isolation_forest")
def outliers_isolation_forest(spark, d):
    return _report(outliers.outlier_report(read(spark, d, "customer"), "isolation_forest", "c_custkey"))


@query("outliers_lof", """
WITH p AS (SELECT c_custkey AS id, c_custkey::DOUBLE AS a, c_nationkey::DOUBLE AS b, c_acctbal AS c FROM customer),
k AS (SELECT least(20, count(*) - 1) AS k FROM p),
n AS (SELECT * FROM (SELECT x.id, y.id AS o, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)) AS dist,
   row_number() OVER (PARTITION BY x.id ORDER BY (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c), y.id) AS r
   FROM p x JOIN p y ON x.id <> y.id), k WHERE r <= k),
kd AS (SELECT id, max(dist) AS kd FROM n GROUP BY id),
lrd AS (SELECT n.id, 1 / (avg(greatest(kd.kd, n.dist)) + 1e-10) AS lrd FROM n JOIN kd ON kd.id = n.o GROUP BY n.id),
lof AS (SELECT n.id, avg(l2.lrd) / any_value(l1.lrd) AS lof FROM n JOIN lrd l1 ON l1.id = n.id JOIN lrd l2 ON l2.id = n.o GROUP BY n.id)
SELECT id AS c_custkey, round(lof, 5) AS lof, lof > 1.5 AS is_outlier FROM lof""")
def outliers_lof(spark, d):
    out = outliers.lof_scores(read(spark, d, "customer"), "c_custkey")
    return out.select("c_custkey", rounded("lof", 5).alias("lof"), (F.col("lof") > outliers.LOF_LIMIT).alias("is_outlier"))


# Customers and orders with columns that give the target away to a known degree.
def _leaky_orders(spark, d):
    return read(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        (F.col("o_totalprice") * -3 + 7).alias("doubled"), F.col("o_custkey").alias("future_customer"))


@query("leakage_numeric", """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * -3 + 7 AS doubled, o_custkey AS future_customer FROM orders),
r AS (SELECT 'o_orderkey' AS "column", corr(o_orderkey, o_totalprice) AS r FROM o UNION ALL SELECT 'o_custkey', corr(o_custkey, o_totalprice) FROM o
 UNION ALL SELECT 'doubled', corr(doubled, o_totalprice) FROM o UNION ALL SELECT 'future_customer', corr(future_customer, o_totalprice) FROM o)
SELECT "column", round(r, 6) AS score, abs(r) >= 0.95 AS flagged FROM r""")
def leakage_numeric(spark, d):
    out = leakage.target_correlations(_leaky_orders(spark, d), "o_totalprice")
    return out.select("column", rounded("score").alias("score"), (F.abs("score") >= leakage.LEAKY_CORRELATION).alias("flagged"))


def _leaky_parts(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size", F.lower("p_type").alias("kind"),
        F.when(F.col("p_size") != 7, F.col("p_type")).alias("p_type"))


_LEAKY_PARTS = "(SELECT p_partkey, p_name, p_brand, p_size, lower(p_type) AS kind, CASE WHEN p_size <> 7 THEN p_type END AS p_type FROM part)"


@query("leakage_purity", per_column_sql(["p_partkey", "p_name", "p_brand", "p_size", "kind"], f"""
SELECT '{{c}}' AS "column", round(sum(CASE WHEN labelled > 0 THEN best::DOUBLE / labelled * size ELSE 0 END) / (SELECT count(*) FROM part), 6) AS score,
  count(*) AS n_unique
FROM (SELECT v, sum(n) AS size, max(CASE WHEN p_type IS NOT NULL THEN n END) AS best, coalesce(sum(CASE WHEN p_type IS NOT NULL THEN n END), 0) AS labelled
  FROM (SELECT {{c}} AS v, p_type, count(*) AS n FROM {_LEAKY_PARTS} WHERE {{c}} IS NOT NULL GROUP BY 1, 2) GROUP BY v)"""))
def leakage_purity(spark, d):
    return leakage.target_purity(_leaky_parts(spark, d), "p_type").select("column", rounded("score").alias("score"), "n_unique")


@query("leakage_flags", """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * -3 + 7 AS doubled, o_custkey AS future_customer FROM orders)
SELECT 'future_customer' AS "column", 'name' AS rule, 'medium' AS severity,
  'column name suggests it may be derived from or occur after the target event' AS reason WHERE (SELECT count(*) FROM o) > 0
UNION ALL SELECT 'doubled', 'correlation', 'high', 'near-perfect correlation with target (' || printf('%.3f', r) || ')'
 FROM (SELECT corr(doubled, o_totalprice) AS r FROM o) WHERE abs(r) >= 0.95
UNION ALL SELECT 'o_custkey', 'correlation', 'high', 'near-perfect correlation with target (' || printf('%.3f', r) || ')'
 FROM (SELECT corr(o_custkey, o_totalprice) AS r FROM o) WHERE abs(r) >= 0.95""")
def leakage_flags(spark, d):
    return leakage.leakage_flags(_leaky_orders(spark, d), "o_totalprice").select("column", "rule", "severity", "reason")


@query("identifier_columns", per_column_sql(["o_orderkey", "o_custkey", "o_orderdate"], """
SELECT '{c}' AS "column", n AS n_unique FROM (SELECT count(DISTINCT {c}) AS n, count(*) AS t FROM orders)
WHERE CASE WHEN regexp_matches('{c}', 'id|uuid|guid|key|index') THEN n / t::DOUBLE > 0.5 ELSE n / t::DOUBLE > 0.98 END""")
    + """ UNION ALL SELECT 'o_orderpriority', n FROM (SELECT count(DISTINCT o_orderpriority) AS n, count(*) AS t FROM orders) WHERE n / t::DOUBLE > 0.5""")
def identifier_columns(spark, d):
    return leakage.identifier_columns(profile.column_profile(read(spark, d, "orders")))


@query("minority_ratio", """
WITH l AS (SELECT quality, toxic, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS grade FROM labels)
SELECT 'quality' AS "column", round(least(avg(quality), 1 - avg(quality)), 6) AS minority_ratio FROM l
UNION ALL SELECT 'toxic', round(least(avg(toxic), 1 - avg(toxic)), 6) FROM l
UNION ALL SELECT 'grade', (SELECT round(min(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM l GROUP BY grade))
UNION ALL SELECT 'exact', (SELECT round(min(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM l GROUP BY grade))""")
def minority_ratio(spark, d):
    df = read(spark, d, "labels").select(
        "quality", "toxic", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("grade"))
    ruled = leakage.minority_share(profile.column_profile(df))
    exact = leakage.class_minority(df, "grade").select(F.lit("exact").alias("column"), "minority_ratio")
    return ruled.unionByName(exact).select("column", rounded("minority_ratio").alias("minority_ratio"))


@query("target_guard", per_column_sql(ORDERS, """
SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) / count(*)::DOUBLE > 0.5 AS rejected FROM orders"""))
def target_guard(spark, d):
    return leakage.target_guard(read(spark, d, "orders"), ORDERS)


@query("target_infogain", per_column_sql(["p_brand", "p_size", "p_name"], """
SELECT '{c}' AS "column", round((SELECT -sum(n / t * ln(n / t)) FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS t FROM part GROUP BY p_type))
 - (SELECT sum(nv / t * h) FROM (SELECT v, any_value(nv) AS nv, any_value(t) AS t, -sum(n / nv * ln(n / nv)) AS h FROM
   (SELECT {c} AS v, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY {c}) AS nv, sum(count(*)) OVER () AS t FROM part GROUP BY {c}, p_type) GROUP BY v)), 6) AS information_gain"""))
def target_infogain(spark, d):
    out = quality.information_gain(read(spark, d, "part"), ["p_brand", "p_size", "p_name"], "p_type")
    return out.select("column", rounded("information_gain").alias("information_gain"))


@query("target_chi2", per_column_sql(["p_brand", "p_size"], """
SELECT '{c}' AS "column", round(sum((o - e) * (o - e) / e), 4) AS chi2, ((count(DISTINCT v) - 1) * (count(DISTINCT t) - 1))::BIGINT AS degrees FROM (
 SELECT r.v, c.t, coalesce(x.n, 0) AS o, r.n * c.n / (SELECT count(*) FROM part)::DOUBLE AS e FROM
 (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1) r CROSS JOIN (SELECT p_type AS t, count(*) AS n FROM part GROUP BY 1) c
 LEFT JOIN (SELECT {c} AS v, p_type AS t, count(*) AS n FROM part GROUP BY 1, 2) x ON x.v = r.v AND x.t = c.t)"""))
def target_chi2(spark, d):
    out = quality.chi_square(read(spark, d, "part"), ["p_brand", "p_size"], "p_type")
    return out.select("column", rounded("chi2", 4).alias("chi2"), "degrees")


@query("target_anova", per_column_sql(["l_quantity", "l_extendedprice", "l_tax"], """
SELECT '{c}' AS "column", round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*))), 4) AS f FROM
 (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS v, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY 1)"""))
def target_anova(spark, d):
    out = quality.anova_f(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_returnflag")
    return out.select("column", rounded("f", 4).alias("f"))


_CUT = "TIMESTAMP '1998-06-01'"


def _before_after(spark, d):
    df = read(spark, d, "lineitem")
    cut = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp")
    return df.where(cut), df.where(~cut)


@query("drift_psi", f"""
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_shipdate < {_CUT}),
b AS (SELECT l_shipdate < {_CUT} AS early, len(list_filter(range(1, 10), lambda i: l_extendedprice >= lo + i * ((hi - lo) / 10))) AS bin, count(*)::DOUBLE AS n
  FROM lineitem, e GROUP BY 1, 2),
f AS (SELECT r.i, coalesce(a.n, 0.5) AS x, coalesce(c.n, 0.5) AS y FROM range(0, 10) r(i) LEFT JOIN b a ON a.bin = r.i AND a.early LEFT JOIN b c ON c.bin = r.i AND NOT c.early),
p AS (SELECT x / sum(x) OVER () AS x, y / sum(y) OVER () AS y FROM f)
SELECT 'l_extendedprice' AS "column", round(sum((y - x) * ln(y / x)), 8) AS psi FROM p""")
def drift_psi(spark, d):
    before, after = _before_after(spark, d)
    out = quality.population_stability(before, after, "l_extendedprice")
    return out.select("column", rounded("psi", 8).alias("psi"))


@query("drift_ks", f"""
WITH v AS (SELECT l_extendedprice AS value, sum((l_shipdate < {_CUT})::INT) AS a, sum((l_shipdate >= {_CUT})::INT) AS b FROM lineitem GROUP BY 1),
c AS (SELECT sum(a) OVER (ORDER BY value) / sum(a) OVER ()::DOUBLE AS x, sum(b) OVER (ORDER BY value) / sum(b) OVER ()::DOUBLE AS y FROM v)
SELECT 'l_extendedprice' AS "column", round(max(abs(x - y)), 8) AS ks FROM c""")
def drift_ks(spark, d):
    before, after = _before_after(spark, d)
    out = quality.kolmogorov_smirnov(before, after, "l_extendedprice")
    return out.select("column", rounded("ks", 8).alias("ks"))


@query("drift_summary", per_column_sql(["l_quantity", "l_extendedprice"], f"""
SELECT '{{c}}' AS "column", round(avg({{c}}) FILTER (l_shipdate < {_CUT}), 4) AS mean_before, round(avg({{c}}) FILTER (l_shipdate >= {_CUT}), 4) AS mean_after,
 round((avg({{c}}) FILTER (l_shipdate >= {_CUT}) - avg({{c}}) FILTER (l_shipdate < {_CUT})) / stddev_samp({{c}}) FILTER (l_shipdate < {_CUT}), 6) AS mean_shift FROM lineitem"""))
def drift_summary(spark, d):
    before, after = _before_after(spark, d)
    out = quality.drift_summary(before, after, ["l_quantity", "l_extendedprice"])
    return out.select("column", rounded("mean_before", 4).alias("mean_before"), rounded("mean_after", 4).alias("mean_after"),
                      rounded("mean_shift").alias("mean_shift"))


_ISSUE_COLUMNS = ["o_orderkey", "o_totalprice", "doubled", "fixed", "flag", "gaps", "mixed", "code"]
_ISSUE_TEXTS = ["fixed", "flag", "mixed", "code"]
_ISSUE_NUMBERS = ["o_orderkey", "o_totalprice", "doubled", "gaps"]
_ISSUE_PARTS = [
    per_column_sql(_ISSUE_COLUMNS, """SELECT '{c}' AS "column", 'constant' AS issue, count(DISTINCT {c})::DOUBLE AS value FROM o HAVING count(DISTINCT {c}) <= 1"""),
    per_column_sql(_ISSUE_COLUMNS, """SELECT '{c}', 'near_constant', max(n) / sum(n)::DOUBLE FROM (SELECT count({c}) AS n FROM o WHERE {c} IS NOT NULL GROUP BY {c}) HAVING max(n) / sum(n) >= 0.95 AND count(*) > 1"""),
    per_column_sql(_ISSUE_TEXTS, """SELECT '{c}', 'high_cardinality', count(DISTINCT {c}) / count(*)::DOUBLE FROM o HAVING count(DISTINCT {c}) / count(*) > 0.5"""),
    per_column_sql(_ISSUE_COLUMNS, """SELECT '{c}', 'sparse', avg(({c} IS NULL)::INT) FROM o HAVING avg(({c} IS NULL)::INT) > 0.5"""),
    per_column_sql(_ISSUE_TEXTS, """SELECT '{c}', 'mixed_types', avg((try_cast({c} AS DOUBLE) IS NOT NULL)::INT) FILTER ({c} IS NOT NULL) AS v FROM o HAVING v > 0.05 AND v < 0.95"""),
    *[f"SELECT '{b}', 'correlated_with_{a}', corr({a}, {b}) AS v FROM o HAVING abs(v) >= 0.95"
      for i, a in enumerate(_ISSUE_NUMBERS) for b in _ISSUE_NUMBERS[i + 1:]],
]


@query("quality_issues", """
WITH o AS (SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS doubled, 'x' AS fixed,
  CASE WHEN o_totalprice > 1100 THEN 'usual' ELSE 'rare' END AS flag, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS gaps,
  CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE o_custkey::VARCHAR END AS mixed, o_orderkey::VARCHAR AS code FROM orders)
SELECT "column", issue, round(value, 6) AS value FROM (""" + "\nUNION ALL ".join(_ISSUE_PARTS) + ")")
def quality_issues(spark, d):
    f = F.col("o_orderstatus") == "F"
    df = read(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("doubled"), F.lit("x").alias("fixed"),
        F.when(F.col("o_totalprice") > 1100, "usual").otherwise("rare").alias("flag"),
        F.when(f, F.col("o_totalprice")).alias("gaps"),
        F.when(f, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
        F.col("o_orderkey").cast("string").alias("code"))
    return quality.quality_issues(df).select("column", "issue", rounded("value").alias("value"))
