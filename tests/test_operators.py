"""Operators against small frames with known answers."""

import datetime
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprofile.operators import association, columns, leakage, neighbours, outliers, pii, profile, quality, rows, split, steps
from tabprofile.sources import loading, sinks


def frame(spark, **data):
    return spark.createDataFrame(pd.DataFrame(data))


def matrix(df):
    return {(r["col_a"], r["col_b"]): r["value"] for r in df.collect()}


# ---- rows -----------------------------------------------------------------------------------

def test_search_ignores_case_and_nulls(spark):
    df = spark.createDataFrame([(1, "Alpha"), (2, None), (3, "beta")], "id int, name string")
    assert [r["id"] for r in rows.search(df, "ALP").collect()] == [1]
    assert rows.search(df, "nan").count() == 0


def test_sort_keeps_missing_last_both_ways(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id int, v double")
    assert [r["id"] for r in rows.sort_rows(df, "v").collect()] == [3, 1, 2]
    assert [r["id"] for r in rows.sort_rows(df, "v", True).collect()] == [1, 3, 2]
    with pytest.raises(ValueError):
        rows.sort_rows(df, "absent")


@pytest.mark.parametrize("page,size", [(0, 10), (1, 0), (1, 201)])
def test_page_rejects_bad_bounds(spark, page, size):
    with pytest.raises(ValueError):
        rows.page(spark.range(3), page, size, "id")


def test_page_and_duplicates(spark):
    df = frame(spark, id=range(6), v=[1, 1, 2, 2, 3, 4])
    assert [r["id"] for r in rows.page(df, 2, 2, "id").collect()] == [2, 3]
    flagged = rows.flag_duplicates(rows.page(df, 1, 3, "id").select("v"))
    assert sorted(r["is_duplicate"] for r in flagged.collect()) == [False, True, True]


def test_column_sample_is_capped(spark):
    assert rows.column_sample(spark.range(100), "id", 50, "id").count() == 20
    with pytest.raises(ValueError):
        rows.column_sample(spark.range(3), "absent")


# ---- personal data --------------------------------------------------------------------------

def test_pii_by_name_and_by_value(spark):
    df = frame(spark, customer_email=["x"] * 5, contact=[f"u{i}@mail.org" for i in range(5)], day=["2022-01-0%d" % (i + 1) for i in range(5)],
               host=["10.0.0.%d" % i for i in range(5)], note=["hello"] * 5)
    found = pii.detect_pii(df)
    assert {c: (h.pii_type, h.method) for c, h in found.items()} == {
        "customer_email": ("email", "name"), "contact": ("email", "pattern"), "host": ("ip_address", "pattern")}
    out = pii.redact(df, found).first()
    assert out["contact"] == pii.REDACTED and out["note"] == "hello"


def test_pii_needs_more_than_the_share(spark):
    df = frame(spark, c=["a@b.co"] * 4 + ["no"])
    assert pii.detect_pii(df) == {}


def test_pii_of_empty_text_column(spark):
    assert pii.detect_pii(spark.createDataFrame([(None,)], "c string")) == {}


# ---- profile --------------------------------------------------------------------------------

def test_quality_counts_duplicates_and_gaps(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b")], "a int, b string")
    q = profile.quality(df).first()
    assert q.asDict() == {"completeness": 0.875, "duplicate_row_count": 1, "duplicate_row_rate": 0.25, "uniqueness": 0.75, "overall": 0.8125}


def test_quality_of_no_rows(spark):
    assert profile.quality(spark.createDataFrame([], "a int")).first()["duplicate_row_count"] == 0


def test_profile_of_nulls_and_types(spark):
    df = spark.createDataFrame([(1, "a", True, None), (None, "b", False, None)], "i int, s string, b boolean, n double")
    p = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert p["i"]["dtype"] == "float64" and p["i"]["null_rate"] == 0.5
    assert p["n"]["n_unique"] == 0 and p["n"]["numeric"]["mean"] is None
    assert p["b"]["dtype"] == "bool" and p["b"]["numeric"]["mean"] == 0.5
    assert [(t["value"], t["count"]) for t in p["s"]["top_values"]] == [("a", 1), ("b", 1)]


def test_wide_profile_clusters_and_lists_every_column(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({f"f{i}": rng.normal(size=200) for i in range(52)})
    data["f1"] = data["f0"] * 2 + 1
    data["target"] = rng.integers(0, 2, 200)
    df = spark.createDataFrame(data)
    found = profile.profile(df)
    p = {r["column"]: r for r in found.columns.collect()}
    assert len(p) == 53 and p["target"]["top_values"] is not None and p["f0"]["top_values"] is None
    clusters = {r["representative"]: r["members"] for r in found.clusters.collect()}
    assert clusters["f0"] == ["f0", "f1"] and len(clusters) == 52


# ---- columns --------------------------------------------------------------------------------

def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(4).integers(0, 50, 1000).astype(float)
    out = [r["count"] for r in columns.histogram(frame(spark, v=values), "v").orderBy("bin").collect()]
    assert out == np.histogram(values, bins=20)[0].tolist()


def test_histogram_of_constant_and_of_nothing(spark):
    out = columns.histogram(frame(spark, v=[3.0] * 4), "v").orderBy("bin").collect()
    assert out[0]["low"] == 2.5 and sum(r["count"] for r in out) == 4
    assert columns.histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_column_stats_of_one_and_of_no_value(spark):
    one = columns.column_stats(frame(spark, v=[3.0]), ["v"]).first()
    assert (one["std"], one["skew"], one["kurtosis"], one["median"]) == (0.0, 0.0, 0.0, 3.0)
    none = columns.column_stats(spark.createDataFrame([(None,)], "v double"), ["v"]).first()
    assert none["mean"] is None and none["std"] is None


def test_detail_of_text_lists_rare_values_only_when_many(spark):
    few = columns.column_detail(frame(spark, k=range(4), s=list("aabc")), "s", "k")
    assert {r["kind"] for r in few.values.collect()} == {"top"}
    many = columns.column_detail(frame(spark, k=range(30), s=[f"v{i % 15}" for i in range(30)]), "s", "k")
    assert {r["kind"] for r in many.values.collect()} == {"top", "rare"}
    with pytest.raises(ValueError):
        columns.column_detail(spark.range(2), "absent", "id")


def test_type_counts(spark):
    df = spark.createDataFrame(pd.DataFrame({
        "age": [1, 2], "plan": ["x", "y"], "signed_up_at": pd.to_datetime(["2020-01-01", "2020-01-02"]),
        "is_active": [True, False], "bio": ["a long text indeed", "another long text"]}))
    found = {r["kind"]: r["columns"] for r in columns.feature_type_counts(df).collect()}
    assert found == {"numeric": 1, "categorical": 1, "datetime": 1, "text": 1, "boolean": 1}


# ---- association ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def gappy():
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 6, 300).astype(float)})
    data["c"] = data["a"] * 0.7 + rng.normal(size=300)
    data["d"] = 1.0
    data.loc[rng.random(300) < 0.2, "b"] = np.nan
    data.loc[rng.random(300) < 0.1, "c"] = np.nan
    return data


@pytest.mark.parametrize("terms", [0, 10**6])
def test_pearson_matches_pandas_both_ways(spark, gappy, terms, monkeypatch):
    monkeypatch.setattr(association, "TERMS_PER_AGGREGATE", terms)
    found, want = matrix(association.correlation_matrix(spark.createDataFrame(gappy))), gappy.corr().fillna(0.0)
    assert len(found) == 16
    for (a, b), v in found.items():
        assert v == pytest.approx(want.loc[a, b], abs=1e-9)


def test_spearman_matches_ranked_pandas(spark, gappy):
    found = matrix(association.correlation_matrix(spark.createDataFrame(gappy), "spearman"))
    for (a, b), v in found.items():
        both = gappy[[a, b]].dropna() if a != b else gappy[[a]].dropna()
        want = both.rank().corr().fillna(0.0).loc[a, b]
        assert v == pytest.approx(want, abs=1e-9), (a, b)


def test_kendall_matches_brute_force(spark, gappy):
    found = matrix(association.correlation_matrix(spark.createDataFrame(gappy), "kendall"))
    for a, b in [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")]:
        p = gappy[[a, b]].dropna().to_numpy()
        sx, sy = np.sign(p[:, None, 0] - p[None, :, 0]), np.sign(p[:, None, 1] - p[None, :, 1])
        den = np.sqrt((sx**2).sum() * (sy**2).sum())
        assert found[a, b] == pytest.approx((sx * sy).sum() / den if den else 0.0, abs=1e-12)


def test_kendall_with_a_dominant_value(spark):
    rng = np.random.default_rng(9)
    x = np.where(rng.random(400) < 0.5, 3.0, rng.normal(size=400))
    y = x + rng.normal(size=400)
    found = matrix(association.correlation_matrix(frame(spark, x=x, y=y), "kendall"))
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    assert found["x", "y"] == pytest.approx((sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()), abs=1e-12)


def test_constant_columns_do_not_break_truncation(spark):
    data = pd.DataFrame({f"c{i}": [1.0] * 5 for i in range(55)})
    data["high_var"] = [1.0, 50.0, -3.0, 8.0, 900.0]
    df = spark.createDataFrame(data)
    names, truncated = association.correlation_columns(df)
    assert truncated and len(names) == 50 and names[0] == "high_var"
    found = matrix(association.correlation_matrix(df))
    assert found["high_var", "high_var"] == pytest.approx(1.0) and found["c0", "c0"] == 0.0


def test_mutual_information_of_few_rows_is_zero(spark):
    found = matrix(association.correlation_matrix(frame(spark, x=[1.0, 2.0, 3.0], y=[2.0, 1.0, 5.0]), "mutual_info"))
    assert found["x", "y"] == 0.0 and found["x", "x"] == 1.0


@pytest.mark.parametrize("points_per_box", [20, 2000])
def test_neighbour_information_equals_brute_force(spark, monkeypatch, points_per_box):
    monkeypatch.setattr(association, "nearest_neighbours", lambda *a, **k: neighbours.nearest_neighbours(*a, points_per_box=points_per_box, **k))
    rng = np.random.default_rng(6)
    x = rng.normal(size=500)
    data = pd.DataFrame({"x": x, "y": (x + rng.normal(size=500)).round(1), "z": rng.integers(0, 4, 500).astype(float), "c": 2.5})
    data.loc[::50, "y"] = None
    found = matrix(association.correlation_matrix(spark.createDataFrame(data), "mutual_info_neighbours"))
    full = data.dropna()
    n, k = len(full), 3
    psi = np.r_[np.nan, -np.euler_gamma + np.r_[0.0, np.cumsum(1 / np.arange(1, n))]]
    scaled = {c: full[c].to_numpy() / (float(f"{full[c].std(ddof=0):.10g}") or 1.0) for c in full}
    for a, b in combinations(full.columns, 2):
        da, db = (np.abs(scaled[c][:, None] - scaled[c][None, :]) for c in (a, b))
        plane = np.maximum(da, db)
        np.fill_diagonal(plane, np.inf)
        r = np.sort(plane, axis=1)[:, k - 1][:, None]
        counts = [np.where(r > 0, d < r, d == 0).sum(1) for d in (da, db)]
        want = max(0.0, psi[n] + psi[k] - (psi[counts[0]] + psi[counts[1]]).mean())
        assert found[a, b] == pytest.approx(want, abs=1e-9) and found[b, a] == found[a, b] and found[a, a] == 1.0
    assert found["x", "y"] > 0.2 > found["x", "z"]


def test_intervals_hold_what_subtraction_holds():
    rng = np.random.default_rng(9)
    value = np.r_[rng.normal(size=500), -0.3, 0.0, 1e9, -1e-300].astype(float)
    radius = np.abs(np.r_[-value[:250] + rng.integers(-2, 3, 250) * 1e-17, rng.normal(size=250), 0.3, 0.1, 1e-3, 0.0])
    low, high = association._interval(value, radius)
    for v, r, a, b in zip(value, radius, low, high):
        for end, out in ((a, -np.inf), (b, np.inf)):
            beyond = np.nextafter(end, out)
            assert (abs(end - v) < r and not abs(beyond - v) < r) or (r == 0 and end == v)


def test_neighbour_information_of_few_rows_is_zero(spark):
    found = matrix(association.correlation_matrix(frame(spark, x=[1.0, 2.0, 3.0], y=[2.0, 1.0, 5.0]), "mutual_info_neighbours"))
    assert found["x", "y"] == 0.0 and found["x", "x"] == 1.0


def test_unknown_method_and_single_column(spark):
    with pytest.raises(ValueError):
        association.correlation_matrix(spark.range(3), "other")
    assert association.correlation_matrix(spark.range(3)).count() == 0


def test_missing_patterns(spark):
    df = spark.createDataFrame([(1.0, 1, "x"), (None, 2, None), (3.0, 3, "y"), (None, 4, None)], "a double, b int, c string")
    rates = {r["column"]: r["null_rate"] for r in association.missing_per_column(df).collect()}
    assert rates == {"a": 0.5, "b": 0.0, "c": 0.5}
    assert matrix(association.missing_correlation(df))["a", "c"] == pytest.approx(1.0)


# ---- outliers -------------------------------------------------------------------------------

def report(df, method):
    return outliers.outlier_report(df, method, "id").first()


def test_iqr_and_zscore(spark):
    df = frame(spark, id=[str(i) for i in range(7)], amount=[10.0, 11, 12, 13, 14, 15, 1000])
    r = report(df, "iqr")
    assert (r["outlier_count"], r["affected_columns"], r["examples"]) == (1, ["amount"], ["6"])
    z = report(frame(spark, id=[f"{i:02d}" for i in range(31)], amount=[50.0] * 30 + [1000]), "zscore")
    assert z["outlier_count"] == 1 and z["examples"] == ["30"]


def test_examples_are_capped_but_the_count_is_not(spark):
    df = frame(spark, id=[f"{i:03d}" for i in range(230)], amount=[10.0 + i % 5 for i in range(200)] + [10000.0] * 30)
    r = report(df, "iqr")
    assert r["outlier_count"] == 30 and len(r["examples"]) == 20


def test_few_or_flat_values_have_no_outliers(spark):
    assert report(frame(spark, id=list("abcd"), v=[1.0, 2, 3, 900]), "iqr")["outlier_count"] == 0
    assert report(frame(spark, id=list("abcdef"), v=[5.0] * 6), "zscore")["outlier_count"] == 0
    assert report(frame(spark, id=list("ab"), t=list("xy")), "iqr")["affected_columns"] == []


@pytest.mark.parametrize("method", ["lof", "isolation_forest"])
def test_multivariate_detectors_bear_empty_columns(spark, method):
    df = spark.createDataFrame([(str(i), float(i % 6), None) for i in range(30)] + [("99", 500.0, None)], "id string, x double, y double")
    r = report(df, method)
    assert "99" in r["examples"] and r["affected_columns"] == ["x", "y"]


def brute_neighbours(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k]


@pytest.mark.parametrize("box", [8, 50, 10_000])
def test_neighbours_match_brute_force(spark, box):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(size=(150, 3)), rng.normal(size=(40, 3)) * 0.01 + 5, [[50, 50, 50]]]
    points = spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(x)], "id bigint, x array<double>, n bigint")
    found = neighbours.nearest_neighbours(points, 6, points_per_box=box).toPandas()
    got = np.stack(found.sort_values(["id", "distance"]).groupby("id")["distance"].apply(np.array).to_numpy())
    assert np.allclose(got, brute_neighbours(x, 6))


@pytest.mark.parametrize("box", [16, None])
def test_wide_neighbours_match_brute_force(spark, box):
    """Many dimensions go through rough products first: the answer is exact, far from the origin and beside copies too."""
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(size=(120, 12)), rng.normal(size=(40, 12)) * 1e-4 + 1e3]
    points = spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(x)], "id bigint, x array<double>, n bigint")
    found = neighbours.nearest_neighbours(points, 5, points_per_box=box).toPandas()
    got = np.stack(found.sort_values(["id", "distance"]).groupby("id")["distance"].apply(np.array).to_numpy())
    assert np.allclose(got, brute_neighbours(x, 5), rtol=1e-12)


def test_tasks_follow_the_pairs_compared(spark, monkeypatch):
    """Few bytes can be many pairs: boxes are dealt out to as many tasks as their pairs ask for, and not merged by their bytes."""
    monkeypatch.setattr(neighbours, "PAIRS_PER_TASK", 2_000)
    points = spark.createDataFrame([(i, [float(i % 37), float(i % 53)], 1) for i in range(600)], "id bigint, x array<double>, n bigint")
    found = neighbours.nearest_neighbours(points, 3, points_per_box=40)
    parts = [int(n) for n in re.findall(r"hashpartitioning\(box#\d+, share#\d+, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().toString())]
    assert parts and min(parts) > 4


def test_neighbours_count_copies(spark):
    points = spark.createDataFrame([(0, [0.0], 3), (1, [1.0], 2), (2, [9.0], 1)], "id bigint, x array<double>, n bigint")
    found = {(r["id"], r["other"]): r["copies"] for r in neighbours.nearest_neighbours(points, 4, points_per_box=1).collect()}
    assert found == {(0, 0): 2, (0, 1): 2, (1, 1): 1, (1, 0): 3, (2, 1): 2, (2, 0): 2}


def test_lof_with_copies_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(40, 2)).round(2), rng.integers(1, 4, 40), axis=0)
    x = np.r_[x, [[30.0, 30.0]]]
    k, n = 5, len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, 1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, 1)
    density = 1 / (np.maximum(near[:, -1][order], near).mean(1) + 1e-10)
    want = density[order].mean(1) / density
    out = outliers.lof_scores(frame(spark, id=range(n), a=x[:, 0], b=x[:, 1]), "id", ["a", "b"], k).toPandas().sort_values("id")
    assert np.allclose(out["lof"], want, rtol=1e-6)


# ---- leakage --------------------------------------------------------------------------------

def flags(df, target):
    return {(r["column"], r["rule"], r["severity"]) for r in leakage.leakage_flags(df, target).collect()}


def test_numeric_and_name_leakage(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, target=np.arange(200.0), leaky_copy=np.arange(200.0) * 2, noise=rng.normal(size=200), post_outcome_flag=rng.integers(0, 2, 200))
    assert flags(df, "target") == {("leaky_copy", "name", "medium"), ("leaky_copy", "correlation", "high"), ("post_outcome_flag", "name", "medium")}
    assert flags(df, "absent") == set()


def test_purity_of_a_text_target(spark):
    df = frame(spark, target=["y", "n"] * 50, code=["A", "B"] * 50, mixed=["A", "A", "B", "B"] * 25, flat=["z"] * 100, key=range(100))
    assert flags(df, "target") == {("code", "purity", "high")}


def test_purity_ignores_rows_without_a_target_in_the_share(spark):
    df = spark.createDataFrame([("a", "y"), ("a", None), ("b", "n"), ("b", "n"), (None, "y")], "c string, t string")
    row = leakage.target_purity(df, "t").first()
    assert row["score"] == pytest.approx(0.8) and row["n_unique"] == 2


@pytest.mark.parametrize("name,dtype,unique,expected", [
    ("customer_id", "int64", 60, True), ("amount", "float64", 100, False), ("code", "object", 99, True), ("code", "object", 97, False)])
def test_identifier_rule(spark, name, dtype, unique, expected):
    df = spark.createDataFrame([(name, dtype, unique, 100)], "c string, d string, u bigint, r bigint")
    assert df.select(leakage.is_identifier(F.col("c"), F.col("d"), F.col("u"), F.col("r"))).first()[0] is expected


# ---- sources --------------------------------------------------------------------------------

@pytest.mark.parametrize("text,encoding", [
    ("name,v\ncafé,1\nthé,2\n", "utf-8"), ("name,v\ncafé,1\nthé,2\n", "latin-1"), ("name;v\ncafé;1\nthé;2\n", "utf-8"),
    ("name|v\ncafé|1\nthé|2\n", "latin-1"), ("name\tv\ncafé\t1\nthé\t2\n", "utf-8")])
def test_csv_encodings_and_delimiters(spark, tmp_path, text, encoding):
    path = tmp_path / "data.csv"
    path.write_bytes(text.encode(encoding))
    assert sorted((r["name"], r["v"]) for r in loading.load_dataset(spark, str(path)).collect()) == [("café", 1), ("thé", 2)]


def test_empty_file_and_json(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        loading.load_dataset(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "rows.json").write_text('[{"a": 1}, {"a": 2}]')
    assert loading.load_dataset(spark, str(tmp_path / "rows.json")).count() == 2


def test_training_frame(spark):
    df = spark.createDataFrame([(1, True, float("inf"), "b"), (2, False, 1.0, "a"), (3, None, 2.0, None)], "i int, f boolean, x double, y string")
    out = loading.training_frame(df, "y", "classification")
    assert out.labels == ["a", "b"]
    assert sorted(tuple(r) for r in out.data.select("i", "f", "y").collect()) == [(1.0, 1.0, 1.0), (2.0, 0.0, 0.0)]
    assert out.data.where("x is null").count() == 1
    text = spark.createDataFrame([(" $1,234.50 ",), ("n/a",), ("3%",)], "y string")
    assert sorted(r["y"] for r in loading.training_frame(text, "y", "regression").data.collect()) == [3.0, 1234.5]
    with pytest.raises(ValueError):
        loading.training_frame(spark.createDataFrame([("x",)], "y string"), "y", "regression")
    with pytest.raises(ValueError):
        loading.training_frame(text, "absent", "regression")


def test_roundtrip_keeps_types(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (None, "x")], "i int, s string")
    sinks.write_dataset(df, str(tmp_path / "t.parquet"))
    assert loading.load_dataset(spark, str(tmp_path / "t.parquet")).schema == df.schema


# ---- missing values, odd names and wide inputs ---------------------------------------------

def test_split_with_missing_times_leaves_them_for_the_test(spark):
    rows = [(i, None if i % 2 else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)) for i in range(100)]
    placed = split.split_time(spark.createDataFrame(rows, "k int, at timestamp"), "at", "k").collect()
    assert sorted(r.k for r in placed if r.is_train) == list(range(0, 80, 2))


def test_columns_without_values_have_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert {r["column"]: r.entropy for r in quality.entropy(df, ["a", "b"]).collect()} == {"a": pytest.approx(np.log(2)), "b": 0.0}
    assert {r["column"]: (r.n_unique, r.rejected) for r in leakage.target_guard(df, ["a", "b"]).collect()} == {"a": (2, True), "b": (0, False)}
    with pytest.raises(ValueError):
        quality.population_stability(df.withColumn("b", df.b.cast("double")), df, "b")


def test_ordinal_codes_beside_helper_names(spark):
    df = spark.createDataFrame([("x", 1, 2), ("y", 3, 4), (None, 5, 6)], "c string, t int, code int")
    for limit in (1, 5_000):
        assert sorted(tuple(r) for r in steps.encode_ordinal(df, ["c"], limit).collect()) == [(0.0, 5, 6), (1.0, 1, 2), (2.0, 3, 4)]


def test_all_numeric_columns_are_correlated_unless_a_limit_is_given(spark):
    df = spark.range(30).selectExpr(*[f"id * {i} + pow(id, {i % 4}) AS c{i}" for i in range(60)])
    assert association.correlation_matrix(df).select("col_a").distinct().count() == 60
    shown, truncated = association.correlation_preview(df)
    assert truncated and shown.select("col_a").distinct().count() == 50


def test_forest_sample_does_not_depend_on_a_switch(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "double(id % 97) AS a", "CASE WHEN id % 50 = 7 THEN 1e4 + id ELSE double(id % 89) END AS b")
    monkeypatch.setattr(outliers, "TREES", 20)
    monkeypatch.setattr(outliers, "TREE_ROWS", 64)
    best = outliers.isolation_scores(df, "id").orderBy(F.desc("score")).limit(30).collect()
    assert sum(r.id % 50 == 7 for r in best) >= 25


def test_spearman_with_gaps_and_a_dominant_value(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({f"c{i}": np.where(rng.uniform(size=400) < 0.99 if i == 0 else rng.uniform(size=400) < 0.3, 5.0, rng.integers(0, 40, 400)) for i in range(12)})
    for i in range(1, 9):
        data.loc[rng.uniform(size=400) < 0.1 * i, f"c{i}"] = np.nan
    got = matrix(association.spearman(spark.createDataFrame(data).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in data.columns]), list(data.columns)))
    want = data.corr("spearman")
    for (a, b), v in got.items():
        expected = want.loc[a, b]
        assert v == pytest.approx(0.0 if np.isnan(expected) else expected, abs=1e-9), (a, b)
    assert len(got) == 144


def test_anova_of_many_columns_reads_the_table_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"t": rng.choice(["a", "b", "c"], 400), **{f"x{i}": rng.normal(i, 1, 400) for i in range(4)}})
    pdf.loc[pdf["t"] == "b", "x1"] = None
    pdf["none"] = None
    pdf["none"] = pdf["none"].astype("float64")
    path = str(tmp_path / "t.parquet")
    pdf.to_parquet(path)
    names = ["x0", "x1", "x2", "x3", "none"]
    out = quality.anova_f(spark.read.parquet(path), names, "t")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    got = {r["column"]: r["f"] for r in out.collect()}
    for c in names[:4]:
        groups = [g.dropna().to_numpy() for _, g in pdf.groupby("t")[c]]
        groups = [g for g in groups if len(g)]
        every = np.concatenate(groups)
        between = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups) / (len(groups) - 1)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(every) - len(groups))
        assert got[c] == pytest.approx(between / within, rel=1e-9)
    assert got["none"] is None
    assert {r["f"] for r in quality.anova_f(spark.read.parquet(path).where("false"), names, "t").collect()} == {None}


def test_ranks_are_taken_in_more_slices_not_larger_ones(spark, gappy, monkeypatch):
    """Slices follow the number of values, so that no task holds more of them as tables grow."""
    df = spark.createDataFrame(gappy)
    want = matrix(association.correlation_matrix(df, "spearman"))
    held, real = [], association._in_parts
    monkeypatch.setattr(association, "_in_parts", lambda d, n, *keys: held.append((keys, (out := real(d, n, *keys)).rdd.getNumPartitions(), n)) or out)
    monkeypatch.setattr(association, "RANKED_VALUES", 20)
    got = matrix(association.correlation_matrix(df, "spearman"))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(held) == 2 and all(parts == n and n * 20 >= len(gappy) * 2 for _, parts, n in held)
