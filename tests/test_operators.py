"""Thresholds, gaps, ties and degenerate tables against pandas or by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions import stats
from tablescope.operators import (adequacy, association, charts, cleaning, distribution, drift, features,
                                  inference, missingness, modeling, outliers, profile, scoring)
from tablescope.plans import audit
from tablescope.sources import tables

RNG = np.random.default_rng(3)
NAN = float("nan")


def values(spark, expr, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (3.0,), (3.0,)], "x double")
    assert profile.missing_by_column(df).first().n_missing == 2
    assert profile.distinct_count(df).first().n_distinct == 2
    assert profile.describe(df).first()["count"] == 3
    assert missingness.missing_severity(df).first().severity == "Critical"


def test_moments_equal_pandas(spark):
    x = RNG.exponential(size=50)
    row = distribution.distributions(spark.createDataFrame(pd.DataFrame({"x": x}))).first()
    s = pd.Series(x)
    assert (row["mean"], row["std"], row.skewness, row.kurtosis) == pytest.approx(
        (s.mean(), s.std(), s.skew(), s.kurtosis()), abs=6e-4)


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, None)] * 8, "k double, n double")
    rows = distribution.distributions(df).collect()
    assert [(r.feature, r.skewness, r.is_normal) for r in rows] == [("k", 0.0, True)]


def test_shape_labels_at_the_cut_offs(spark):
    assert values(spark, distribution.shape_label, [0.49, 0.5, 0.51, 1.5, 1.51, -0.5, -1.5, -1.51]) == [
        "Normal / Symmetric", "Mildly Left-Skewed", "Mildly Right-Skewed", "Mildly Right-Skewed",
        "Highly Right-Skewed", "Mildly Left-Skewed", "Mildly Left-Skewed", "Highly Left-Skewed"]


def test_threshold_labels_are_strict(spark):
    assert values(spark, stats.vif_label, [5, 5.1, 10, 10.1]) == ["OK", "MODERATE", "MODERATE", "HIGH"]
    assert values(spark, stats.correlation_label, [0.85, 0.86, 0.95, -0.96]) == ["OK", "WATCH", "WATCH", "HIGH RISK"]
    assert values(spark, stats.ks_severity, [0.15, 0.16, 0.3, 0.31]) == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]
    assert values(spark, stats.grade, [90, 89.9, 75, 60, 40, 39.9]) == ["A", "B", "B", "C", "D", "F"]


def test_shapiro_separates_normal_from_skewed():
    assert distribution.shapiro_wilk(np.random.default_rng(0).normal(size=300))[1] > 0.05
    assert distribution.shapiro_wilk(RNG.exponential(size=300))[1] < 1e-6
    # Shapiro and Wilk's own example of 11 weights: W = 0.79, p below 0.01.
    w, p = distribution.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01


def test_ks_p_value_near_published_points(spark):
    df = spark.createDataFrame([(float(1.3581 / np.sqrt(5e8)),), (float(1.6276 / np.sqrt(5e8)),), (0.0,)], "d double")
    p = [r[0] for r in df.select(stats.ks_p_value(F.col("d"), F.lit(10**9), F.lit(10**9))).collect()]
    assert p == pytest.approx([0.05, 0.01, 1.0], abs=2e-4)


def test_listwise_and_pairwise_correlation(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, None, 7.0], "b": [2, 1, None, 4, 5, 9.0], "k": [1.0] * 6,
                        "none": [None] * 6}).astype(float)
    df = spark.createDataFrame(pdf)
    pair = {(r.feature_1, r.feature_2): r["corr"] for r in association.correlation_matrix(df, listwise=False).collect()}
    assert pair["a", "b"] == pytest.approx(pdf.a.corr(pdf.b), abs=1e-4) and pair["a", "k"] is None
    full = pdf[["a", "b"]].dropna()
    rows = {(r.feature_1, r.feature_2): r["corr"] for r in association.correlation_matrix(df).collect()}
    assert rows["a", "b"] == pytest.approx(full.a.corr(full.b), abs=1e-4)
    assert ("a", "none") not in rows


def test_vif_of_collinear_and_constant_features(spark):
    x, y = RNG.normal(size=(2, 100))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": x + y, "k": 1.0, "w": RNG.normal(size=100)}))
    got = {r.feature: r.vif for r in association.vif(df).collect()}
    assert got["x"] == got["z"] == got["k"] == 1e8 and got["w"] < 1.2


def test_leakage_of_text_target_is_empty(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, t string")
    assert association.leakage_by_correlation(df, "t").count() == 0
    assert association.leakage_probability(df, "t").count() == 0
    assert association.leakage_summary(df, "t").first().verdict == "SAFE"


def test_kraskov_finds_dependence():
    def draw(seed):
        return np.random.default_rng(seed).normal(size=500)
    # Clipped at 0, so independent samples average a little above it.
    assert np.mean([association.kraskov_mi(draw(s), draw(s + 50)) for s in range(12)]) < 0.05
    x, noise = draw(2), draw(4)
    rho = 0.9
    got = association.kraskov_mi(x, rho * x + np.sqrt(1 - rho**2) * noise)
    assert got == pytest.approx(-0.5 * np.log(1 - rho**2), abs=0.15)


def test_task_types(spark):
    def kind(rows, ddl="t double"):
        return profile.task_type(spark.createDataFrame(rows, ddl), "t").first().task_type
    assert kind([("a",), ("b",), ("c",)], "t string") == "classification"
    assert kind([(1.0,), (0.0,), (None,)]) == "classification"
    assert kind([(float(i % 20),) for i in range(401)]) == "classification"
    assert kind([(float(i % 20),) for i in range(400)]) == "regression"      # 20 / 400 is not under 0.05
    assert kind([(float(i % 21),) for i in range(5000)]) == "regression"


def test_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "x double, s string, y double")
    assert profile.duplicate_rows(empty).first().duplicate_rows == 0
    assert distribution.distributions(empty).count() == 0
    assert drift.drift_report(empty, "y", ["x"]).count() == 0
    assert adequacy.sample_adequacy(empty, "y").first().adequate is False
    assert profile.iqr_outliers(empty).count() == 0
    with pytest.raises(ValueError):
        tables.ingest_guard(empty)


def test_all_null_target_fails_the_class_check(spark):
    df = spark.createDataFrame([(1.0, None)] * 200, "x double, t string")
    got = {r.rule: r["pass"] for r in adequacy.sample_size_checks(df, "t").collect()}
    assert got == {"rows per feature": True, "absolute minimum": True, "rows per class": False}


def test_mode_takes_the_smallest_tie_and_impute_fills(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), ("b", 4), ("a", 2), (None, 4)], "s string, n int")
    assert cleaning.modes(df, ["s"]) == {"s": "a"}
    got = cleaning.impute(df).collect()
    assert got[4].s == "a" and got[1].n == 3.0
    gone = spark.createDataFrame([(None,), (None,)], "s string")
    assert {r.s for r in cleaning.impute(gone).collect()} == {"Unknown"}


def test_quantile_bins_with_ties(spark):
    x = [1, 2, 2, 2, 2, 2, 3, 9, 10, None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "i int, x double")
    got = [r.x_bin for r in features.quantile_bin(df, "x").orderBy("i").collect()]
    want = pd.qcut(pd.Series(x, dtype=float), 5, labels=False, duplicates="drop")
    assert got == [None if np.isnan(w) else int(w) for w in want]


def test_one_hot_and_its_limit(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    assert features.one_hot(df, ["x"]).columns == ["x_b", "x_c"]
    assert [tuple(r) for r in features.one_hot(df, ["x"]).collect()] == [
        (True, False), (False, False), (False, False), (False, True)]
    with pytest.raises(ValueError):
        features.one_hot(spark.createDataFrame([(str(i),) for i in range(6)], "x string"), ["x"])


def test_clean_twice_changes_nothing_more(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 4], "k": 1, "x": [1.0, 2, NAN, 50, 50], "y": [1.0, 2, 3, 4, 4],
                        "s": ["a", None, "a", "b", "b"], "t": [0, 1, 0, 1, 1]})
    fixed, log = cleaning.clean(spark.createDataFrame(pdf), "t")
    assert fixed.count() == 4 and "k" not in fixed.columns
    again, log2 = cleaning.clean(fixed, "t")
    assert again.count() == 4
    assert "drop_duplicates" not in {r.action for r in log2.collect()}


def test_clean_drops_ids(spark):
    df = spark.createDataFrame([(i, float(i * i % 7), i % 2) for i in range(30)], "user_id int, x double, t int")
    fixed, log = cleaning.clean(df, "t")
    assert fixed.columns == ["x", "t"] and log.first().action == "drop_id"


def test_health_score_by_hand(spark):
    ddl = ("rows bigint, missing_pct double, duplicate_rows bigint, n_constant int, n_leak int, n_redundant int, "
           "n_type_warnings int, adequate boolean, ratio double, pattern string")
    rows = [(100, 0.0, 0, 0, 0, 0, 0, True, 1.0, "NONE"), (100, 33.4, 55, 3, 1, 8, 1, False, 0.59, "MAR")]
    got = scoring.health_score(spark.createDataFrame(rows, ddl)).collect()
    assert (got[0].total, got[0].grade) == (100, "A")
    worse = got[1]
    assert (worse.completeness, worse.integrity, worse.leakage_safety, worse.feature_quality,
            worse.sample_adequacy) == (0, 0, 10, 0, 11)
    overall = scoring.overall_grade(spark.createDataFrame(rows, ddl)).collect()
    assert overall[0].overall_score == 100 and overall[0].percentile_text == 99
    # 34 + 15 + 50 + 75 + 59 + 50, over six
    assert overall[1].overall_score == 47 and overall[1].overall_grade == "D"


def test_robust_scatter_ignores_far_rows(spark):
    x = RNG.normal(size=(1000, 2))
    x[:80] += 40
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    flagged = outliers.outlier_rows(df, contamination=None).toPandas()
    assert flagged[flagged.a > 20].is_outlier.all() and flagged[flagged.a < 20].is_outlier.mean() < 0.06
    with pytest.raises(ValueError):
        outliers.mahalanobis_scores(df.select("a"))


@pytest.mark.parametrize("share, away", [(0.3, 6), (0.4, 8)])
def test_robust_scatter_with_a_far_cluster(spark, share, away):
    x = RNG.normal(size=(1000, 4))
    n = int(1000 * share)
    x[:n] = x[:n] * 0.1 + away
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(key=np.arange(1000)))
    flagged = outliers.outlier_rows(df, contamination=None, keep=["key"])
    rows = flagged.toPandas()
    far = rows["key"] < n
    assert rows.columns.tolist() == ["key", "a", "b", "c", "d", "d2", "is_outlier"]
    assert rows[far].is_outlier.all() and rows[~far].is_outlier.mean() < 0.08
    top = outliers.top_scores(flagged, 3, keep=["key"]).toPandas()
    assert top.columns.tolist() == ["key", "d2"] and (top["key"] < n).all()
    assert [r.feature for r in outliers.outlier_drivers(flagged, keep=["key"]).collect()] == list("abcd")


def test_all_columns_are_looked_at(spark):
    x = pd.DataFrame(RNG.normal(size=(200, 25)), columns=[f"c{i:02}" for i in range(25)])
    x["c24"] += np.where(np.arange(200) < 100, 0, 50)
    for i in range(7):
        x.loc[i, f"c{i:02}"] = np.nan
    x.loc[x["c24"] > 25, "c06"] = np.nan
    df = spark.createDataFrame(x.assign(key=np.arange(200)))
    assert distribution.distributions(df).count() == 26
    assert drift.drift_report(df, None, ["key"]).filter("drifted").filter("feature = 'c24'").count() == 1
    assert {r.column for r in missingness.mar_signals(df).collect()} >= {"c06"}
    assert association.vif(df).count() == 26 and association.vif(df, max_columns=3).count() == 3
    flagged = outliers.outlier_rows(df, robust=False, keep=["key"])
    assert outliers.outlier_drivers(flagged, keep=["key"]).count() == 25


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [(r.bin, r.n) for r in charts.histogram(df, "x").collect()] == [(0, 2)]


def test_types_by_rule(spark):
    n = 60
    df = spark.createDataFrame(pd.DataFrame({
        "id": range(n), "flag": [i % 2 for i in range(n)], "share": np.arange(n) / n,
        "money": np.r_[np.full(n - 2, 1500.0), 9e5, 9e6], "my_rsi": np.linspace(-5, 99, n),
        "zip": [f"{10000 + i}" for i in range(n)], "day": ["2024-01-%02d" % (i % 28 + 1) for i in range(n)],
        "mail": [f"a{i}@b.c" for i in range(n)], "link": ["http://x"] * n, "word": ["w"] * n}))
    got = {r.column: r.inferred for r in inference.infer_types(df).collect()}
    assert got == {"id": "ID Column", "flag": "Binary Flag (0/1)", "share": "Percentage (0-1)",
                   "money": "Possible Currency / Revenue", "my_rsi": "RSI: Corrupted Range", "zip": "ZIP Code",
                   "day": "Date / Datetime", "mail": "Email Address", "link": "URL", "word": "string"}
    assert inference.type_warnings(df).count() == 4
    assert inference.find_time_column(df) == "day"


def test_frequency_names(spark):
    for step, name in (("D", "Daily"), ("7D", "Weekly"), ("MS", "Monthly"), ("h", "Sub-daily"),
                       ("3D", "~3-day intervals")):
        days = pd.date_range("2024-01-01", periods=40, freq=step)
        df = spark.createDataFrame(pd.DataFrame({"t": days}))
        assert inference.detect_timeseries(df).first().frequency_guess == name


def test_schema_diff_reports_type_changes(spark):
    old = spark.createDataFrame([(1, "a")], "x int, s string")
    new = spark.createDataFrame([(1.0, 2)], "x double, n int")
    assert {r.column: r.status for r in drift.schema_diff(old, new).collect()} == {
        "x": "type_changed", "s": "removed", "n": "added"}


def test_root_causes_default(spark):
    ddl = "missing_total int, imbalanced boolean, diagnosis string, suspicious boolean, n_correlated_pairs int"
    rows = spark.createDataFrame([(0, False, "Healthy", False, 0)], ddl)
    assert [r.root_cause for r in modeling.root_causes(rows).collect()] == ["none"]


def test_baseline_learns_a_separable_table(spark):
    x = RNG.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "n": RNG.normal(size=400), "t": (x > 0).astype(int),
                                             "k": range(400)}))
    from tablescope.sources.sampling import stratified_split
    report = modeling.baseline_report(stratified_split(df, "t", "k"), ["x", "n"], "t").first()
    assert report.train_accuracy > 0.97
    model = modeling.baseline_classifier(modeling.assembled(df, ["x", "n"], "t"))
    assert modeling.coefficient_importance(model, ["x", "n"], spark).first().feature == "x"
    curve = modeling.learning_curve(df, ["x", "n"], "t", "k", fractions=(0.3, 1.0), folds=2).collect()
    assert len(curve) == 2 and all(r.validation_accuracy > 0.9 for r in curve)


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "x int, s string")
    path = tables.write_cleaned(df, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_table(spark, path, "csv").collect())) == [(1, "a,b"), (2, None)]


def test_findings_of_wide_tables(spark):
    names = [f"c{k}" for k in range(14)]
    df = spark.range(60).select(F.col("id").cast("double").alias("y"), *[
        (F.col("id") + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5))).cast("double").alias(c) for k, c in enumerate(names)])
    rows = audit.findings(df, "y", sections=["redundancy", "leakage_probability"]).collect()
    assert sum(r.section == "redundancy" for r in rows) == 14 * 13 // 2
    assert {r.subject for r in rows if r.section == "leakage_probability"} == set(names)
