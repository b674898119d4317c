"""Shared-scan logistic regression, learning curves, expanding folds, and records that do not fit a schema."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import logistic, modeling
from tablescope.sources import tables


def _made(spark, n=400, classes=2, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 50.0]
    z = np.stack([np.zeros(n), *[x @ w + c for w, c in [([1.0, 0.01], 0.3), ([-1.0, 0.03], -0.2)][:classes - 1]]], axis=1)
    y = (z + rng.gumbel(size=z.shape)).argmax(axis=1)
    rows = [(int(i), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double")


def _gradient(x, y, fit, penalty):
    """Of the penalised loss at the fitted weights, computed anew."""
    x = np.hstack([np.ones((len(x), 1)), x])
    z = x @ fit.weights.T
    if len(fit.classes) == 2:
        return (1 / (1 + np.exp(-z[:, 0])) - (y == fit.classes[1])) @ x + penalty * np.array([0, *fit.weights[0, 1:]])
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = y[:, None] == np.array(fit.classes)
    return (p - hit).T @ x + penalty * np.hstack([np.zeros((len(z.T), 1)), fit.weights[:, 1:]])


@pytest.mark.parametrize("classes", [2, 3])
def test_fits_are_stationary(spark, classes):
    df = _made(spark, classes=classes)
    trains = F.when(F.col("id") % 3 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = logistic.prepared(df, ["a", "b"], "y", trains).cache()
    fits = logistic.fit_many(rows, 2, 2)
    local = df.toPandas()
    for k, part in ((0, local), (1, local[local.id % 3 != 0])):
        assert fits[k].n_rows == len(part)
        assert np.abs(_gradient(part[["a", "b"]].to_numpy(), part.y.to_numpy(), fits[k], 1.0)).max() < 1e-4
    rows.unpersist()


def test_same_as_the_library_model(spark):
    df = _made(spark)
    rows = logistic.prepared(df, ["a", "b"], "y", F.array(F.lit(0)))
    ours = logistic.fit_many(rows, 1, 2)[0]
    from pyspark.ml.classification import LogisticRegression
    theirs = LogisticRegression(maxIter=1000, regParam=1 / 400, standardization=False, tol=1e-14).fit(
        modeling.assembled(df, ["a", "b"], "y"))
    assert np.allclose(ours.coefficients, theirs.coefficients.toArray(), atol=1e-6)
    assert ours.weights[0, 0] == pytest.approx(theirs.intercept, abs=1e-6)


def test_one_scan_a_step(spark, monkeypatch):
    scans = []
    real = logistic._added
    monkeypatch.setattr(logistic, "_added", lambda rows, fits, *a: scans.append(len(fits)) or real(rows, fits, *a))
    trains = F.sequence(F.lit(0), (F.col("id") % 12).cast("int"))
    fits = logistic.fit_many(logistic.prepared(_made(spark), ["a", "b"], "y", trains), 12, 2)
    assert len(fits) == 12 and scans[0] == 12 and len(scans) < 20


def test_gaps_single_classes_and_separable_rows(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 1.0), (4.0, 1.0), (None, 1.0), (5.0, None), (float("nan"), 0.0)],
                               "a double, y double")
    trains = F.when(F.col("y") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = logistic.prepared(df, ["a"], "y", trains, F.array(F.lit(0)))
    fits = logistic.fit_many(rows, 2, 1)
    assert set(fits) == {0} and fits[0].n_rows == 4 and fits[0].classes == (0.0, 1.0)
    assert {(r.fit, r.part, r.n, r.hits) for r in logistic.accuracies(rows, fits, 2, 1).collect()} == {(0, "train", 4, 4), (0, "test", 4, 4)}
    assert logistic.fit_many(rows.limit(0), 2, 1) == {}
    assert logistic.accuracies(rows.limit(0), {}, 2, 1).count() == 0


def test_learning_curve_uses_more_rows(spark):
    rows = modeling.learning_curve(_made(spark), ["a", "b"], "y", "id").orderBy("fraction").collect()
    assert [r.fraction for r in rows] == list(modeling.CURVE_FRACTIONS)
    assert rows[-1].mean_train_rows == pytest.approx(320)
    assert rows[0].mean_train_rows < rows[1].mean_train_rows and rows[-1].validation_accuracy > 0.6


def test_cross_validate_learns_from_earlier_blocks(spark):
    got = modeling.cross_validate(_made(spark, 600), ["a", "b"], "y", ["id"]).orderBy("fold").collect()
    assert [(r.fold, r.train_rows, r.validation_rows) for r in got] == [(k, 100 * k, 100) for k in range(1, 6)]
    local = _made(spark, 600).toPandas().sort_values("id")
    x, y = np.hstack([np.ones((600, 1)), local[["a", "b"]].to_numpy()]), local.y.to_numpy()
    for r in got:                                           # the same folds by a plain Newton iteration
        seen, w = slice(0, 100 * r.fold), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x[seen] @ w))
            shrink = np.diag([0.0, 1.0, 1.0])
            w = w - np.linalg.solve((x[seen].T * (p * (1 - p))) @ x[seen] + shrink, x[seen].T @ (p - y[seen]) + shrink @ w)
        right = (x @ w > 0) == (y == 1)
        assert r.train_accuracy == round(right[seen].mean(), 4)
        assert r.validation_accuracy == round(right[100 * r.fold:100 * r.fold + 100].mean(), 4)
    with pytest.raises(ValueError, match="block"):
        modeling.expanding_blocks(_made(spark).withColumn("block", F.lit(1)), ["id"])


def test_bad_records_are_a_result(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\nx,3.5\n3,oops\n4,\n")
    (tmp_path / "b.csv").write_text("id,v\n7,1.0\n")
    (tmp_path / "c.csv").write_text("id,v\nno,no\n")
    good, status = tables.read_checked(spark, str(tmp_path), "id long, v double")
    assert sorted((r.id, r.v) for r in good.collect()) == [(1, 2.5), (4, None), (7, 1.0)]
    assert {(r.file.rsplit("/", 1)[1], r.rows, r.bad_rows, r.sample, r.status) for r in status.collect()} == {
        ("a.csv", 4, 2, "3,oops", "bad records"), ("b.csv", 1, 0, None, "ok"), ("c.csv", 1, 1, "no,no", "no good rows")}
    assert good.select("id").count() == 3 and good.count() == 3


def test_bad_json_and_a_path_that_is_not_there(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": \n{"id": 2}\n')
    good, status = tables.read_checked(spark, str(tmp_path / "a.json"), "id long", "json")
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert [(r.rows, r.bad_rows, r.status) for r in status.collect()] == [(3, 1, "bad records")]
    good, status = tables.read_checked(spark, str(tmp_path / "none.csv"), "id long")
    assert good.count() == 0 and status.first().status == "unreadable"
