"""Forecast fixtures and model twins (numpy closed forms)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.forecast import models as FM
from attrix.forecast import prepare as FP
from attrix.forecast import solvers
from attrix.ml import basics as B
from attrix.ml import models as M


def _series(spark, values, start=dt.date(2024, 1, 1), days=None):
    days = days or list(range(len(values)))
    rows = [(dt.datetime.combine(start + dt.timedelta(days=d), dt.time()), float(v))
            for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, v double")


def test_gap_grid_and_forward_fill(spark):
    df = _series(spark, [1.0, 2.0, 5.0], days=[0, 1, 4])
    out = FP.prepare_series(df, "ts", "v").orderBy("date").collect()
    assert [r["y"] for r in out] == [1.0, 2.0, 2.0, 2.0, 5.0]


def test_subday_grain_truncates(spark):
    rows = [(dt.datetime(2024, 1, 1, 8), 1.0), (dt.datetime(2024, 1, 3, 9), 2.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = FP.prepare_series(df, "ts", "v").orderBy("date").collect()
    assert [r["y"] for r in out] == [1.0, 1.0, 2.0]


def test_feature_table_rows(spark):
    df = _series(spark, list(range(1, 21)))
    ft = FP.feature_table(FP.prepare_series(df, "ts", "v")).orderBy("date").collect()
    assert len(ft) == 13
    first = ft[0]
    assert first["y"] == 8.0 and first["lag_7"] == 1.0 and first["diff_7"] == 7.0
    assert first["rolling_mean_7"] == pytest.approx(np.mean(range(2, 9)))
    assert first["dayofweek"] == dt.date(2024, 1, 8).weekday()


def _season(n=56):
    off = [3.0, -1.0, 0.5, 2.0, -2.5, -1.5, -0.5]
    return [10 + 0.5 * t + off[t % 7] for t in range(n)], off


def test_holt_winters_continues_noiseless_season():
    y, off = _season()
    fc, _ = solvers.holt_winters_forecast(np.array(y), 14)
    truth = [10 + 0.5 * t + off[t % 7] for t in range(56, 70)]
    assert np.allclose(fc, truth, atol=1e-6)


def test_additive_continues_noiseless_season():
    y, off = _season(84)
    days = np.arange(19723, 19723 + 84)
    yhat, trend, lo, hi = solvers.additive_forecast(days, np.array(y), 14)
    truth = [10 + 0.5 * t + off[t % 7] for t in range(84, 98)]
    assert np.allclose(yhat[84:], truth, atol=0.5)


def test_arima_shapes_and_interval():
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(0.2, 1.0, 300))
    fc, lo, hi, (p1, p2, th, s2, aic, bic) = solvers.arima211_forecast(y, 30)
    assert fc.shape == (30,) and np.all(lo < fc) and np.all(fc < hi)
    assert np.all(np.diff(hi - lo) >= -1e-9)      # interval widens with the horizon
    assert bic > aic


def test_forecast_jobs_multi_series(spark):
    y, _ = _season(40)
    a = _series(spark, y).withColumn("k", F.lit("a"))
    b = _series(spark, [2 * v for v in y]).withColumn("k", F.lit("b"))
    df = a.unionByName(b)
    hw = FM.holt_winters(df, "ts", "v", 7, ["k"])
    assert hw.groupBy("k").count().orderBy("k").collect()[1]["count"] == 7
    ar = FM.arima(df, "ts", "v", 5, ["k"]).collect()
    assert len(ar) == 10
    rep = FM.additive_report(FM.additive(df, "ts", "v", 30, ["k"]), ["k"]).collect()
    assert len(rep) == 2 and all(r["mape"] is not None for r in rep)


def test_row_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    with pytest.raises(B.NotEnoughRows):
        B.require_rows(df, "regression")
    assert B.require_rows(df, "clustering") == 3


def test_ols_and_ridge_match_closed_form(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(0, 1, (400, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(0, 0.1, 400)
    rows = [(i, *map(float, x), float(t)) for i, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    r = M.regress(df, "y", ["a", "b", "c"], "linear", key="id")
    buckets = [r0["b"] for r0 in df.orderBy("id").select(B.split_bucket("id").alias("b")).collect()]
    train = np.array([b != 0 for b in buckets])
    Xt, yt = X[train], y[train]
    A = np.column_stack([np.ones(len(Xt)), Xt])
    beta = np.linalg.lstsq(A, yt, rcond=None)[0]
    coefs = {row["feature"]: row["coefficient"] for row in r.importance.collect()}
    assert [coefs["a"], coefs["b"], coefs["c"]] == pytest.approx(list(beta[1:]), rel=1e-6)
    # ridge on population z-scores: (Z'Z + αI)⁻¹ Z'(y − ȳ)
    rr = M.regress(df, "y", ["a", "b", "c"], "ridge", key="id", alpha=1.0)
    Z = (Xt - Xt.mean(0)) / Xt.std(0)
    w = np.linalg.solve(Z.T @ Z + np.eye(3), Z.T @ (yt - yt.mean()))
    got = {row["feature"]: row["coefficient"] for row in rr.importance.collect()}
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(w), rel=1e-5)


def test_pca_matches_eigh(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(0, 1, (300, 4)) @ rng.normal(0, 1, (4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double, d double")
    res = M.pca(df, ["a", "b", "c", "d"], 2)
    Z = (X - X.mean(0)) / X.std(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(Z.T)))[::-1]
    got = [r["variance_pct"] for r in res.variance.orderBy("component").collect()]
    assert got == pytest.approx(list(ev[:2] / ev.sum() * 100), rel=1e-6)
    load = np.array([[r["PC1"], r["PC2"]] for r in res.loadings.collect()])
    for j in range(2):
        assert load[np.argmax(np.abs(load[:, j])), j] > 0


def test_kmeans_and_confusion_total(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(c, 0.2, (20, 2)) for c in ([0, 0], [5, 5], [0, 5])])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)],
                               "id long, a double, b double")
    res = M.cluster(df, ["a", "b"], "kmeans", k=3, keep=["id"], restarts=2)
    sizes = sorted(r["count"] for r in res.labelled.groupBy("cluster").count().collect())
    assert sizes == [20, 20, 20]
    pred = df.select(F.when(F.col("a") > 2.5, "x").otherwise("y").alias("label"),
                     F.when(F.col("b") > 2.5, "x").otherwise("y").alias("prediction"))
    cm = B.confusion(pred).collect()
    assert sum(r["count"] for r in cm) == 60 and len(cm) == 4
