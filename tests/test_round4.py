"""Passes spread over the cluster, bounded pieces in Python tasks, bisecting k-means that stops when it stands still."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.ml import knn, models
from attrix.operators import normality
from attrix.session import spread


def test_one_split_of_many_rows_is_spread(spark):
    one = spark.range(0, 120_000, 1, 1)
    many = spread(one)
    assert many.rdd.getNumPartitions() == 3
    assert many.agg(F.count("*"), F.sum("id")).first() == one.agg(F.count("*"), F.sum("id")).first()
    assert spread(spark.range(0, 50_000, 1, 1)).rdd.getNumPartitions() == 1


def test_iterative_fits_see_spread_rows(spark, monkeypatch):
    df = spark.range(0, 60_000, 1, 1).select("id", (F.col("id") % 97).alias("a"), (F.col("id") % 89 * 1.5).alias("b"))
    seen = []
    fit = models.KMeans.fit
    monkeypatch.setattr(models.KMeans, "fit", lambda self, X: seen.append(X.rdd.getNumPartitions()) or fit(self, X))
    models.cluster(df, ["a", "b"], "kmeans", keep=["id"], restarts=1)
    assert seen == [2]


def test_bisecting_stops_where_all_iterations_end(spark, monkeypatch):
    from pyspark.ml.clustering import BisectingKMeans

    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double").coalesce(1)
    turns = []

    class Counted(BisectingKMeans):
        def fit(self, X):
            turns.append(self.getMaxIter())
            return super().fit(X)

    monkeypatch.setattr(models, "BisectingKMeans", Counted)
    got = {r["id"]: r["cluster"] for r in models.cluster(df, ["a", "b"], "bisecting", keep=["id"], max_iter=300).labelled.collect()}
    assert sum(turns) < 300
    monkeypatch.setattr(models, "_bisect", lambda X, k, seed, n: BisectingKMeans(k=k, seed=seed, maxIter=n).fit(X))
    assert got == {r["id"]: r["cluster"] for r in models.cluster(df, ["a", "b"], "bisecting", keep=["id"], max_iter=300).labelled.collect()}


def test_knn_pieces_are_bounded_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(6)
    X = np.repeat(rng.integers(0, 3, (40, 3)).astype(float), 8, axis=0)
    label = np.array([str(v) for v in rng.integers(0, 4, len(X))])
    q = rng.integers(0, 3, (30, 3)).astype(float)
    want = knn._nearest(q, X, label, 5)
    tall = []
    distances = knn._distances
    monkeypatch.setattr(knn, "OUT", 64)
    monkeypatch.setattr(knn, "_distances", lambda x, y: tall.append(len(x)) or distances(x, y))
    got = knn._nearest(q, X, label, 5)
    assert all((a == b).all() for a, b in zip(got, want)) and min(tall) < len(q)
    monkeypatch.setattr(knn, "ROWS", 7)
    import pandas as pd

    pieces = list(knn._slices([pd.DataFrame({"id": range(20)}), pd.DataFrame({"id": []})]))
    assert [len(p) for p in pieces] == [7, 7, 6] and pd.concat(pieces)["id"].tolist() == list(range(20))


def test_shapiro_reads_the_rows_twice_only(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = np.r_[rng.normal(0, 1, 300), np.repeat(0.5, 90), [-0.0, 0.0]]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    written = []
    stash = normality.stash
    monkeypatch.setattr(normality, "stash", lambda d, name: written.append(name) or stash(d, name))
    r = normality.shapiro_wilk(df, "v", buckets=8, exact_run=16).first()
    assert written == ["ties"]
    m = np.array([normality._py_ppf((i - 0.375) / (len(v) + 0.25)) for i in range(1, len(v) + 1)])
    x = np.sort(v)
    assert r["n"] == len(v) and r["W"] == pytest.approx((m @ x) ** 2 / (m @ m) / ((x - x.mean()) ** 2).sum(), abs=0.01)
