"""forests whose cost grows with the rows."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import attrix.ml.forest as FO
from attrix.ml import models as M


def table(spark, n, d=6, classes=3, seed=1, noise=0.2):
    rng = np.random.default_rng(seed)
    X = rng.normal(0, 1, (n, d)).round(1)
    y = np.where(rng.random(n) < noise, rng.integers(0, classes, n), (X[:, 0] > 0).astype(int) + (X[:, 1] > 0.5))
    cols = [f"f{j}" for j in range(d)]
    df = spark.createDataFrame([(i, *map(float, x), int(c), float(c + x[2])) for i, (x, c) in enumerate(zip(X, y))],
                               ", ".join(["id long", *[f"{c} double" for c in cols], "c int", "v double"])).repartition(3, "id")
    return df, cols


def brute(X, w, s, classes):
    """The largest gain of one node over all features and bins."""
    def score(m):
        if classes:
            return sum(w[m][s[m] == c].sum() ** 2 for c in np.unique(s)) / w[m].sum()
        return s[m].sum() ** 2 / w[m].sum()
    every = np.ones(len(w), bool)
    return max([score(m) + score(~m) - score(every) for f in range(X.shape[1]) for b in np.unique(X[:, f])[:-1] for m in [X[:, f] <= b]] or [0])


@pytest.mark.parametrize("classes", [True, False])
def test_splits_have_the_largest_gain_and_leaves_the_shares(classes):
    rng = np.random.default_rng(5)
    for _ in range(15):
        n = int(rng.integers(2, 60))
        X, w = rng.integers(0, 5, (n, 3)).astype(np.uint8), rng.integers(1, 4, n).astype(float)
        s = rng.integers(0, 3, n).astype(float) if classes else rng.normal(0, 1, n)
        t = FO.grow(X, w, s, classes, 30, 3, rng)
        inside, total = [np.arange(n)], 0.0
        for v in range(len(t["feat"])):
            m, rows = inside[v], t["leaf"] == v
            gain = brute(X[m], w[m], s[m], classes)
            if t["feat"][v] < 0:
                assert gain < 1e-9
                want = [w[m][s[m] == c].sum() / w[m].sum() for c in np.unique(s[m])] if classes else [s[m].sum() / w[m].sum()]
                assert t["p"][rows] == pytest.approx(want)
                assert (FO.route(t, X[m]) == v).all()
                continue
            left = X[m, t["feat"][v]] <= t["bin"][v]
            inside += [m[left], m[~left]]
            one = FO.grow(X[m], w[m], s[m], classes, 1, 3, rng)["gain"].sum()
            assert one == pytest.approx(gain)
            total += gain
        assert t["gain"].sum() == pytest.approx(total)


@pytest.mark.parametrize("label,classes,depth", [("c", True, 12), ("v", False, 4)])  # small nodes of values have equal gains
def test_large_nodes_are_split_by_histograms_into_the_same_trees(spark, monkeypatch, label, classes, depth):
    df, cols = table(spark, 900)
    got = []
    for most in (32 << 20, 1000):
        monkeypatch.setattr(FO, "GROUP_BYTES", most)
        forest = FO.fit(df, cols, label, classes, 5, depth, len(cols), 7)
        pred = {r["id"]: r["prediction"] for r in forest.predict(df, ["id"]).collect()}
        got.append((forest.importances(), [pred[i] for i in range(900)]))
        assert all((len(t["feat"]) > 1) == (most == 1000) for t in forest.tops)
    assert got[0][0] == pytest.approx(got[1][0], rel=1e-9)
    assert got[0][1] == pytest.approx(got[1][1], rel=1e-9)


def test_large_nodes_that_nothing_splits_are_leaves(spark, monkeypatch):
    monkeypatch.setattr(FO, "GROUP_BYTES", 100)
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 >= 10).cast("int").alias("c"))
    forest = FO.fit(df, ["a"], "c", True, 3, 30, 1, 1)
    assert forest.predict(df, ["c"]).where("prediction <> c").count() == 0
    assert forest.trees.count() == sum((t["feat"] < 0).sum() for t in forest.tops)
    assert list(forest.importances()) == [1.0]


def test_bootstrap_is_poisson_and_independent():
    ids = np.arange(200_000) + (3 << 33)
    a, b = FO.bootstrap(ids, 0, 42), FO.bootstrap(ids, 1, 42)
    assert [(a == i).mean() for i in range(4)] == pytest.approx(np.exp(-1) / np.array([1, 1, 2, 6]), abs=4e-3)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.01
    assert (FO.bootstrap(ids[::-1], 0, 42) == a[::-1]).all()


def test_rows_are_not_passed_over_again_for_every_level(spark):
    """Before, each level took a job over all rows, and more where its nodes were many."""
    df, cols = table(spark, 1500, noise=1.0)
    df = df.withColumn("c", F.col("c").cast("string"))
    sc, jobs = spark.sparkContext, []
    for depth in (3, 30):
        group = uuid.uuid4().hex
        sc.setJobGroup(group, "forest")
        try:
            r = M.classify(df, "c", cols, "rf", key="id", n_estimators=30, max_depth=depth)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(group)))
    assert jobs[1] <= jobs[0] + 3, jobs
    assert r.predictions.count() == r.metrics.first()["n_test"] > 200


def test_forests_find_what_mllib_finds(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    df, cols = table(spark, 2000)
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    tr, te = M.assemble(train, cols), M.assemble(test, cols)
    theirs = RandomForestClassifier(labelCol="c", numTrees=20, maxDepth=8, featureSubsetStrategy="sqrt", seed=1).fit(tr)
    ours = FO.fit(train, cols, "c", True, 20, 8, 3, 1)
    right = [p.where("prediction = c").count() / 400 for p in (theirs.transform(te), ours.predict(test, ["c"]))]
    assert right[1] == pytest.approx(right[0], abs=0.05) and right[1] > 0.75
    assert ours.importances() == pytest.approx(theirs.featureImportances.toArray(), abs=0.06)
    theirs = RandomForestRegressor(labelCol="v", numTrees=20, maxDepth=8, featureSubsetStrategy="all", seed=1).fit(tr)
    ours = FO.fit(train, cols, "v", False, 20, 8, len(cols), 1)
    error = [p.select(F.avg((F.col("v") - F.col("prediction")) ** 2)).first()[0] for p in (theirs.transform(te), ours.predict(test, ["v"]))]
    assert error[1] == pytest.approx(error[0], rel=0.1)
    assert ours.importances() == pytest.approx(theirs.featureImportances.toArray(), abs=0.02)
