"""Findings of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import attrix.ml.silhouette as S
from attrix.ml.models import silhouette_euclidean


def _mean_silhouette(Z, lab):
    D = np.sqrt(((Z[:, None] - Z[None]) ** 2).sum(2))
    score = np.zeros(len(Z))
    for i in range(len(Z)):
        own = lab == lab[i]
        if own.sum() > 1:
            a, b = D[i, own].sum() / (own.sum() - 1), min(D[i, lab == k].mean() for k in set(lab) if k != lab[i])
            score[i] = (b - a) / max(a, b)
    return score.mean()


@pytest.mark.parametrize("d", [2, 12])
def test_silhouette_measures_all_pairs(spark, monkeypatch, d):
    """clusters of more rows than any sample, some rows equal, one row alone,
    over several groups and tiles."""
    monkeypatch.setattr(S, "MOST", 300)
    monkeypatch.setattr(S, "TILE", 64)
    monkeypatch.setattr(S, "PIECE_BYTES", 4000)
    rng = np.random.default_rng(d)
    X = np.vstack([rng.normal(0, 1, (1300, d)), rng.normal(1.5, 1, (700, d)), np.full((9, d), 0.25), rng.normal(9, 1, (1, d))])
    lab = np.array([0] * 1300 + [1] * 700 + [0] * 5 + [1] * 4 + [2])
    names = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(lab, X)] + [(-1, *[5.0] * d)],
                               ", ".join(["cluster int", *[f"{n} double" for n in names]]))
    got = silhouette_euclidean(df.repartition(5), names).first()
    assert got["silhouette"] == pytest.approx(_mean_silhouette((X - X.mean(0)) / X.std(0), lab), abs=1e-10)
    assert (got["clusters"], got["error"], got["exact"]) == (3, 0.0, True)


def test_silhouette_queries_take_no_sample(spark, tmp_path):
    from attrix.plans.q_models import EMB_N, QUERIES

    rng = np.random.default_rng(8)
    X, lab = rng.normal(0, 1, (4300, EMB_N)), np.r_[np.zeros(4100, int), np.ones(200, int)]
    X[:200] += 0.3
    spark.createDataFrame([(i, [float(v) for v in x], int(c)) for i, (x, c) in enumerate(zip(X, lab))],
                          "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    Z = X.astype(np.float32).astype(float)
    Z = (Z - Z.mean(0)) / Z.std(0)
    sq = (Z * Z).sum(1)
    D = np.sqrt(np.maximum(sq[:, None] + sq - 2 * Z @ Z.T, 0))
    np.fill_diagonal(D, 0)
    to = np.stack([D[:, lab == c].sum(1) for c in (0, 1)], 1)
    n = np.array([4100, 200])
    own, other = to[np.arange(4300), lab] / (n[lab] - 1), to[np.arange(4300), 1 - lab] / n[1 - lab]
    got = QUERIES["silhouette_labels"](spark, str(tmp_path)).first()
    assert got["exact"] and got["silhouette"] == pytest.approx(((other - own) / np.maximum(own, other)).mean(), abs=1e-6)


def test_close_rows_are_measured_without_cancellation():
    x = np.random.default_rng(1).normal(0, 1, (40, 20)) + 50
    y = x + 1e-9
    every = slice(0, 40)
    assert np.diag(S.distances(S.Rows(x), every, S.Rows(y), every)) == pytest.approx(np.sqrt(20) * 1e-9, rel=1e-4)  # (50 + 1e-9) has no more digits
    assert (np.diag(S.distances(S.Rows(x), every, S.Rows(x), every)) == 0).all()


def test_many_clusters_and_groups_without_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "_groups", lambda *a: 40)
    rng = np.random.default_rng(5)
    X, lab = rng.normal(0, 1, (60, 2)), np.arange(60) // 2
    df = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(lab, X)], "cluster int, a double, b double")
    got = silhouette_euclidean(df, ["a", "b"], scale=False).first()
    assert got["silhouette"] == pytest.approx(_mean_silhouette(X, lab), abs=1e-12)
    assert df.where(F.col("cluster") < 0).count() == 0


def _boosted_data(spark, continuous):
    rng = np.random.default_rng(7)
    n = 3000
    a = rng.normal(0, 2, n) if continuous else rng.integers(0, 20, n) * 0.5
    b, c = rng.integers(-3, 4, n).astype(float), rng.integers(0, 9, n) / 100
    y = a * a + 3 * b - 100 * c + rng.normal(0, 1, n)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(y, a, b, c))]
    return spark.createDataFrame(rows, "k long, y double, a double, b double, c double").repartition(4)


def test_boosting_on_bins_is_boosting_on_rows(spark, monkeypatch):
    """rows of equal bins are one entry; MLlib on all rows is the same model."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from attrix.ml import boost
    from attrix.ml.models import _split, regress

    df = _boosted_data(spark, False)
    fitted = []
    monkeypatch.setattr(boost, "GBTRegressor", lambda **kw: _Seen(GBTRegressor(**kw), fitted))
    got = regress(df, "y", ["a", "b", "c"], "gbt", key="k", n_estimators=12)
    assert fitted[0] <= 20 * 7 * 9 < 2000  # entries, not rows
    train, test = (VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(d) for d in _split(df, "k", ["y", "a", "b", "c"]))
    want = GBTRegressor(featuresCol="x", labelCol="y", maxIter=12, stepSize=0.1, maxDepth=3, seed=42).fit(train)
    mine, theirs = (sorted((round(r["l"], 9), r["prediction"]) for r in d.collect()) for d in (
        got.predictions.withColumnRenamed("label", "l"), want.transform(test).withColumnRenamed("y", "l")))
    assert [p for _, p in mine] == pytest.approx([p for _, p in theirs], rel=1e-9)
    imp = {r["feature"]: r["importance"] for r in got.importance.collect()}
    assert [imp[f] for f in "abc"] == pytest.approx(list(want.featureImportances.toArray()), rel=1e-6)


class _Seen:
    def __init__(self, est, seen):
        self.est, self.seen = est, seen

    def fit(self, df):
        self.seen.append(df.count())
        return self.est.fit(df)


def test_boosting_bins_of_many_values(spark, monkeypatch):
    """Borders of a feature with more values than are counted come from a sketch of all rows."""
    from attrix.ml import boost
    from attrix.ml.models import regress

    df = _boosted_data(spark, True)
    counted = regress(df, "y", ["a", "b", "c"], "gbt", key="k", n_estimators=30).metrics.first()
    monkeypatch.setattr(boost, "COUNTED", 50)
    sketched = regress(df, "y", ["a", "b", "c"], "gbt", key="k", n_estimators=30).metrics.first()
    assert counted["n_total"] == sketched["n_total"] == 3000
    assert counted["r2"] > 0.9 and sketched["r2"] == pytest.approx(counted["r2"], abs=0.02)


def test_bin_numbers_follow_the_borders(spark):
    from attrix.ml.boost import _code

    t = np.array([-1.0, 0.0, 0.5, 2.0, 7.0])
    x = [-5.0, -1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 2.0, 3.0, 7.0, 8.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(_code(F.col("x"), t, 0, 5).alias("c"), "x").collect()
    assert {r["x"]: r["c"] for r in got} == {v: float(np.searchsorted(t, v)) for v in x}


def test_op4_leaves_no_shuffle_files_of_its_steps(spark, monkeypatch):
    """shuffles go as soon as the step that wrote them ends."""
    import random

    import attrix.llm.jaccard_join as J
    from attrix.llm.text import FREED
    from tests.llm.conftest import prose
    from tests.llm.test_dedup import brute_components

    rng = random.Random(4)
    rows = [(i, prose(rng, 60)) for i in range(40)]
    rows += [(100 + i, t + " " + prose(rng, 3)) for i, t in rows[:20]]
    before, states = spark.conf.get(FREED), []
    for name in ("_verify", "_deltas", "_near_pairs"):
        monkeypatch.setattr(J, name, lambda *a, f=getattr(J, name): states.append(spark.conf.get(FREED)) or f(*a))
    kept = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses
    had = kept().size()
    out = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert set(states) == {"true"} and spark.conf.get(FREED) == before == "false"
    assert kept().size() <= had + 2
    for _ in range(2):  # the result can be run again
        assert sorted(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()) == brute_components(rows)
