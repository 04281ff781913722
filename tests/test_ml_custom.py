"""Distributed custom algorithms vs brute-force numpy twins / planted data."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.ml import isoforest
from attrix.operators import normality


def _sw_bruteforce(x):
    """Royston's algorithm on a sorted numpy array (the published recipe)."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(m @ m)
    u = 1 / math.sqrt(n)
    poly = lambda c, v: sum(ci * v ** i for i, ci in enumerate(c))
    a = m / math.sqrt(mm)
    an = m[-1] / math.sqrt(mm) + poly(normality.C1, u)
    if n > 5:
        an1 = m[-2] / math.sqrt(mm) + poly(normality.C2, u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
        a = m / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
        a = m / math.sqrt(phi)
        a[-1], a[0] = an, -an
    w = (a @ x) ** 2 / np.sum((x - x.mean()) ** 2)
    return min(w, 1.0)


def test_norm_ppf_accuracy(spark):
    ps = [1e-6, 0.001, 0.02, 0.024, 0.3, 0.5, 0.77, 0.976, 0.999, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(normality.norm_ppf(F.col("p"))).collect()]
    for p, g in zip(ps, got):
        assert g == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-9)


@pytest.mark.parametrize("seed,dist", [(1, "normal"), (2, "expo"), (3, "ties")])
def test_shapiro_matches_bruteforce(spark, seed, dist):
    rng = np.random.default_rng(seed)
    if dist == "normal":
        x = rng.normal(10, 2, 400)
    elif dist == "expo":
        x = rng.exponential(1.0, 300)
    else:
        x = np.concatenate([np.round(rng.normal(0, 1, 300), 1), np.zeros(150)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    r = normality.shapiro_wilk(df, "v", buckets=8, exact_run=200).collect()[0]
    assert r["W"] == pytest.approx(_sw_bruteforce(x), rel=1e-7)
    if dist == "normal":
        assert r["is_normal"]
    if dist == "expo":
        assert not r["is_normal"] and r["p_value"] < 1e-6


def test_shapiro_long_ties_use_integral(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 200), np.full(300, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    r = normality.shapiro_wilk(df, "v", buckets=8, exact_run=16).collect()[0]
    assert r["W"] == pytest.approx(_sw_bruteforce(x), rel=1e-3)


def test_shapiro_small_n(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    r = normality.shapiro_wilk(df, "v").collect()[0]
    assert r["W"] == pytest.approx((math.sqrt(0.5) * 3) ** 2 / (14 / 3), rel=1e-9)
    assert 0 <= r["p_value"] <= 1
    df2 = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert normality.shapiro_wilk(df2, "v").collect()[0]["W"] is None


def test_isolation_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))]
    pts += [(1000 + j, 50.0 + j, 50.0 - j) for j in range(3)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    out = isoforest.isolation_forest(df, ["a", "b"], contamination=0.05, keep=["id"])
    worst = [r["id"] for r in out.orderBy("score").limit(3).collect()]
    assert sorted(worst) == [1000, 1001, 1002]
    n_anom = out.where("is_anomaly").count()
    assert 5 <= n_anom <= 15


def _dbscan_brute(X, eps, min_samples):
    n = len(X)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(2))
    nb = d <= eps
    core = nb.sum(1) >= min_samples
    lab = -np.ones(n, dtype=int)
    c = 0
    for i in range(n):
        if not core[i] or lab[i] >= 0:
            continue
        stack = [i]
        lab[i] = c
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(nb[j]):
                if lab[k] < 0:
                    lab[k] = c
                    if core[k]:
                        stack.append(k)
        c += 1
    return lab, core


def _partition(labels):
    groups = {}
    for i, l in enumerate(labels):
        if l >= 0:
            groups.setdefault(l, set()).add(i)
    return sorted(map(frozenset, groups.values()), key=min), {i for i, l in enumerate(labels) if l < 0}


@pytest.mark.parametrize("salt_rows", [7, 100_000])
def test_dbscan_matches_bruteforce(spark, salt_rows):
    from attrix.ml.dbscan import dbscan

    rng = np.random.default_rng(7)
    centers = np.array([[0, 0], [6, 6], [0, 8]])
    X = np.vstack([c + rng.normal(0, 0.3, (20, 2)) for c in centers] + [[[15, -5]], [[-9, 12]]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = dbscan(df, ["a", "b"], eps=0.5, min_samples=5, keep=["id"], salt_rows=salt_rows)
    got = dict((r["id"], r["cluster"]) for r in out.collect())
    Z = (X - X.mean(0)) / X.std(0)
    ref, _ = _dbscan_brute(Z, 0.5, 5)
    assert _partition([got[i] for i in range(len(X))]) == _partition(ref)
    assert got[60] == -1 and got[61] == -1


@pytest.mark.parametrize("d,eps", [(1, 0.05), (2, 0.2), (3, 0.6)])
def test_dbscan_core_points_and_clusters(spark, d, eps):
    """Dense and thin places, ties, chains that barely touch."""
    from attrix.ml.dbscan import dbscan

    rng = np.random.default_rng(d)
    X = np.vstack([rng.uniform(-2, 2, (120, d)), rng.normal(0, 0.2, (150, d)), rng.normal(1, 0.05, (40, d)), np.zeros((30, d))])
    cols = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, " + ", ".join(f"{c} double" for c in cols))
    out = {r["id"]: r for r in dbscan(df, cols, eps=eps, min_samples=5, keep=["id"], salt_rows=9).collect()}
    Z = (X - X.mean(0)) / X.std(0)
    ref, core = _dbscan_brute(Z, eps, 5)
    assert [out[i]["is_core"] for i in range(len(X))] == core.tolist()
    mine = [out[i]["cluster"] if core[i] else -1 for i in range(len(X))]
    assert _partition(mine)[0] == _partition([r if c else -1 for r, c in zip(ref, core)])[0]
    assert [out[i]["cluster"] == -1 for i in range(len(X))] == (ref == -1).tolist()
    firsts = {}
    for i in np.flatnonzero(core):
        firsts[mine[i]] = min(firsts.get(mine[i], (np.inf,) * d), tuple(Z[i]))
    assert [firsts[c] for c in sorted(firsts)] == sorted(firsts.values())


def test_dbscan_one_coordinate(spark):
    """All points on one coordinate of the first axis; the hot place is one cell."""
    from attrix.ml.dbscan import dbscan

    rng = np.random.default_rng(1)
    y = np.concatenate([np.zeros(300), rng.uniform(0, 0.001, 300), rng.uniform(5, 6, 200), [50.0]])
    df = spark.createDataFrame([(i, 1.0, float(v)) for i, v in enumerate(y)], "id long, x double, y double")
    out = {r["id"]: r["cluster"] for r in dbscan(df, ["x", "y"], eps=0.1, min_samples=5, keep=["id"], salt_rows=50).collect()}
    z = np.column_stack([np.zeros(len(y)), (y - y.mean()) / y.std()])
    ref, _ = _dbscan_brute(z, 0.1, 5)
    assert _partition([out[i] for i in range(len(y))]) == _partition(ref)


def _knn_brute(X, labels, Q, k):
    out = []
    for q in Q:
        d = ((X - q) ** 2).sum(1)
        out.append([labels[j] for j in sorted(range(len(X)), key=lambda j: (d[j], labels[j]))[:k]])
    return out


@pytest.mark.parametrize("pivots,block,visits", [(1, 32_768, 262_144), (7, 13, 11), (40, 50, 262_144)])
def test_knn_join_matches_bruteforce(spark, monkeypatch, pivots, block, visits):
    """Clusters, a hot point that a third of the rows repeat, ties, cells with less than k rows."""
    from attrix.ml import knn

    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "VISITS", visits)
    rng = np.random.default_rng(pivots)
    X = np.vstack([rng.normal(c, 0.3, (40, 3)) for c in (0, 4, 9)] + [np.full((60, 3), 4.0)] + [rng.uniform(-20, 20, (15, 3))])
    labels = [f"c{i % 5}" for i in range(len(X))]
    Q = np.vstack([rng.uniform(-5, 12, (40, 3)), X[::9], np.full((5, 3), 4.0)])
    zc = ["z0", "z1", "z2"]
    shape = ", ".join(f"{z} double" for z in zc)
    train = spark.createDataFrame([(lb, *map(float, x)) for lb, x in zip(labels, X)], f"label string, {shape}")
    test = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(Q)], f"id long, {shape}")
    got = {}
    for r in knn.knn_join(train, test, 3, 5, pivots=pivots).collect():
        got.setdefault(r["tid"], []).append((r["r"], r["nlabel"], r["dist"]))
    want = _knn_brute(X, labels, Q, 5)
    for i in range(len(Q)):
        assert [x[1] for x in sorted(got[i])] == want[i]
        assert sorted(x[2] for x in got[i]) == pytest.approx(sorted(np.sqrt(((X - Q[i]) ** 2).sum(1)))[:5], abs=1e-9)


def test_knn_cells_are_pruned():
    from attrix.ml.knn import _Cells

    rng = np.random.default_rng(2)
    centres = rng.uniform(-100, 100, (30, 8))
    X = centres[rng.integers(0, 30, 3000)] + rng.normal(0, 1, (3000, 8))
    cells = _Cells(centres)
    home, d = cells.home(X)
    far = d[np.arange(len(X)), home]
    for j in range(30):
        cells.count[j], cells.radius[j] = (home == j).sum(), far[home == j].max()
        cells.smallest[j] = np.sort(far[home == j])[:5]
    low = cells.below(X, d, home)
    exact = np.stack([np.sqrt(((X[:, None] - X[None, home == j]) ** 2).sum(2)).min(1) for j in range(30)], 1)
    assert (low <= exact + 1e-12).all()
    assert (low <= cells.above(X, d, 5)[:, None]).mean() < 0.1


def test_row_number_over_ranges(spark):
    from attrix.functions.rank import with_row_number

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("tie"))
    out = with_row_number(df, [F.col("tie").desc(), F.col("v").asc()])
    got = [(r["tie"], r["v"]) for r in sorted(out.collect(), key=lambda r: r["rank"])]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and out.agg(F.max("rank"), F.countDistinct("rank")).first() == (5000, 5000)
    assert with_row_number(df.where("v < 0"), [F.col("v")]).count() == 0
    assert with_row_number(df, [F.col("v")], source=df).where("rank = v + 1").count() == 5000
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def _silhouette_brute(Z, lab):
    D = np.sqrt(((Z[:, None] - Z[None]) ** 2).sum(2))
    s = []
    for i in range(len(Z)):
        own = lab == lab[i]
        if own.sum() < 2:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    return np.mean(s)


def test_silhouette_euclidean_matches_numpy(spark):
    from attrix.ml.models import silhouette_euclidean

    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(5, 1, (25, 2)), rng.normal([0, 6], 1, (20, 2)), [[20, 20]], np.zeros((4, 2))])
    lab = np.array([0] * 30 + [1] * 25 + [2] * 20 + [3] + [0] * 4)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(X, lab)] + [(9.0, 9.0, -1)],
                               "a double, b double, cluster int")
    got = silhouette_euclidean(df, ["a", "b"]).first()
    Z = (X - X.mean(0)) / X.std(0)
    assert got["silhouette"] == pytest.approx(_silhouette_brute(Z, lab), abs=1e-7)
    assert (got["clusters"], got["error"], got["exact"]) == (4, 0.0, True)
    one = silhouette_euclidean(df.where("cluster = 0"), ["a", "b"]).first()
    assert (one["silhouette"], one["clusters"]) == (0.0, 1)


def test_silhouette_sample_is_near_with_its_error(spark):
    from attrix.ml.models import silhouette_euclidean

    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(0, 1, (900, 2)), rng.normal(2.5, 1, (700, 2))])
    lab = np.array([0] * 900 + [1] * 700)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(X, lab)], "a double, b double, cluster int")
    got = silhouette_euclidean(df, ["a", "b"], reference=160).first()
    want = _silhouette_brute((X - X.mean(0)) / X.std(0), lab)
    assert not got["exact"] and 0 < got["error"] < 0.03
    assert abs(got["silhouette"] - want) < max(5 * got["error"], 0.01)
