"""Isolation forest (100 trees × 256 samples, seed 42, unscaled features).

Plan:

1. Per-tree samples: equal rows collapse into one point with its weight; for
   each tree a point is drawn ``floor(w·p + u)`` times (``p ≈ 3·256/n``, ``u``
   uniform from a seeded hash), so a point that holds a third of all rows has
   its share in every sample — an ``explode`` of a few trees per point, not of
   all 100 — and ``row_number() ≤ 256`` by hash per tree picks the sample.
   The sample table is ≈ 100 × 768 rows whatever ``n`` is.
2. ``groupBy(tree).applyInPandas`` grows the 100 trees in parallel
   (≤ 256 rows per group); each tree is a flat node table.
3. The node table is bounded (≤ 100 × 511 nodes), so it is broadcast and
   every partition scores its rows with vectorised numpy traversal
   (``mapInPandas``).
4. The decision threshold is the ``contamination`` quantile of the scores
   (``percentile_approx``, a bounded sketch); decision = score − threshold,
   anomaly when < 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.functions.quantiles import exact_quantiles
from attrix.ml.basics import complete_rows, require_rows
from attrix.session import ship_package, stash

EULER = 0.5772156649015329


def c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(pdf: pd.DataFrame, d: int, max_depth: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = pdf[[f"x{i}" for i in range(d)]].to_numpy(dtype=float)
    rng = np.random.default_rng(seed * 1_000_003 + tree)
    nodes = []  # node, feature, threshold, left, right, size

    def build(idx, depth):
        node = len(nodes)
        nodes.append([node, -1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return node
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            return node
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        nodes[node][1], nodes[node][2] = f, thr
        nodes[node][3] = build(left, depth + 1)
        nodes[node][4] = build(right, depth + 1)
        return node

    build(np.arange(len(X)), 0)
    out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size"])
    out.insert(0, "tree", tree)
    return out


def fit(df: DataFrame, features: list[str], n_trees: int = 100, max_samples: int = 256,
        seed: int = 42) -> tuple[pd.DataFrame, int]:
    """Grow the forest; returns the node table (bounded) and the sample size."""
    ship_package(df.sparkSession)
    src = complete_rows(df, features).select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    n = src.count()
    psi = int(min(max_samples, n))
    p = min(1.0, 3.0 * psi / max(n, 1))
    xs = [f"x{i}" for i in range(len(features))]
    points = src.groupBy(*xs).agg(F.count(F.lit(1)).alias("w")).withColumn(
        "h", F.xxhash64(*xs, F.lit(seed)))
    # uniform in [0,1) per (tree, point) from a seeded 64-bit hash; a point of
    # weight w is drawn floor(w p + u) times, w p times on average
    unit = lambda t: F.pmod(F.xxhash64("h", t), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = lambda t: F.floor(F.col("w") * F.lit(p) + unit(t)).cast("int")
    picks = points.select("*", F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                                        lambda t: times(t) > 0).alias("trees"))
    exploded = picks.select("*", F.explode("trees").alias("tree")).drop("trees")
    exploded = exploded.withColumn("copy", F.explode(F.sequence(F.lit(1), times(F.col("tree")))))
    exploded = exploded.withColumn("u", F.xxhash64("h", "tree", "copy"))
    w = Window.partitionBy("tree").orderBy("u", *xs)
    sample = exploded.withColumn("r", F.row_number().over(w)).where(F.col("r") <= psi).drop(
        "u", "r", "h", "w", "copy")
    d = len(features)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    schema = ("tree int, node long, feature long, threshold double, left long, right long, "
              "size long")
    nodes = sample.groupBy("tree").applyInPandas(lambda g: _grow(g, d, max_depth, seed), schema)
    return nodes.toPandas(), psi


def _path_lengths(X: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
    total = np.zeros(len(X))
    trees = nodes.groupby("tree")
    for _, t in trees:
        t = t.sort_values("node")
        feat = t["feature"].to_numpy()
        thr = t["threshold"].to_numpy()
        left = t["left"].to_numpy()
        right = t["right"].to_numpy()
        size = t["size"].to_numpy()
        cur = np.zeros(len(X), dtype=np.int64)
        depth = np.zeros(len(X))
        active = feat[cur] >= 0
        while active.any():
            idx = np.flatnonzero(active)
            f = feat[cur[idx]]
            go_left = X[idx, f] < thr[cur[idx]]
            cur[idx] = np.where(go_left, left[cur[idx]], right[cur[idx]])
            depth[idx] += 1
            active = feat[cur] >= 0
        total += depth + c_factor(size[cur])
    return total / trees.ngroups


def score(df: DataFrame, features: list[str], nodes: pd.DataFrame, psi: int,
          keep: list[str] | None = None) -> DataFrame:
    """``score`` = −2^(−E[h]/c(ψ)) (higher = more normal), per row."""
    keep = list(keep or [])
    spark = df.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(nodes)
    cpsi = float(c_factor(np.array([psi]))[0])
    src = complete_rows(df, features).select(*keep, *features)
    out_schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields] + ["score double"])

    def fn(batches):
        forest = bc.value
        for b in batches:
            X = b[features].to_numpy(dtype=float)
            h = _path_lengths(X, forest)
            b = b.copy()
            b["score"] = -np.power(2.0, -h / cpsi)
            yield b

    return src.mapInPandas(fn, out_schema)


def isolation_forest(df: DataFrame, features: list[str], contamination: float = 0.05,
                     n_trees: int = 100, max_samples: int = 256, seed: int = 42,
                     keep: list[str] | None = None) -> DataFrame:
    """Rows with ``score``, ``decision`` (score − threshold; negative =
    anomaly) and ``is_anomaly``; the threshold is the scores' exact
    ``contamination`` quantile (linear interpolation)."""
    src = complete_rows(df, features)
    require_rows(src, "anomaly")
    nodes, psi = fit(src, features, n_trees, max_samples, seed)
    scored = stash(score(src, features, nodes, psi, keep), "scores")  # scored once, read twice
    thr = exact_quantiles(scored, ["score"], [contamination])[0][("score", contamination)]
    return scored.withColumn("decision", F.col("score") - F.lit(thr)).withColumn(
        "is_anomaly", F.col("decision") < 0)
