"""Findings of round 3."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import attrix.functions.quantiles as Q
from attrix.operators import charts


def test_small_groups_take_no_sketch_and_spread_over_more_tasks(spark, monkeypatch):
    """a task holds as many rows however many groups there are."""
    rng = np.random.default_rng(3)
    groups = {f"g{i}": rng.integers(0, 50, rng.integers(1, 12)).astype(float) for i in range(300)} | {"hot": rng.normal(0, 9, 3000)}
    rows = [(g, float(v)) for g, arr in groups.items() for v in arr] + [(None, 1.0), ("g0", None), ("g0", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    n = df.where("x is not null and not isnan(x) and g is not null").groupBy("g").agg(F.count("*").alias("n"))
    monkeypatch.setattr(Q, "PER_TASK", 100)
    large, rest, tasks = Q.by_size(df, "g", n, 1000)
    small = sum(len(a) for g, a in groups.items() if g != "hot")
    assert tasks == rest.rdd.getNumPartitions() == -(-small // 100)
    assert large.select("g").distinct().collect() == [("hot",)] and rest.where("g = 'hot'").count() == 0
    taken = []
    monkeypatch.setattr(Q, "_sketch", lambda x, f=Q._sketch: taken.append(1) or f(x))
    Q.group_quantiles(df.where("g <> 'hot'"), "g", "x", [0.5], small=1000).collect()
    assert not taken
    for limit in (5, 1000, 100_000):
        monkeypatch.setattr(Q, "SMALL", limit)
        monkeypatch.setattr(charts, "SMALL", limit)
        got = {r["g"]: r for r in charts.box_summary(df, "x", "g").collect()}
        assert sorted(got) == sorted(groups)
        for g, a in groups.items():
            q = np.percentile(a, [25, 50, 75])
            lo, hi = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
            assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(a), a.min(), a.max())
            assert [got[g][c] for c in ("q1", "median", "q3")] == pytest.approx(list(q), rel=1e-12)
            assert [got[g][c] for c in ("whisker_low", "whisker_high")] == [a[a >= lo].min(), a[a <= hi].max()]
            assert got[g]["outliers"] == ((a < lo) | (a > hi)).sum()


@pytest.mark.parametrize("seed,alts,near", [(1, 2, True), (2, 40, True), (3, 2, False)])
def test_near_copies_that_just_do_not_link_are_not_joined_in_pairs(spark, monkeypatch, seed, alts, near):
    """op4: a family around one text, most of it just below the similarity; what differs
    recurs (few ``alts``) or not.  ``near``: with the rule for far pairs alone the result is the same."""
    import random

    import attrix.llm.jaccard_join as J
    from tests.llm.conftest import prose
    from tests.llm.test_dedup import brute_components

    if not near:
        monkeypatch.setattr(J, "NEAR", "false")
    rng = random.Random(seed)
    base, line = prose(rng, 150).split(), prose(rng, 12)
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"alt{rng.randrange(alts)}"
        rows.append((i, " ".join(w[:rng.choice([150, 150, 130])])))
    rows += [(300 + i, prose(rng, rng.randint(8, 40)) + " " + line + " " + prose(rng, rng.randint(0, 9))) for i in range(60)]
    offered = []
    monkeypatch.setattr(J, "_near_pairs", lambda *a, f=J._near_pairs: offered.append(f(*a)) or offered[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in J.jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)
    if alts > 2:  # else most differences recur
        assert offered[0].count() < 220 * 219 / 2 / 8  # an eighth of the pairs of the family


def test_difference_from_a_pivot_decides_a_link():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = int(rng.integers(5, 60))
        pivot = set(range(n))
        pool, most = np.arange(n), max(2, n // 4)
        x, y = ((pivot - set(rng.choice(pool, rng.integers(0, most), replace=False))) | set(100 + rng.integers(0, 12, rng.integers(0, most)))
                for _ in range(2))
        w = [5 * len(pivot - s) + 4 * len(s - pivot) for s in (x, y)]
        shared = len((x ^ pivot) & (y ^ pivot))
        assert (100 * len(x & y) >= 80 * len(x | y)) == (9 * shared >= sum(w) - n)
        assert (100 * len(x & pivot) >= 80 * len(x | pivot)) == (w[0] <= n)
