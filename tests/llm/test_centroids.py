"""Centroid clustering against plain Lloyd rounds, and its bounds."""

import hashlib
import random

import numpy as np

from attrix.llm import centroids as C
from tests.llm.conftest import key

NAN, INF = float("nan"), float("inf")


def brute(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        member = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for m, (_, v) in zip(member, kept) if m == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {j: sum(d for _, c, d in got if c == j) for j in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in got], key=key)


def messy():
    rng = random.Random(8)
    centres = [[rng.uniform(-3, 3) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 9]]) for i in range(150)]
    hot = rows[0][1]
    rows += [(1000 + i, list(hot)) for i in range(80)] + [(3, [1.0] * 64), (3, [1.0] * 64), (None, [0.5] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [NAN] + [0.0] * 63), (205, [-INF] * 64)]
    return rows


def frame(spark, rows):
    more = [(i, v, 1, "x", 2) for i, v in rows]
    return spark.createDataFrame(more, "vec_id long, embedding array<double>, label int, cluster string, distance int").repartition(4)


def test_against_brute_force(spark):
    rows = messy()
    for k, rounds in ((16, 3), (5, 1), (400, 2)):
        out = C.with_inertia(*C.centroid_clusters(frame(spark, rows), k=k, rounds=rounds))
        assert sorted(map(tuple, out.collect()), key=key) == brute(rows, k, rounds)


def test_beyond_and_nothing(spark):
    rows = messy()[:40]
    out = C.with_inertia(*C.centroid_clusters(frame(spark, rows + [(900, [1e30] * 64)]))).collect()
    assert [tuple(r)[1:] for r in out if r["vec_id"] == 900] == [(None,) * 5]
    assert sorted((tuple(r) for r in out if r["vec_id"] != 900), key=key) == brute(rows, 16, 3)
    assert C.with_inertia(*C.centroid_clusters(frame(spark, rows[:0] + [(1, None)]))).count() == 0
    same = C.with_inertia(*C.centroid_clusters(frame(spark, [(i, [0.25] * 64) for i in range(30)]))).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in same} == {(0, 0, 0)}


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    for scale in (3, 1000, C.LIMIT - 1):
        centres = rng.integers(-scale, scale, (12, 64))
        x = np.clip(centres[rng.integers(0, 12, 600)] + rng.integers(-scale // 9 - 1, scale // 9 + 1, (600, 64)), -C.LIMIT, C.LIMIT)
        pivots = C.farthest_first(centres, 6)
        cached = np.stack([C.squares(x, p) for p in pivots], 1)
        bounds = C.Bounds(pivots, centres)
        exact = np.stack([C.squares(x, c) for c in centres], 1)
        assert (bounds.least_squares(cached) <= exact.astype(float)).all()
        cluster, d, checked = C.assign(x, cached, centres, bounds)
        assert (cluster == exact.argmin(1)).all() and (d == exact.min(1)).all()
        assert checked.mean() < 6
