"""Substring, Jaccard and suffix-array dedup against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import attrix.llm.jaccard_join as J
import attrix.llm.suffix_dedup as S
from attrix.functions.graph import components
from attrix.llm import sketch
from attrix.llm.jaccard_join import jaccard_join
from attrix.llm.substring_dedup import substring_dedup
from attrix.llm.suffix_dedup import common_prefixes, merge_runs, refine, suffix_dedup
from tests.llm.conftest import key, prose

LEAST = -(1 << 63)


def brute_windows(rows, span):
    first = {}
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - span + 1):
            k = tuple(w[i:i + span])
            first[k] = min(first.get(k, (1 << 62,)), (LEAST if d is None else d,))
    out = []
    for d, t, *_ in rows:
        w, seen = (t or "").encode().split(), set()
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            k = tuple(w[i:i + span])
            if k in seen or first[k][0] < (LEAST if d is None else d):
                gone[i:i + span] = [True] * span
            seen.add(k)
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=key)


def test_substring_dedup(messy, rows):
    got = substring_dedup(messy, carry=("lang", "key")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=key) == brute_windows(rows, 20)
    for r in got:  # the cleaned text holds exactly the kept words; null stays null
        assert (r["text"] or "").encode().split() == r["kept"].encode().split()
        assert r["key"] == 1


def brute_components(rows):
    sets = []
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same = rows[i][0] == rows[j][0] and a and b
            if same or (a and b and 100 * len(a & b) >= 80 * len(a | b)):
                up[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        v = LEAST if d is None else d
        least[root(i)] = min(least.get(root(i), v), v)
    out = [(rows[i][0], len(s), least[root(i)] if s else (rows[i][0])) for i, s in enumerate(sets)]
    return sorted(((d, n, None if c == LEAST else c) for d, n, c in out), key=key)


def test_jaccard_join(messy, rows):
    got = jaccard_join(messy).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=key) == brute_components(rows)


@pytest.mark.parametrize("hits,rounds", [(64, 2), (3, 0)])
def test_jaccard_family(spark, monkeypatch, hits, rounds):
    """A large family of near copies, common lines and small sets."""
    monkeypatch.setattr(J, "HEAVY_HITS", hits)
    monkeypatch.setattr(J, "ROUNDS", max(1, rounds))
    rng = random.Random(hits)
    base, line = prose(rng, 90).split(), prose(rng, 14)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, prose(rng, rng.randint(8, 60)) + " " + line) for i in range(80)]
    for i in range(60):
        w = prose(rng, rng.randint(1, 15)).split()
        rows += [(400 + 2 * i, " ".join(w)), (401 + 2 * i, " ".join(w[:-1] if i % 2 else [*w, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_boundary_rises_with_list_length():
    assert J.boundary(1) <= J.boundary(20) <= J.boundary(500) <= J.MAX_SMALL


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(60)}}


def brute_bytes(rows, span):
    count = collections.Counter()
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    for _, b in texts:
        count.update(b[i:i + span] for i in range(len(b) - span + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if count[b[i:i + span]] > 1:
                gone[i:i + span] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=key)


@pytest.mark.parametrize("often", [4096, 2])
def test_suffix_dedup(messy, rows, monkeypatch, often):
    monkeypatch.setattr(S, "SUB_SHARD_PIECES", often)
    small = messy.where("doc_id is null or doc_id <> 50")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup(small).collect()]
    assert sorted(got, key=key) == brute_bytes([r for r in rows if r[0] != 50], 200)


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(40):
        n, sigma, depth = rng.randint(1, 300), rng.choice([1, 2, 20]), rng.choice([5, 8, 12, 30])
        data = np.array([rng.randint(97, 96 + sigma) for _ in range(n)], np.uint8)
        order, text = refine(data, depth), data.tobytes()
        parts = [text[i:i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and parts == sorted(parts)
        shared = common_prefixes(data, order, depth)
        for x, y in zip(order[1:], order[:-1]):
            m = 0
            while m < depth and max(x, y) + m < n and text[x + m] == text[y + m]:
                m += 1
            assert shared[x] == m


def test_merge_runs_by_binary_search():
    pair = np.dtype([("a", "u8"), ("b", "u8")])
    runs = [np.array(v, pair) for v in ([(1, 1), (2, 2)], [(2, 2), (3, 1)], [], [(2, 2), (3, 2)])]
    assert [x.tolist() for x in merge_runs(runs)] == [[True, False], [False, True], [], [False, True]]


def test_sketch_never_misses_a_repeat(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    v = np.r_[v, v[:500]]
    bits = sketch.log2_width(4000)
    parts = [b for x in np.array_split(v, 7) for b in sketch.parts(x, bits)]
    rows = [tuple(r.values()) for b in parts for r in b.to_pylist()]
    repeated = sketch.merge(spark.createDataFrame(rows, sketch.PARTS), bits)
    assert repeated(v[:500]).all()
    assert repeated(v[500:5000]).mean() < 0.5


def test_empty_tables(nothing):
    assert substring_dedup(nothing).count() == 0
    assert jaccard_join(nothing).count() == 0
    assert suffix_dedup(nothing).count() == 0
    assert substring_dedup(nothing.withColumn("text", F.lit(None).cast("string"))).count() == 0
