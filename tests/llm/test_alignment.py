"""Cross-tokenizer alignment against one text, one pair at a time."""

import collections
import hashlib
import random

import numpy as np
import pytest

from attrix.llm import alignment as A
from tests.conftest import SF001
from tests.llm.conftest import COLUMNS, key

NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def vocabularies():
    return A.Vocabularies(*(open(f"{A.FOLDER}/{n}", "rb").read() for n in (A.FILE_A, A.FILE_B)))


def brute(v, rows):
    """``rows``: (doc_id, text)."""
    per, holds = [], collections.Counter()
    for d, t in rows:
        a = v.whole_a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = v.whole_b.encode(t) if t else []
        want = b" " + (t or "").encode()
        if b"".join(v.a[i] for i in a) != want or b"".join(v.b[i] for i in b) != want:
            a = b = []
        ends = []
        for ids, side in ((a, v.a), (b, v.b)):
            at, out = 0, []
            for i in ids:
                at += len(side[i])
                out.append(at)
            ends.append(out)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = [], []
            while i < len(a) and ends[0][i] <= cut:
                x.append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                y.append(b[j])
                j += 1
            groups.append((x, y))
        links = collections.Counter((p, q) for x, y in groups for p in x for q in y)
        holds.update(links.keys())
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        per.append((d, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    top = collections.Counter()
    for (p, _), n in holds.items():
        top[p] = max(top[p], n)
    out = [(d, na, nb, g, sum(ln.values()), sum(m for k, m in ln.items() if holds[k] == top[k[0]]),
            sum(m * holds[k] for k, m in ln.items()), sha) for d, na, nb, g, ln, sha in per]
    return sorted(out, key=key), {(*k, n, n == top[k[0]]) for k, n in holds.items()}


ODD = [(100, "日本語のテキスト 混ぜる"), (101, "a\u2581b"), (102, " two  spaces   here "), (103, "=" * 9000), (104, "<|endoftext|> </s> <s>"),
       (105, "emoji 🙂🙂 e\u0301"), (106, "\u0000x\r\n\ty"), (107, "ab" * 4000 + "  " * 900), (108, "'s don't I'LL 12345 ½ ²"), (109, "ʼn ǆ")]


def test_alignment(spark, rows, vocabularies):
    """Nulls, empty and long texts, repeated rows, texts that B does not give back;
    hot radixes dealt to several salts."""
    every = rows + [(d, t, "en", "s0", len(t), 1, 2, 0.5, "r") for d, t in ODD]
    docs = spark.createDataFrame(every, COLUMNS).repartition(3)
    want, want_pairs = brute(vocabularies, [(r[0], r[1]) for r in every])
    for group_bytes, radixes in ((A.GROUP, A.RADIXES), (300, 2)):
        out, pairs = A.cross_tokenizer_alignment(docs, radixes=radixes, group_bytes=group_bytes)
        assert out.columns == NAMES
        assert sorted((tuple(r) for r in out.collect()), key=key) == want
        assert {tuple(r) for r in pairs.collect()} == want_pairs


def test_chunks_and_frames(spark, rows, vocabularies, monkeypatch):
    docs = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    v, tab = vocabularies, A.tables(vocabularies)
    texts = [None if r[1] is None else r[1].encode() for r in rows]
    _, keys, times = A.align(v, tab, texts)
    monkeypatch.setattr(A, "FRAME", 7)
    monkeypatch.setattr(A, "WIDE", 2)
    _, keys2, times2 = A.align(v, tab, texts)
    assert (keys == keys2).all() and (times == times2).all()
    runs = [h for r, h, _ in A.to_runs(keys, times, 4) if r == 1] + [h for r, h, _ in A.to_runs(keys2, times2, 4) if r == 1]
    k, c = map(np.concatenate, zip(*A.merge(runs)))
    assert (np.diff(k) > 0).all() and (c % 2 == 0).all()
    assert docs.count() == len(rows)


def test_nothing(spark, nothing):
    out, pairs = A.cross_tokenizer_alignment(nothing)
    assert out.columns == NAMES and out.count() == 0 and pairs.count() == 0


def test_quick_ways_give_the_same_ids(spark, vocabularies):
    v, rng = vocabularies, random.Random(3)
    assert v.quick
    letters = [chr(c) for c in range(1, 0x250)]
    texts = [f"a{c}b {c}{c} 1{c}2 .{c}" for c in letters] + ["".join(rng.choices(letters, k=40)) for _ in range(500)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect() if r["text"]] + ["x" * 20_000, "=-" * 9000]
    for t in texts:
        got, b = v.encode(t), v.whole_b.encode(t)
        if b"".join(v.b[i] for i in b) != b" " + t.encode():
            assert got is None, t
        else:
            assert got[0].tolist() == v.whole_a.encode(" " + t, add_special_tokens=False).ids and got[1].tolist() == b
