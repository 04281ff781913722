"""Quality, toxicity, language model, decontamination, mixing, fingerprints and
licences: brute force, held-out accuracy, and odd rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from attrix.llm.decontaminate import Items, best_alignment, contamination
from attrix.llm.fingerprints import HASH_BITS, K, PLACE_BITS, SLOTS, edit_probe
from attrix.llm.licenses import BAR, TEMPLATES, license_scan, own_licenses
from attrix.llm.mixing import mix_sources
from attrix.llm.ppm import Trie, context_keys, entry_key, score_ppm
from attrix.llm.quality import filter_quality, pool_adjacent, score_quality
from attrix.llm.queries import part_of
from attrix.llm.text import PLAIN, Words
from attrix.llm.toxicity import score_toxicity
from tests.conftest import SF01
from tests.llm.conftest import WORDS, key, prose


def tables(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def accuracy(scored, labels, column, held, bar):
    got = scored.where(held).join(labels.select("doc_id", column), "doc_id").select("score", column).collect()
    return np.mean([(r["score"] >= bar) == bool(r[column]) for r in got])


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    held = part_of(4) == 2
    out = score_quality(docs, labels, learn=~held)
    assert out.count() == docs.count()
    assert accuracy(out, labels, "quality", held, 0.7) >= 0.95


def test_quality_odd_rows(spark, messy, nothing, rows):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 5), (1, 0), (7, 0)], "doc_id long, quality int")
    out = score_quality(messy, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    blank = {r["score"] for r in out if r["doc_id"] in (40, 41)}
    assert len(blank) == 1
    none = labels.where("doc_id > 99")
    assert {r["score"] for r in score_quality(messy, none).collect()} == {0.5}
    assert score_quality(nothing, labels).count() == 0
    assert filter_quality(messy, none, 0.4, ["doc_id", "text", "key"]).count() == len(rows)


def test_isotonic_is_monotone():
    fit = pool_adjacent(np.array([0, 3, 1, 4, 2.0]), np.array([5, 5, 5, 5, 2.0]))
    assert (np.diff(fit) >= 0).all() and np.isclose(fit @ [5, 5, 5, 5, 2], 10)


def test_toxicity_held_out_and_gapped(spark):
    docs, labels = tables(spark)
    held = part_of(5) == 0
    extra = [(10_001, "The of and i.d.i.o.t in here"), (10_002, "the of s t u p i d and nt"), (10_003, "IDIOOT of the of and"),
             (10_004, "of the and that was for this."), (10_005, None), (10_006, "!!!")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    out = score_toxicity(both, labels, learn=~held).cache()
    assert accuracy(out, labels, "toxic", held, 0.5) >= 0.9
    score = {r["doc_id"]: r["score"] for r in out.where("doc_id > 10000").collect()}
    assert min(score[10_001], score[10_002], score[10_003]) > 2 * score[10_004]
    assert score[10_005] == score[10_006]


def test_toxicity_odd_rows(spark, messy, nothing, rows):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 5), (1, 0), (7, 0)], "doc_id long, toxic int")
    assert score_toxicity(messy, labels).count() == len(rows)
    assert {r["score"] for r in score_toxicity(messy, labels.where("doc_id > 99")).collect()} == {0.5}
    assert score_toxicity(nothing, labels).count() == 0


def test_ppm_probabilities_sum_to_one():
    rng = random.Random(3)
    seen = collections.Counter()
    for _ in range(300):
        unit = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) + rng.choice([b" ", b"\xff"])
        symbol = np.frombuffer(unit, np.uint8)
        for context, use in context_keys(np.arange(len(unit)), symbol):
            seen.update(entry_key(context[use], symbol[use]).tolist())
    trie = Trie(np.array(list(seen), np.uint64), np.array(list(seen.values())))
    for before in (b"", b"a", b"zab", b"abcabca", b"q"):
        total = 0.0
        for x in range(256):
            symbol = np.frombuffer(before + bytes([x]), np.uint8)
            total += 10 ** trie.log10(np.arange(len(symbol)), symbol)[-1]
        assert np.isclose(total, 1)


def test_ppm_counts_and_base(messy, nothing, rows):
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    got = score_ppm(messy, learn=learn).collect()
    c = collections.Counter()
    for d, t, *_ in rows:
        if d is not None and d % 2 == 0:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)

    def expect(d, t):
        tokens = [*(t or "").encode().lower().split(), None]
        return (d, len(tokens), sum(c[w] > 0 for w in tokens), n,
                round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), 6))

    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got),
                  key=key) == sorted((expect(d, t) for d, t, *_ in rows), key=key)
    assert all(r["score"] < 0 for r in got)
    known = score_ppm(messy).where("doc_id = 1").first()["score"]
    assert known > score_ppm(messy, learn=F.lit(False)).where("doc_id = 1").first()["score"]
    assert score_ppm(nothing).count() == 0


def levenshtein_part(item, text):
    best = list(range(len(item) + 1))
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    del best
    return min(row)


def test_alignment_is_exact():
    rng = random.Random(2)
    for _ in range(100):
        item = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 12))], np.uint64)
        text = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 25))], np.uint64)
        edits, lo, hi = best_alignment(item, text)
        assert edits == levenshtein_part(item.tolist(), text.tolist())
        assert 0 <= lo <= hi <= len(text)


def test_contamination_recall(spark, messy, nothing):
    rng = random.Random(4)
    bench = [(i, prose(rng, rng.randint(14, 50))) for i in range(40)] + [(99, None), (98, ""), (97, " . ")]
    docs, want = [], {}
    for i, (item, text) in enumerate(bench[:40]):
        w = text.split()
        for _ in range(int(0.1 * len(w))):
            j = rng.randrange(len(w))
            w[j:j + 1] = rng.choice([[], ["other"], [w[j], "added"]])
        edited = " ".join(x.upper() + "," if rng.random() < 0.2 else x for x in w)
        docs += [(3 * i, f"{prose(rng, 80)} {text} {prose(rng, 9)}"), (3 * i + 1, f"{prose(rng, 50)} {edited}"),
                 (3 * i + 2, prose(rng, 200))]
        want[3 * i] = want[3 * i + 1] = item
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in
           contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    found = [item in got[d] for d, item in want.items()]
    assert np.mean(found) >= 0.97
    assert not any(got[3 * i + 2] for i in range(40))
    assert contamination(messy, items, carry=("key",), with_text=True).count() == messy.count()
    assert contamination(nothing, items).count() == 0
    assert contamination(messy, items.limit(0)).where("size(hits) > 0").count() == 0


@pytest.mark.parametrize("size", [15, 50, 80, 150, 300])
def test_contamination_recall_at_full_share(size):
    rng = random.Random(size)
    k, trials = int(0.2 * size), 40
    items, texts = [], []
    kinds = ("swap", "add", "drop", "swap front", "swap back", "swap ends", "drop ends")
    ends = [*range(k // 2), *range(size - (k - k // 2), size)]
    for kind in kinds:
        for _ in range(trials):
            item = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
            w = list(item)
            spots = {"swap front": range(k), "swap back": range(size - k, size), "swap ends": ends, "drop ends": ends}.get(
                kind, rng.sample(range(size), k))
            for j in sorted(spots, reverse=True):
                w[j:j + 1] = {"drop": [], "drop ends": [], "add": ["new", w[j]]}.get(kind, [f"x{rng.randrange(10 ** 6)}"])
            items.append(" ".join(item))
            texts.append(" ".join([prose(rng, 2 * size), *w, prose(rng, size)]).encode())
    search = Items(list(range(len(items))), [i.encode() for i in items], 0.2, 0.99)
    got = search.search(Words(pa.record_batch([pa.array(texts, pa.binary())], names=["text"]), table=PLAIN))
    found = np.array([any(h["item_id"] == i for h in got.get(i, [])) for i in range(len(items))])
    assert found.reshape(len(kinds), trials).mean(1).min() >= 0.95, found.reshape(len(kinds), trials).mean(1)


def test_mixing(messy, nothing, rows):
    got = mix_sources(messy).collect()
    size = collections.Counter()
    for d, t, lang, s, *_ in rows:
        size[s] += len((t or "").encode().split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:  # share, cap, share the excess again
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        heft = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / heft for s in names}
        over = {s for s in names if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in names)
    again = mix_sources(messy.repartition(5)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert mix_sources(nothing).count() == 0


def order_minhash(text):
    """The fingerprint, written out one k-mer at a time."""
    words = (text or "").encode().split()
    grams = [words[i:i + K] for i in range(len(words) - K + 1)] or ([words] if words else [])

    def chain(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v, seed=h)
        return h

    times, least = collections.Counter(), {}
    for place, gram in enumerate(grams):
        h = chain(gram) >> (64 - HASH_BITS)
        nth = times[h]
        times[h] += 1
        v = chain([h.to_bytes(8, "little"), nth.to_bytes(4, "little")]) >> (64 - HASH_BITS)
        packed = (v << PLACE_BITS) | place
        slot = v >> (HASH_BITS - 6)
        least[slot] = min(least.get(slot, packed), packed)
    out = []
    for j in range(SLOTS):
        both = sorted((x for x in (least.get(j), least.get((j + 1) % SLOTS)) if x is not None),
                      key=lambda x: x & ((1 << PLACE_BITS) - 1))
        out.append("%08x" % (chain([(x >> PLACE_BITS).to_bytes(8, "little") for x in both]) & 0xFFFFFFFF) if both else "-" * 8)
    return "".join(out)


def test_fingerprints(messy, nothing, rows):
    got = edit_probe(messy).collect()
    line = sorted(((d, t) for d, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(line):
        a, b = t or "", line[(i + 1) % len(line)][1] or ""
        e = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        fa, fe, fb = order_minhash(a), order_minhash(e), order_minhash(b)

        def like(x, y):
            pairs = [(x[j:j + 8], y[j:j + 8]) for j in range(0, len(x), 8)]
            used = [p for p in pairs if p != ("-" * 8, "-" * 8)]
            return sum(p == q for p, q in used) / len(used) if used else 1.0

        want.append((d, hashlib.sha256(e.encode()).hexdigest(), fa, fe, like(fa, fe), like(fa, fb)))
    seen = [(r["doc_id"], hashlib.sha256(r["edited"].encode()).hexdigest(), r["fingerprint"], r["edited_fingerprint"],
             r["near_edited"], r["near_next"]) for r in got]
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert edit_probe(nothing).count() == 0


def test_licenses(spark, nothing):
    word = dict((n, t) for n, t in reversed(TEMPLATES))
    files = [(1, "a/LICENSE", word["MIT"]), (2, "a/b/x.txt", "no word"), (3, "a/b/c/y.txt", "code\n" + word["GPL-3.0"]),
             (4, "a/b/c/z.txt", None), (5, "a/b/c/COPYING", "Copyright.\n" + word["Apache-2.0"] + "\nend"),
             (6, "top.txt", ""), (7, None, "x"), (8, "q/r.txt", " ".join(WORDS * 30) + " " + word["CC-BY-NC-4.0"]),
             (9, "q/s.txt", "x"), (9, "q/s.txt", "x"), (10, "a/bb/t.txt", "licensed thing under version")]
    df = spark.createDataFrame([(*f, 1, "z") for f in files], "doc_id long, path string, text string, dir long, license string")
    got = sorted({(r["doc_id"], r["license"], r["origin"], r["from_path"]) for r in license_scan(df).collect()})
    assert got == [(1, "MIT", "own", "a/LICENSE"), (2, "MIT", "inherited", "a/LICENSE"),
                   (3, "GPL-3.0", "own", "a/b/c/y.txt"), (4, "Apache-2.0", "inherited", "a/b/c/COPYING"),
                   (5, "Apache-2.0", "own", "a/b/c/COPYING"), (6, None, None, None), (7, None, None, None),
                   (8, "CC-BY-NC-4.0", "own", "q/r.txt"), (9, None, None, None), (10, "MIT", "inherited", "a/LICENSE")]
    assert license_scan(df).count() == len(files)
    assert all(r["score"] is None or BAR <= r["score"] <= 1 for r in license_scan(df).collect())
    assert license_scan(nothing.withColumn("path", F.col("text"))).count() == 0


def brute_ppm(texts, learnt):
    """log10 probability of each text by the trie of all contexts, none dropped."""
    def symbols(text):
        return np.frombuffer(b" ".join((text or "").encode().lower().split()) + b"\xff", np.uint8)

    seen = collections.Counter()
    for text in learnt:
        symbol = symbols(text)
        for context, use in context_keys(np.arange(len(symbol)), symbol):
            seen.update(entry_key(context[use], symbol[use]).tolist())
    trie = Trie(np.array(list(seen), np.uint64), np.array(list(seen.values())))
    return [trie.log10(np.arange(len(s)), s).sum() for s in map(symbols, texts)]


def test_ppm_drops_no_entry(messy, rows, monkeypatch):
    monkeypatch.setattr("attrix.llm.ppm.MAX_GRAMS", 50)
    even = [t for d, t, *_ in rows if d is not None and d % 2 == 0]
    want = brute_ppm([t for _, t, *_ in rows], even)
    got = score_ppm(messy, learn=F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).collect()
    assert sorted(((r["doc_id"], round(r["score"], 4)) for r in got), key=key) == sorted(
        ((d, round(s, 4)) for (d, *_), s in zip(rows, want)), key=key)


def test_ppm_score_follows_word_order(spark):
    line = "every morning the old baker carries warm bread across the frozen river to market"
    words = line.split()
    mixed = " ".join(words[1:-1][::-1] + words[:1] + words[-1:])  # the same words, the same last
    docs = spark.createDataFrame([(i, line) for i in range(20)] + [(90, line), (91, mixed)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in score_ppm(docs, learn=F.col("doc_id") < 90).where("doc_id >= 90").collect()}
    assert score[90] > score[91] + 5


def test_license_siblings(spark):
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    notice = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU {}General "
              "Public License as published by the Free Software Foundation; either version {} of the License, or (at your "
              "option) any later version.")
    cases = [("GPL-2.0", gnu.format("", 2)), ("GPL-3.0", gnu.format("", 3)), ("LGPL-3.0", gnu.format("Lesser ", 3)),
             ("AGPL-3.0", gnu.format("Affero ", 3)), ("LGPL-2.1", notice.format("Lesser ", "2.1")),
             ("LGPL-2.0", notice.format("Library ", 2)), ("GPL-2.0", notice.format("", 2)), (None, gnu.format("", 7)),
             ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
             ("CC-BY-ND-3.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 License."),
             ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
             (None, "Redistribution and use in source and binary forms, with or without modification, are permitted")]
    cases += TEMPLATES
    docs = spark.createDataFrame([(i, "x", f"Some Words\n{t}\nmore words") for i, (_, t) in enumerate(cases)] + [
        (1000 + i, "x", "plain words " * 9) for i in range(300)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in own_licenses(docs).collect()}
    assert [(got[i], t) for i, (_, t) in enumerate(cases)] == [(n, t) for n, t in cases]
    assert not any(got[1000 + i] for i in range(300))
