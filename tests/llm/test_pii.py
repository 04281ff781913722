"""Personal data against a plain Python twin."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from attrix.llm import pii as P
from tests.llm.conftest import COLUMNS, key, prose

# the contract's patterns, as given
RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TERM = re.compile(r"[^\W_]+")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(text):
    out = [(m.start(), n, m.end(), m[0]) for n, k in enumerate(RAW) for m in re.finditer(RAW[k], text) if passes(k, m[0])]
    return sorted(out)


def words(text):
    return [w for w in (m[0].lower() for m in TERM.finditer(text)) if len(w) >= P.LEAST]


def brute(texts):
    """Spans of every text and the disclosing terms."""
    contexts, counts = collections.Counter(), collections.Counter()
    for t in texts:
        counts.update(words(t))
        for kind, pattern in RAW.items():
            at, gaps, found = 0, [], []
            for m in re.finditer(pattern, t):
                gaps.append(t[at:m.start()])
                found.append(m[0])
                at = m.end()
            gaps.append(t[at:])
            for i, m in enumerate(found):
                if passes(kind, m):
                    e = f"{kind}:" + (re.sub("[^0-9]", "", m) if kind in ("card", "phone") else m.lower())
                    contexts[e, tuple(words(gaps[i])[-P.WIDTH:]), tuple(words(gaps[i + 1])[:P.WIDTH])] += 1
    n_te, seen, n_e, times, alike = (collections.Counter() for _ in range(5))
    for e, b, a in contexts:
        times.update((e, w) for w in set(b + a))
    for (e, b, a), n in contexts.items():
        n_e[e] += n
        own = set(b + a)
        apart = 4 * sum(times[e, w] == 1 for w in own) >= len(own)
        for w in own:
            n_te[e, w] += n
            seen[e, w] += apart
            alike[e, w] |= not apart
    seen += alike
    total = sum(counts.values())
    stem_te, stem_t = collections.Counter(), collections.Counter()
    for (e, w), n in n_te.items():
        stem_te[e, w[:P.STEM]] += n
    for w, n in counts.items():
        stem_t[w[:P.STEM]] += n

    def share(te, t, e):
        info = math.log(total / n_e[e])
        return 1 - math.log(max(1, t / te)) / info if info > 0 else -1

    marked = {}
    for (e, w), n in n_te.items():
        if seen[e, w] >= P.SUPPORT and share(n, counts[w], e) >= P.SHARE:
            s = w[:P.STEM]
            gone = share(stem_te[e, s], stem_t[s], e) >= P.SHARE or len(w) <= P.STEM
            marked[w] = max(marked.get(w, 0), 5 if gone else 4)
    spans = []
    for t in texts:
        own = base(t)
        more = [(m.start(), marked[m[0].lower()], m.end(), m[0]) for m in TERM.finditer(t) if m[0].lower() in marked]
        spans.append((own, sorted(own + [x for x in more if all(x[2] <= s or x[0] >= e for s, _, e, _ in own)])))
    return spans, marked


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = []
    for i in range(60):  # one address, a name beside it that stands nowhere else
        t = prose(rng, rng.randint(5, 40))
        if i % 6 == 0:
            t += f" {rng.choice('abc')}x Zoltanova Verylongname write to zv.{i % 2}@mail.example.com or +1 (499) 555-650{i % 3} "
            t += " ".join(f"v{rng.randint(0, 300)}o" for _ in range(12))
        if i % 6 == 3:  # near copies: one context, whatever stands in them
            t = f"copied {i} text of Samename here sn@mail.example.com and no more"
        if i % 15 == 1:
            t += " Verylotus verygood very common"
        out.append(t)
    out += [out[0]] * 5 + [
        "", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559", "a@b.c_x@d.e a@b@c.d .@-.- é@é.e éabc@x.y",
        "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.000 1.2.3 9999999999999999999999.1.1.1", "+1 555 +12 (3) 45-67-89 0 +123456789012345 +1234567890123456",
        "🙂🙂 mail é.z@b.de 🙂 10.0.0.1", "1" * 3000, "a" * 3000 + "@x.yz", "1 " * 900, "a.b@c.d " * 700, "+4111 1111 1111 1111", "10.0.0.1" * 40,
        "x" * 20_000 + " " + "7." * 5000, "+1" + "-" * 4000, "Zoltanova alone, far from it"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t), 1, 2, 0.5, "r") for i, t in enumerate(texts)] + [(None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


def test_against_brute_force(docs, texts):
    rows, marked = P.personal_data(docs)
    want, terms = brute([*texts, ""])
    got = {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in rows.collect()}
    assert len(got) == len(texts) + 1 and got[None] == ([], [])
    for i, (b, s) in enumerate(want[:-1]):
        assert got[i][0] == b, texts[i][:80]
        assert got[i][1] == s, texts[i][:80]
    assert {r["term"]: r["kind"] for r in marked.collect()} == terms
    assert "zoltanova" in terms and "samename" not in terms and any(k == 4 for k in terms.values()) and any(k == 5 for k in terms.values())


def test_sanitise(docs, texts):
    spans, _ = brute([*texts, ""])
    got = {r["doc_id"]: r["sanitised"] for r in P.sanitise(docs).collect()}
    tags = [f"[{k}]" for k in P.BASE]
    for i, (_, s) in enumerate(spans[:-1]):
        out, past = "", 0
        for a, k, b, v in s:
            out += texts[i][past:a] + (tags[k] if k < 4 else v[:P.STEM] + "*" if k == 4 else "[...]")
            past = max(past, b)
        assert got[i] == out + texts[i][past:], texts[i][:80]


def test_no_python_on_the_path(spark, docs):
    rows, _ = P.personal_data(docs)
    plan = rows._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "InPandas" not in plan and "ArrowEval" not in plan and "BatchEval" not in plan


def test_nothing_and_columns(spark, nothing, messy):
    rows, marked = P.personal_data(nothing)
    assert rows.count() == 0 and marked.count() == 0
    rows, _ = P.personal_data(messy)
    assert rows.count() == messy.count()
    assert {len(r["base"]) for r in rows.collect()} == {0}


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000, 3000)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<bigint>").withColumn("b", P.running("x")).withColumn("y", P.joined("b"))
    df = df.withColumn("c", P.running("x", F.greatest)).withColumn("z", P.joined("c", F.greatest))
    for r in df.collect():
        assert r["y"] == [sum(r["x"][:i + 1]) for i in range(len(r["x"]))]
        assert r["z"] == [max(r["x"][:i + 1]) for i in range(len(r["x"]))]
    assert key((1,)) and hashlib.sha256(b"").hexdigest()
