import random

import pytest

WORDS = [a + b for a in "ba ke li mo nu ri sa te vo zu".split() for b in "d l n r s t m k".split()]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, score double, row string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def messy_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    passage = prose(rng, 45)
    out = []
    for i, t in enumerate(texts):
        if i % 4 == 1:
            t = texts[i - 1]
        if i % 4 == 2:
            w = texts[i - 2].split() or ["x"]
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 5 == 0:
            t = t + "\n" + passage + " " + prose(rng, 5)
        out.append((i, t, "en", f"s{i % 3}"))
    out += [(40, None, None, None), (41, "", "en", "s1"), (42, " \t\n", None, "s0"), (None, texts[0], "en", None),
            (None, None, None, None), (3, texts[3], "en", "s0"), (3, texts[3], "en", "s0"), (4, "other text here", "de", "s1"),
            (50, prose(rng, 30_000), "en", "s2"), (51, "the " * 60, "en", "s2"), (52, "a b c", "en", "s2"),
            (53, "A  b\tC", "en", "s2"), (54, "x" * 5000, "fr", "s0"), (-7, passage, "en", "s1"), (55, "é" * 300, "fr", "s1")]
    return [(d, t, lg, s, None if t is None else len(t), 1, 2, 0.5, "r") for d, t, lg, s in out]


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def key(row):
    return tuple((v is not None, v) for v in row)
