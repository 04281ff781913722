"""Quality classifier: random Fourier features, ridge scores, isotonic
calibration.

Each text becomes a few statistics (shares of letters, capitals, digits,
symbols and spaces, word lengths, repeats).  Random Fourier features
approximate a Gaussian kernel over the standardised statistics; every task sums
its part of the normal equations, Spark adds the parts, and the driver solves
one system of fixed size.  Raw scores are calibrated by isotonic regression
(pool adjacent violators) over ``BINS`` score bins, counted by Spark.

Defined results: null and empty texts have all statistics zero and get the
score of such a text; a label that is null or not 0/1 is not learnt from;
several labels of one ``doc_id`` all count; with no usable label every score is
0.5.  Rows that share a ``doc_id`` are scored one by one.  Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.sums import float_lists, matrix, partition_sum
from attrix.llm.text import Words, chunks, id_and_text, map_arrow, record, stash

FEATURES, BINS, SEED = 192, 2000, 20_240_101
_CLASSES = np.zeros(256, np.int64)  # 0: other symbols
_CLASSES[0x61:0x7B] = 1
_CLASSES[0x41:0x5B] = 2
_CLASSES[0x30:0x3A] = 3
_CLASSES[0x80:] = 4
_CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 5
_CLASSES[0x0A] = 6
_CLASSES[[0x2E, 0x2C, 0x27, 0x2D, 0x3F, 0x3A, 0x3B]] = 7  # . , ' - ? : ;
_CLASSES[0x21] = 8  # !
_CLASSES[0x7C] = 9  # |
STATISTICS = 10 + 8


def statistics(batch) -> np.ndarray:
    """One row of statistics for each text of a chunk."""
    w, rows = Words(batch, lower=True), batch.num_rows
    size = np.diff(w.offsets)
    row = np.repeat(np.arange(rows), size)
    counts = np.bincount(row * 10 + _CLASSES[w.data], minlength=rows * 10).reshape(rows, 10)
    share = counts / np.maximum(size, 1)[:, None]
    n = np.maximum(w.lengths, 1)
    length = (w.end - w.begin).astype(float)

    def per_doc(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=rows)

    mean = per_doc(length, w.doc) / n
    spread = np.sqrt(np.maximum(0, per_doc(length ** 2, w.doc) / n - mean ** 2))
    order = np.lexsort((w.hashes, w.doc))
    h, d = w.hashes[order], w.doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][:len(h)]
    distinct = per_doc(new[new], d[new])
    again = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    twice = per_doc(again.astype(float), w.doc[1:])
    last = w.data[w.end - 1] if w.total else np.empty(0, np.uint8)
    odd_end = per_doc(np.isin(_CLASSES[last], [0, 8, 9]).astype(float), w.doc)
    return np.column_stack([
        share, np.log1p(size), np.log1p(w.lengths), mean / 10, spread / 10, distinct / n, twice / n, odd_end / n,
        np.log1p(counts[:, 6]) / 4,
    ])


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every whole text."""

    def run(batches):
        for b in chunks(batches):
            yield record(doc_id=b.column("doc_id"), x=float_lists(statistics(b)))

    return map_arrow(id_and_text(docs), run, "doc_id long, x array<float>")


def _lift(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w = rng.normal(scale=1 / np.sqrt(2 * STATISTICS / 3), size=(STATISTICS, FEATURES))
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / sd, -8, 8)
    return np.column_stack([np.cos(z @ w + shift) * np.sqrt(2 / FEATURES), np.ones(len(x))])


def pool_adjacent(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Isotonic (rising) fit of ``total/count``, one value for each bin."""
    blocks: list[list[float]] = []
    for t, c in zip(total, count):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, c, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + c, blocks[-1][2] + n]
    return np.concatenate([np.full(n, t / c) for t, c, n in blocks]) if blocks else np.empty(0)


def calibrated(raw: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Scores in 0..1 by interpolation between the calibrated bins."""
    return np.clip(np.interp(raw, at, value), 0, 1) if len(at) else np.full(len(raw), 0.5)


def isotonic(scored: DataFrame, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Calibration points from ``raw, y``: Spark counts labels by score bin."""
    step = (high - low) / BINS
    place = F.floor((F.least(F.greatest("raw", F.lit(low)), F.lit(high)) - low) / step)
    got = sorted(scored.groupBy(place.alias("bin")).agg(F.sum("y").alias("t"), F.count("*").alias("c")).collect())
    if not got:
        return np.empty(0), np.empty(0)
    return (np.array([low + (r["bin"] + 0.5) * step for r in got]),
            pool_adjacent(np.array([float(r["t"]) for r in got]), np.array([float(r["c"]) for r in got])))


def labelled(features: DataFrame, labels: DataFrame, column: str, learn: Column) -> DataFrame:
    """Rows to learn from, with label ``y``."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y"))
    return features.where(learn).join(y.where("y in (0, 1)"), "doc_id")


class QualityModel:
    """Fitted weights and calibration; scores chunks of texts."""

    def __init__(self, mean, sd, weight, at, value):
        self.mean, self.sd, self.weight, self.at, self.value = mean, sd, weight, at, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _lift(x, self.mean, self.sd) @ self.weight

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.raw(x), self.at, self.value)


def fit_quality(features: DataFrame, labels: DataFrame, learn: Column | None = None, ridge: float = 1.0) -> QualityModel:
    """Fit on ``text_statistics`` rows.  ``learn`` (over ``doc_id``) says which
    rows' labels may be used; all labelled rows that it admits are."""
    rows = stash(labelled(features, labels, "quality", F.lit(True) if learn is None else learn), "labelled")
    k = STATISTICS

    def moments(b):
        x = matrix(b, "x")
        return np.r_[len(x), x.sum(0), (x ** 2).sum(0)]

    m = partition_sum(features, moments, 2 * k + 1)
    mean = m[1:k + 1] / max(m[0], 1)
    sd = np.sqrt(np.maximum(m[k + 1:] / max(m[0], 1) - mean ** 2, 1e-8))
    d = FEATURES + 1

    def normal(b):
        z, y = _lift(matrix(b, "x"), mean, sd), b.column("y").to_numpy(zero_copy_only=False)
        return np.r_[(z.T @ z).ravel(), z.T @ y]

    sums = partition_sum(rows, normal, d * d + d)
    weight = np.linalg.solve(sums[:d * d].reshape(d, d) + ridge * np.eye(d), sums[d * d:])
    model = QualityModel(mean, sd, weight, np.empty(0), np.empty(0))

    def raw(batches):
        for b in batches:
            if b.num_rows:
                yield record(raw=model.raw(matrix(b, "x")), y=b.column("y"))

    model.at, model.value = isotonic(map_arrow(rows, raw, "raw double, y double"), -0.5, 1.5)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    features = stash(text_statistics(docs), "quality")
    model = fit_quality(features, labels, learn)

    def final(batches):
        for b in batches:
            if b.num_rows:
                yield record(doc_id=b.column("doc_id"), score=model(matrix(b, "x")))

    return map_arrow(features, final, "doc_id long, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, bar: float, columns: list[str]) -> DataFrame:
    """``columns`` (``text`` among them) of the rows that score ``bar`` or more;
    texts are scored where they are read and never shuffled."""
    model = fit_quality(stash(text_statistics(docs), "quality"), labels)
    rows = docs.select(*[F.col(c).cast("binary").alias(c) if c == "text" else F.col(c) for c in columns])

    def keep(batches):
        for b in chunks(batches):
            yield b.filter(pa.array(model(statistics(b)) >= bar))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_arrow(rows, keep, shape).withColumn("text", F.col("text").cast("string"))
