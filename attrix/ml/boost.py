"""Boosted regression trees whose cost does not grow with rows times trees.

MLlib passes over all rows several times a tree.  A tree sees a row only through its bins
(at most 32 a feature), and squared loss sees the labels of rows of equal bins only through
their number and mean; so such rows are one weighted entry, at most 32 ^ features of them,
and MLlib boosts on these: the same gains, splits and leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.functions.quantiles import _at, _sketch
from attrix.ml.forest import BINS, counted_thresholds
from attrix.session import spread, stash

#: Features of more values than these take quantiles of a sketch of all rows as borders, others
#: MLlib's rule on the counts of all values.
COUNTED = 10_000


def borders(cells: DataFrame, rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Borders of each feature; ``cells``: the ``rows`` with equal ones as one of weight ``w``."""
    many = cells.agg(*[F.approx_count_distinct(c).alias(c) for c in features]).first()
    few = [c for c in features if many[c] <= COUNTED]
    wide = [c for c in features if many[c] > COUNTED]
    out = {}
    if few:
        values = cells.select("w", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in few])).alias("x"))
        counts: dict = {c: [] for c in few}
        for r in values.groupBy("x.f", "x.v").agg(F.sum("w").alias("n")).collect():  # about COUNTED a feature at most
            counts[r["f"]].append((r["v"], r["n"]))
        out = {c: counted_thresholds(*(np.array(x, float) for x in zip(*sorted(counts[c]))), bins) for c in few}
    if wide:
        ranks = [i / bins for i in range(1, bins)]
        got = rows.agg(*[_sketch(F.col(c)).alias(c) for c in wide]).select(*[_at(F.col(c), ranks).alias(c) for c in wide]).first()
        out |= {c: np.unique(np.array(got[c], float)) for c in wide}
    return [out[c] for c in features]


def _code(x: Column, t: np.ndarray, lo: int, hi: int) -> Column:
    """How many borders lie below ``x``: ``lo`` and those of ``t[lo:hi]``, by halving."""
    if lo == hi:
        return F.lit(float(lo))
    mid = (lo + hi) // 2
    return F.when(x <= F.lit(float(t[mid])), _code(x, t, lo, mid)).otherwise(_code(x, t, mid + 1, hi))


@dataclass
class Boosted:
    """A fitted model; its trees split the numbers of bins."""

    model: GBTRegressionModel
    borders: list
    features: list

    def _bins(self, df: DataFrame, keep: list[str]) -> DataFrame:
        coded = [_code(F.col(c), t, 0, len(t)).alias(c) for c, t in zip(self.features, self.borders)]
        return df.select(*keep, *coded)

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``prediction``; the features are doubles."""
        x = VectorAssembler(inputCols=self.features, outputCol="_x").transform(self._bins(df, keep))
        return self.model.transform(x).select(*keep, "prediction")

    def importances(self) -> np.ndarray:
        return self.model.featureImportances.toArray()


def fit(rows: DataFrame, features: list[str], label: str, rounds: int, step: float, depth: int, seed: int) -> Boosted:
    """Least-squares boosting of ``rows`` (doubles, no nulls)."""
    cells = stash(rows.groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum(label).alias("_sum")), "boost")
    n = int(cells.agg(F.sum("w")).first()[0])
    out = Boosted(None, borders(cells, rows, features, min(BINS, n)), list(features))
    entries = (out._bins(cells, ["w", "_sum"]).groupBy(*features)
               .agg(F.sum("w").alias("w"), (F.sum("_sum") / F.sum("w")).alias("_mean")))
    x = VectorAssembler(inputCols=features, outputCol="_x").transform(spread(stash(entries, "boost-bins")))
    x = x.select("_x", "_mean", "w").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # MLlib samples what exceeds max_bins ^ 2 entries for its borders; here the bins are set
        most = max(BINS, math.isqrt(x.count()) + 1)
        out.model = GBTRegressor(featuresCol="_x", labelCol="_mean", weightCol="w", maxIter=rounds, stepSize=step, maxDepth=depth,
                                 maxBins=most, seed=seed, checkpointInterval=10).fit(x)
    finally:
        x.unpersist()
    return out
