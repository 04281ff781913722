"""Shapiro–Wilk normality test (Royston 1992/1995, published algorithm).

W = (Σ aᵢ x₍ᵢ₎)² / Σ (x − x̄)², aᵢ built from the expected normal scores
mᵢ = Φ⁻¹((i − 3/8)/(n + 1/4)) with Royston's corrections on the two most
extreme coefficients at each end.

Distributed plan (no global sort into one task):

1. ``groupBy(x).count()`` — ties collapse, map-side combined; written once, and
   all that follows reads the distinct values.
2. Global ranks: distinct values are bucketed by their approximate quantiles
   (a bounded array of boundaries, searched by halving); bucket
   totals (≤ ``buckets`` rows) give the bucket offsets; a window
   partitioned by bucket gives the running count inside each bucket.
3. Each distinct value covers ranks ``lo+1 … hi``; Σ mᵢ over the range is
   summed exactly (``explode(sequence)``) for runs of ≤ ``exact_run``
   ties, and by the closed-form integral of Φ⁻¹ (``−φ(Φ⁻¹(p))``) for
   longer runs — so a value holding a third of all rows costs O(1).
4. Σ mᵢ² comes from ``spark.range(n)`` (distributed), the four extreme
   values from two bounded top-2 queries.
5. The p-value needs Φ of one number and is computed on the driver.

Φ⁻¹ is Acklam's rational approximation (relative error < 1.2e-9) written
as Spark expressions, so the per-row work stays in generated code.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.session import partitions_for, stash

# ---------------------------------------------------------------------------
# Fixed published constants.
# Acklam's inverse-normal rational approximation.
# ---------------------------------------------------------------------------
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]
P_LOW = 0.02425
# Royston's polynomial corrections for a_n and a_(n-1), and p-value fits.
C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
G_SMALL = [-2.273, 0.459]
C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
C4 = [1.3822, -0.77857, 0.062767, -2.0322e-3]
C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
C6 = [-0.4803, -0.082676, 0.0030302]


def _poly(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Φ⁻¹(p) for 0 < p < 1 as a Spark expression."""
    q_lo = F.sqrt(-2.0 * F.log(p))
    q_hi = F.sqrt(-2.0 * F.log(1.0 - p))
    q = p - 0.5
    r = q * q
    low = _poly(_C, q_lo) / (_poly(_D, q_lo) * q_lo + 1.0)
    high = -_poly(_C, q_hi) / (_poly(_D, q_hi) * q_hi + 1.0)
    central = _poly(_A, r) * q / (_poly(_B, r) * r + 1.0)
    return F.when(p < P_LOW, low).when(p > 1 - P_LOW, high).otherwise(central)


def _py_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _poly_py(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(df: DataFrame, column: str, buckets: int = 256, exact_run: int = 64) -> DataFrame:
    """One row: ``column, n, W, p_value, is_normal (p > 0.05), explanation,
    p_reliable (n ≤ 5000)``; n < 3 → W and p are NULL."""
    spark: SparkSession = df.sparkSession
    x = F.col(column).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, mean, var_pop = vals.agg(F.count(F.lit(1)), F.avg("x"), F.var_pop("x")).first()
    if n < 3:
        return _row(spark, column, n, None, None)
    nn = float(n)
    # Σ m_i² over i = 1..n, distributed
    mi = norm_ppf((F.col("id").cast("double") - 0.375) / (nn + 0.25))
    mm = spark.range(1, n + 1).agg(F.sum(mi * mi)).first()[0]
    g = stash(vals.groupBy("x").agg(F.count(F.lit(1)).alias("c")), "ties")
    # extremes (bounded top-2 at each end)
    lo2 = [r[0] for r in g.orderBy("x").limit(2).collect() for _ in range(min(r[1], 2))][:2]
    hi2 = [r[0] for r in g.orderBy(F.col("x").desc()).limit(2).collect() for _ in range(min(r[1], 2))][:2]
    m_n = _py_ppf((nn - 0.375) / (nn + 0.25))
    m_n1 = _py_ppf((nn - 1.375) / (nn + 0.25))
    u = 1.0 / math.sqrt(nn)
    a_n = m_n / math.sqrt(mm) + _poly_py(C1, u) if n > 3 else math.sqrt(0.5)
    if n > 5:
        a_n1 = m_n1 / math.sqrt(mm) + _poly_py(C2, u)
        phi = (mm - 2 * m_n ** 2 - 2 * m_n1 ** 2) / (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)
    else:
        a_n1 = None
        phi = (mm - 2 * m_n ** 2) / (1 - 2 * a_n ** 2) if n > 3 else None

    if n == 3:
        num = math.sqrt(0.5) * (hi2[0] - lo2[0])
    else:
        # Σ m_i x_(i) over all ranks, distributed
        probs = [i / buckets for i in range(1, buckets)]
        bounds = g.agg(F.percentile_approx("x", probs, 16 * buckets)).first()[0]
        splits = sorted({-math.inf, 0.0, math.inf, *bounds})  # any cuts will do
        ranked = Bucketizer(splits=splits, inputCol="x", outputCol="bucket", handleInvalid="keep").transform(g)
        boff = ranked.groupBy("bucket").agg(F.sum("c").alias("bc")).select("bucket", F.sum("bc").over(
            Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("boff"))   # ≤ buckets rows
        win = Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        lo = F.coalesce("boff", F.lit(0)) + F.coalesce("inb", F.lit(0))
        ranked = (ranked.repartition(partitions_for(n, cap=buckets), "bucket").withColumn("inb", F.sum("c").over(win)).join(F.broadcast(boff), "bucket")
                  .select("x", "c", lo.alias("lo"), (lo + F.col("c")).alias("hi")))
        each = F.explode(F.when(F.col("c") <= exact_run, F.sequence(F.col("lo") + 1, F.col("hi"))).otherwise(
            F.array(F.lit(None).cast("long"))))
        pa = (F.col("lo").cast("double") + 0.125) / (nn + 0.25)
        pb = (F.col("hi").cast("double") + 0.125) / (nn + 0.25)
        dens = lambda p: F.exp(-0.5 * norm_ppf(p) * norm_ppf(p)) / math.sqrt(2 * math.pi)
        rank = norm_ppf((F.col("i").cast("double") - 0.375) / (nn + 0.25))
        s_mx = ranked.select("*", each.alias("i")).agg(F.sum(F.col("x") * F.when(F.col("i").isNotNull(), rank).otherwise(
            (nn + 0.25) * (dens(pa) - dens(pb))))).first()[0]
        inv = 1.0 / math.sqrt(phi)
        num = s_mx * inv
        # replace the coefficients at the extreme ranks
        x1, x2 = lo2[0], lo2[1]
        xn, xn1 = hi2[0], hi2[1]
        num += (a_n - m_n * inv) * xn + (-a_n + m_n * inv) * x1
        if a_n1 is not None:
            num += (a_n1 - m_n1 * inv) * xn1 + (-a_n1 + m_n1 * inv) * x2
    ss = var_pop * nn
    if ss <= 0:
        return _row(spark, column, n, None, None)
    w = min(1.0, num * num / ss)
    return _row(spark, column, n, w, _p_value(w, n))


def _p_value(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, (6.0 / math.pi) * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    one_minus = max(1.0 - w, 1e-300)
    if n <= 11:
        gamma = _poly_py(G_SMALL, n)
        if gamma - math.log(one_minus) <= 0:
            return 0.0
        y = -math.log(gamma - math.log(one_minus))
        mu = _poly_py(C3, n)
        sigma = math.exp(_poly_py(C4, n))
    else:
        ln = math.log(n)
        y = math.log(one_minus)
        mu = _poly_py(C5, ln)
        sigma = math.exp(_poly_py(C6, ln))
    return 1.0 - NormalDist().cdf((y - mu) / sigma)


def _row(spark, column, n, w, p):
    normal = None if p is None else bool(p > 0.05)
    expl = None if p is None else ("approximately normal" if normal else "deviates from normal")
    return spark.createDataFrame(
        [(column, int(n), w, p, normal, expl, bool(n <= 5000))],
        "column string, n long, W double, p_value double, is_normal boolean, "
        "explanation string, p_reliable boolean")
