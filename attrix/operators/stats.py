"""Descriptive statistics (two jobs for all columns, one row per column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.functions.exprs import sample_kurtosis, sample_skewness
from attrix.functions.quantiles import exact_quantiles

DESCRIBE_FIELDS = ["count", "mean", "median", "std", "min", "max", "q25", "q75", "skew",
                   "kurtosis", "cv"]


def describe(df: DataFrame, columns: list[str], exact: bool = True,
             accuracy: int = 10000) -> DataFrame:
    """Eleven statistics per column, one row per column:

    count, mean, median, std (n−1), min, max, q25, q75 (linear
    interpolation), skew (bias-adjusted G1), kurtosis (bias-adjusted excess
    G2), cv = std/mean (NULL when mean is 0).

    Moments are algebraic and combine map-side; they ride along with the
    quantile bracketing aggregate of :func:`exact_quantiles`, so the whole
    table is two jobs and no task ever holds a column's distinct values.
    ``exact=False`` returns the sketch quantiles directly (one job)."""
    spark = df.sparkSession
    moments = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        n = F.count(x)
        moments += [
            n.alias(f"cnt{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
            sample_skewness(x, n).alias(f"sk{i}"), sample_kurtosis(x, n).alias(f"ku{i}"),
        ]
    probs = [0.25, 0.5, 0.75]
    if exact:
        q, row = exact_quantiles(df, columns, probs, moments)
    else:
        row = df.agg(*moments, *[F.percentile_approx(
            F.col(c).cast("double"), probs, accuracy).alias(f"pa{i}")
            for i, c in enumerate(columns)]).first()
        q = {(c, p): (row[f"pa{i}"][j] if row[f"pa{i}"] else None)
             for i, c in enumerate(columns) for j, p in enumerate(probs)}
    out = []
    for i, c in enumerate(columns):
        mean, std = row[f"mean{i}"], row[f"std{i}"]
        cv = None if (std is None or mean is None or mean == 0) else std / mean
        out.append((c, row[f"cnt{i}"], mean, q[(c, 0.5)], std, row[f"min{i}"], row[f"max{i}"],
                    q[(c, 0.25)], q[(c, 0.75)], row[f"sk{i}"], row[f"ku{i}"], cv))
    schema = ("column string, count long, mean double, median double, std double, min double, "
              "max double, q25 double, q75 double, skew double, kurtosis double, cv double")
    return spark.createDataFrame(out, schema)
