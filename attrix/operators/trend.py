"""Trend by dimension with a growth table (first vs last point per series).

The daily series is an aggregate (days × dimension values); the growth
table then needs only ``min_by`` / ``max_by`` over that aggregate — no
window, no sort of the raw data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.functions.exprs import safe_ratio_pct, sign_class
from attrix.functions.rank import with_row_number


def _d(date_col: str, grain: str):
    c = F.col(date_col)
    return F.to_date(c) if grain == "day" else c.cast("timestamp_ntz")


def trend_series(
    df: DataFrame, date_col: str, metric: str, dim: str | None = None, grain: str = "day"
) -> DataFrame:
    """Sum of ``metric`` per date (and per value of ``dim``); NULL keys are
    dropped, an all-NULL group sums to 0."""
    keys = [_d(date_col, grain).alias("date")]
    if dim:
        keys.append(F.col(dim).cast("string").alias(dim))
    out = df.select(*keys, F.col(metric).cast("double").alias("m")).where(
        F.col("date").isNotNull()
    )
    if dim:
        out = out.where(F.col(dim).isNotNull())
    group = ["date"] + ([dim] if dim else [])
    return out.groupBy(*group).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias(metric))


def trend_growth(
    df: DataFrame, date_col: str, metric: str, dim: str, grain: str = "day"
) -> DataFrame:
    """Per dimension value with ≥ 2 points: first and last value, change,
    growth % (0 when first is 0), mean of the per-date sums, trend
    (up / down / flat) and rank by ``abs(change)`` desc."""
    s = trend_series(df, date_col, metric, dim, grain)
    g = s.groupBy(dim).agg(
        F.min_by(metric, "date").alias("first"),
        F.max_by(metric, "date").alias("last"),
        F.avg(metric).alias("mean"),
        F.count(F.lit(1)).alias("points"),
    ).where(F.col("points") >= 2)
    change = F.col("last") - F.col("first")
    out = g.select(
        F.col(dim),
        "first",
        "last",
        change.alias("change"),
        safe_ratio_pct(change, F.col("first")).alias("growth_pct"),
        "mean",
        sign_class(change).alias("trend"),
        "points",
    )
    return with_row_number(out, [F.abs(F.col("change")).desc(), F.col(dim).asc()], source=df)
