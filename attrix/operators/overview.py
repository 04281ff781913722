"""Overview: period series, latest-day value counts, dimension summary,
preview.

Every output is a small aggregate; the scans are single passes with
map-side partial aggregation.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.functions.exprs import TOTAL_LABEL, period_label
from attrix.functions.rank import with_row_number

UNITS = ("day", "week", "month", "year")


def _date_expr(date_col: str, grain: str) -> Column:
    c = F.col(date_col)
    return F.to_date(c) if grain == "day" else c.cast("timestamp_ntz")


def period_series(
    df: DataFrame, date_col: str, metrics: list[str], unit: str = "day", grain: str = "day",
    max_metrics: int | None = None,
) -> DataFrame:
    """Sum of all metrics (the first ``max_metrics`` if given) per day / week / month / year.

    ``period`` is the day (``date``; the raw timestamp with ``grain='raw'``)
    or a label: week ``yyyy-MM-dd/yyyy-MM-dd`` (Mon/Sun), month ``yyyy-MM``,
    year ``yyyy``.  Rows with a NULL date are dropped; an all-NULL metric
    sums to 0."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    metrics = list(metrics)[:max_metrics]
    d = _date_expr(date_col, grain)
    key = d if unit == "day" else period_label(d, unit)
    return (
        df.select(key.alias("period"), *metrics)
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(*[F.coalesce(F.sum(F.col(m).cast("double")), F.lit(0.0)).alias(m) for m in metrics])
    )


def latest_filter(df: DataFrame, date_col: str, grain: str = "day") -> DataFrame:
    """Rows of the latest day (``grain='raw'``: the latest timestamp).

    The maximum is one scalar read on the driver; the row filter is then a
    literal range predicate on the raw column, which Spark pushes into the
    Parquet scan (row groups outside the day are skipped by their min/max
    statistics)."""
    c = F.col(date_col)
    if grain == "day":
        latest = df.select(F.max(F.to_date(c))).first()[0]
        if latest is None:
            return df.where(F.lit(False))
        lo = F.lit(latest.isoformat()).cast("timestamp_ntz")
        hi = F.lit((latest + timedelta(days=1)).isoformat()).cast("timestamp_ntz")
        return df.where((c >= lo) & (c < hi))
    latest = df.select(F.max(c)).first()[0]
    return df.where(c == F.lit(latest))


def latest_value_counts(
    df: DataFrame, date_col: str, dims: list[str], top: int = 8, max_dims: int | None = None,
    grain: str = "day",
) -> DataFrame:
    """Value counts on the latest day for all dimensions (the first
    ``max_dims`` if given), top ``top`` per dimension (count desc, then value), in one aggregate over
    the long form ``(dimension, value)``."""
    dims = list(dims)[:max_dims]
    latest = latest_filter(df, date_col, grain)
    pairs = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in dims)
    long = latest.select(F.expr(f"stack({len(dims)}, {pairs}) AS (dimension, value)"))
    counts = long.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("count")
    )
    w = Window.partitionBy("dimension").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(
        F.col("rank") <= top
    )


def latest_dim_summary(
    df: DataFrame, date_col: str, dim: str, metric: str, grain: str = "day"
) -> DataFrame:
    """Latest-day ``sum, mean, count`` per dimension value sorted by sum
    desc, plus a total row (sum of sums, row-level mean over all latest
    rows, sum of counts).  ``count`` counts non-null metric values."""
    latest = latest_filter(df, date_col, grain).select(
        F.col(dim).cast("string").alias("value"), F.col(metric).cast("double").alias("m")
    )
    per = latest.where(F.col("value").isNotNull()).groupBy("value").agg(
        F.coalesce(F.sum("m"), F.lit(0.0)).alias("sum"),
        F.avg("m").alias("mean"),
        F.count("m").alias("count"),
    )
    detail = with_row_number(per.select("value", "sum", "mean", "count", F.lit(False).alias("is_total")),
                             [F.col("sum").desc(), F.col("value").asc()], source=df)
    total = latest.agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("m"))), F.lit(0.0)).alias("sum"),
        F.avg("m").alias("mean"),
        F.count(F.when(F.col("value").isNotNull(), F.col("m"))).alias("count"),
    ).select(F.lit(TOTAL_LABEL).alias("value"), "sum", "mean", "count",
             F.lit(True).alias("is_total"), F.lit(0).cast("long").alias("rank"))
    return total.unionByName(detail)


def preview(df: DataFrame, order_by: list[str], n: int = 50) -> DataFrame:
    """First ``n`` rows in an explicit order (frames have no row order)."""
    return df.orderBy(*order_by).limit(n)


def data_summary(df: DataFrame, date_col: str | None, grain: str = "raw") -> DataFrame:
    """Rows, columns and distinct "days" of the first date column (the
    reference counts distinct timestamps, ``grain='raw'``)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if date_col:
        aggs.append(F.count_distinct(_date_expr(date_col, grain)).alias("days"))
    out = df.agg(*aggs).withColumn("columns", F.lit(len(df.columns)))
    return out
