"""Series preparation, the lag/window feature table and the future calendar.

Every function takes optional ``series_keys`` so one job handles many
series: windows are ``partitionBy(series_keys)``, so each series is one
window partition.  A daily series has at most one row per calendar day, so
a partition is bounded by the calendar span, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAGS = 7
WINDOW = 7


def daily_series(df: DataFrame, date_col: str, metric: str,
                 series_keys: list[str] | None = None, grain: str = "day") -> DataFrame:
    """Sum of ``metric`` per (series, day); map-side partial aggregation
    means the shuffle carries at most one row per (series, day) per task."""
    keys = list(series_keys or [])
    d = F.to_date(date_col) if grain == "day" else F.col(date_col).cast("timestamp_ntz")
    src = df.select(*keys, d.alias("date"), F.col(metric).cast("double").alias("m")).where(
        F.col("date").isNotNull())
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    return src.groupBy(*keys, "date").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("y"))


def prepare_series(df: DataFrame, date_col: str, metric: str,
                   series_keys: list[str] | None = None, grain: str = "day") -> DataFrame:
    """Daily sums on a regular daily grid from each series' first to last
    day, gaps forward-filled.  Columns: ``*series_keys, date, y``.

    The grid is ``explode(sequence(first, last, 1 day))`` per series (one
    row per series in, one row per day out), joined to the sums on
    ``(series, date)``; the fill is ``last(y, ignorenulls)`` over the
    series window."""
    keys = list(series_keys or [])
    s = daily_series(df, date_col, metric, keys, grain)
    bounds = s.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    step = F.expr("INTERVAL 1 DAY")
    grid = bounds.select(*keys, F.explode(F.sequence("lo", "hi", step)).alias("date"))
    joined = grid.join(s, on=keys + ["date"], how="left")
    w = (Window.partitionBy(*keys).orderBy("date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.select(*keys, "date", F.last("y", ignorenulls=True).over(w).alias("y"))


def feature_table(series: DataFrame, series_keys: list[str] | None = None,
                  lags: int = LAGS, window: int = WINDOW, y: str = "y",
                  shifted: bool = False) -> DataFrame:
    """Training features per row: ``dayofweek`` (Monday = 0), ``month``,
    ``day``, ``year``, ``lag_1..lag_n``, ``rolling_mean_7``,
    ``rolling_std_7`` (sample), ``expanding_mean``, ``diff_1``, ``diff_7``;
    rows with any missing feature are dropped.

    ``shifted=False`` reproduces the reference exactly: the rolling and
    expanding windows include the current row (the target leaks into its
    own features).  ``shifted=True`` ends every window one row earlier so
    training and serving see the same information."""
    keys = list(series_keys or [])
    w = Window.partitionBy(*keys).orderBy("date")
    end = -1 if shifted else 0
    roll = w.rowsBetween(-(window - 1) + end, end)
    expand = w.rowsBetween(Window.unboundedPreceding, end)
    v = F.col(y)
    cols = [*keys, "date", v.alias("y"),
            F.weekday("date").alias("dayofweek"), F.month("date").alias("month"),
            F.dayofmonth("date").alias("day"), F.year("date").alias("year")]
    cols += [F.lag(v, i).over(w).alias(f"lag_{i}") for i in range(1, lags + 1)]
    cols += [F.avg(v).over(roll).alias(f"rolling_mean_{window}"),
             F.stddev_samp(v).over(roll).alias(f"rolling_std_{window}"),
             F.avg(v).over(expand).alias("expanding_mean")]
    if shifted:
        cols += [(F.lag(v, 1).over(w) - F.lag(v, 2).over(w)).alias("diff_1"),
                 (F.lag(v, 1).over(w) - F.lag(v, 8).over(w)).alias("diff_7")]
    else:
        cols += [(v - F.lag(v, 1).over(w)).alias("diff_1"),
                 (v - F.lag(v, 7).over(w)).alias("diff_7")]
    out = series.select(*cols)
    return out.dropna()


FEATURES = (["dayofweek", "month", "day", "year"] + [f"lag_{i}" for i in range(1, LAGS + 1)]
            + [f"rolling_mean_{WINDOW}", f"rolling_std_{WINDOW}", "expanding_mean", "diff_1",
               "diff_7"])


def future_calendar(series: DataFrame, horizon: int = 30,
                    series_keys: list[str] | None = None) -> DataFrame:
    """The next ``horizon`` days after each series' last day, with the step
    number (1..horizon)."""
    keys = list(series_keys or [])
    last = series.groupBy(*keys).agg(F.max("date").alias("last"))
    steps = last.select(*keys, "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(*keys, "step", F.date_add(F.col("last"), F.col("step")).alias("date"))
