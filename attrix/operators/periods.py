"""Comparison periods (base vs target) and their presets.

A period is an inclusive pair of ``yyyy-MM-dd`` days.  The filter is built
as a pair of range predicates on the raw column so it reaches the Parquet
scan as ``PushedFilters``.

Presets work on the *distinct observed* dates (not the calendar):

* ``latest``  – latest vs previous observed day
* ``wow``     – latest day vs latest−7 days (falls back to ``latest``)
* ``yoy``     – latest day vs latest−365 days (falls back to ``latest``)
* ``last7``   – last 7 vs previous 7 observed days (needs ≥ 14)
* ``last30``  – last 30 vs previous 30 observed days (needs ≥ 60)
* ``custom``  – explicit days; without any, base = target = latest day

Only the 60 most recent distinct dates are ever materialised
(``TakeOrderedAndProject``); existence checks are scalar aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.functions.exprs import col_


@dataclass(frozen=True)
class PeriodPair:
    base_start: str
    base_end: str
    target_start: str
    target_end: str

    @property
    def base_days(self) -> int:
        return (date.fromisoformat(self.base_end) - date.fromisoformat(self.base_start)).days + 1

    @property
    def target_days(self) -> int:
        return (
            date.fromisoformat(self.target_end) - date.fromisoformat(self.target_start)
        ).days + 1


def _day_after(day: str) -> str:
    return (date.fromisoformat(day) + timedelta(days=1)).isoformat()


def in_period(date_col, start: str, end: str, grain: str = "day") -> Column:
    """Inclusive period predicate.

    ``grain='day'`` keeps every time on the end day (``< end + 1 day``);
    ``grain='raw'`` compares against midnight of ``end`` like the reference
    (later times on the last day drop out).  Both forms are plain range
    comparisons on the column, so Catalyst pushes them into the scan."""
    c = col_(date_col)
    lo = F.lit(start).cast("timestamp_ntz")
    if grain == "raw":
        return (c >= lo) & (c <= F.lit(end).cast("timestamp_ntz"))
    return (c >= lo) & (c < F.lit(_day_after(end)).cast("timestamp_ntz"))


def date_values(df: DataFrame, date_col: str, grain: str = "day") -> DataFrame:
    """Non-null date values at the chosen grain, column ``d``."""
    c = F.col(date_col)
    d = F.to_date(c) if grain == "day" else c.cast("timestamp_ntz")
    return df.select(d.alias("d")).where(F.col("d").isNotNull())


PRESETS = ("latest", "wow", "yoy", "last7", "last30", "custom")


def resolve_period(
    df: DataFrame,
    date_col: str,
    preset: str,
    grain: str = "day",
    custom: PeriodPair | None = None,
) -> DataFrame:
    """One-row frame ``(preset, preset_used, base_start, base_end,
    target_start, target_end)``; the four bounds are ``yyyy-MM-dd`` strings.

    Fewer than two distinct dates → zero rows."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    vals = date_values(df, date_col, grain)
    # Bounded: at most 60 distinct values reach the final single partition.
    top = vals.distinct().orderBy(F.col("d").desc()).limit(60)
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(F.col("d").desc())))

    def nth(i: int) -> Column:
        return F.max(F.when(F.col("rn") == i, F.col("d")))

    picks = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        nth(1).alias("d1"),
        nth(2).alias("d2"),
        nth(7).alias("d7"),
        nth(8).alias("d8"),
        nth(14).alias("d14"),
        nth(30).alias("d30"),
        nth(31).alias("d31"),
        nth(60).alias("d60"),
    )

    fmt = lambda c: F.date_format(c, "yyyy-MM-dd")
    d1, d2 = F.col("d1"), F.col("d2")

    if preset in ("wow", "yoy"):
        lag_days = 7 if preset == "wow" else 365
        # Existence of latest − N days among observed values: a scalar
        # aggregate over the whole column (one pass, no join).
        latest = vals.agg(F.max("d")).scalar()
        probe = vals.agg(
            F.max(
                F.when(
                    F.col("d") == (latest - F.expr(f"INTERVAL {lag_days} DAYS")), F.lit(1)
                )
            )
        ).scalar()
        shifted = d1 - F.expr(f"INTERVAL {lag_days} DAYS")
        hit = probe.isNotNull()
        out = picks.select(
            F.when(hit, F.lit(preset)).otherwise(F.lit("latest")).alias("preset_used"),
            F.when(hit, fmt(shifted)).otherwise(fmt(d2)).alias("base_start"),
            F.when(hit, fmt(shifted)).otherwise(fmt(d2)).alias("base_end"),
            fmt(d1).alias("target_start"),
            fmt(d1).alias("target_end"),
            F.col("n"),
        )
    elif preset in ("last7", "last30"):
        k = 7 if preset == "last7" else 30
        need = 2 * k
        ok = F.col("n") >= need
        bs, be, ts = (
            (F.col("d14"), F.col("d8"), F.col("d7"))
            if k == 7
            else (F.col("d60"), F.col("d31"), F.col("d30"))
        )
        out = picks.select(
            F.when(ok, F.lit(preset)).otherwise(F.lit("latest")).alias("preset_used"),
            F.when(ok, fmt(bs)).otherwise(fmt(d2)).alias("base_start"),
            F.when(ok, fmt(be)).otherwise(fmt(d2)).alias("base_end"),
            F.when(ok, fmt(ts)).otherwise(fmt(d1)).alias("target_start"),
            fmt(d1).alias("target_end"),
            F.col("n"),
        )
    elif preset == "custom":
        if custom is not None:
            out = picks.select(
                F.lit("custom").alias("preset_used"),
                F.lit(custom.base_start).alias("base_start"),
                F.lit(custom.base_end).alias("base_end"),
                F.lit(custom.target_start).alias("target_start"),
                F.lit(custom.target_end).alias("target_end"),
                F.col("n"),
            )
        else:
            out = picks.select(
                F.lit("custom").alias("preset_used"),
                fmt(d1).alias("base_start"),
                fmt(d1).alias("base_end"),
                fmt(d1).alias("target_start"),
                fmt(d1).alias("target_end"),
                F.col("n"),
            )
    else:  # latest
        out = picks.select(
            F.lit("latest").alias("preset_used"),
            fmt(d2).alias("base_start"),
            fmt(d2).alias("base_end"),
            fmt(d1).alias("target_start"),
            fmt(d1).alias("target_end"),
            F.col("n"),
        )
    return out.where(F.col("n") >= 2).select(F.lit(preset).alias("preset"), *[
        c for c in ("preset_used", "base_start", "base_end", "target_start", "target_end")
    ])


def calendar(df: DataFrame, date_col: str) -> DataFrame:
    """Custom-preset drill-down: observed (year, month, day) triples."""
    d = F.to_date(F.col(date_col))
    return (
        df.select(d.alias("day"))
        .where(F.col("day").isNotNull())
        .distinct()
        .select(F.year("day").alias("year"), F.month("day").alias("month"), "day")
    )


def collect_period(period_df: DataFrame) -> PeriodPair | None:
    """Bring the one-row preset result to the driver (bounded: one row)."""
    rows = period_df.take(1)
    if not rows:
        return None
    r = rows[0]
    return PeriodPair(r["base_start"], r["base_end"], r["target_start"], r["target_end"])
