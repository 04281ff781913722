"""Change attribution between two periods (single, multi and auto dimension).

Plan shape (one scan, one shuffle for the whole analysis):

1. ``Filter(base OR target)`` — pushed into the Parquet scan.
2. One ``HashAggregate`` per key tuple with two conditional sums
   (``sum(m) FILTER base``, ``sum(m) FILTER target``) — partial aggregation
   happens map-side, so the shuffle carries one row per key per task.
   This replaces the full outer join of two aggregates: a key present in one
   period only gets 0 on the other side.
3. Grand totals are a scalar subquery over the *same* aggregate, which
   Spark plans as a ``ReusedExchange`` — the data is not read twice and no
   join is needed to attach totals to detail rows.

Output layout (one row per key plus a leading total row)::

    dimension, value, base, target, delta, rate_pct, contribution_pct,
    contribution_pp, is_total, rank

``rank`` is 0 on the total row and 1.. by ``abs(delta)`` desc (ties by key).
It is computed over the aggregated table (one row per dimension value): with
``top_n`` by a limit in every task, otherwise over ranges of the order
(:mod:`attrix.functions.rank`), so that no dimension is ranked in one task
unless the scanned files prove it small; ``rank=False`` sorts without numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.functions.exprs import TOTAL_LABEL, safe_ratio_pct
from attrix.functions.rank import fits_one_task, with_row_number
from attrix.operators.periods import PeriodPair, in_period
from attrix.session import stash

METHODS = ("sum", "daily_avg")


def _not_null_all(cols) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def period_sums(
    df: DataFrame,
    dims: list[str],
    metric: str,
    date_col: str,
    periods: PeriodPair,
    method: str = "sum",
    grain: str = "day",
) -> DataFrame:
    """Per-key ``base`` and ``target`` (sum or daily average) in one pass.

    Null keys are dropped on every dimension; an all-null group sums to 0."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    b = in_period(date_col, periods.base_start, periods.base_end, grain)
    t = in_period(date_col, periods.target_start, periods.target_end, grain)
    m = F.col(metric).cast("double")
    src = df.select(*dims, metric, date_col).where((b | t) & _not_null_all(dims))
    base = F.coalesce(F.sum(F.when(b, m)), F.lit(0.0))
    target = F.coalesce(F.sum(F.when(t, m)), F.lit(0.0))
    if method == "daily_avg":
        base = base / F.lit(float(periods.base_days))
        target = target / F.lit(float(periods.target_days))
    return src.groupBy(*dims).agg(base.alias("base"), target.alias("target"))


def _measures(base: Column, target: Column, tot_b: Column, tot_t: Column) -> list[Column]:
    delta = target - base
    tot_delta = tot_t - tot_b
    total_rate = safe_ratio_pct(tot_delta, tot_b)
    contrib = safe_ratio_pct(delta, tot_delta)
    return [
        base.alias("base"),
        target.alias("target"),
        delta.alias("delta"),
        safe_ratio_pct(delta, base).alias("rate_pct"),
        contrib.alias("contribution_pct"),
        (contrib * total_rate / F.lit(100.0)).alias("contribution_pp"),
    ]


def _total_measures(tot_b: Column, tot_t: Column) -> list[Column]:
    tot_delta = tot_t - tot_b
    total_rate = safe_ratio_pct(tot_delta, tot_b)
    return [
        tot_b.alias("base"),
        tot_t.alias("target"),
        tot_delta.alias("delta"),
        total_rate.alias("rate_pct"),
        F.lit(100.0).alias("contribution_pct"),
        total_rate.alias("contribution_pp"),
    ]


def _attach(agg: DataFrame, keys: list[Column], source: DataFrame, top_n, rank: bool,
            key_order: list[str]) -> DataFrame:
    """Detail rows (with totals from a reused-exchange scalar subquery) plus
    the total row, ranked; ``agg`` is an aggregate of ``source``."""
    spread = rank and top_n is None and not fits_one_task(source)
    agg = stash(agg, "sums") if spread else agg  # ranking reads it twice
    tot = agg.select(
        F.struct(F.sum("base").alias("b"), F.sum("target").alias("t")).alias("tot")
    ).scalar()
    # attach the subquery once; every measure then reads the same attribute
    with_tot = agg.withColumn("_tot", tot)
    detail = with_tot.select(
        *keys,
        *_measures(F.col("base"), F.col("target"), F.col("_tot.b"), F.col("_tot.t")),
        F.lit(False).alias("is_total"),
    )
    order = [F.abs(F.col("delta")).desc(), *[F.col(k).asc() for k in key_order]]
    if spread:
        detail = with_row_number(detail, order)
    elif rank or top_n is not None:
        detail = detail.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
        if top_n is not None:
            detail = detail.where(F.col("rank") <= top_n)
    total = agg.groupBy().agg(F.sum("base").alias("tb"), F.sum("target").alias("tt"))
    return detail, total, order


def contribution(
    df: DataFrame,
    dimension: str,
    metric: str,
    date_col: str,
    periods: PeriodPair,
    method: str = "sum",
    grain: str = "day",
    top_n: int | None = None,
    rank: bool = True,
) -> DataFrame:
    """Single-dimension attribution (AN1)."""
    agg = period_sums(df, [dimension], metric, date_col, periods, method, grain)
    agg = agg.select(F.col(dimension).cast("string").alias("value"), "base", "target")
    detail, total, order = _attach(agg, [F.col("value")], df, top_n, rank, ["value"])
    detail = detail.select(F.lit(dimension).alias("dimension"), "*")
    total_row = total.select(
        F.lit(dimension).alias("dimension"),
        F.lit(TOTAL_LABEL).alias("value"),
        *_total_measures(F.coalesce(F.col("tb"), F.lit(0.0)), F.coalesce(F.col("tt"), F.lit(0.0))),
        F.lit(True).alias("is_total"),
        *([F.lit(0).cast("long").alias("rank")] if (rank or top_n is not None) else []),
    )
    out = total_row.unionByName(detail)
    if not rank and top_n is None:
        out = out.orderBy(F.col("is_total").desc(), *order)
    return out


def multi_contribution(
    df: DataFrame,
    dims: list[str],
    metric: str,
    date_col: str,
    periods: PeriodPair,
    method: str = "sum",
    grain: str = "day",
    top_n: int | None = None,
    rank: bool = True,
) -> DataFrame:
    """Attribution over a tuple of dimensions (AN2); every dimension column
    of the total row carries the total label."""
    agg = period_sums(df, dims, metric, date_col, periods, method, grain)
    agg = agg.select(*[F.col(d).cast("string").alias(d) for d in dims], "base", "target")
    detail, total, order = _attach(agg, [F.col(d) for d in dims], df, top_n, rank, dims)
    total_row = total.select(
        *[F.lit(TOTAL_LABEL).alias(d) for d in dims],
        *_total_measures(F.coalesce(F.col("tb"), F.lit(0.0)), F.coalesce(F.col("tt"), F.lit(0.0))),
        F.lit(True).alias("is_total"),
        *([F.lit(0).cast("long").alias("rank")] if (rank or top_n is not None) else []),
    )
    out = total_row.unionByName(detail)
    if not rank and top_n is None:
        out = out.orderBy(F.col("is_total").desc(), *order)
    return out


def auto_attribution(
    df: DataFrame,
    dims: list[str],
    metric: str,
    date_col: str,
    periods: PeriodPair,
    method: str = "sum",
    grain: str = "day",
    top_n: int = 10,
    max_dims: int | None = None,
) -> DataFrame:
    """AN1 for each dimension (the first ``max_dims`` if given) in ONE job.

    The per-dimension aggregates come out of a single aggregate over the
    long form ``(dimension, value)`` (one scan, one shuffle); NULL values
    are dropped per dimension, so a row with a NULL in one dimension still
    counts for the others.  ``n_values`` is the dimension's number of values.
    Per-dimension totals (one row each) are
    broadcast to the detail rows; ``row_number ≤ top_n`` is planned with a
    partial ``WindowGroupLimit`` so only the top rows per task travel."""
    dims = list(dims)[:max_dims]
    b = in_period(date_col, periods.base_start, periods.base_end, grain)
    t = in_period(date_col, periods.target_start, periods.target_end, grain)
    m = F.col(metric).cast("double")
    src = df.select(*[F.col(d).cast("string").alias(d) for d in dims], metric, date_col).where(b | t)
    base = F.coalesce(F.sum(F.when(b, m)), F.lit(0.0))
    target = F.coalesce(F.sum(F.when(t, m)), F.lit(0.0))
    if method == "daily_avg":
        base = base / F.lit(float(periods.base_days))
        target = target / F.lit(float(periods.target_days))
    n = len(dims)
    # Long form (dimension, value) via one Generate, then a single
    # groupBy(dimension, value): the same physical shape as GROUPING SETS
    # (rows multiplied by the number of dims before partial aggregation).
    stack_expr = "stack({n}, {pairs}) as (dimension, value)".format(
        n=n, pairs=", ".join(f"'{d}', `{d}`" for d in dims)
    )
    long = src.select(F.expr(stack_expr), metric, date_col).where(F.col("value").isNotNull())
    agg = long.groupBy("dimension", "value").agg(base.alias("base"), target.alias("target"))
    # Per-dimension totals: at most ``max_dims`` rows, so broadcasting them
    # is bounded; the aggregate's exchange is reused for both branches.
    totals = agg.groupBy("dimension").agg(F.sum("base").alias("tb"), F.sum("target").alias("tt"),
                                          F.count(F.lit(1)).alias("n_values"))
    joined = agg.join(F.broadcast(totals), "dimension")
    detail = joined.select("dimension", "value",
                           *_measures(F.col("base"), F.col("target"), F.col("tb"), F.col("tt")),
                           F.lit(False).alias("is_total"), "n_values")
    order = [F.abs(F.col("delta")).desc(), F.col("value").asc()]
    # row_number ≤ top_n is planned as a partial WindowGroupLimit before the
    # shuffle, so only top_n rows per dimension per task travel.
    detail = detail.withColumn(
        "rank", F.row_number().over(Window.partitionBy("dimension").orderBy(*order)).cast("long")
    )
    detail_top = detail.where(F.col("rank") <= top_n)
    total_rows = totals.select(
        "dimension", F.lit(TOTAL_LABEL).alias("value"),
        *_total_measures(F.col("tb"), F.col("tt")),
        F.lit(True).alias("is_total"), "n_values", F.lit(0).cast("long").alias("rank"),
    )
    return total_rows.unionByName(detail_top)


def cross_pivot(
    df: DataFrame,
    dims: list[str],
    metric: str,
    date_col: str,
    periods: PeriodPair,
    method: str = "sum",
    grain: str = "day",
    max_columns: int = 200,
    values: list | None = None,
) -> DataFrame:
    """Change matrix for two dimensions (AG10): rows = first dimension,
    columns = values of the second, cell = delta, missing cell = 0.

    Column values are taken from ``values`` or computed with a bounded
    ``distinct().limit(max_columns + 1)``; more than ``max_columns`` raise, as the
    shape of the result may not depend on the data."""
    d0, d1 = dims[:2]
    agg = period_sums(df, [d0, d1], metric, date_col, periods, method, grain)
    long = agg.select(
        F.col(d0).cast("string").alias(d0),
        F.col(d1).cast("string").alias(d1),
        (F.col("target") - F.col("base")).alias("delta"),
    )
    if values is None:
        vals = [r[0] for r in long.select(d1).distinct().orderBy(d1).limit(max_columns + 1).collect()]
    else:
        vals = sorted(str(v) for v in values)
    if len(vals) > max_columns:
        raise ValueError(f"{d1} has more than {max_columns} values; pass max_columns or values")
    wide = long.groupBy(d0).pivot(d1, vals).agg(F.avg("delta"))
    return wide.select(f"`{d0}`", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c)
                                    for c in wide.columns[1:]])


def cross_rollup(
    df: DataFrame,
    dims: list[str],
    metric: str,
    date_col: str,
    periods: PeriodPair,
    method: str = "sum",
    grain: str = "day",
) -> DataFrame:
    """Hierarchy behind the treemap/sunburst (AG11) for ≥ 3 dimensions:
    ``rollup(*dims)`` over the per-key attribution; node value = sum of the
    target period, node colour = target-weighted mean of the target
    (``sum(t²)/sum(t)``); ``level`` = number of dims fixed."""
    agg = period_sums(df, dims, metric, date_col, periods, method, grain)
    agg = agg.select(*[F.col(d).cast("string").alias(d) for d in dims], "target")
    r = agg.rollup(*dims).agg(
        F.sum("target").alias("node_value"),
        (F.sum(F.col("target") * F.col("target")) / F.nullif(F.sum("target"), F.lit(0.0))).alias(
            "node_color"
        ),
        F.grouping_id().alias("gid"),
    )
    n = len(dims)
    level = reduce(
        lambda a, b: a + b,
        [F.when(F.col("gid").bitwiseAND(1 << (n - 1 - i)) == 0, 1).otherwise(0) for i in range(n)],
    )
    return r.select(*dims, F.col("node_value"), F.col("node_color"),
                    level.cast("int").alias("level"))
