"""Data behind the visualisation module: bar, pie, box, scatter+OLS, row-order
line and the correlation matrix.  Only the numbers are produced; drawing is
left to the caller."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.functions.exprs import guarded_corr
from attrix.functions.quantiles import SMALL, by_size, group_quantiles
from attrix.session import stash


def _group_sum(df: DataFrame, dims: list[str], metric: str) -> DataFrame:
    src = df.select(*[F.col(d).cast("string").alias(d) for d in dims],
                    F.col(metric).cast("double").alias("m"))
    for d in dims:
        src = src.where(F.col(d).isNotNull())
    return src.groupBy(*dims).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias(metric))


def bar_top(df: DataFrame, dim: str, metric: str, n: int = 20) -> DataFrame:
    """Top ``n`` dimension values by summed metric (ties by value).  The
    ``orderBy().limit()`` is a ``TakeOrderedAndProject``: each task keeps its
    own top ``n``; the rank window then runs over at most ``n`` rows."""
    g = _group_sum(df, [dim], metric)
    top = g.orderBy(F.col(metric).desc(), F.col(dim).asc()).limit(n)
    w = Window.orderBy(F.col(metric).desc(), F.col(dim).asc())
    return top.withColumn("rank", F.row_number().over(w).cast("long"))


def pie_top(df: DataFrame, dims: list[str], metric: str, n: int = 10) -> DataFrame:
    """Top ``n`` slices by summed metric and each slice's share (percent) of
    the slices shown."""
    g = _group_sum(df, dims, metric)
    top = g.orderBy(F.col(metric).desc(), *[F.col(d).asc() for d in dims]).limit(n)
    w_all = Window.partitionBy()
    w = Window.orderBy(F.col(metric).desc(), *[F.col(d).asc() for d in dims])
    return top.select(
        *dims, metric,
        (F.col(metric) / F.nullif(F.sum(metric).over(w_all), F.lit(0.0)) * 100).alias("share_pct"),
        F.row_number().over(w).cast("long").alias("rank"),
    )


def box_summary(df: DataFrame, metric: str, dim: str | None = None, exact: bool = True,
                accuracy: int = 10000) -> DataFrame:
    """Box-plot numbers per dimension value (or overall): quartiles with
    linear interpolation, whiskers at the most extreme values within
    1.5·IQR of the box, number of outliers.

    Quartiles are exact with bounded memory (see ``functions.quantiles``): a
    hot group never has its values gathered in one task, and the quartiles are a
    Spark table, one row per group, joined to the rows for the whisker / outlier
    pass; ``exact=False`` uses the sketch quantiles directly."""
    key = dim or "_all"
    x = F.col(metric).cast("double")
    value = F.col(dim).cast("string") if dim else F.lit("all")
    src = df.select(value.alias(key), x.alias("m")).where(F.col("m").isNotNull() & ~F.isnan("m") & F.col(key).isNotNull())
    probs = [0.25, 0.5, 0.75]
    if exact:
        q = group_quantiles(src, key, "m", probs).select(
            F.col("g").alias(key), "n", "min", "max", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    else:
        q = src.groupBy(key).agg(F.count("*").alias("n"), F.min("m").alias("min"), F.max("m").alias("max"),
                                 F.percentile_approx("m", probs, accuracy).alias("q"))
        q = q.select(key, "n", "min", "max", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    q = stash(q.withColumn("iqr", F.col("q3") - F.col("q1")), "box")
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    fences = q.select(key, "n", lo.alias("lo"), hi.alias("hi"))
    large, rest, tasks = by_size(src, key, fences)
    aggs = [
        F.min(F.when(F.col("m") >= F.col("lo"), F.col("m"))).alias("whisker_low"),
        F.max(F.when(F.col("m") <= F.col("hi"), F.col("m"))).alias("whisker_high"),
        F.count(F.when((F.col("m") < F.col("lo")) | (F.col("m") > F.col("hi")), 1)).alias(
            "outliers"),
    ]
    wh = (large.join(F.broadcast(fences.where(F.col("n") > SMALL)), key).groupBy(key).agg(*aggs)
          .unionByName(rest.join(fences.repartition(tasks, key), key).groupBy(key).agg(*aggs)))
    return q.join(wh, key).select(
        *([dim] if dim else []), "n", "min", "max", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "outliers")


def scatter_ols(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """OLS trend line of ``y`` on ``x`` (per optional group): slope,
    intercept, R² and the number of complete pairs — full data, no sample.
    ``regr_*`` are algebraic aggregates, so partial aggregation is map-side
    even for a hot group."""
    keys = [F.col(group).cast("string").alias(group)] if group else []
    src = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    X, Y = F.col("_x"), F.col("_y")
    aggs = [
        F.regr_slope(Y, X).alias("slope"),
        F.regr_intercept(Y, X).alias("intercept"),
        F.regr_r2(Y, X).alias("r2"),
        F.regr_count(Y, X).alias("n"),
    ]
    if group:
        return src.where(F.col(group).isNotNull()).groupBy(group).agg(*aggs)
    return src.agg(*aggs)


def line_series(df: DataFrame, metric: str, order_col: str, dim: str | None = None) -> DataFrame:
    """Metric against row order.  Spark rows have no position, so the order
    column is the x axis; the output is a distributed sort (range
    partitioned), not a single-task row numbering."""
    cols = [F.col(order_col).alias("x")]
    if dim:
        cols.append(F.col(dim).cast("string").alias("series"))
    cols.append(F.col(metric).cast("double").alias("y"))
    return df.select(*cols).orderBy("x")


def corr_matrix(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Pearson correlation for every pair (pairwise-complete rows) in ONE
    aggregate, returned long: ``(metric_a, metric_b, r, strength)``.
    Constant columns give NULL instead of an ANSI error."""
    pairs = list(combinations_with_replacement(metrics, 2))
    row = df.agg(*[guarded_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(f"'{a}', '{b}', c{i}")
        if a != b:
            entries.append(f"'{b}', '{a}', c{i}")
    long = row.select(F.expr(f"stack({len(entries)}, {', '.join(entries)}) "
                             f"AS (metric_a, metric_b, r)"))
    ar = F.abs(F.col("r"))
    strength = (F.when(ar > 0.8, F.lit("strong"))
                .when((ar > 0.5) & (ar < 0.8), F.lit("medium"))
                .when(ar < 0.3, F.lit("weak")))
    return long.withColumn("strength", strength)
