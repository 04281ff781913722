"""Forecasting entry points (one or many daily series per job).

All functions take the raw table, the date column, the metric and optional
``series_keys``; the daily series is prepared by
:func:`attrix.forecast.prepare.prepare_series` (sum per day, daily grid,
forward fill).  Per-series solvers run in ``applyInPandas`` grouped by the
series key; the tree-model forecasts train ONE MLlib model on the pooled
feature table and advance every series together.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.forecast import solvers
from attrix.forecast.prepare import FEATURES, feature_table, prepare_series
from attrix.ml.basics import regression_metrics
from attrix.session import ensure_checkpoint_dir, partitions_for, ship_package, stash

SERIES = "_series"


def _keys(df: DataFrame, series_keys):
    ship_package(df.sparkSession)
    if series_keys:
        return df, list(series_keys)
    return df.withColumn(SERIES, F.lit("all")), [SERIES]


def _key_schema(df: DataFrame, keys) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def holt_winters(df: DataFrame, date_col: str, metric: str, horizon: int = 30,
                 series_keys: list[str] | None = None) -> DataFrame:
    """Additive trend + additive weekly season; needs ≥ 10 points.
    Columns: keys, date, yhat, alpha, beta, gamma (smoothing parameters).

    The parameter grids are rows: each series (one array, bounded by its calendar
    span) is dealt with eleven slices of the coarse grid, then of the fine grid around
    the best point, so that a single long series uses as many tasks."""
    src, keys = _keys(df, series_keys)
    s = prepare_series(src, date_col, metric, keys)
    packed = stash(s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "y"))).alias("p"))
                   .select(*keys, F.element_at("p", -1)["date"].alias("last"), F.transform("p", lambda x: x["y"]).alias("y"))
                   .where(F.size("y") >= 10), "series")
    n = packed.count()
    shape = f"{_key_schema(packed, keys)}, sse double, a double, b double, g double"

    def best(rows: DataFrame, grids) -> DataFrame:
        def fn(batches):
            for batch in batches:
                out = [solvers.hw_best(np.asarray(r["y"], float), *grids(r)) for r in batch.to_dict("records")]
                yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(out, columns=["sse", "a", "b", "g"])], axis=1)

        dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(solvers.COARSE) - 1))))
        found = dealt.repartition(max(1, min(len(solvers.COARSE) * n, 4096)), *keys, "part").mapInPandas(fn, shape)
        return found.groupBy(*keys).agg(F.min(F.struct("sse", "a", "b", "g")).alias("best")).select(*keys, "best.*")

    def coarse(r):
        return solvers.COARSE[int(r["part"]):int(r["part"]) + 1], solvers.COARSE, solvers.COARSE

    def fine(r):
        return solvers.hw_around((r["a"], r["b"], r["g"]), int(r["part"]))

    centre = stash(packed.join(best(packed, coarse).drop("sse"), keys), "centre")
    chosen = packed.join(best(centre, fine).drop("sse"), keys)

    def ahead(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                yhat = solvers.hw_forecast_at(np.asarray(r["y"], float), horizon, r["a"], r["b"], r["g"])
                days = [r["last"] + timedelta(days=i) for i in range(1, horizon + 1)]
                yield pd.DataFrame({**{k: [r[k]] * horizon for k in keys}, "date": days, "yhat": yhat,
                                    "alpha": r["a"], "beta": r["b"], "gamma": r["g"]})

    return chosen.mapInPandas(ahead, f"{_key_schema(packed, keys)}, date date, yhat double, alpha double, beta double, gamma double")


def arima(df: DataFrame, date_col: str, metric: str, horizon: int = 30,
          series_keys: list[str] | None = None) -> DataFrame:
    """ARIMA(2,1,1) mean forecast with 95 % interval, AIC and BIC; needs
    ≥ 10 points."""
    src, keys = _keys(df, series_keys)
    s = prepare_series(src, date_col, metric, keys)
    schema = f"{_key_schema(s, keys)}, date date, yhat double, lower double, upper double, " \
             f"aic double, bic double"
    return s.groupBy(*keys).applyInPandas(solvers.arima_group(keys, horizon), schema)


def additive(df: DataFrame, date_col: str, metric: str, horizon: int = 30,
             series_keys: list[str] | None = None) -> DataFrame:
    """Additive trend + yearly/weekly seasonality with an 80 % interval,
    over history (fitted values next to ``actual``) and the future days."""
    src, keys = _keys(df, series_keys)
    s = prepare_series(src, date_col, metric, keys)
    schema = (f"{_key_schema(s, keys)}, date date, actual double, yhat double, trend double, "
              f"lower double, upper double, is_future boolean")
    return s.groupBy(*keys).applyInPandas(solvers.additive_group(keys, horizon), schema)


def additive_report(fc: DataFrame, series_keys: list[str] | None = None) -> DataFrame:
    """In-sample MAPE (rows with actual ≠ 0; NULL if none), trend flag
    (trend on the last row vs 30 rows before the end), mean of the future
    forecast, last date — one row per series."""
    keys = list(series_keys or [SERIES])
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    ranked = fc.withColumn("_rn", F.row_number().over(w))
    a = F.col("actual")
    return ranked.groupBy(*keys).agg(
        (F.avg(F.when(a != 0, F.abs((a - F.col("yhat")) / a))) * 100).alias("mape"),
        F.when(F.max(F.when(F.col("_rn") == 1, F.col("trend")))
               > F.max(F.when(F.col("_rn") == 30, F.col("trend"))), F.lit("up"))
        .otherwise(F.lit("down")).alias("trend"),
        F.avg(F.when(F.col("is_future"), F.col("yhat"))).alias("forecast_mean"),
        F.max("date").alias("last_date"),
    )


# ---------------------------------------------------------------------------
# tree-model forecasts with recursive multi-step prediction
# ---------------------------------------------------------------------------

def _tail_features(tail: Column, target_date: Column, shifted: bool) -> list[Column]:
    n = F.size(tail)

    def last(i):  # i-th value from the end, first value when the tail is short
        return F.when(n >= i, F.element_at(tail, -i)).otherwise(F.element_at(tail, 1))

    win = F.slice(tail, F.greatest(n - 6, F.lit(1)), 7)
    wn = F.size(win).cast("double")
    wsum = F.aggregate(win, F.lit(0.0), lambda acc, x: acc + x)
    wsq = F.aggregate(win, F.lit(0.0), lambda acc, x: acc + x * x)
    wmean = wsum / wn
    # reference serving uses the population std and a 6-step "diff_7";
    # the shifted variant serves exactly what it trained on.
    ddof = 1.0 if shifted else 0.0
    var = F.greatest(wsq - wn * wmean * wmean, F.lit(0.0)) / (wn - ddof)
    wstd = F.when(wn > 1, F.sqrt(var)).otherwise(0.0)
    mean_all = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x) / n.cast("double")
    cols = [F.weekday(target_date).alias("dayofweek"), F.month(target_date).alias("month"),
            F.dayofmonth(target_date).alias("day"), F.year(target_date).alias("year")]
    cols += [last(i).alias(f"lag_{i}") for i in range(1, 8)]
    cols += [wmean.alias("rolling_mean_7"), wstd.alias("rolling_std_7"),
             mean_all.alias("expanding_mean"),
             F.when(n >= 2, last(1) - last(2)).otherwise(0.0).alias("diff_1"),
             (F.when(n >= 8, last(1) - last(8)) if shifted else
              F.when(n >= 7, last(1) - last(7))).otherwise(0.0).alias("diff_7")]
    return cols


def ml_forecast(df: DataFrame, date_col: str, metric: str, horizon: int = 30,
                model: str = "rf", series_keys: list[str] | None = None, tail_len: int = 30,
                shifted: bool = False, checkpoint_every: int = 10, seed: int = 42):
    """Random-forest (100 trees, depth 10) or boosted-tree (100 rounds,
    depth 5, step 0.1) forecast on the lag/window features, predicted
    recursively from the last ``tail_len`` values.

    Returns ``(forecast, report)``: forecast = keys, step, date, yhat;
    report = one row per series with training R², top-3 features and the
    trend flag (last prediction above the first).

    The recursion state is one row per series (``tail`` array ≤ tail_len +
    horizon values); each step is one ``model.transform`` over that state,
    and the lineage is cut with a reliable ``checkpoint()`` into the shared
    checkpoint folder every ``checkpoint_every`` steps."""
    src, keys = _keys(df, series_keys)
    s = prepare_series(src, date_col, metric, keys)
    feats = feature_table(s, keys, shifted=shifted)
    va = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = va.transform(feats.withColumnRenamed("y", "label"))
    if model == "rf":
        est = RandomForestRegressor(numTrees=100, maxDepth=10, featureSubsetStrategy="all",
                                    seed=seed, checkpointInterval=10)
    elif model == "gbt":
        est = GBTRegressor(maxIter=100, maxDepth=5, stepSize=0.1, seed=seed,
                           checkpointInterval=10)
    else:
        raise ValueError("model must be 'rf' or 'gbt'")
    # iterative estimator: keep the feature table materialised, partitioned
    # by its size (one row per series-day) rather than by the shuffle default
    n_rows = feats.count()
    train = train.repartition(partitions_for(n_rows)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = est.fit(train)
        imp = sorted(zip(FEATURES, fitted.featureImportances.toArray()), key=lambda t: -t[1])
        train_r2 = regression_metrics(
            fitted.transform(train).select("label", "prediction")).first()["r2"]
    finally:
        train.unpersist()
    ensure_checkpoint_dir(df.sparkSession)

    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    last = s.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= tail_len)
    state = last.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "y"))), lambda x: x["y"]).alias(
            "tail"),
        F.max("date").alias("last_date"),
    ).withColumn("preds", F.array().cast("array<double>"))
    # one row per series: size the recursion state by the series count
    n_series = state.count()
    state = state.repartition(partitions_for(n_series, 50_000), *keys)
    for step in range(1, horizon + 1):
        target = F.date_add(F.col("last_date"), step)
        x = state.select("*", *_tail_features(F.col("tail"), target, shifted))
        p = fitted.transform(va.transform(x)).select(*keys, "tail", "last_date", "preds",
                                                     "prediction")
        state = p.select(*keys, F.concat("tail", F.array("prediction")).alias("tail"),
                         "last_date", F.concat("preds", F.array("prediction")).alias("preds"))
        if step % checkpoint_every == 0 and step < horizon:
            state = state.checkpoint(eager=True)
    fc = state.select(*keys, "last_date", F.posexplode("preds").alias("pos", "yhat")).select(
        *keys, (F.col("pos") + 1).alias("step"),
        F.date_add("last_date", F.col("pos") + 1).alias("date"), "yhat")

    top3 = [f for f, _ in imp[:3]]
    first_last = fc.groupBy(*keys).agg(F.min_by("yhat", "step").alias("first"),
                                       F.max_by("yhat", "step").alias("last"))
    report = first_last.select(
        *keys, F.lit(train_r2).cast("double").alias("train_r2"),
        F.array(*[F.lit(f) for f in top3]).alias("top3_features"),
        F.when(F.col("last") > F.col("first"), F.lit("up")).otherwise(F.lit("down")).alias(
            "trend"),
    )
    return fc, report
