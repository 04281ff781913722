"""Model plumbing that is plain SQL: row guards, z-scaling, the
deterministic train/test split, z-score anomalies, target binarisation and
the evaluation metrics.

All of these are aggregates or projections; statistics such as means and
standard deviations reach the rows through scalar subqueries (one small
job, no join, no driver round trip).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS = {"clustering": 3, "anomaly": 10, "reduction": 10, "regression": 20,
            "classification": 20}


class NotEnoughRows(ValueError):
    pass


def require_rows(df: DataFrame, task: str) -> int:
    """Minimum-row guard (3 clustering, 10 anomaly/reduction, 20
    regression/classification).  ``limit(n).count()`` stops reading as soon
    as enough rows are found."""
    need = MIN_ROWS[task]
    have = df.limit(need).count()
    if have < need:
        raise NotEnoughRows(f"{task} needs at least {need} rows, got {have}")
    return have


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a NULL (or NaN) in any of ``cols``."""
    cond = reduce(lambda a, b: a & b,
                  [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])
    return df.where(cond)


def zscale(df: DataFrame, features: list[str], suffix: str = "_z",
           keep: list[str] | None = None) -> DataFrame:
    """Population z-scores ``(x − mean) / std_pop``; a constant column is
    divided by 1 (it becomes 0).

    The 2·k statistics come from one aggregate and are read on the driver
    (a bounded handful of numbers): every output row depends on them, so a
    full pass is needed before the first row either way, and literal
    constants keep the row projection small enough for the JIT."""
    src = complete_rows(df, features)
    row = src.agg(*[e for c in features for e in (
        F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double")))]).first()
    cols = [F.col(k) for k in (keep or [])]
    for i, c in enumerate(features):
        m, s = row[2 * i], row[2 * i + 1]
        m = 0.0 if m is None else float(m)
        s = 1.0 if not s else float(s)
        cols.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(f"{c}{suffix}"))
    return src.select(*cols)


def split_bucket(key) -> Column:
    """Deterministic 0..4 bucket from the row key (md5 → first 32 bits).
    Rows in bucket 0 are the 20 % hold-out.  The same bucket in DuckDB:
    ``('0x' || substr(md5(k), 1, 8))::BIGINT % 5``."""
    k = key if isinstance(key, Column) else F.col(key)
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long") % 5


def train_test_split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    b = split_bucket(key)
    return df.where(b != 0), df.where(b == 0)


def with_split(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("is_test", split_bucket(key) == 0)


def zscore_anomalies(df: DataFrame, features: list[str], threshold: float = 3.0,
                     keep: list[str] | None = None) -> DataFrame:
    """Flag rows where any feature has ``|z| > threshold`` (population std);
    score = −max|z| (lower = more anomalous)."""
    z = zscale(df, features, keep=(keep or []) + features)
    mx = F.greatest(*[F.abs(F.col(f"{c}_z")) for c in features]) if len(features) > 1 else \
        F.abs(F.col(f"{features[0]}_z"))
    return z.select(*(keep or []), *features, mx.alias("max_abs_z"),
                    (-mx).alias("score"), (mx > threshold).alias("is_anomaly"))


def anomaly_summary(scored: DataFrame, source: DataFrame) -> DataFrame:
    """Anomaly count and its share of ALL source rows (rows with NULL
    features count in the denominator, as in the reference)."""
    total = source.select(F.count(F.lit(1))).scalar()
    return scored.agg(F.count_if(F.col("is_anomaly")).alias("anomalies")).select(
        "anomalies", total.alias("rows"),
        (F.col("anomalies") / F.nullif(total, F.lit(0)) * 100).alias("anomaly_pct"))


def binarize_target(df: DataFrame, target: str, max_classes: int = 5) -> DataFrame:
    """Classification target: an integer/float target with more than
    ``max_classes`` distinct values becomes ``target > median`` (0/1),
    otherwise it is used as is.  Decided by an aggregate (scalar subquery)."""
    y = F.col(target)
    numeric = dict(df.dtypes)[target] in ("int", "bigint", "double", "float", "smallint")
    if not numeric:
        return df.withColumn("label", y.cast("string"))
    # two scalars, read once: the distinct count is capped (limit) so a
    # continuous target never builds a full distinct set
    nd = df.select(y).where(y.isNotNull()).distinct().limit(max_classes + 1).count()
    if nd <= max_classes:
        return df.withColumn("label", y.cast("string"))
    from attrix.functions.quantiles import exact_quantiles

    med = exact_quantiles(df, [target], [0.5])[0][(target, 0.5)]
    return df.withColumn("label", (y.cast("double") > F.lit(med)).cast("int").cast("string"))


def regression_metrics(pred: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """R², RMSE, MAE and row count of (label, prediction) pairs in one
    aggregate (R² = 1 − SS_res / SS_tot)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    ss_tot = F.var_pop(y) * F.count(y)
    return pred.agg(
        (F.lit(1.0) - F.sum((y - p) * (y - p)) / F.nullif(ss_tot, F.lit(0.0))).alias("r2"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long confusion matrix over the sorted union of labels, with explicit
    zeros for absent pairs.  The class list is one small array (one entry
    per class); the grid is built by exploding it twice."""
    counts = pred.groupBy(F.col(label).cast("string").alias("label"),
                          F.col(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))
    classes = counts.agg(F.array_sort(F.array_union(F.collect_set("label"),
                                                    F.collect_set("prediction"))).alias("c"))
    grid = classes.select(F.explode("c").alias("label"), "c").select(
        "label", F.explode("c").alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def classification_report(pred: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per class precision / recall / f1 / support (0 where undefined), plus
    ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    cm = confusion(pred, label, prediction)
    per = cm.groupBy(F.col("label").alias("cls")).agg(
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count"))).alias("tp"),
        F.sum("count").alias("support"))
    pcol = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("pred_n"))
    j = per.join(pcol, "cls")
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    classes = j.select(F.col("cls").alias("class"), prec.alias("precision"),
                       rec.alias("recall"), f1.alias("f1"),
                       F.col("support").cast("long").alias("support"),
                       F.col("tp"))
    # Classes are the union of true and predicted labels; a predicted-only
    # class has support 0 and still counts in the macro average.
    avgs = classes.agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
    )
    summary = avgs.select(F.expr(
        "stack(3, 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), tp / n, n, "
        "'macro avg', mp, mr, mf, n, 'weighted avg', wp, wr, wf, n) "
        "AS (class, precision, recall, f1, support)"))
    return classes.drop("tp").unionByName(
        summary.withColumn("support", F.col("support").cast("long")))


def cluster_stats(df: DataFrame, cluster: str, features: list[str],
                  decimals: int | None = 2) -> DataFrame:
    """Per-cluster ``mean, std (n−1), count`` of every feature (long form:
    ``cluster, feature, mean, std, count``)."""
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.count(x).alias(f"n{i}")]
    g = df.groupBy(F.col(cluster).alias("cluster")).agg(*aggs)
    entries = ", ".join(f"'{c}', m{i}, s{i}, n{i}" for i, c in enumerate(features))
    long = g.select("cluster", F.expr(
        f"stack({len(features)}, {entries}) AS (feature, mean, std, count)"))
    if decimals is not None:
        long = long.withColumn("mean", F.round("mean", decimals)).withColumn(
            "std", F.round("std", decimals))
    return long
