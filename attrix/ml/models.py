"""Clustering, regression, classification and reduction on MLlib.

Shared rules (reference semantics): rows with a NULL in the features (and
target) are dropped; scaled algorithms use population z-scores fitted on the
training rows; the hold-out is 20 % chosen by a deterministic hash of the
row key (so a recomputed partition lands on the same side); seed 42.

Driver traffic is bounded by the model, never by the data: scaler
statistics (2 numbers per feature), label lists (one entry per class),
coefficients and importances.  The assembled training frame is persisted
(memory and disk) only while iterative estimators run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.ml import boost, forest
from attrix.ml.basics import (
    binarize_target,
    classification_report,
    complete_rows,
    confusion,
    regression_metrics,
    require_rows,
    split_bucket,
)
from attrix.ml.silhouette import silhouette_sums
from attrix.session import spread, stash

SEED = 42


# ---------------------------------------------------------------------------
# shared plumbing
# ---------------------------------------------------------------------------

def row_bucket(df: DataFrame, key: str | None, cols: list[str]) -> Column:
    """0..4 split bucket: md5 of the key column, or a 64-bit hash of the
    row's own values when the table has no key (deterministic either way)."""
    if key:
        return split_bucket(key)
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(5))


def scaler_stats(df: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    """(mean, population std) per feature — one aggregate, 2·k scalars."""
    row = df.agg(*[e for c in features for e in (
        F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double")))]).first()
    out = []
    for i in range(len(features)):
        m, s = row[2 * i], row[2 * i + 1]
        out.append((float(m or 0.0), float(s) if s else 1.0))
    return out


def scaled_cols(features: list[str], stats, shift: float = 0.0) -> list[Column]:
    return [((F.col(c).cast("double") - F.lit(m)) / F.lit(s) + F.lit(shift)).alias(f"{c}__z")
            for c, (m, s) in zip(features, stats)]


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def _importance_frame(spark, features, values, kind: str, ascending: bool = False) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, values)]
    df = spark.createDataFrame(rows, f"feature string, {kind} double")
    if kind == "coefficient":
        return df.orderBy(F.abs(F.col(kind)).desc(), "feature")
    return df.orderBy(F.col(kind).asc() if ascending else F.col(kind).desc(), "feature")


# ---------------------------------------------------------------------------
# clustering
# ---------------------------------------------------------------------------

@dataclass
class ClusterResult:
    labelled: DataFrame          # keep + features + cluster
    n_clusters: int
    cost: float | None = None


def _bisect(X: DataFrame, k: int, seed: int, max_iter: int):
    """Bisecting k-means of ``max_iter`` iterations a split.  MLlib runs them all, long
    after the centres stand still; here fits of 16, 32, ... iterations stop at the first
    that ends where half as many did.  A row that changes sides moves a centre by far more
    than the tolerance, which only covers sums added up in another order."""
    was, turns = None, 16
    while True:
        turns = min(turns, max_iter)
        model = BisectingKMeans(k=k, seed=seed, maxIter=turns).fit(X)
        if turns == max_iter:
            return model
        now = list(model.summary.clusterSizes), np.array(model.clusterCenters())
        if was and was[0] == now[0] and np.allclose(was[1], now[1], rtol=1e-11, atol=0):
            return model
        was, turns = now, 2 * turns


def cluster(df: DataFrame, features: list[str], algorithm: str = "kmeans", k: int = 3,
            keep: list[str] | None = None, restarts: int = 10, seed: int = SEED,
            max_iter: int = 300) -> ClusterResult:
    """K-means (best of ``restarts`` seeded fits, like ``n_init=10``) or
    bisecting k-means (the scalable stand-in for agglomerative clustering).

    Bisecting k-means runs on z-scores shifted by a constant: on exactly
    centred data its first split degenerates (all rows in one cluster);
    a shift leaves every distance unchanged."""
    keep = list(keep or [])
    src = complete_rows(df, features)
    require_rows(src, "clustering")
    stats = scaler_stats(src, features)
    shift = 10.0 if algorithm == "bisecting" else 0.0
    z = spread(src.select(*keep, *features, *scaled_cols(features, stats, shift)))
    X = assemble(z, [f"{c}__z" for c in features]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if algorithm == "kmeans":
            best, best_cost = None, None
            for i in range(restarts):
                m = KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=1e-4,
                           initMode="k-means||").fit(X)
                cost = m.summary.trainingCost
                if best_cost is None or cost < best_cost:
                    best, best_cost = m, cost
            model, cost = best, best_cost
        elif algorithm == "bisecting":
            model = _bisect(X, k, seed, max_iter)
            cost = model.summary.trainingCost
        else:
            raise ValueError(f"unknown clustering algorithm {algorithm!r}")
        labelled = model.transform(X).select(*keep, *features,
                                             F.col("prediction").cast("int").alias("cluster"))
        n = len(model.clusterCenters())
    finally:
        X.unpersist()
    return ClusterResult(labelled, n, cost)


def silhouette(labelled: DataFrame, features: list[str], cluster_col: str = "cluster") -> DataFrame:
    """Silhouette of a labelling on z-scored features, noise (−1) removed,
    0 when fewer than two clusters remain.

    Distributed (MLlib evaluator, O(n·k)); it uses squared Euclidean
    distance; for the Euclidean score see :func:`silhouette_euclidean`."""
    src = complete_rows(labelled, features).where(F.col(cluster_col) != -1)
    stats = scaler_stats(src, features)
    z = assemble(spread(src.select(F.col(cluster_col).cast("double").alias("c"),
                                   *scaled_cols(features, stats))), [f"{c}__z" for c in features])
    n_clusters = z.select(F.count_distinct("c")).first()[0]
    if n_clusters < 2:
        score = 0.0
    else:
        score = ClusteringEvaluator(featuresCol="features", predictionCol="c",
                                    metricName="silhouette",
                                    distanceMeasure="squaredEuclidean").evaluate(z)
    spark = labelled.sparkSession
    return spark.createDataFrame([(float(score), int(n_clusters))],
                                 "silhouette double, clusters long")


# ---------------------------------------------------------------------------
# regression
# ---------------------------------------------------------------------------

@dataclass
class ModelResult:
    predictions: DataFrame      # test rows: label, prediction (+ keep)
    metrics: DataFrame          # one row
    importance: DataFrame | None
    model: object = None


def _split(df, key, cols):
    b = row_bucket(df, key, cols)
    return df.where(b != 0), df.where(b == 0)


def regress(df: DataFrame, target: str, features: list[str], algorithm: str = "linear",
            key: str | None = None, alpha: float = 1.0, n_estimators: int = 100,
            max_depth: int = 10, learning_rate: float = 0.1, seed: int = SEED) -> ModelResult:
    """linear (unscaled OLS), ridge (scaled; ``alpha`` on the squared-error
    sum), rf (random forest, all features per split), gbt (gradient
    boosting, depth 3)."""
    cols = features + [target]
    src = complete_rows(df, cols).select(*([key] if key else []), *cols)
    require_rows(src, "regression")
    train, test = _split(src, key, cols)
    y = F.col(target).cast("double").alias("label")
    if algorithm == "gbt":
        train, test = (d.select(y, *[F.col(c).cast("double").alias(c) for c in features]) for d in (train, test))
        model = boost.fit(train, features, "label", n_estimators, learning_rate, 3, seed)
        return _reg_result(df.sparkSession, model.predict(test, ["label"]), model.importances(), "importance", features, model, src)
    train, test = spread(train), spread(test)
    if algorithm == "rf":
        model = forest.fit(train, features, target, False, n_estimators, max_depth, len(features), seed)
        pred = model.predict(test.select(y, *features), ["label"])
        return _reg_result(df.sparkSession, pred, model.importances(), "importance", features, model, src)
    if algorithm == "ridge":
        stats = scaler_stats(train, features)
        fcols = [f"{c}__z" for c in features]
        prep = lambda d: assemble(d.select(y, *scaled_cols(features, stats)), fcols)
    else:
        prep = lambda d: assemble(d.select(y, *[F.col(c).cast("double") for c in features]),
                                  features)
    tr = prep(train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if algorithm == "linear":
            est = LinearRegression(regParam=0.0, solver="normal", standardization=False)
        elif algorithm == "ridge":
            # Spark scales the label by its std and averages the loss; this
            # regParam reproduces the closed form (X'X + αI)⁻¹X'y.
            n, sy = tr.agg(F.count(F.lit(1)), F.stddev_samp("label")).first()
            est = LinearRegression(regParam=alpha * float(sy or 1.0) / n, elasticNetParam=0.0,
                                   solver="normal", standardization=False)
        else:
            raise ValueError(f"unknown regression algorithm {algorithm!r}")
        model = est.fit(tr)
    finally:
        tr.unpersist()
    pred = model.transform(prep(test)).select("label", "prediction")
    return _reg_result(df.sparkSession, pred, model.coefficients.toArray(), "coefficient", features, model, src)


def _reg_result(spark, pred, values, kind, features, model, src) -> ModelResult:
    metrics = regression_metrics(pred).select(
        "r2", "rmse", "mae", F.col("n").alias("n_test"),
        src.select(F.count(F.lit(1))).scalar().alias("n_total"))
    return ModelResult(pred, metrics, _importance_frame(spark, features, values, kind), model)


# ---------------------------------------------------------------------------
# classification
# ---------------------------------------------------------------------------

def classify(df: DataFrame, target: str, features: list[str], algorithm: str = "logreg",
             key: str | None = None, C: float = 1.0, n_estimators: int = 100,
             max_depth: int | None = None, hidden: int = 100, max_iter: int = 1000,
             n_neighbors: int = 5, seed: int = SEED) -> ModelResult:
    """logreg / rf / svm (linear kernel) / knn / dt / nb (Gaussian) / mlp.

    A numeric target with more than 5 distinct values is split at its
    median.  logreg, svm, knn and mlp see z-scored features; the tree
    models and naive Bayes see raw ones."""
    cols = features + [target]
    src = complete_rows(df, features).where(F.col(target).isNotNull())
    src = binarize_target(src.select(*([key] if key else []), *cols), target)
    require_rows(src, "classification")
    classes = [r[0] for r in src.select("label").distinct().orderBy("label").limit(10001).collect()]
    if len(classes) > 10000:
        raise ValueError("classification takes at most 10,000 classes")
    if len(classes) < 2:
        raise ValueError("classification needs at least two classes")
    train, test = (spread(d) for d in _split(src, key, cols))
    indexer = StringIndexer(inputCol="label", outputCol="label_idx",
                            stringOrderType="alphabetAsc").fit(src.select("label"))
    scaled = algorithm in ("logreg", "svm", "knn", "mlp")
    if scaled:
        stats = scaler_stats(train, features)
        fcols = [f"{c}__z" for c in features]
        prep = lambda d: assemble(indexer.transform(
            d.select("label", *scaled_cols(features, stats))), fcols)
    else:
        prep = lambda d: assemble(indexer.transform(
            d.select("label", *[F.col(c).cast("double") for c in features])), features)
    if algorithm == "knn":
        from attrix.ml.knn import knn_classify

        pred = knn_classify(train, test, features, "label", n_neighbors, key=key,
                            stats=scaler_stats(train, features))
        return _class_result(df.sparkSession, pred, None, features, None, src)
    to_label = IndexToString(inputCol="prediction", outputCol="pred_label",
                             labels=indexer.labels)
    if algorithm == "rf":
        model = forest.fit(indexer.transform(train), features, "label_idx", True, n_estimators, max_depth or 30,
                           math.ceil(math.sqrt(len(features))), seed)
        pred = to_label.transform(model.predict(test, ["label"])).select("label", F.col("pred_label").alias("prediction"))
        return _class_result(df.sparkSession, pred, model, features, indexer, src)
    tr = prep(train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = tr.count()
        k = len(classes)
        if algorithm == "logreg":
            est = LogisticRegression(labelCol="label_idx", regParam=1.0 / (C * n),
                                     elasticNetParam=0.0, standardization=False,
                                     maxIter=max_iter, tol=1e-10)
        elif algorithm == "svm":
            svc = LinearSVC(labelCol="label_idx", regParam=1.0 / (C * n), standardization=False,
                            maxIter=max_iter)
            est = svc if k == 2 else OneVsRest(classifier=svc, labelCol="label_idx",
                                               parallelism=min(k, 8))
        elif algorithm == "dt":
            est = DecisionTreeClassifier(labelCol="label_idx", maxDepth=max_depth or 5,
                                         impurity="gini", seed=seed)
        elif algorithm == "nb":
            est = NaiveBayes(labelCol="label_idx", modelType="gaussian")
        elif algorithm == "mlp":
            est = MultilayerPerceptronClassifier(labelCol="label_idx",
                                                 layers=[len(features), hidden, k],
                                                 maxIter=max_iter, seed=seed)
        else:
            raise ValueError(f"unknown classification algorithm {algorithm!r}")
        model = est.fit(tr)
    finally:
        tr.unpersist()
    pred = to_label.transform(model.transform(prep(test))).select(
        "label", F.col("pred_label").alias("prediction"))
    return _class_result(df.sparkSession, pred, model, features, indexer, src)


def _class_result(spark, pred, model, features, indexer, src) -> ModelResult:
    acc = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
                   F.count(F.lit(1)).alias("n_test"))
    metrics = acc.select("accuracy", "n_test",
                         src.select(F.count(F.lit(1))).scalar().alias("n_total"))
    imp = None
    if isinstance(model, forest.Forest):
        imp = _importance_frame(spark, features, model.importances(), "importance")
    elif model is not None and hasattr(model, "featureImportances"):
        imp = _importance_frame(spark, features, model.featureImportances.toArray(), "importance")
    elif model is not None and hasattr(model, "coefficientMatrix"):
        imp = _importance_frame(spark, features, model.coefficientMatrix.toArray()[0],
                                "coefficient")
    elif model is not None and hasattr(model, "coefficients"):
        imp = _importance_frame(spark, features, model.coefficients.toArray(), "coefficient")
    return ModelResult(pred, metrics, imp, model)


def report(result: ModelResult) -> DataFrame:
    return classification_report(result.predictions)


def confusion_matrix(result: ModelResult) -> DataFrame:
    return confusion(result.predictions)


# ---------------------------------------------------------------------------
# reduction
# ---------------------------------------------------------------------------

@dataclass
class PCAResult:
    variance: DataFrame   # component, variance_pct, cumulative_pct
    loadings: DataFrame   # feature, PC1..PCk
    scores: DataFrame     # keep + PC1..PCk


def pca(df: DataFrame, features: list[str], n_components: int = 2,
        keep: list[str] | None = None) -> PCAResult:
    """PCA of population z-scores.  ``n_components`` is capped by the
    number of features and rows.  Component signs are made deterministic:
    each loading vector's largest-magnitude entry is positive."""
    keep = list(keep or [])
    src = complete_rows(df, features)
    require_rows(src, "reduction")
    k = min(n_components, len(features), src.limit(n_components).count())
    stats = scaler_stats(src, features)
    X = assemble(src.select(*keep, *scaled_cols(features, stats)),
                 [f"{c}__z" for c in features])
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(X)
    pc = model.pc.toArray()            # d × k
    signs = []
    for j in range(k):
        col = pc[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    spark = df.sparkSession
    cum, rows = 0.0, []
    for j, r in enumerate(ratios):
        cum += r
        rows.append((f"PC{j + 1}", r * 100.0, cum * 100.0))
    variance = spark.createDataFrame(rows, "component string, variance_pct double, "
                                           "cumulative_pct double")
    load_rows = [(f, *[float(pc[i, j] * signs[j]) for j in range(k)])
                 for i, f in enumerate(features)]
    loadings = spark.createDataFrame(
        load_rows, "feature string, " + ", ".join(f"PC{j + 1} double" for j in range(k)))
    t = model.transform(X).withColumn("_pcs", vector_to_array(F.col("pcs")))
    scores = t.select(
        *keep, *[(F.col("_pcs")[j] * F.lit(signs[j])).alias(f"PC{j + 1}") for j in range(k)])
    return PCAResult(variance, loadings, scores)


def feature_importance(df: DataFrame, target: str, features: list[str],
                       n_estimators: int = 100, seed: int = SEED,
                       max_depth: int = 30) -> tuple[DataFrame, DataFrame]:
    """Random-forest importances on all complete rows (ascending, as drawn)
    and the training R²."""
    src = complete_rows(df, features + [target])
    require_rows(src, "reduction")
    X = spread(src.select(F.col(target).cast("double").alias("_label"), *features))
    model = forest.fit(X, features, "_label", False, n_estimators, max_depth, len(features), seed)
    spark = df.sparkSession
    imp = _importance_frame(spark, features, model.importances(), "importance", ascending=True)
    r2 = regression_metrics(model.predict(X.withColumnRenamed("_label", "label"), ["label"])).select(
        F.col("r2").alias("train_r2"), F.col("n").alias("rows"))
    return imp, r2


def silhouette_euclidean(labelled: DataFrame, features: list[str], cluster_col: str = "cluster",
                         reference: int | None = None, seed: int = SEED, scale: bool = True) -> DataFrame:
    """Euclidean silhouette (the reference's metric), noise (-1) removed, 0 with fewer
    than two clusters: ``silhouette, clusters, error, exact``.

    All pairs of rows are measured (``ml/silhouette.py``): ``exact``, error 0.  Only a caller
    that gives ``reference`` gets an estimate instead (:func:`_silhouette_estimate`)."""
    src = complete_rows(labelled, features).where(F.col(cluster_col) != -1)
    cols = scaled_cols(features, scaler_stats(src, features)) if scale else [F.col(c).cast("double") for c in features]
    zc = [f"z{i}" for i in range(len(features))]
    pts = src.select(F.col(cluster_col).cast("string").alias("c"), *[e.alias(z) for z, e in zip(zc, cols)])
    if reference is not None:
        return _silhouette_estimate(pts, zc, reference, seed)
    spark = labelled.sparkSession
    pts = stash(spread(pts), "silhouette")
    sizes = {r["c"]: r["n"] for r in pts.groupBy("c").agg(F.count("*").alias("n")).collect()}  # one row a cluster
    if len(sizes) < 2:
        return spark.createDataFrame([(0.0, len(sizes), 0.0, True)], "silhouette double, clusters long, error double, exact boolean")
    return silhouette_sums(pts, zc, sizes).select((F.col("total") / F.col("rows")).alias("silhouette"), F.lit(len(sizes)).cast("long").alias("clusters"),
                                                 F.lit(0.0).alias("error"), F.lit(True).alias("exact"))


def _silhouette_estimate(pts: DataFrame, zc: list[str], reference: int, seed: int) -> DataFrame:
    """Every row is scored against a seeded sample of at most ``reference`` rows a cluster
    (those of smallest hash; clusters x ``reference`` rows are broadcast, whatever the
    table's size), kept as eight blocks.  Clusters that fit into the sample are measured
    exactly, and with all of them the score is exact (``exact``, error 0); otherwise
    ``error`` is the standard error of the mean over the blocks' own scores.  A row's
    distance to itself is left out."""
    import pandas as pd

    from attrix.session import ship_package

    spark = pts.sparkSession
    ship_package(spark)
    pts = stash(spread(pts).withColumn("h", F.xxhash64(*zc, F.lit(seed))).withColumn("id", F.monotonically_increasing_id()), "silhouette")
    sizes = {r["c"]: r["n"] for r in pts.groupBy("c").agg(F.count("*").alias("n")).collect()}  # one row a cluster
    names = sorted(sizes)
    if len(names) < 2:
        return spark.createDataFrame([(0.0, len(names), 0.0, True)], "silhouette double, clusters long, error double, exact boolean")
    first = Window.partitionBy("c").orderBy("h", "id")
    sample = (pts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= reference)
              .select("c", "id", *zc).orderBy("c", "id").toPandas())  # clusters x reference rows
    place = {c: j for j, c in enumerate(names)}
    blocks = 8
    refs = [sample[sample["c"] == c] for c in names]
    shared = spark.sparkContext.broadcast([(r[zc].to_numpy(dtype=float), r["id"].to_numpy(dtype=np.int64)) for r in refs])
    n_of = np.array([sizes[c] for c in names], float)

    def score(q, own, ids, part):
        """Silhouettes of rows against the sample (``part``: one block of it, or None)."""
        mean = np.zeros((len(q), len(names)))
        alone = np.zeros(len(q), bool)
        for j, (x, xid) in enumerate(shared.value):
            at = slice(None) if part is None or len(x) < 2 * blocks else slice(part, None, blocks)
            x, xid = x[at], xid[at]
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1), 0.0))
            mine = (own == j)[:, None] & (ids[:, None] == xid[None, :])
            d[mine] = 0.0
            count = len(x) - mine.sum(1)
            alone |= (own == j) & ((count == 0) | (n_of[j] < 2))
            mean[:, j] = d.sum(1) / np.maximum(count, 1)
        rows = np.arange(len(q))
        a = mean[rows, own]
        mean[rows, own] = np.inf
        b = mean.min(1)
        return np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))

    def fn(batches):
        total = np.zeros(blocks + 2)
        for batch in batches:
            for lo in range(0, len(batch), 256):  # x reference: what a task holds at a time
                b = batch.iloc[lo:lo + 256]
                q, ids = b[zc].to_numpy(dtype=float), b["id"].to_numpy(dtype=np.int64)
                own = np.array([place[c] for c in b["c"]])
                total[0] += len(b)
                total[1] += score(q, own, ids, None).sum()
                if not exact:
                    total[2:] += [score(q, own, ids, k).sum() for k in range(blocks)]
        yield pd.DataFrame([total], columns=[f"t{i}" for i in range(blocks + 2)])

    exact = all(n <= reference for n in sizes.values())
    sums = pts.mapInPandas(fn, ", ".join(f"t{i} double" for i in range(blocks + 2))).agg(
        *[F.sum(f"t{i}").alias(f"t{i}") for i in range(blocks + 2)])
    each = [F.col(f"t{i}") / F.col("t0") for i in range(2, blocks + 2)]
    middle = sum(each, F.lit(0.0)) / blocks
    deviation = F.sqrt(sum(((e - middle) * (e - middle) for e in each), F.lit(0.0)) / (blocks - 1) / blocks)
    return sums.select((F.col("t1") / F.col("t0")).alias("silhouette"), F.lit(len(names)).cast("long").alias("clusters"),
                       (F.lit(0.0) if exact else deviation).alias("error"), F.lit(exact).alias("exact"))
