"""Registered queries: MLlib-backed models (rows-only checks: model output
is not expressible in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrix.ml import isoforest
from attrix.ml import models as M
from attrix.ml.basics import anomaly_summary
from attrix.operators.normality import shapiro_wilk
from attrix.plans.common import finalize, rounded_sql, table
from attrix.plans.q_ml_basic import report_sql

PART_F = ["p_size", "p_retailprice"]
CUST_F = ["c_acctbal", "c_nationkey"]
EMB_N = 64


def emb(s, sf, n=EMB_N):
    e = table(s, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


EMB_F = [f"e{i}" for i in range(EMB_N)]


def _kmeans(s, sf):
    r = M.cluster(table(s, sf, "customer"), CUST_F, "kmeans", k=3, keep=["c_custkey"])
    return finalize(r.labelled)


def _bisecting(s, sf):
    r = M.cluster(table(s, sf, "customer"), CUST_F, "bisecting", k=3, keep=["c_custkey"])
    return finalize(r.labelled)


def _silhouette(s, sf):
    r = M.cluster(table(s, sf, "part"), PART_F, "kmeans", k=3, keep=["p_partkey"], restarts=10)
    return finalize(M.silhouette(r.labelled, PART_F))


def _reg(alg, **kw):
    def q(s, sf):
        li = table(s, sf, "lineitem").withColumn(
            "row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
        r = M.regress(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], alg,
                      key="row_key", **kw)
        return finalize(r.metrics, 6)
    return q


def _reg_importance(alg, **kw):
    def q(s, sf):
        li = table(s, sf, "lineitem").withColumn(
            "row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
        r = M.regress(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], alg,
                      key="row_key", **kw)
        return finalize(r.importance, 6)
    return q


def _clf(alg, **kw):
    def q(s, sf):
        r = M.classify(emb(s, sf), "label", EMB_F, alg, key="vec_id", **kw)
        return finalize(M.report(r))
    return q


def _knn_predictions(s, sf):
    """Every held-out vector with its vote among the five nearest, key by key."""
    from attrix.ml.basics import train_test_split
    from attrix.ml.knn import knn_classify

    train, test = train_test_split(emb(s, sf), "vec_id")
    return knn_classify(train, test, EMB_F, "label", 5, "vec_id", M.scaler_stats(train, EMB_F))


def _pca(s, sf):
    return finalize(M.pca(emb(s, sf), EMB_F, 3).variance)


def _pca_loadings(s, sf):
    return finalize(M.pca(emb(s, sf), EMB_F, 3).loadings)


def _feat_importance(s, sf):
    imp, _ = M.feature_importance(table(s, sf, "part"), "p_retailprice", ["p_size", "p_partkey"])
    return finalize(imp)


def _dbscan(s, sf):
    from attrix.ml.dbscan import dbscan

    return finalize(dbscan(table(s, sf, "customer"), CUST_F, eps=0.5, min_samples=5,
                           keep=["c_custkey"]))


def _dbscan_partition(s, sf):
    """The clustering without its numbering: each core point with the smallest
    key of its cluster's core points, and which other points are noise."""
    d = _dbscan(s, sf).select("c_custkey", "cluster", "is_core")
    first = d.where("is_core").groupBy("cluster").agg(F.min("c_custkey").alias("first_core"))
    return d.join(first, "cluster", "left").select(
        "c_custkey", "is_core", (F.col("cluster") == -1).alias("is_noise"),
        F.when(F.col("is_core"), F.col("first_core")).alias("first_core"))


def _iso(s, sf):
    return isoforest.isolation_forest(table(s, sf, "customer"), CUST_F, 0.05, keep=["c_custkey"])


def _iso_threshold(s, sf):
    """How many rows the contamination's quantile must have below it at most, and up to
    it at least, and whether the anomalies and the rest are on their sides."""
    scored = _iso(s, sf)
    at = F.floor(F.lit(0.05) * (F.col("rows") - 1)).cast("long")
    return scored.agg(F.count("*").alias("rows"), F.count_if("is_anomaly").alias("low"),
                      F.count_if(F.col("decision") <= 0).alias("upto"),
                      F.count_if(F.col("is_anomaly") != (F.col("decision") < 0)).alias("wrong")).select(
        "rows", at.alias("rank"), (F.col("low") <= at + 1).alias("low_fits"),
        ((F.col("upto") >= at + 1) | (F.col("low") == at + 1)).alias("upto_fits"), "wrong")


QUERIES = {
    "shapiro": lambda s, sf: finalize(shapiro_wilk(table(s, sf, "part"), "p_retailprice")),
    "shapiro_lineitem": lambda s, sf: finalize(shapiro_wilk(table(s, sf, "lineitem"),
                                                            "l_extendedprice")),
    "isoforest": lambda s, sf: finalize(_iso(s, sf)),
    "isoforest_summary": lambda s, sf: finalize(anomaly_summary(_iso(s, sf),
                                                                table(s, sf, "customer"))),
    "kmeans": _kmeans,
    "dbscan": lambda s, sf: _dbscan(s, sf),
    "dbscan_partition": _dbscan_partition,
    "silhouette_euclidean": lambda s, sf: finalize(M.silhouette_euclidean(
        M.cluster(table(s, sf, "part"), PART_F, "kmeans", k=3, keep=["p_partkey"],
                  restarts=10).labelled, PART_F)),
    "silhouette_labels": lambda s, sf: finalize(M.silhouette_euclidean(emb(s, sf), EMB_F, "label"), 6),
    "isoforest_threshold": _iso_threshold,
    "bisecting": _bisecting,
    "silhouette": _silhouette,
    "linreg": _reg("linear"),
    "ridge": _reg("ridge", alpha=1.0),
    "ridge_coef": _reg_importance("ridge", alpha=1.0),
    "rf_reg": _reg("rf", n_estimators=100, max_depth=10),
    "gbt_reg": _reg("gbt", n_estimators=100, learning_rate=0.1),
    "logreg": _clf("logreg", C=1.0),
    "rf_clf": _clf("rf", n_estimators=100),
    "svm_linear": _clf("svm", C=1.0, max_iter=1000),
    "knn": _clf("knn", n_neighbors=5),
    "knn_predictions": _knn_predictions,
    "dt_clf": _clf("dt", max_depth=5),
    "nb": _clf("nb"),
    "mlp_clf": _clf("mlp", hidden=50, max_iter=1000),
    "pca": _pca,
    "pca_loadings": _pca_loadings,
    "pca_scores": lambda s, sf: finalize(M.pca(emb(s, sf), EMB_F, 3, keep=["vec_id"]).scores, 6),
    "feat_importance": _feat_importance,
    "feat_importance_r2": lambda s, sf: finalize(M.feature_importance(
        table(s, sf, "part"), "p_retailprice", ["p_size", "p_partkey"])[1]),
}
#: All pairs of held-out and training vectors, z-scored by the training rows.
KNN_SQL = """(
WITH e AS (SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS v,
                  ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 5 AS b FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))) = 64),
u AS (SELECT vec_id, b, i, v[i] AS x FROM e, range(1, 65) t(i)),
st AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM u WHERE b <> 0 GROUP BY i),
z AS (SELECT vec_id, list((x - m) / s ORDER BY i) AS z FROM u JOIN st USING (i) GROUP BY vec_id),
f AS (SELECT e.vec_id, label, b, z.z FROM e JOIN z USING (vec_id)),
n AS (SELECT q.vec_id, q.label, r.label AS near, row_number() OVER (
          PARTITION BY q.vec_id ORDER BY list_distance(q.z, r.z), r.label) AS k
      FROM f q JOIN f r ON q.b = 0 AND r.b <> 0 QUALIFY k <= 5),
votes AS (SELECT vec_id, label, near, count(*) AS c FROM n GROUP BY ALL)
SELECT vec_id, label, arg_min(near, [-c::VARCHAR::DOUBLE, r]) AS prediction
FROM (SELECT *, (rank() OVER (ORDER BY near))::DOUBLE AS r FROM votes) GROUP BY vec_id, label)"""

#: Mean silhouette of the labels: z-scores, all pairs.
SILHOUETTE_SQL = """
WITH e AS (SELECT row_number() OVER () AS id, label, embedding::DOUBLE[] AS v FROM embeddings
           WHERE label <> -1 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))) = 64),
u AS (SELECT id, label, i, v[i] AS x FROM e, range(1, 65) t(i)),
st AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM u GROUP BY i),
z AS (SELECT id, label, list((x - m) / s ORDER BY i) AS z FROM u JOIN st USING (i) GROUP BY id, label),
d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.z, b.z)) AS total, count(*) AS n
      FROM z a JOIN z b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, max(CASE WHEN label = other THEN total / n END) AS a, min(CASE WHEN label <> other THEN total / n END) AS b
      FROM d GROUP BY id)
SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette,
       (SELECT count(DISTINCT label) FROM e) AS clusters, 0.0::DOUBLE AS error, true AS exact FROM s"""


def linear_sql(features: list[str], target: str, ridge: float | None = None) -> str:
    """``f``: the least-squares fit of the training rows of lineitem by elimination of the
    normal equations (``ridge``: z-scored features and a penalty on their weights)."""
    from attrix.plans.q_ml_basic import LI_KEY_SQL, SPLIT_SQL

    k = len(features)
    rows = f"r AS (SELECT *, {SPLIT_SQL.format(k=LI_KEY_SQL)} AS b FROM lineitem)"
    stats = ", ".join(f"avg({c}) AS m{i}, {f'stddev_pop({c})' if ridge is not None else '1.0'} AS s{i}" for i, c in enumerate(features))
    zs = ", ".join(f"({c} - m{i}) / s{i} AS x{i}" for i, c in enumerate(features))
    parts = [rows, f"st AS (SELECT {stats}, avg({target}) AS my FROM r WHERE b <> 0)",
             f"z AS (SELECT b, {target} - my AS y, {zs}, my FROM r, st)"]
    cells = [f"sum(x{i} * x{j}) + {(ridge or 0) if i == j else 0} AS a0_{i}_{j}" for i in range(k) for j in range(k)]
    cells += [f"sum(x{i} * y) AS a0_{i}_{k}" for i in range(k)]
    parts.append(f"e0 AS (SELECT {', '.join(cells)} FROM z WHERE b <> 0)")
    for p in range(k):  # Gauss-Jordan
        cells = [(f"a{p}_{i}_{j} / a{p}_{p}_{p}" if i == p else f"a{p}_{i}_{j} - a{p}_{i}_{p} * a{p}_{p}_{j} / a{p}_{p}_{p}")
                 + f" AS a{p + 1}_{i}_{j}" for i in range(k) for j in range(k + 1)]
        parts.append(f"e{p + 1} AS (SELECT {', '.join(cells)} FROM e{p})")
    weights = ", ".join(f"a{k}_{i}_{k} AS w{i}" for i in range(k))
    return f"{', '.join(parts)}, f AS (SELECT {weights} FROM e{k})"


def regression_sql(features: list[str], target: str, ridge: float | None = None) -> str:
    guess = " + ".join(f"w{i} * x{i}" for i in range(len(features)))
    return rounded_sql(f"""WITH {linear_sql(features, target, ridge)},
t AS (SELECT y + my AS y, my + {guess} AS p FROM z, f WHERE b = 0)
SELECT 1 - sum((y - p) ** 2) / nullif(sum((y - (SELECT avg(y) FROM t)) ** 2), 0) AS r2, sqrt(avg((y - p) ** 2)) AS rmse,
       avg(abs(y - p)) AS mae, count(*) AS n_test, (SELECT count(*) FROM lineitem) AS n_total FROM t""", ["r2", "rmse", "mae"], 6)


LI_F = ["l_quantity", "l_discount", "l_tax"]
#: Gaussian naive Bayes: class priors, means and variances with a small addition, then the largest posterior.
NB_SQL = """(
WITH e AS (SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS v,
                  ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 5 AS b FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))) = 64),
u AS (SELECT vec_id, label, b, i, v[i] AS x FROM e, range(1, 65) t(i)),
eps AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(x) AS s FROM u WHERE b <> 0 GROUP BY i)),
c AS (SELECT label, i, avg(x) AS m, var_pop(x) + (SELECT e FROM eps) AS s FROM u WHERE b <> 0 GROUP BY label, i),
pr AS (SELECT label, ln(count(*)) AS p FROM e WHERE b <> 0 GROUP BY label),
l AS (SELECT u.vec_id, u.label, c.label AS guess, sum(-0.5 * ln(2 * pi() * s) - (x - m) ** 2 / (2 * s)) + any_value(p) AS score
      FROM u JOIN c USING (i) JOIN pr ON pr.label = c.label WHERE b = 0 GROUP BY ALL)
SELECT vec_id, label, arg_max(guess, score) AS prediction FROM l GROUP BY vec_id, label)"""

ORACLE: dict = {
    "silhouette_labels": rounded_sql(SILHOUETTE_SQL, ["silhouette", "error"], 6),
    "isoforest_threshold": "SELECT count(*) AS rows, floor(0.05 * (count(*) - 1))::BIGINT AS rank, true AS low_fits, "
                           "true AS upto_fits, 0::BIGINT AS wrong FROM customer",
    "linreg": regression_sql(LI_F, "l_extendedprice"),
    "ridge": regression_sql(LI_F, "l_extendedprice", 1.0),
    "ridge_coef": rounded_sql(f"WITH {linear_sql(LI_F, 'l_extendedprice', 1.0)} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, w{i} AS coefficient FROM f" for i, c in enumerate(LI_F)), ["coefficient"], 6),
    "nb": report_sql(NB_SQL),
    "knn_predictions": f"SELECT * FROM {KNN_SQL}",
    "knn": report_sql(KNN_SQL),
    "dbscan_partition": """
WITH RECURSIVE st AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mn,
                             stddev_pop(c_nationkey) AS sn FROM customer),
z AS (SELECT c_custkey AS k, (c_acctbal - ma) / sa AS x, (c_nationkey - mn) / sn AS y FROM customer, st),
near AS (SELECT a.k AS a, b.k AS b FROM z a JOIN z b
         ON b.y BETWEEN a.y - 0.5 AND a.y + 0.5 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.25),
core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 5),
link AS (SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
r AS (SELECT k AS a, k AS b FROM core UNION SELECT r.a, link.b FROM r JOIN link ON link.a = r.b),
f AS (SELECT a AS k, min(b) AS first_core FROM r GROUP BY a),
side AS (SELECT DISTINCT a AS k FROM near WHERE b IN (SELECT k FROM core))
SELECT z.k AS c_custkey, core.k IS NOT NULL AS is_core, side.k IS NULL AS is_noise, f.first_core
FROM z LEFT JOIN core ON core.k = z.k LEFT JOIN f ON f.k = z.k LEFT JOIN side ON side.k = z.k
""",
}
