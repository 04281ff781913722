"""Registered queries: SQL-checkable model plumbing and forecast features."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from attrix.forecast import prepare as FP
from attrix.ml import basics as B
from attrix.plans.common import finalize, rounded_sql, table

Z_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
def _li_keyed(s, sf):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return table(s, sf, "lineitem").withColumn("row_key", key)


def rule_predictions(s, sf):
    """Deterministic rule as the classifier (never predicts 'R')."""
    li = table(s, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("label"),
                     F.when(F.col("l_discount") >= 0.05, "A").otherwise("N").alias("prediction"))


def _ols(s, sf):
    li = _li_keyed(s, sf)
    train, test = B.train_test_split(li, "row_key")
    va = VectorAssembler(inputCols=["l_quantity"], outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="l_extendedprice", regParam=0.0,
                          solver="normal", standardization=False)
    model = lr.fit(va.transform(train))
    return model, va, test


def q_linreg_ols(s, sf):
    model, _, _ = _ols(s, sf)
    rows = [("intercept", float(model.intercept)), ("l_quantity", float(model.coefficients[0]))]
    return finalize(s.createDataFrame(rows, "term string, coefficient double"))


def q_reg_metrics(s, sf):
    model, va, test = _ols(s, sf)
    pred = model.transform(va.transform(test)).select(
        F.col("l_extendedprice").alias("label"), "prediction")
    return finalize(B.regression_metrics(pred))


def _emb(s, sf, k=4):
    e = table(s, sf, "embeddings")
    return e.select("vec_id", "label",
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(k)])


QUERIES = {
    "zscale": lambda s, sf: finalize(B.zscale(table(s, sf, "lineitem"), Z_FEATURES,
                                              keep=["l_orderkey", "l_linenumber"]), 6),
    "split": lambda s, sf: B.with_split(table(s, sf, "orders").select("o_orderkey"), "o_orderkey"),
    "zscore_anomaly": lambda s, sf: finalize(B.zscore_anomalies(
        table(s, sf, "lineitem"), Z_FEATURES, 3.0, keep=["l_orderkey", "l_linenumber"]), 6),
    "anomaly_summary": lambda s, sf: finalize(B.anomaly_summary(
        B.zscore_anomalies(table(s, sf, "lineitem"), Z_FEATURES, 3.0), table(s, sf, "lineitem"))),
    "binarize": lambda s, sf: B.binarize_target(table(s, sf, "part"), "p_size").select(
        "p_partkey", "label"),
    "linreg_ols": q_linreg_ols,
    "reg_metrics": q_reg_metrics,
    "accuracy": lambda s, sf: finalize(B.accuracy(rule_predictions(s, sf))),
    "confusion": lambda s, sf: B.confusion(rule_predictions(s, sf)),
    "class_report": lambda s, sf: finalize(B.classification_report(rule_predictions(s, sf))),
    "cluster_stats": lambda s, sf: finalize(B.cluster_stats(
        _emb(s, sf, 64), "label", [f"e{i}" for i in range(64)], decimals=None)),
    "ts_prepare": lambda s, sf: finalize(FP.prepare_series(table(s, sf, "orders"), "o_orderdate",
                                                           "o_totalprice")),
    "ts_prepare_multi": lambda s, sf: finalize(FP.prepare_series(
        table(s, sf, "events"), "ts", "value", ["event_type"])),
    "ts_features": lambda s, sf: finalize(FP.feature_table(FP.prepare_series(
        table(s, sf, "events"), "ts", "value", ["event_type"]), ["event_type"])),
    "future_calendar": lambda s, sf: FP.future_calendar(FP.prepare_series(
        table(s, sf, "events"), "ts", "value", ["event_type"]), 30, ["event_type"]),
}

# ---------------------------------------------------------------------------
# DuckDB twins
# ---------------------------------------------------------------------------


def report_sql(predictions: str) -> str:
    """The classification report of a table expression with ``label, prediction``."""
    return rounded_sql(f"""
WITH r AS {predictions},
     k AS (SELECT DISTINCT label AS cls FROM r UNION SELECT DISTINCT prediction FROM r),
     s AS (SELECT cls,
             count_if(r.label = cls AND r.prediction = cls) AS tp,
             count_if(r.prediction = cls) AS pn,
             count_if(r.label = cls) AS support FROM k, r GROUP BY cls),
     m AS (SELECT cls, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS precision,
                  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
                  support, tp FROM s),
     f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall
                  / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT cls AS class, precision, recall, f1, support::BIGINT AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, SUM(tp) / SUM(support), SUM(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), SUM(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support),
       SUM(recall * support) / SUM(support), SUM(f1 * support) / SUM(support),
       SUM(support)::BIGINT FROM f""", ["precision", "recall", "f1"])


def _z_sql(keep):
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in Z_FEATURES)
    zs = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}_z"
                   for c in Z_FEATURES)
    nn = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in Z_FEATURES)
    return (f"WITH src AS (SELECT * FROM lineitem WHERE {nn}), st AS (SELECT {stats} FROM src) "
            f"SELECT {', '.join(keep)}{', ' if keep else ''}{zs} FROM src, st")


SPLIT_SQL = "(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 5)"
LI_KEY_SQL = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
RULE_SQL = ("(SELECT l_returnflag AS label, CASE WHEN l_discount >= 0.05 THEN 'A' ELSE 'N' END "
            "AS prediction FROM lineitem)")

_maxz = "greatest(" + ", ".join(f"abs({c}_z)" for c in Z_FEATURES) + ")"
_ols_fit = (f"(SELECT regr_slope(l_extendedprice, l_quantity) AS b, "
            f"regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem "
            f"WHERE {SPLIT_SQL.format(k=LI_KEY_SQL)} <> 0)")

ORACLE = {
    "zscale": rounded_sql(_z_sql(["l_orderkey", "l_linenumber"]), [f"{c}_z" for c in Z_FEATURES],
                          6),
    "split": f"SELECT o_orderkey, {SPLIT_SQL.format(k='o_orderkey')} = 0 AS is_test FROM orders",
    "zscore_anomaly": rounded_sql(
        f"SELECT l_orderkey, l_linenumber, {', '.join(Z_FEATURES)}, {_maxz} AS max_abs_z, "
        f"-{_maxz} AS score, {_maxz} > 3.0 AS is_anomaly FROM ({_z_sql(['l_orderkey', 'l_linenumber'] + Z_FEATURES)}) "
        f"AS z(l_orderkey, l_linenumber, {', '.join(Z_FEATURES)}, "
        f"{', '.join(c + '_z' for c in Z_FEATURES)})",
        Z_FEATURES + ["max_abs_z", "score"], 6),
    "anomaly_summary": rounded_sql(
        f"SELECT count_if({_maxz} > 3.0)::BIGINT AS anomalies, (SELECT count(*) FROM lineitem) AS rows, "
        f"count_if({_maxz} > 3.0) / (SELECT count(*) FROM lineitem) * 100 AS anomaly_pct "
        f"FROM ({_z_sql([])})", ["anomaly_pct"]),
    "binarize": """SELECT p_partkey, CASE WHEN (SELECT count(DISTINCT p_size) FROM part) > 5
        THEN CAST((p_size > (SELECT quantile_cont(p_size, 0.5) FROM part))::INT AS VARCHAR)
        ELSE CAST(p_size AS VARCHAR) END AS label FROM part""",
    "linreg_ols": rounded_sql(f"SELECT 'intercept' AS term, a AS coefficient FROM {_ols_fit} "
                              f"UNION ALL SELECT 'l_quantity', b FROM {_ols_fit}",
                              ["coefficient"]),
    "reg_metrics": rounded_sql(f"""
WITH t AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem, {_ols_fit} f
           WHERE {SPLIT_SQL.format(k=LI_KEY_SQL)} = 0)
SELECT 1 - SUM((y - p) * (y - p)) / NULLIF(SUM((y - (SELECT avg(y) FROM t)) *
                                              (y - (SELECT avg(y) FROM t))), 0) AS r2,
       sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, count(*) AS n FROM t""",
        ["r2", "rmse", "mae"]),
    "accuracy": rounded_sql(f"SELECT avg((label = prediction)::INT::DOUBLE) AS accuracy "
                            f"FROM {RULE_SQL}", ["accuracy"]),
    "confusion": f"""
WITH c AS (SELECT DISTINCT label AS v FROM {RULE_SQL} UNION SELECT DISTINCT prediction FROM {RULE_SQL}),
     n AS (SELECT label, prediction, count(*) AS cnt FROM {RULE_SQL} GROUP BY ALL)
SELECT a.v AS label, b.v AS prediction, COALESCE(cnt, 0)::BIGINT AS count
FROM c a CROSS JOIN c b LEFT JOIN n ON n.label = a.v AND n.prediction = b.v""",
    "class_report": report_sql(RULE_SQL),
    "cluster_stats": rounded_sql(" UNION ALL ".join(
        f"SELECT label AS cluster, 'e{i}' AS feature, avg(embedding[{i + 1}]::DOUBLE) AS mean, "
        f"stddev_samp(embedding[{i + 1}]::DOUBLE) AS std, count(embedding[{i + 1}]) AS count "
        f"FROM embeddings GROUP BY label" for i in range(64)), ["mean", "std"]),
}


def _prep_sql(tbl, dcol, metric, key=None):
    k = f"{key}, " if key else ""
    kk = f"CAST({key} AS VARCHAR) AS {key}, " if key else ""
    part = f"PARTITION BY g.{key} " if key else ""
    nn = f" AND {key} IS NOT NULL" if key else ""
    return f"""
WITH s AS (SELECT {kk}{dcol}::DATE AS date, COALESCE(SUM({metric}), 0)::DOUBLE AS y FROM {tbl}
           WHERE {dcol} IS NOT NULL{nn} GROUP BY ALL),
     b AS (SELECT {k}min(date) AS lo, max(date) AS hi FROM s GROUP BY ALL),
     g AS (SELECT {k}unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM b)
SELECT {('g.' + key + ', ') if key else ''}g.date, last_value(s.y IGNORE NULLS) OVER ({part}ORDER BY g.date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
FROM g LEFT JOIN s ON g.date = s.date{(' AND g.' + key + ' = s.' + key) if key else ''}"""


_feat_cols = (["lag_%d" % i for i in range(1, 8)]
              + ["rolling_mean_7", "rolling_std_7", "expanding_mean", "diff_1", "diff_7"])
ORACLE["ts_prepare"] = rounded_sql(_prep_sql("orders", "o_orderdate", "o_totalprice"), ["y"])
ORACLE["ts_prepare_multi"] = rounded_sql(_prep_sql("events", "ts", "value", "event_type"), ["y"])
ORACLE["ts_features"] = rounded_sql(f"""
SELECT * FROM (
  SELECT event_type, date, y, (isodow(date) - 1)::INTEGER AS dayofweek,
         month(date)::INTEGER AS month, day(date)::INTEGER AS day, year(date)::INTEGER AS year,
         {', '.join(f'lag(y, {i}) OVER w AS lag_{i}' for i in range(1, 8))},
         avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean_7,
         stddev_samp(y) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_std_7,
         avg(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS expanding_mean,
         y - lag(y, 1) OVER w AS diff_1, y - lag(y, 7) OVER w AS diff_7
  FROM ({_prep_sql("events", "ts", "value", "event_type")}) AS p
  WINDOW w AS (PARTITION BY event_type ORDER BY date))
WHERE {' AND '.join(f'{c} IS NOT NULL AND NOT isnan({c})' for c in _feat_cols)}""",
    ["y"] + _feat_cols)
ORACLE["future_calendar"] = """
SELECT event_type, step::INTEGER AS step, (last + step * INTERVAL 1 DAY)::DATE AS date
FROM (SELECT CAST(event_type AS VARCHAR) AS event_type, max(ts::DATE) AS last FROM events
      WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
     unnest(generate_series(1, 30)) AS t(step)"""
