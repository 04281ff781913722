"""Registered queries: overview, trend, chart data, statistics, cleaning,
formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrix.functions.exprs import pct_format, pp_format, signed_format, smart_format
from attrix.operators import charts, cleaning, overview, stats, trend
from attrix.plans.common import finalize, rounded_sql, table

LI_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _ov(unit, tbl, col, metrics):
    def q(spark, sf):
        return finalize(overview.period_series(table(spark, sf, tbl), col, metrics, unit))
    return q


def dirty_orders(spark, sf):
    """Orders with planted gaps and copies (the fixture tables have no NULLs):
    NULL customer on status 'P', NULL price on priority '3-MEDIUM', NULL
    status on priority '4-NOT SPECIFIED', an all-NULL column, and every
    '1-URGENT' order twice."""
    o = table(spark, sf, "orders")
    planted = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", None)
        .otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", None)
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
        F.lit(None).cast("string").alias("o_comment"),
    )
    return planted.unionByName(planted.where(F.col("o_orderpriority") == "1-URGENT"))


DIRTY_SQL = """(SELECT o_orderkey,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderstatus END
            AS o_orderstatus,
        CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice END AS o_totalprice,
        o_orderdate, o_orderpriority, CAST(NULL AS VARCHAR) AS o_comment
    FROM orders
    UNION ALL
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END,
        o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, CAST(NULL AS VARCHAR)
    FROM orders WHERE o_orderpriority = '1-URGENT')"""

QUERIES = {
    "overview_day": _ov("day", "lineitem", "l_shipdate", LI_METRICS[:3]),
    "overview_week": _ov("week", "orders", "o_orderdate", ["o_totalprice"]),
    "overview_month": _ov("month", "orders", "o_orderdate", ["o_totalprice"]),
    "overview_year": _ov("year", "lineitem", "l_shipdate", LI_METRICS),
    "overview_latest_counts": lambda s, sf: overview.latest_value_counts(
        table(s, sf, "orders"), "o_orderdate", ["o_orderstatus", "o_orderpriority"]),
    "overview_latest_counts_events": lambda s, sf: overview.latest_value_counts(
        table(s, sf, "events"), "ts", ["event_type"]),
    "overview_dim_summary": lambda s, sf: finalize(overview.latest_dim_summary(
        table(s, sf, "events"), "ts", "event_type", "value")),
    "preview": lambda s, sf: finalize(overview.preview(table(s, sf, "orders"), ["o_orderkey"])),
    "data_summary": lambda s, sf: overview.data_summary(table(s, sf, "orders"), "o_orderdate"),
    "trend_total": lambda s, sf: finalize(trend.trend_series(table(s, sf, "events"), "ts", "value")),
    "trend_by_dim": lambda s, sf: finalize(
        trend.trend_series(table(s, sf, "events"), "ts", "value", "event_type")),
    "trend_growth": lambda s, sf: finalize(
        trend.trend_growth(table(s, sf, "events"), "ts", "value", "event_type")),
    "bar_top20": lambda s, sf: finalize(charts.bar_top(table(s, sf, "part"), "p_brand",
                                                       "p_retailprice", 20)),
    "pie_top10": lambda s, sf: finalize(charts.pie_top(table(s, sf, "part"), ["p_brand"],
                                                       "p_retailprice", 10)),
    "box_summary": lambda s, sf: finalize(charts.box_summary(table(s, sf, "part"),
                                                             "p_retailprice", "p_type")),
    "box_summary_parts": lambda s, sf: finalize(charts.box_summary(table(s, sf, "lineitem"),
                                                                   "l_extendedprice", "l_partkey"), 11),
    "box_summary_all": lambda s, sf: finalize(charts.box_summary(table(s, sf, "lineitem"),
                                                                 "l_extendedprice")),
    "scatter_ols": lambda s, sf: finalize(charts.scatter_ols(
        table(s, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")),
    "scatter_ols_all": lambda s, sf: finalize(charts.scatter_ols(
        table(s, sf, "lineitem"), "l_extendedprice", "l_discount")),
    "line_series": lambda s, sf: finalize(charts.line_series(
        table(s, sf, "orders"), "o_totalprice", "o_orderkey", "o_orderstatus")),
    "corr_matrix": lambda s, sf: finalize(charts.corr_matrix(table(s, sf, "lineitem"), LI_METRICS)),
    "describe": lambda s, sf: finalize(stats.describe(table(s, sf, "lineitem"),
                                                      LI_METRICS + ["l_linenumber"])),
    "missing": lambda s, sf: cleaning.missing_counts(dirty_orders(s, sf)),
    "missing_total": lambda s, sf: cleaning.missing_total(dirty_orders(s, sf)),
    "duplicates": lambda s, sf: cleaning.duplicate_count(dirty_orders(s, sf)),
    "fill_mean": lambda s, sf: finalize(cleaning.fill_mean(dirty_orders(s, sf),
                                                           ["o_custkey", "o_totalprice"])),
    "fill_mode": lambda s, sf: finalize(cleaning.fill_mode(dirty_orders(s, sf),
                                                           ["o_orderstatus", "o_comment"])),
    "mode_values": lambda s, sf: cleaning.mode_values(
        table(s, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_tax"]),
    "dedupe": lambda s, sf: finalize(cleaning.dedupe(dirty_orders(s, sf))),
    "dedupe_report": lambda s, sf: cleaning.dedupe_report(dirty_orders(s, sf)),
    "drop_null_cols": lambda s, sf: finalize(cleaning.drop_null_columns(dirty_orders(s, sf))[0]),
    "smart_format": lambda s, sf: table(s, sf, "orders").groupBy("o_orderpriority").agg(
        smart_format(F.sum("o_totalprice")).alias("total_fmt"),
        smart_format(F.avg("o_totalprice") / 1000).alias("mean_k_fmt"),
        pct_format(F.count(F.lit(1)) / 150.0).alias("share_fmt"),
    ),
    "change_formats": lambda s, sf: table(s, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        pp_format(F.count("*") / 64.0 - 3).alias("points_fmt"),
        signed_format(F.avg("o_totalprice") - 150_000).alias("change_fmt"),
    ),
}


def _in(col, start, end):
    return f"({col} >= TIMESTAMP '{start}' AND {col} < TIMESTAMP '{end}' + INTERVAL 1 DAY)"


def _ov_sql(unit, tbl, col, metrics):
    if unit == "day":
        key = f"{col}::DATE"
    elif unit == "week":
        wk = f"date_trunc('week', {col})::DATE"
        key = f"strftime({wk}, '%Y-%m-%d') || '/' || strftime({wk} + 6, '%Y-%m-%d')"
    elif unit == "month":
        key = f"strftime({col}, '%Y-%m')"
    else:
        key = f"strftime({col}, '%Y')"
    sums = ", ".join(f"COALESCE(SUM({m}), 0)::DOUBLE AS {m}" for m in metrics)
    return rounded_sql(
        f"SELECT {key} AS period, {sums} FROM {tbl} WHERE {col} IS NOT NULL GROUP BY 1", metrics)


LATEST = lambda tbl, col: (
    f"(SELECT * FROM {tbl} WHERE {col}::DATE = (SELECT max({col}::DATE) FROM {tbl}))")


def _latest_counts_sql(tbl, col, dims):
    parts = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM {LATEST(tbl, col)}"
        for d in dims)
    return f"""SELECT * FROM (
  SELECT dimension, value, count(*) AS count,
         row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS rank
  FROM ({parts}) WHERE value IS NOT NULL GROUP BY dimension, value) WHERE rank <= 8"""


DIRTY_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority", "o_comment"]

ORACLE = {
    "overview_day": _ov_sql("day", "lineitem", "l_shipdate", LI_METRICS[:3]),
    "overview_week": _ov_sql("week", "orders", "o_orderdate", ["o_totalprice"]),
    "overview_month": _ov_sql("month", "orders", "o_orderdate", ["o_totalprice"]),
    "overview_year": _ov_sql("year", "lineitem", "l_shipdate", LI_METRICS),
    "overview_latest_counts": _latest_counts_sql("orders", "o_orderdate",
                                                 ["o_orderstatus", "o_orderpriority"]),
    "overview_latest_counts_events": _latest_counts_sql("events", "ts", ["event_type"]),
    "overview_dim_summary": rounded_sql(f"""
WITH l AS {LATEST('events', 'ts')}
SELECT CAST(event_type AS VARCHAR) AS value, COALESCE(SUM(value), 0.0) AS sum, AVG(value) AS mean,
       COUNT(value) AS count, FALSE AS is_total,
       row_number() OVER (ORDER BY COALESCE(SUM(value), 0.0) DESC, CAST(event_type AS VARCHAR))
           AS rank
FROM l WHERE event_type IS NOT NULL GROUP BY event_type
UNION ALL
SELECT '【总计】', COALESCE(SUM(CASE WHEN event_type IS NOT NULL THEN value END), 0.0), AVG(value),
       COUNT(CASE WHEN event_type IS NOT NULL THEN value END), TRUE, 0::BIGINT FROM l
""", ["sum", "mean"]),
    "preview": rounded_sql("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50", ["o_totalprice"]),
    "data_summary": "SELECT count(*) AS rows, count(DISTINCT o_orderdate) AS days, "
                    "6 AS columns FROM orders",
    "trend_total": rounded_sql("SELECT ts::DATE AS date, COALESCE(SUM(value), 0.0) AS value "
                               "FROM events WHERE ts IS NOT NULL GROUP BY 1", ["value"]),
    "trend_by_dim": rounded_sql(
        "SELECT ts::DATE AS date, CAST(event_type AS VARCHAR) AS event_type, "
        "COALESCE(SUM(value), 0.0) AS value FROM events "
        "WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2", ["value"]),
    "trend_growth": rounded_sql("""
WITH s AS (SELECT ts::DATE AS date, CAST(event_type AS VARCHAR) AS event_type,
                  COALESCE(SUM(value), 0.0) AS v
           FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
     g AS (SELECT event_type, arg_min(v, date) AS first, arg_max(v, date) AS last, AVG(v) AS mean,
                  count(*) AS points FROM s GROUP BY 1 HAVING count(*) >= 2)
SELECT event_type, first, last, last - first AS change,
       CASE WHEN first <> 0 THEN (last - first) / first * 100 ELSE 0.0 END AS growth_pct, mean,
       CASE WHEN last > first THEN 'up' WHEN last < first THEN 'down' ELSE 'flat' END AS trend,
       points, row_number() OVER (ORDER BY abs(last - first) DESC, event_type) AS rank
FROM g""", ["first", "last", "change", "growth_pct", "mean"]),
    "bar_top20": rounded_sql("""
SELECT p_brand, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_brand) AS rank
FROM (SELECT CAST(p_brand AS VARCHAR) AS p_brand, COALESCE(SUM(p_retailprice), 0.0) AS p_retailprice
      FROM part WHERE p_brand IS NOT NULL GROUP BY 1)
QUALIFY rank <= 20""", ["p_retailprice"]),
    "pie_top10": rounded_sql("""
WITH g AS (SELECT CAST(p_brand AS VARCHAR) AS p_brand, COALESCE(SUM(p_retailprice), 0.0) AS p_retailprice
           FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
     t AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_brand) AS rank FROM g
           QUALIFY rank <= 10)
SELECT p_brand, p_retailprice, p_retailprice / NULLIF(SUM(p_retailprice) OVER (), 0) * 100
       AS share_pct, rank FROM t""", ["p_retailprice", "share_pct"]),
    "box_summary": rounded_sql("""
WITH s AS (SELECT CAST(p_type AS VARCHAR) AS p_type, p_retailprice::DOUBLE AS m FROM part
           WHERE p_retailprice IS NOT NULL AND p_type IS NOT NULL),
     q AS (SELECT p_type, count(*) AS n, min(m) AS min, max(m) AS max,
                  quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS median,
                  quantile_cont(m, 0.75) AS q3 FROM s GROUP BY 1)
SELECT q.p_type, n, min, max, q1, median, q3, q3 - q1 AS iqr,
       min(CASE WHEN m >= q1 - 1.5 * (q3 - q1) THEN m END) AS whisker_low,
       max(CASE WHEN m <= q3 + 1.5 * (q3 - q1) THEN m END) AS whisker_high,
       count(CASE WHEN m < q1 - 1.5 * (q3 - q1) OR m > q3 + 1.5 * (q3 - q1) THEN 1 END)
           AS outliers
FROM q JOIN s USING (p_type) GROUP BY ALL""",
        ["min", "max", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]),
    "box_summary_parts": rounded_sql("""
WITH s AS (SELECT CAST(l_partkey AS VARCHAR) AS l_partkey, l_extendedprice::DOUBLE AS m FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_partkey IS NOT NULL),
     q AS (SELECT l_partkey, count(*) AS n, min(m) AS min, max(m) AS max,
                  quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS median,
                  quantile_cont(m, 0.75) AS q3 FROM s GROUP BY 1)
SELECT q.l_partkey, n, min, max, q1, median, q3, q3 - q1 AS iqr,
       min(CASE WHEN m >= q1 - 1.5 * (q3 - q1) THEN m END) AS whisker_low,
       max(CASE WHEN m <= q3 + 1.5 * (q3 - q1) THEN m END) AS whisker_high,
       count(CASE WHEN m < q1 - 1.5 * (q3 - q1) OR m > q3 + 1.5 * (q3 - q1) THEN 1 END)
           AS outliers
FROM q JOIN s USING (l_partkey) GROUP BY ALL""",
        ["min", "max", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high"], 11),
    "box_summary_all": rounded_sql("""
WITH s AS (SELECT l_extendedprice::DOUBLE AS m FROM lineitem WHERE l_extendedprice IS NOT NULL),
     q AS (SELECT count(*) AS n, min(m) AS min, max(m) AS max,
                  quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS median,
                  quantile_cont(m, 0.75) AS q3 FROM s)
SELECT n, min, max, q1, median, q3, q3 - q1 AS iqr,
       min(CASE WHEN m >= q1 - 1.5 * (q3 - q1) THEN m END) AS whisker_low,
       max(CASE WHEN m <= q3 + 1.5 * (q3 - q1) THEN m END) AS whisker_high,
       count(CASE WHEN m < q1 - 1.5 * (q3 - q1) OR m > q3 + 1.5 * (q3 - q1) THEN 1 END)
           AS outliers
FROM q, s GROUP BY ALL""", ["min", "max", "q1", "median", "q3", "iqr", "whisker_low",
                            "whisker_high"]),
    "scatter_ols": rounded_sql("""
SELECT CAST(l_returnflag AS VARCHAR) AS l_returnflag,
       regr_slope(l_extendedprice, l_quantity) AS slope,
       regr_intercept(l_extendedprice, l_quantity) AS intercept,
       regr_r2(l_extendedprice, l_quantity) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""", ["slope", "intercept", "r2"]),
    "scatter_ols_all": rounded_sql("""
SELECT regr_slope(l_discount, l_extendedprice) AS slope,
       regr_intercept(l_discount, l_extendedprice) AS intercept,
       regr_r2(l_discount, l_extendedprice) AS r2, regr_count(l_discount, l_extendedprice)::BIGINT AS n
FROM lineitem""", ["slope", "intercept", "r2"]),
    "line_series": rounded_sql("SELECT o_orderkey AS x, CAST(o_orderstatus AS VARCHAR) AS series, "
                               "o_totalprice::DOUBLE AS y FROM orders ORDER BY o_orderkey", ["y"]),
}


def _corr_sql(tbl, metrics):
    rows = []
    for a in metrics:
        for b in metrics:
            r = (f"covar_pop({a}, {b}) / NULLIF(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END)"
                 f" * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")
            rows.append(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, ({r})::DOUBLE AS r FROM {tbl}")
    body = " UNION ALL ".join(rows)
    return rounded_sql(f"""SELECT metric_a, metric_b, r,
  CASE WHEN abs(r) > 0.8 THEN 'strong' WHEN abs(r) > 0.5 AND abs(r) < 0.8 THEN 'medium'
       WHEN abs(r) < 0.3 THEN 'weak' END AS strength FROM ({body})""", ["r"])


def _describe_sql(tbl, cols):
    parts = []
    for c in cols:
        x = f"{c}::DOUBLE"
        parts.append(f"""SELECT '{c}' AS column, count({x}) AS count, avg({x}) AS mean,
  quantile_cont({x}, 0.5) AS median, stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max,
  quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.75) AS q75,
  CASE WHEN count({x}) >= 3 THEN COALESCE(skewness({x}), 0.0) END AS skew,
  CASE WHEN count({x}) >= 4 THEN COALESCE(kurtosis({x}), 0.0) END AS kurtosis,
  stddev_samp({x}) / NULLIF(avg({x}), 0) AS cv FROM {tbl}""")
    return rounded_sql(" UNION ALL ".join(parts),
                       ["mean", "median", "std", "min", "max", "q25", "q75", "skew", "kurtosis",
                        "cv"])


ORACLE["corr_matrix"] = _corr_sql("lineitem", LI_METRICS)
ORACLE["describe"] = _describe_sql("lineitem", LI_METRICS + ["l_linenumber"])

_miss = " UNION ALL ".join(
    f"SELECT '{c}' AS column, count_if({c} IS NULL"
    + (f" OR isnan({c})" if c == "o_totalprice" else "") + f")::BIGINT AS missing FROM {DIRTY_SQL}"
    for c in DIRTY_COLS)
ORACLE["missing"] = _miss
ORACLE["missing_total"] = f"SELECT SUM(missing)::BIGINT AS missing_cells FROM ({_miss})"
ORACLE["duplicates"] = (f"SELECT COALESCE(SUM(n - 1), 0)::BIGINT AS duplicates FROM "
                        f"(SELECT count(*) AS n FROM {DIRTY_SQL} GROUP BY ALL)")
ORACLE["duplicates"] = (f"SELECT COALESCE(SUM(n - 1), 0)::BIGINT AS duplicates FROM "
                        f"(SELECT {', '.join(DIRTY_COLS)}, count(*) AS n FROM {DIRTY_SQL} AS d "
                        f"GROUP BY {', '.join(DIRTY_COLS)})")
ORACLE["fill_mean"] = rounded_sql(f"""
SELECT o_orderkey,
  COALESCE(o_custkey::DOUBLE, (SELECT avg(o_custkey) FROM {DIRTY_SQL})) AS o_custkey,
  o_orderstatus,
  COALESCE(o_totalprice, (SELECT avg(o_totalprice) FROM {DIRTY_SQL})) AS o_totalprice,
  o_orderdate, o_orderpriority, o_comment FROM {DIRTY_SQL}""", ["o_custkey", "o_totalprice"])
ORACLE["fill_mode"] = rounded_sql(f"""
WITH m AS (SELECT o_orderstatus AS v FROM {DIRTY_SQL} WHERE o_orderstatus IS NOT NULL
           GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT o_orderkey, o_custkey, COALESCE(o_orderstatus, (SELECT v FROM m)) AS o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority, o_comment FROM {DIRTY_SQL}""", ["o_totalprice"])


def _mode_sql(tbl, cols, numeric):
    parts = []
    for c in cols:
        order = f"count(*) DESC, {c}" if c in numeric else f"count(*) DESC, CAST({c} AS VARCHAR)"
        parts.append(f"(SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS mode, count(*) AS freq "
                     f"FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY {order} LIMIT 1)")
    return " UNION ALL ".join(parts)


ORACLE["mode_values"] = _mode_sql("lineitem", ["l_returnflag", "l_linestatus", "l_quantity",
                                               "l_tax"], {"l_quantity", "l_tax"})
ORACLE["dedupe"] = rounded_sql(f"SELECT DISTINCT * FROM {DIRTY_SQL}", ["o_totalprice"])
ORACLE["dedupe_report"] = (f"SELECT (SELECT count(*) FROM {DIRTY_SQL}) AS rows_before, "
                           f"count(*) AS rows_after, (SELECT count(*) FROM {DIRTY_SQL}) - count(*)"
                           f" AS removed FROM (SELECT DISTINCT * FROM {DIRTY_SQL})")
ORACLE["drop_null_cols"] = rounded_sql(
    f"SELECT * EXCLUDE (o_comment) FROM {DIRTY_SQL}", ["o_totalprice"])
ORACLE["smart_format"] = """
SELECT o_orderpriority,
  CASE WHEN abs(SUM(o_totalprice)) >= 100 THEN format('{:,.0f}', SUM(o_totalprice))
       ELSE format('{:.2f}', SUM(o_totalprice)) END AS total_fmt,
  CASE WHEN abs(AVG(o_totalprice) / 1000) >= 100 THEN format('{:,.0f}', AVG(o_totalprice) / 1000)
       ELSE format('{:.2f}', AVG(o_totalprice) / 1000) END AS mean_k_fmt,
  format('{:.2f}', count(*)::DOUBLE / 150.0) || '%' AS share_fmt
FROM orders GROUP BY 1"""
ORACLE["change_formats"] = """
SELECT o_orderpriority, o_orderstatus, format('{:.2f}', count(*)::DOUBLE / 64 - 3) || 'pp' AS points_fmt,
  CASE WHEN avg(o_totalprice) >= 150000 THEN '+' ELSE '' END || format('{:,.2f}', avg(o_totalprice) - 150000) AS change_fmt
FROM orders GROUP BY ALL"""
