"""Registered queries: attribution, cross analysis and period presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrix.operators import attribution as A
from attrix.operators.periods import PeriodPair, resolve_period
from attrix.plans.common import finalize, rounded_sql, table

HALF_YEAR = PeriodPair("1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31")
UNEQUAL = PeriodPair("1996-01-01", "1996-01-31", "1996-02-01", "1996-02-29")

MEASURES = ["base", "target", "delta", "rate_pct", "contribution_pct", "contribution_pp"]


def _latest_vs_week_before(df, date_col) -> PeriodPair:
    """Bounded driver read: the latest day (one scalar)."""
    d1 = df.agg(F.max(F.to_date(date_col))).first()[0]
    from datetime import timedelta

    b = (d1 - timedelta(days=7)).isoformat()
    return PeriodPair(b, b, d1.isoformat(), d1.isoformat())


def q_contribution_sum(spark, sf):
    li = table(spark, sf, "lineitem")
    return finalize(A.contribution(li, "l_returnflag", "l_extendedprice", "l_shipdate", HALF_YEAR))


def q_contribution_daily_avg(spark, sf):
    o = table(spark, sf, "orders")
    return finalize(
        A.contribution(o, "o_orderpriority", "o_totalprice", "o_orderdate", UNEQUAL,
                       method="daily_avg")
    )


def q_contribution_full_outer(spark, sf):
    o = table(spark, sf, "orders")
    p = _latest_vs_week_before(o, "o_orderdate")
    return finalize(A.contribution(o, "o_orderpriority", "o_totalprice", "o_orderdate", p))


def q_contribution_empty_base(spark, sf):
    li = table(spark, sf, "lineitem")
    p = PeriodPair("1990-01-01", "1990-01-31", "1996-01-01", "1996-01-31")
    return finalize(A.contribution(li, "l_returnflag", "l_extendedprice", "l_shipdate", p))


def q_cross_2d(spark, sf):
    li = table(spark, sf, "lineitem")
    return finalize(
        A.multi_contribution(li, ["l_returnflag", "l_linestatus"], "l_extendedprice",
                             "l_shipdate", HALF_YEAR)
    )


def q_cross_2d_pivot(spark, sf):
    li = table(spark, sf, "lineitem")
    return finalize(
        A.cross_pivot(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_shipdate",
                      HALF_YEAR)
    )


def _orders_customer(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority",
                                          "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "inner")


def q_cross_3d(spark, sf):
    v = _orders_customer(spark, sf)
    return finalize(
        A.multi_contribution(v, ["o_orderstatus", "o_orderpriority", "c_mktsegment"],
                             "o_totalprice", "o_orderdate", HALF_YEAR)
    )


def q_cross_3d_rollup(spark, sf):
    v = _orders_customer(spark, sf)
    return finalize(
        A.cross_rollup(v, ["o_orderstatus", "o_orderpriority", "c_mktsegment"],
                       "o_totalprice", "o_orderdate", HALF_YEAR)
    )


def q_auto_attribution_topn(spark, sf):
    o = table(spark, sf, "orders")
    return finalize(
        A.auto_attribution(o, ["o_orderstatus", "o_orderpriority"], "o_totalprice",
                           "o_orderdate", HALF_YEAR, top_n=3)
    )


def _period(preset, tbl, col, grain="day"):
    def q(spark, sf):
        return resolve_period(table(spark, sf, tbl), col, preset, grain=grain)
    return q


QUERIES = {
    "contribution_sum": q_contribution_sum,
    "contribution_daily_avg": q_contribution_daily_avg,
    "contribution_full_outer": q_contribution_full_outer,
    "contribution_empty_base": q_contribution_empty_base,
    "cross_2d": q_cross_2d,
    "cross_2d_pivot": q_cross_2d_pivot,
    "cross_pairs_top15": lambda s, sf: finalize(A.multi_contribution(
        _orders_customer(s, sf), ["o_orderpriority", "c_mktsegment"], "o_totalprice", "o_orderdate", HALF_YEAR, top_n=15)),
    "contribution_parts": lambda s, sf: finalize(A.contribution(
        table(s, sf, "lineitem"), "l_partkey", "l_extendedprice", "l_shipdate", HALF_YEAR)),
    "period_custom_explicit": lambda s, sf: resolve_period(table(s, sf, "orders"), "o_orderdate", "custom", custom=HALF_YEAR),
    "cross_3d": q_cross_3d,
    "cross_3d_rollup": q_cross_3d_rollup,
    "auto_attribution_topn": q_auto_attribution_topn,
    "period_latest": _period("latest", "orders", "o_orderdate"),
    "period_wow": _period("wow", "orders", "o_orderdate"),
    "period_yoy": _period("yoy", "orders", "o_orderdate"),
    "period_last7": _period("last7", "orders", "o_orderdate"),
    "period_last30": _period("last30", "orders", "o_orderdate"),
    "period_custom": _period("custom", "orders", "o_orderdate"),
    "period_last7_events": _period("last7", "events", "ts"),
}

# ---------------------------------------------------------------------------
# DuckDB twins.  Written from the specification, not from the Spark code:
# full outer join of two per-period aggregates, cross join with totals.
# ---------------------------------------------------------------------------


def _in(col, start, end):
    return (f"({col} >= TIMESTAMP '{start}' AND {col} < TIMESTAMP '{end}' + INTERVAL 1 DAY)")


def _attr_sql(tbl, dims, metric, date_col, p: PeriodPair, method="sum", dim_label=True,
              base_days=None, target_days=None):
    keys = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dims)
    nn = " AND ".join(f"{d} IS NOT NULL" for d in dims)
    bdiv = f" / {float(p.base_days)}" if method == "daily_avg" else ""
    tdiv = f" / {float(p.target_days)}" if method == "daily_avg" else ""
    on = " AND ".join(f"b.{d} = t.{d}" for d in dims)
    sel = ", ".join(f"COALESCE(b.{d}, t.{d}) AS {d}" for d in dims)
    order = ", ".join(dims)
    return f"""
WITH b AS (SELECT {keys}, SUM({metric})::DOUBLE{bdiv} AS v FROM {tbl}
           WHERE {nn} AND {_in(date_col, p.base_start, p.base_end)} GROUP BY ALL),
     t AS (SELECT {keys}, SUM({metric})::DOUBLE{tdiv} AS v FROM {tbl}
           WHERE {nn} AND {_in(date_col, p.target_start, p.target_end)} GROUP BY ALL),
     m AS (SELECT {sel}, COALESCE(b.v, 0.0) AS base, COALESCE(t.v, 0.0) AS target
           FROM b FULL OUTER JOIN t ON {on}),
     tot AS (SELECT COALESCE(SUM(base), 0.0) AS tb, COALESCE(SUM(target), 0.0) AS tt FROM m),
     r AS (SELECT CASE WHEN tb <> 0 THEN (tt - tb) / tb * 100 ELSE 0.0 END AS trate, tb, tt FROM tot)
SELECT {"'" + dims[0] + "' AS dimension, " + dims[0] + " AS value, " if dim_label else order + ", "}
       base, target, target - base AS delta,
       CASE WHEN base <> 0 THEN (target - base) / base * 100 ELSE 0.0 END AS rate_pct,
       CASE WHEN tt - tb <> 0 THEN (target - base) / (tt - tb) * 100 ELSE 0.0 END AS contribution_pct,
       (CASE WHEN tt - tb <> 0 THEN (target - base) / (tt - tb) * 100 ELSE 0.0 END) * trate / 100
           AS contribution_pp,
       FALSE AS is_total,
       row_number() OVER (ORDER BY abs(target - base) DESC, {order}) AS rank
FROM m, r
UNION ALL
SELECT {"'" + dims[0] + "', '【总计】', " if dim_label else ", ".join("'【总计】'" for _ in dims) + ", "}
       tb, tt, tt - tb, trate, 100.0::DOUBLE, trate, TRUE, 0::BIGINT FROM r
"""


ORACLE = {
    "contribution_sum": rounded_sql(
        _attr_sql("lineitem", ["l_returnflag"], "l_extendedprice", "l_shipdate", HALF_YEAR),
        MEASURES),
    "contribution_daily_avg": rounded_sql(
        _attr_sql("orders", ["o_orderpriority"], "o_totalprice", "o_orderdate", UNEQUAL,
                  method="daily_avg"), MEASURES),
    "contribution_empty_base": rounded_sql(
        _attr_sql("lineitem", ["l_returnflag"], "l_extendedprice", "l_shipdate",
                  PeriodPair("1990-01-01", "1990-01-31", "1996-01-01", "1996-01-31")), MEASURES),
    "cross_2d": rounded_sql(
        _attr_sql("lineitem", ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_shipdate",
                  HALF_YEAR, dim_label=False), MEASURES),
    "cross_3d": rounded_sql(
        _attr_sql("(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)",
                  ["o_orderstatus", "o_orderpriority", "c_mktsegment"], "o_totalprice",
                  "o_orderdate", HALF_YEAR, dim_label=False), MEASURES),
}

ORACLE["cross_pairs_top15"] = "SELECT * FROM (" + rounded_sql(
    _attr_sql("(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)", ["o_orderpriority", "c_mktsegment"],
              "o_totalprice", "o_orderdate", HALF_YEAR, dim_label=False), MEASURES) + ") WHERE rank <= 15"
ORACLE["contribution_parts"] = rounded_sql(
    _attr_sql("lineitem", ["l_partkey"], "l_extendedprice", "l_shipdate", HALF_YEAR), MEASURES)

ORACLE["contribution_full_outer"] = rounded_sql("""
WITH d AS (SELECT max(o_orderdate)::DATE AS d1 FROM orders),
     b AS (SELECT o_orderpriority AS value, SUM(o_totalprice) AS v FROM orders, d
           WHERE o_orderdate::DATE = d1 - 7 AND o_orderpriority IS NOT NULL GROUP BY 1),
     t AS (SELECT o_orderpriority AS value, SUM(o_totalprice) AS v FROM orders, d
           WHERE o_orderdate::DATE = d1 AND o_orderpriority IS NOT NULL GROUP BY 1),
     m AS (SELECT COALESCE(b.value, t.value) AS value, COALESCE(b.v, 0.0) AS base,
                  COALESCE(t.v, 0.0) AS target FROM b FULL OUTER JOIN t ON b.value = t.value),
     r AS (SELECT COALESCE(SUM(base), 0.0) AS tb, COALESCE(SUM(target), 0.0) AS tt,
                  CASE WHEN SUM(base) <> 0 THEN (SUM(target) - SUM(base)) / SUM(base) * 100
                       ELSE 0.0 END AS trate FROM m)
SELECT 'o_orderpriority' AS dimension, value, base, target, target - base AS delta,
       CASE WHEN base <> 0 THEN (target - base) / base * 100 ELSE 0.0 END AS rate_pct,
       CASE WHEN tt - tb <> 0 THEN (target - base) / (tt - tb) * 100 ELSE 0.0 END AS contribution_pct,
       (CASE WHEN tt - tb <> 0 THEN (target - base) / (tt - tb) * 100 ELSE 0.0 END) * trate / 100
           AS contribution_pp,
       FALSE AS is_total, row_number() OVER (ORDER BY abs(target - base) DESC, value) AS rank
FROM m, r
UNION ALL SELECT 'o_orderpriority', '【总计】', tb, tt, tt - tb, trate, 100.0::DOUBLE, trate, TRUE,
       0::BIGINT FROM r
""", MEASURES)

ORACLE["cross_2d_pivot"] = rounded_sql(f"""
WITH a AS (SELECT l_returnflag, l_linestatus,
      SUM(CASE WHEN {_in('l_shipdate', HALF_YEAR.target_start, HALF_YEAR.target_end)}
               THEN l_extendedprice ELSE 0 END)
    - SUM(CASE WHEN {_in('l_shipdate', HALF_YEAR.base_start, HALF_YEAR.base_end)}
               THEN l_extendedprice ELSE 0 END) AS delta
    FROM lineitem
    WHERE {_in('l_shipdate', HALF_YEAR.base_start, HALF_YEAR.base_end)}
       OR {_in('l_shipdate', HALF_YEAR.target_start, HALF_YEAR.target_end)}
    GROUP BY ALL)
SELECT l_returnflag,
       COALESCE(MAX(CASE WHEN l_linestatus = 'F' THEN delta END), 0.0) AS "F",
       COALESCE(MAX(CASE WHEN l_linestatus = 'O' THEN delta END), 0.0) AS "O"
FROM a GROUP BY l_returnflag
""", ["F", "O"])

ORACLE["cross_3d_rollup"] = rounded_sql(f"""
WITH a AS (SELECT o_orderstatus, o_orderpriority, c_mktsegment,
       COALESCE(SUM(CASE WHEN {_in('o_orderdate', HALF_YEAR.target_start, HALF_YEAR.target_end)}
                    THEN o_totalprice END), 0.0)::DOUBLE AS t
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND c_mktsegment IS NOT NULL
      AND ({_in('o_orderdate', HALF_YEAR.base_start, HALF_YEAR.base_end)}
           OR {_in('o_orderdate', HALF_YEAR.target_start, HALF_YEAR.target_end)})
    GROUP BY ALL)
SELECT o_orderstatus, o_orderpriority, c_mktsegment,
       SUM(t) AS node_value, SUM(t * t) / NULLIF(SUM(t), 0) AS node_color,
       (CASE WHEN GROUPING(o_orderstatus) = 0 THEN 1 ELSE 0 END
        + CASE WHEN GROUPING(o_orderpriority) = 0 THEN 1 ELSE 0 END
        + CASE WHEN GROUPING(c_mktsegment) = 0 THEN 1 ELSE 0 END)::INTEGER AS level
FROM a GROUP BY ROLLUP (o_orderstatus, o_orderpriority, c_mktsegment)
""", ["node_value", "node_color"])

ORACLE["auto_attribution_topn"] = rounded_sql(f"""
WITH src AS (SELECT * FROM orders
             WHERE {_in('o_orderdate', HALF_YEAR.base_start, HALF_YEAR.base_end)}
                OR {_in('o_orderdate', HALF_YEAR.target_start, HALF_YEAR.target_end)}),
     long AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, o_totalprice AS m,
                     o_orderdate AS d FROM src
              UNION ALL
              SELECT 'o_orderpriority', o_orderpriority, o_totalprice, o_orderdate FROM src),
     agg AS (SELECT dimension, value,
                COALESCE(SUM(CASE WHEN {_in('d', HALF_YEAR.base_start, HALF_YEAR.base_end)}
                                  THEN m END), 0.0) AS base,
                COALESCE(SUM(CASE WHEN {_in('d', HALF_YEAR.target_start, HALF_YEAR.target_end)}
                                  THEN m END), 0.0) AS target
             FROM long WHERE value IS NOT NULL GROUP BY ALL),
     tot AS (SELECT dimension, SUM(base) AS tb, SUM(target) AS tt, COUNT(*) AS n_values,
                    CASE WHEN SUM(base) <> 0 THEN (SUM(target) - SUM(base)) / SUM(base) * 100
                         ELSE 0.0 END AS trate
             FROM agg GROUP BY dimension),
     det AS (SELECT a.dimension, value, base, target, target - base AS delta,
                CASE WHEN base <> 0 THEN (target - base) / base * 100 ELSE 0.0 END AS rate_pct,
                CASE WHEN tt - tb <> 0 THEN (target - base) / (tt - tb) * 100 ELSE 0.0 END
                    AS contribution_pct,
                (CASE WHEN tt - tb <> 0 THEN (target - base) / (tt - tb) * 100 ELSE 0.0 END)
                    * trate / 100 AS contribution_pp,
                FALSE AS is_total, n_values,
                row_number() OVER (PARTITION BY a.dimension
                                   ORDER BY abs(target - base) DESC, value) AS rank
             FROM agg a JOIN tot USING (dimension))
SELECT * FROM det WHERE rank <= 3
UNION ALL
SELECT dimension, '【总计】', tb, tt, tt - tb, trate, 100.0::DOUBLE, trate, TRUE, n_values, 0::BIGINT FROM tot
""", MEASURES)


def _period_sql(preset, tbl, col):
    base = f"""
WITH v AS (SELECT DISTINCT {col}::DATE AS d FROM {tbl} WHERE {col} IS NOT NULL),
     r AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS rn FROM v),
     p AS (SELECT count(*) AS n_all,
                  max(CASE WHEN rn = 1 THEN d END) AS d1, max(CASE WHEN rn = 2 THEN d END) AS d2,
                  max(CASE WHEN rn = 7 THEN d END) AS d7, max(CASE WHEN rn = 8 THEN d END) AS d8,
                  max(CASE WHEN rn = 14 THEN d END) AS d14, max(CASE WHEN rn = 30 THEN d END) AS d30,
                  max(CASE WHEN rn = 31 THEN d END) AS d31, max(CASE WHEN rn = 60 THEN d END) AS d60
           FROM r),
     f AS (SELECT p.*, EXISTS (SELECT 1 FROM v WHERE v.d = p.d1 - 7) AS w,
                       EXISTS (SELECT 1 FROM v WHERE v.d = p.d1 - 365) AS y FROM p)
"""
    s = lambda e: f"strftime({e}, '%Y-%m-%d')"
    if preset == "latest":
        body = f"'latest', {s('d2')}, {s('d2')}, {s('d1')}, {s('d1')}"
    elif preset == "custom":
        body = f"'custom', {s('d1')}, {s('d1')}, {s('d1')}, {s('d1')}"
    elif preset in ("wow", "yoy"):
        flag, k = ("w", 7) if preset == "wow" else ("y", 365)
        body = (f"CASE WHEN {flag} THEN '{preset}' ELSE 'latest' END, "
                f"CASE WHEN {flag} THEN {s(f'd1 - {k}')} ELSE {s('d2')} END, "
                f"CASE WHEN {flag} THEN {s(f'd1 - {k}')} ELSE {s('d2')} END, "
                f"{s('d1')}, {s('d1')}")
    else:
        need, bs, be, ts = (14, "d14", "d8", "d7") if preset == "last7" else (60, "d60", "d31", "d30")
        ok = f"n_all >= {need}"
        body = (f"CASE WHEN {ok} THEN '{preset}' ELSE 'latest' END, "
                f"CASE WHEN {ok} THEN {s(bs)} ELSE {s('d2')} END, "
                f"CASE WHEN {ok} THEN {s(be)} ELSE {s('d2')} END, "
                f"CASE WHEN {ok} THEN {s(ts)} ELSE {s('d1')} END, {s('d1')}")
    return base + f"SELECT '{preset}', {body} FROM f WHERE n_all >= 2"


def _named_period_sql(preset, tbl, col):
    sql = _period_sql(preset, tbl, col)
    head, tail = sql.rsplit("SELECT '", 1)
    return (head + "SELECT * FROM (SELECT '" + tail + ") AS x(preset, preset_used, base_start, "
            "base_end, target_start, target_end)")


for _k, (_p, _t, _c) in {
    "period_latest": ("latest", "orders", "o_orderdate"),
    "period_wow": ("wow", "orders", "o_orderdate"),
    "period_yoy": ("yoy", "orders", "o_orderdate"),
    "period_last7": ("last7", "orders", "o_orderdate"),
    "period_last30": ("last30", "orders", "o_orderdate"),
    "period_custom": ("custom", "orders", "o_orderdate"),
    "period_last7_events": ("last7", "events", "ts"),
}.items():
    ORACLE[_k] = _named_period_sql(_p, _t, _c)
ORACLE["period_custom_explicit"] = f"""SELECT * REPLACE ('{HALF_YEAR.base_start}' AS base_start, '{HALF_YEAR.base_end}' AS base_end,
  '{HALF_YEAR.target_start}' AS target_start, '{HALF_YEAR.target_end}' AS target_end) FROM ({ORACLE["period_custom"]})"""
