"""Registered queries: column-role profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrix.operators.profile import profile, profile_stats
from attrix.plans.common import finalize, rounded_sql, table

def text_orders(s, sf):
    """Orders as a text export has them: dates, thousands and percentages as strings."""
    o = table(s, sf, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("order_day"),
                    F.format_number("o_totalprice", 2).alias("amount_text"),
                    F.concat((F.col("o_custkey") % 97).cast("string"), F.lit("%")).alias("share_text"), "o_orderpriority")


QUERIES = {
    "profile_text": lambda s, sf: finalize(profile_stats(text_orders(s, sf))),
    "profile_frame": lambda s, sf: finalize(profile(text_orders(s, sf))[0], 12),
    "profile": lambda s, sf: finalize(profile_stats(table(s, sf, "orders"))),
    "profile_lineitem": lambda s, sf: finalize(profile_stats(table(s, sf, "lineitem"))),
}

KEYWORDS = ["date", "time", "日期", "时间", "dt", "day", "month", "year"]


def _profile_sql(tbl: str, cols: list[tuple[str, str, str]]) -> str:
    """cols: (name, kind, spark dtype) with kind in int / float / text / ts."""
    parts = []
    for i, (c, kind, dtype) in enumerate(cols):
        thr = 0.5 if any(k in c.lower() for k in KEYWORDS) else 0.9
        if kind == "ts":
            d = f"{c}::TIMESTAMP"
            num = "NULL::DOUBLE"
        elif kind == "int":
            s = f"CAST({c} AS VARCHAR)"
            yr = (f"CASE WHEN regexp_full_match({s}, '\\d{{4}}') AND {s}::INT BETWEEN 1678 AND 2261 "
                  f"THEN make_timestamp({s}::INT, 1, 1, 0, 0, 0) END")
            ymd = (f"CASE WHEN regexp_full_match({s}, '\\d{{8}}') THEN "
                   f"try_strptime({s}, '%Y%m%d') END")
            d = None
            num = f"{c}::DOUBLE"
        elif kind == "float":
            d = "NULL::TIMESTAMP"
            num = f"{c}::DOUBLE"
        else:
            d = "NULL::TIMESTAMP"
            num = f"CASE WHEN NOT isnan(TRY_CAST(regexp_replace(trim({c}), '[,%]', '', 'g') AS DOUBLE)) THEN TRY_CAST(regexp_replace(trim({c}), '[,%]', '', 'g') AS DOUBLE) END"
        if kind == "int":
            facts = (f"count({ymd}) AS d1, min({ymd}) AS lo1, max({ymd}) AS hi1, "
                     f"count({yr}) AS d2, min({yr}) AS lo2, max({yr}) AS hi2")
            best = "greatest(d1, d2)"
            multi = "CASE WHEN d1 >= d2 THEN lo1 < hi1 ELSE lo2 < hi2 END"
            fmt = "CASE WHEN d1 >= d2 THEN 'yyyyMMdd' ELSE 'yyyy' END"
        else:
            facts = f"count({d}) AS d1, min({d}) AS lo1, max({d}) AS hi1"
            best = "d1"
            multi = "lo1 < hi1"
            fmt = "'native'"
        role_num = ("CASE WHEN nd < 10 AND nd / rows < 0.05 THEN 'dimension' ELSE 'metric' END")
        if kind == "text":
            role_num = f"CASE WHEN nv / rows > 0.8 THEN ({role_num}) ELSE 'dimension' END"
        if kind == "ts":
            role_num = "'dimension'"
        is_date = f"(rows > 0 AND {best} / rows > {thr} AND COALESCE({multi}, false))"
        parts.append(f"""SELECT '{c}' AS column, {i} AS position, '{dtype}' AS dtype,
  CASE WHEN {is_date} THEN 'date' ELSE {role_num} END AS role, rows, non_null,
  {"NULL::BIGINT" if kind == "ts" else "nd"} AS n_distinct,
  ({best} / rows)::DOUBLE AS date_fraction, CASE WHEN {is_date} THEN {fmt} END AS date_format,
  {"NULL::DOUBLE" if kind == "ts" else "(nv / rows)::DOUBLE"} AS numeric_fraction
FROM (SELECT count(*) AS rows, count({c}) AS non_null, count({num}) AS nv,
             count(DISTINCT {num}) AS nd, {facts} FROM {tbl})""")
    return rounded_sql(" UNION ALL ".join(parts), ["date_fraction", "numeric_fraction"])


ORACLE = {
    "profile": _profile_sql("orders", [
        ("o_orderkey", "int", "bigint"), ("o_custkey", "int", "bigint"),
        ("o_orderstatus", "text", "string"), ("o_totalprice", "float", "double"),
        ("o_orderdate", "ts", "timestamp_ntz"), ("o_orderpriority", "text", "string")]),
    "profile_lineitem": _profile_sql("lineitem", [
        ("l_orderkey", "int", "bigint"), ("l_partkey", "int", "bigint"),
        ("l_suppkey", "int", "bigint"), ("l_linenumber", "int", "int"),
        ("l_quantity", "float", "double"), ("l_extendedprice", "float", "double"),
        ("l_discount", "float", "double"), ("l_tax", "float", "double"),
        ("l_returnflag", "text", "string"), ("l_linestatus", "text", "string"),
        ("l_shipdate", "ts", "timestamp_ntz")]),
}

ORACLE["profile_text"] = rounded_sql("""
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, round(o_totalprice, 2) AS a, (o_custkey % 97)::DOUBLE AS p, o_orderpriority FROM orders),
t AS (SELECT count(*) AS rows FROM o)
SELECT 'o_orderkey' AS column, 0 AS position, 'bigint' AS dtype, 'metric' AS role, rows, (SELECT count(o_orderkey) FROM o) AS non_null,
  (SELECT count(DISTINCT o_orderkey) FROM o) AS n_distinct,
  (SELECT count(*) FROM o WHERE o_orderkey BETWEEN 1678 AND 2261) / rows AS date_fraction, NULL::VARCHAR AS date_format,
  1.0::DOUBLE AS numeric_fraction FROM t
UNION ALL SELECT 'order_day', 1, 'string', 'date', rows, (SELECT count(d) FROM o), 0, 1.0, 'yyyy/M/d', 0.0 FROM t
UNION ALL SELECT 'amount_text', 2, 'string', 'metric', rows, (SELECT count(a) FROM o), (SELECT count(DISTINCT a) FROM o), 0.0, NULL, 1.0 FROM t
UNION ALL SELECT 'share_text', 3, 'string', 'metric', rows, (SELECT count(p) FROM o), (SELECT count(DISTINCT p) FROM o), 0.0, NULL, 1.0 FROM t
UNION ALL SELECT 'o_orderpriority', 4, 'string', 'dimension', rows, (SELECT count(o_orderpriority) FROM o), 0, 0.0, NULL, 0.0 FROM t
""", ["date_fraction", "numeric_fraction"])
ORACLE["profile_frame"] = rounded_sql("""
SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS order_day, round(o_totalprice, 2) AS amount_text,
       (o_custkey % 97)::DOUBLE AS share_text, o_orderpriority FROM orders""", ["amount_text", "share_text"], 12)
