"""Attribution, cross analysis and periods: hand tables + invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attrix.functions.exprs import TOTAL_LABEL
from attrix.operators import attribution as A
from attrix.operators.periods import PeriodPair, resolve_period
from tests.conftest import SF001

P = PeriodPair("2024-01-01", "2024-01-01", "2024-01-02", "2024-01-02")


def d(s):
    return dt.datetime.fromisoformat(s)


def test_flagship_sf0001(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    r = A.contribution(li, "l_returnflag", "l_extendedprice", "l_shipdate",
                       PeriodPair("1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31"))
    got = {x["value"]: (round(x["base"], 2), round(x["target"], 2)) for x in r.collect()}
    assert got["A"] == (8010298.11, 7796030.43)
    assert got["N"] == (8395784.67, 9449746.92)
    assert got["R"] == (8425190.34, 8020582.90)
    assert len(got) == 4 and TOTAL_LABEL in got


def test_invariants(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    r = A.contribution(li, "l_returnflag", "l_extendedprice", "l_shipdate",
                       PeriodPair("1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31")).collect()
    tot = [x for x in r if x["is_total"]][0]
    det = [x for x in r if not x["is_total"]]
    assert sum(x["delta"] for x in det) == pytest.approx(tot["delta"])
    assert sum(x["contribution_pct"] for x in det) == pytest.approx(100.0)
    assert sum(x["contribution_pp"] for x in det) == pytest.approx(tot["rate_pct"])
    assert sorted(x["rank"] for x in det) == [1, 2, 3]
    assert tot["rank"] == 0 and tot["contribution_pct"] == 100.0


def test_null_group_sums_to_zero_and_null_keys_dropped(spark):
    df = spark.createDataFrame(
        [(d("2024-01-01"), "1", None), (d("2024-01-02"), "1", None), (d("2024-01-02"), None, 5.0)],
        "day timestamp_ntz, k string, v double")
    r = A.contribution(df, "k", "v", "day", P).collect()
    det = [x for x in r if not x["is_total"]]
    assert [(x["value"], x["base"], x["target"]) for x in det] == [("1", 0.0, 0.0)]
    tot = [x for x in r if x["is_total"]][0]
    assert (tot["base"], tot["target"], tot["rate_pct"]) == (0.0, 0.0, 0.0)


def test_one_sided_keys_outer_union(spark):
    df = spark.createDataFrame(
        [(d("2024-01-01"), "x", 3.0), (d("2024-01-02"), "y", 4.0)],
        "day timestamp_ntz, k string, v double")
    r = {x["value"]: x for x in A.contribution(df, "k", "v", "day", P).collect()}
    assert (r["x"]["base"], r["x"]["target"], r["x"]["rate_pct"]) == (3.0, 0.0, -100.0)
    assert (r["y"]["base"], r["y"]["target"], r["y"]["rate_pct"]) == (0.0, 4.0, 0.0)


def test_cancelling_changes_total_row_fixed(spark):
    df = spark.createDataFrame(
        [(d("2024-01-01"), "a", 10.0), (d("2024-01-02"), "a", 15.0),
         (d("2024-01-01"), "b", 10.0), (d("2024-01-02"), "b", 5.0)],
        "day timestamp_ntz, k string, v double")
    r = A.contribution(df, "k", "v", "day", P).collect()
    det = [x for x in r if not x["is_total"]]
    assert all(x["contribution_pct"] == 0.0 for x in det)
    tot = [x for x in r if x["is_total"]][0]
    assert tot["contribution_pct"] == 100.0 and tot["contribution_pp"] == 0.0


def test_daily_average_divides_by_calendar_days(spark):
    df = spark.createDataFrame(
        [(d("2024-01-01"), "a", 31.0), (d("2024-02-01"), "a", 29.0)],
        "day timestamp_ntz, k string, v double")
    p = PeriodPair("2024-01-01", "2024-01-31", "2024-02-01", "2024-02-29")
    r = [x for x in A.contribution(df, "k", "v", "day", p, method="daily_avg").collect()
         if not x["is_total"]][0]
    assert (r["base"], r["target"]) == (1.0, 1.0)


def test_auto_equals_single(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    p = PeriodPair("1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31")
    auto = A.auto_attribution(o, ["o_orderpriority"], "o_totalprice", "o_orderdate", p, top_n=50)
    one = A.contribution(o, "o_orderpriority", "o_totalprice", "o_orderdate", p)
    key = lambda x: (x["value"], round(x["delta"], 6), x["rank"])
    assert sorted(map(key, auto.collect())) == sorted(map(key, one.collect()))


def test_multi_dim_total_label_every_dim(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    p = PeriodPair("1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31")
    r = A.multi_contribution(li, ["l_returnflag", "l_linestatus"], "l_extendedprice",
                             "l_shipdate", p)
    tot = r.where("is_total").collect()[0]
    assert tot["l_returnflag"] == TOTAL_LABEL and tot["l_linestatus"] == TOTAL_LABEL


def test_periods_fallback_sf0001(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    for preset in ("wow", "yoy"):
        r = resolve_period(o, "o_orderdate", preset).collect()[0]
        assert r["preset_used"] == "latest"
        assert r["base_start"] < r["target_start"]


def test_periods_need_two_dates(spark):
    df = spark.createDataFrame([(d("2024-01-01"), 1.0)], "day timestamp_ntz, v double")
    assert resolve_period(df, "day", "latest").count() == 0


def test_raw_grain_drops_later_times_on_end_day(spark):
    df = spark.createDataFrame(
        [(d("2024-01-02 09:00:00"), "a", 1.0), (d("2024-01-01 00:00:00"), "a", 1.0)],
        "day timestamp_ntz, k string, v double")
    raw = [x for x in A.contribution(df, "k", "v", "day", P, grain="raw").collect()
           if not x["is_total"]][0]
    day = [x for x in A.contribution(df, "k", "v", "day", P).collect() if not x["is_total"]][0]
    assert raw["target"] == 0.0 and day["target"] == 1.0


def test_pivot_fills_zero(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    p = PeriodPair("1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31")
    w = A.cross_pivot(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_shipdate", p)
    assert set(w.columns) == {"l_returnflag", "F", "O"}
    assert all(r["F"] is not None and r["O"] is not None for r in w.collect())
