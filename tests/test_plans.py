"""Plan-shape checks: pushdown, pruning, one scan, no cartesian products."""

from attrix.operators import attribution as A
from attrix.operators.periods import PeriodPair
from tests.conftest import SF001

P = PeriodPair("1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_pushed_and_columns_pruned(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    r = A.contribution(li, "l_returnflag", "l_extendedprice", "l_shipdate", P)
    r.collect()
    plan = _plan(r)
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_shipdate" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_totals_reuse_the_aggregate_exchange(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    r = A.contribution(li, "l_returnflag", "l_extendedprice", "l_shipdate", P)
    r.collect()
    plan = _plan(r)
    assert "ReusedExchange" in plan


def test_auto_attribution_single_scan(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    r = A.auto_attribution(o, ["o_orderstatus", "o_orderpriority"], "o_totalprice",
                           "o_orderdate", P, top_n=3)
    r.collect()
    plan = _plan(r)
    assert "CartesianProduct" not in plan
    # partial + final aggregate around exactly one data shuffle of the long form
    assert "Generate stack" in plan or "Generate" in plan
