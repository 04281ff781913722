"""Ranks without a single task, exact distinct counts, the Holt-Winters grid as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.functions import rank
from attrix.operators import attribution as A
from attrix.operators import overview, trend
from attrix.operators.periods import PeriodPair
from tests.conftest import SF001

P = PeriodPair("1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_ranks_over_ranges_equal_ranks_in_one_task(spark, monkeypatch):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")

    def all_four():
        return [A.contribution(li, "l_partkey", "l_extendedprice", "l_shipdate", P),
                A.multi_contribution(li, ["l_suppkey", "l_returnflag"], "l_extendedprice", "l_shipdate", P),
                overview.latest_dim_summary(li, "l_shipdate", "l_returnflag", "l_extendedprice"),
                trend.trend_growth(li, "l_shipdate", "l_extendedprice", "l_returnflag")]

    want = [_rows(d) for d in all_four()]
    monkeypatch.setattr(rank, "SMALL_BYTES", 0)
    spread = all_four()
    assert [_rows(d) for d in spread] == want
    for d in spread:
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan  # numbered before, over ranges


def test_distinct_counts_are_exact(spark):
    from attrix.operators.profile import profile_stats

    df = spark.range(5000).select(F.col("id").alias("wide"), (F.col("id") % 7).alias("few"), (F.col("id") % 3000 / 7).alias("mid"),
                                  F.concat((F.col("id") % 2500).cast("string"), F.lit("%")).alias("txt"), F.lit(None).cast("double").alias("none"))
    got = {r["column"]: r["n_distinct"] for r in profile_stats(df).collect()}
    assert got == {"wide": 5000, "few": 7, "mid": 3000, "txt": 2500, "none": 0}


def test_holt_winters_grid_as_rows(spark):
    from attrix.forecast import models as FM
    from attrix.forecast import solvers

    rng = np.random.default_rng(4)
    ys = {k: 50 + 0.3 * np.arange(n) + 8 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 1, n) for k, n in (("a", 60), ("b", 25), ("c", 5))}
    rows = [(k, f"2024-01-{1:02d}", i, float(v)) for k, y in ys.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, d string, i int, v double").select(
        "k", F.date_add(F.to_date("d"), F.col("i")).cast("timestamp").alias("ts"), "v")
    got = FM.holt_winters(df, "ts", "v", 9, ["k"]).orderBy("k", "date").collect()
    assert {r["k"] for r in got} == {"a", "b"}
    for k in "ab":
        want, (a, b, g) = solvers.holt_winters_forecast(ys[k], 9)
        mine = [r for r in got if r["k"] == k]
        assert [r["yhat"] for r in mine] == pytest.approx(list(want), rel=1e-9)
        assert (mine[0]["alpha"], mine[0]["beta"], mine[0]["gamma"]) == pytest.approx((a, b, g))
