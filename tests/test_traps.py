"""Semantics traps: date inference, moments, constant columns, formats,
cleaning rules, overview labels."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attrix.functions.exprs import smart_format
from attrix.operators import charts, cleaning, overview, profile, stats


def test_date_inference_rules(spark):
    pdf = pd.DataFrame({
        "iso": ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06"],
        "ymd": ["20240101", "20240102", "20240103", "20240104", "20240105"],
        "yr": ["1995", "1996", "1997", "1998", "1999"],
        "five": ["12345", "12346", "12347", "12348", "12349"],
        "six": ["202401", "202402", "202403", "202404", "202405"],
        "frac": ["12.5", "12.6", "12.7", "12.8", "12.9"],
        "id": ["a", "b", "c", "d", "e"],
    })
    _, p = profile.profile(spark.createDataFrame(pdf))
    assert p.date_cols == ["iso", "ymd", "yr"]
    assert set(p.numeric_cols) == {"five", "six", "frac"}
    assert "id" not in p.date_cols + p.numeric_cols + p.cat_cols


def test_numeric_text_and_threshold(spark):
    t = spark.createDataFrame(pd.DataFrame({"v": ["1,234", "56%", "7", "8", "9", "n/a"]}))
    typed, p = profile.profile(t)
    assert p.numeric_cols == ["v"]
    vals = [r["v"] for r in typed.collect()]
    assert vals[:5] == [1234.0, 56.0, 7.0, 8.0, 9.0] and vals[5] is None
    t2 = spark.createDataFrame(pd.DataFrame({"v": ["1", "2", "3", "4", "x"]}))
    _, p2 = profile.profile(t2)
    assert p2.cat_cols == ["v"]          # exactly 0.8 is not > 0.8


def test_low_cardinality_numeric_is_dimension(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("amount"))
    _, p = profile.profile(df)
    assert p.cat_cols == ["k"] and p.numeric_cols == ["amount"]


def test_moments_bias_adjusted(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 2.0, 3.0, 3.0, 9.0, None]], "x double")
    r = stats.describe(df, ["x"]).collect()[0]
    assert r["skew"] == pytest.approx(2.0756055, abs=1e-6)
    assert r["kurtosis"] == pytest.approx(4.6806712, abs=1e-6)
    assert r["std"] == pytest.approx(2.8751812, abs=1e-6)
    assert r["q25"] == 2.0 and r["count"] == 6


def test_constant_column(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0), (2.0, 3.0), (2.0, 4.0)], "x double, y double")
    r = stats.describe(df, ["x"]).collect()[0]
    assert r["skew"] == 0.0 and r["kurtosis"] == 0.0
    c = {(x["metric_a"], x["metric_b"]): x["r"] for x in charts.corr_matrix(df, ["x", "y"]).collect()}
    assert c[("x", "y")] is None and c[("y", "y")] == pytest.approx(1.0)


def test_smart_format(spark):
    vals = [0.125, 2.675, 99.999, 100.0, 1234.5, -1234.5, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(smart_format("x")).collect()]
    assert got == ["0.12", "2.67", "100.00", "100", "1,234", "-1,234", "-"]


def test_mode_ties_smallest_and_fill(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    m = cleaning.mode_values(df, ["c"]).collect()[0]
    assert m["mode"] == "a" and m["freq"] == 2
    filled = [r["c"] for r in cleaning.fill_mode(df, ["c"]).collect()]
    assert filled.count("a") == 3 and None not in filled


def test_numeric_mode_orders_numerically(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,)], "c int")
    assert cleaning.mode_values(df, ["c"]).collect()[0]["mode"] == "9"


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert cleaning.duplicate_count(df).collect()[0][0] == 1
    assert cleaning.dedupe(df).count() == 2


def test_fill_mean_and_drop_null_columns(spark):
    df = spark.createDataFrame([(1, None), (3, None), (None, None)], "a int, b string")
    assert [r["a"] for r in cleaning.fill_mean(df, ["a"]).collect()] == [1.0, 3.0, 2.0]
    out, dropped = cleaning.drop_null_columns(df)
    assert dropped == ["b"] and out.columns == ["a"]


def test_week_label_monday_sunday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 3), 1.0)], "d timestamp_ntz, v double")
    r = overview.period_series(df, "d", ["v"], "week").collect()[0]
    assert r["period"] == "2024-01-01/2024-01-07"


def test_original_frame_unchanged_by_cleaning(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    cleaning.drop_null_columns(df)
    cleaning.fill_mean(df, ["a"])
    assert df.columns == ["a", "b"]


def test_exact_quantiles_iterative_and_ties(spark):
    import numpy as np

    from attrix.functions.quantiles import exact_quantiles

    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, 3000), np.full(2000, 0.5)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    for small in (50, 100_000):
        got, _ = exact_quantiles(df, ["x"], probs, small=small)
        for p in probs:
            assert got[("x", p)] == pytest.approx(float(np.percentile(x, p * 100)), abs=1e-12)


@pytest.mark.parametrize("small", [3, 40, 100_000])
def test_group_quantiles_refinement(spark, small):
    """Ties at the ranks, two-valued groups, tiny groups, far-off values."""
    import numpy as np

    from attrix.functions.quantiles import group_quantiles

    rng = np.random.default_rng(12)
    groups = {"a": rng.normal(0, 1, 2000), "b": np.concatenate([rng.exponential(2.0, 1500), np.full(1500, 1.0)]),
              "c": np.repeat([1.0, 5.0], [500, 1500]), "d": np.repeat([1.0, 5.0], [501, 500]), "e": np.array([7.0]), "f": np.array([1.0, 2.0]),
              "g": np.concatenate([rng.normal(0, 1e-6, 900), [1e12, -1e12]]), "h": np.full(999, 3.0)}
    rows = [(g, float(v)) for g, arr in groups.items() for v in arr] + [("z", None), (None, 1.0), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: r for r in group_quantiles(df, "g", "x", probs, small=small).collect()}
    assert sorted(got) == sorted(groups)
    for g, arr in groups.items():
        assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(arr), arr.min(), arr.max())
        for j, p in enumerate(probs):
            assert got[g][f"q{j}"] == pytest.approx(float(np.percentile(arr, p * 100)), rel=1e-12, abs=1e-12), (g, p)
