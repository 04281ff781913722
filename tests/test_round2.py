"""Fixes of round 2: graph components, weighted samples, CSV quoting, caps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.functions.graph import components
from attrix.ml.dbscan import dbscan
from attrix.ml.isoforest import fit, score
from attrix.operators import attribution as A
from attrix.operators.overview import period_series
from attrix.operators.periods import PeriodPair
from attrix.sources import read_csv
from attrix.sources.readers import corrupt_rows
from tests.test_sources import _csv


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r["component"] for r in components(edges).collect()} == {0}


def test_dbscan_cluster_across_many_cells(spark):
    rows = [(i, float(i), 0.0) for i in range(400)] + [(1000 + i, 9000.0 + i, 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = dbscan(df, ["x", "y"], eps=0.01, min_samples=2, keep=["id"], salt_rows=3)
    by = {r["id"]: r["cluster"] for r in got.collect()}
    assert len({by[i] for i in range(400)}) == 1 and len({by[1000 + i] for i in range(40)}) == 1
    assert by[0] != by[1000] and -1 not in by.values()


def test_isolation_forest_sample_keeps_the_share_of_a_hot_point(spark):
    rng = np.random.default_rng(0)
    rows = [(5.0, 5.0)] * 3000 + [tuple(map(float, r)) for r in rng.normal(size=(6000, 2))]
    df = spark.createDataFrame(rows, "a double, b double")
    nodes, psi = fit(df, ["a", "b"], n_trees=30)
    leaves = nodes[nodes["feature"] < 0].groupby("tree")["size"].max() / psi
    assert 0.2 < leaves.mean() < 0.45
    scored = score(spark.createDataFrame([(5.0, 5.0), (40.0, -40.0)], "a double, b double"), ["a", "b"], nodes, psi)
    hot, far = [r["score"] for r in scored.collect()]
    assert hot > far


def test_csv_quotes_newlines_and_bad_rows(spark):
    path = _csv('id,text,n\n1,"two\nlines",5\n2,"say ""hi"", ok",6\n3,x,7,extra\n4,y\n')
    rows = read_csv(spark, path).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4]
    assert rows[0]["text"] == "two\nlines" and rows[1]["text"] == 'say "hi", ok' and rows[1]["n"] == 6
    assert corrupt_rows(spark, path) == 2


def test_pivot_with_dots_and_too_many_columns(spark):
    df = spark.createDataFrame([("a", "v1.0", "2024-01-01", 1.0), ("a", "v2", "2024-01-02", 3.0)],
                               "p string, q string, d string, m double").withColumn("d", F.to_date("d"))
    p = PeriodPair("2024-01-01", "2024-01-01", "2024-01-02", "2024-01-02")
    row = A.cross_pivot(df, ["p", "q"], "m", "d", p).first()
    assert row["v1.0"] == -1.0 and row["v2"] == 3.0
    with pytest.raises(ValueError):
        A.cross_pivot(df, ["p", "q"], "m", "d", p, max_columns=1)


def test_all_metrics_and_dimensions_by_default(spark):
    df = spark.range(10).select(F.to_date(F.lit("2024-01-01")).alias("d"), *[F.col("id").alias(f"m{i}") for i in range(7)])
    assert len(period_series(df, "d", [f"m{i}" for i in range(7)]).columns) == 8
