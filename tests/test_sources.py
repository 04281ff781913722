import os
import tempfile

import pytest

from attrix.operators import cleaning
from attrix.sources import Snapshot, SourceError, read_csv, read_table


def _csv(text):
    d = tempfile.mkdtemp(prefix="attrix-test-")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_csv_na_tokens_and_inference(spark):
    p = _csv("日期,amount,city\n2024-01-01,1,北京\n2024-01-02,NA,N/A\n2024-01-03,3.5,上海\n")
    df = read_csv(spark, p)
    types = dict(df.dtypes)
    assert types["amount"] == "double"
    rows = df.collect()
    assert rows[1]["amount"] is None and rows[1]["city"] is None
    assert rows[0]["city"] == "北京"


def test_missing_file_raises(spark):
    with pytest.raises(SourceError):
        read_csv(spark, "/nonexistent/nowhere.csv")


def test_suffix_dispatch_case_sensitive(spark):
    p = _csv("a\n1\n")
    assert read_table(spark, p).count() == 1


def test_snapshot_reset(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    snap = Snapshot.of(df).apply(cleaning.drop_null_columns)
    assert snap.current.columns == ["a"]
    assert snap.reset().current.columns == ["a", "b"]


def test_plain_csv_is_split_over_tasks(spark):
    from attrix.sources.readers import spans_lines

    plain = _csv('a,b\n' + "".join(f'{i},"x ""{i}"" y"\n' for i in range(60_000)))
    folded = _csv('a,b\n1,"two\nlines"\n2,z\n')
    assert not spans_lines(spark, plain) and spans_lines(spark, folded)
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = read_csv(spark, plain, infer=False)
        assert df.rdd.getNumPartitions() > 4
        assert df.count() == 60_000 and df.where("a = '7'").first()["b"] == 'x "7" y'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert [tuple(r) for r in read_csv(spark, folded).collect()] == [(1, "two\nlines"), (2, "z")]


def test_na_tokens_are_compared_as_they_stand(spark):
    got = [r["b"] for r in read_csv(spark, _csv('a,b\n1,NA\n2," NA"\n3,n/a\n')).collect()]
    assert got == [None, " NA", None]
