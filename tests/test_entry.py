"""Driver contract: entry() runs the flagship query on sf0.001."""

import __spark_entry__ as E


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4
    assert {"dimension", "value", "base", "target", "delta", "rate_pct", "contribution_pct",
            "contribution_pp", "is_total", "rank"} == set(df.columns)


def test_registry_keys_unique_and_callable():
    qs = E.queries()
    assert len(qs) >= 90
    assert all(callable(f) for f in qs.values())
    assert set(E.oracle_sql()) <= set(qs)
