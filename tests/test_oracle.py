"""Every registered query with a DuckDB twin must agree with it at sf0.001
(column names, row count and values after significant-digit rounding)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from attrix.session import TABLES
from tests.conftest import SF001

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if isinstance(v, float):
        return repr(v)
    return str(v)[:26] if hasattr(v, "isoformat") else str(v)


def test_every_oracle_key_is_registered():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, con, key):
    sdf = QUERIES[key](spark, SF001)
    cols = sorted(sdf.columns)
    s_rows = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.execute(ORACLE[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    d_rows = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert s_rows == d_rows
