"""Shared plumbing for the registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attrix.functions.exprs import sig_round, sig_round_sql

SIG_DIGITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finalize(df: DataFrame, digits: int = SIG_DIGITS) -> DataFrame:
    """Round every double column to ``SIG_DIGITS`` significant digits so that
    results of differently ordered floating sums compare equal."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(sig_round(f"`{f.name}`", digits).alias(f.name))
        else:
            cols.append(f"`{f.name}`")
    return df.select(*cols)


def rounded_sql(sql: str, double_cols: list[str], digits: int = SIG_DIGITS) -> str:
    """Wrap oracle SQL so the listed double columns get the same rounding."""
    if not double_cols:
        return sql
    repl = ", ".join(f"{sig_round_sql(f'q.\"{c}\"', digits)} AS \"{c}\"" for c in double_cols)
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"
