"""Cleaning: missing cells, duplicates, mean / mode filling, de-duplication,
all-null column removal.

Frames are immutable: each operator returns a new frame and the original
handle stays the "reset" snapshot.  Fill values are a handful of scalars
(one per column) read on the driver and applied as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_float(dt) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def _missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    dt = df.schema[name].dataType
    return c.isNull() | F.isnan(c) if _is_float(dt) else c.isNull()


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column (NULL, and NaN in float columns), long form
    ``(column, missing)``, from one aggregate."""
    row = df.agg(*[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    entries = ", ".join(f"'{c}', m{i}" for i, c in enumerate(df.columns))
    return row.select(F.expr(f"stack({len(df.columns)}, {entries}) AS (column, missing)"))


def missing_total(df: DataFrame) -> DataFrame:
    """Total number of missing cells (one row)."""
    return missing_counts(df).agg(F.sum("missing").cast("long").alias("missing_cells"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows (NULLs equal).

    ``groupBy(all columns).count()`` combines map-side, so a row repeated a
    billion times still travels as one partial count per task."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULL/NaN of numeric columns with the column mean (integer
    columns become double, as the mean is fractional)."""
    means = df.agg(*[
        F.avg(F.when(~_missing(df, c), F.col(f"`{c}`").cast("double"))).alias(f"a{i}")
        for i, c in enumerate(columns)
    ]).first()   # one number per column
    out = []
    for c in df.columns:
        if c in columns:
            i = columns.index(c)
            x = F.col(f"`{c}`").cast("double")
            fill = F.lit(means[f"a{i}"]).cast("double")
            out.append(F.when(_missing(df, c), fill).otherwise(x).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def mode_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-null value per column, ties → smallest value,
    long form ``(column, mode, freq)``.

    Distributed: the frame is unpivoted once to ``(column, value)``, counted
    with a map-side-combined ``groupBy``, and the winner per column is a
    ``min_by`` over ``(-count, value)`` — no task ever holds a whole column's
    value set.  Numeric columns order ties numerically (sort key column)."""
    entries = ", ".join(
        f"'{c}', CAST(`{c}` AS STRING), "
        + (f"CAST(`{c}` AS DOUBLE)" if isinstance(df.schema[c].dataType, T.NumericType)
           else "CAST(NULL AS DOUBLE)")
        for c in columns
    )
    long = df.select(F.expr(f"stack({len(columns)}, {entries}) AS (column, value, numkey)"))
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value", "numkey").agg(
        F.count(F.lit(1)).alias("freq"))
    key = F.struct((-F.col("freq")).alias("nf"), F.col("numkey"), F.col("value"))
    return counts.groupBy("column").agg(F.min_by("value", key).alias("mode"),
                                        F.max("freq").alias("freq"))


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULLs of categorical columns with the column mode (ties →
    smallest); all-null columns are left as they are."""
    modes = {r["column"]: r["mode"] for r in mode_values(df, columns).collect()}  # ≤ 1 row/column
    out = []
    for c in df.columns:
        if c in columns:
            dt = df.schema[c].dataType
            out.append(F.coalesce(F.col(f"`{c}`"), F.lit(modes.get(c)).cast(dt)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def dedupe(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (identical rows are interchangeable, so
    which copy survives does not matter)."""
    return df.dropDuplicates()


def dedupe_report(df: DataFrame) -> DataFrame:
    """``(rows_before, rows_after, removed)`` in one row."""
    before = df.agg(F.count(F.lit(1)).alias("rows_before"))
    after = df.dropDuplicates().agg(F.count(F.lit(1)).alias("rows_after"))
    b = before.select(F.col("rows_before")).scalar()
    return after.select(b.alias("rows_before"), "rows_after",
                        (b - F.col("rows_after")).alias("removed"))


def null_column_counts(df: DataFrame) -> DataFrame:
    """Non-null count per column (long), the input to :func:`drop_null_columns`."""
    row = df.agg(*[F.count(F.when(~_missing(df, c), F.lit(1))).alias(f"n{i}")
                   for i, c in enumerate(df.columns)])
    entries = ", ".join(f"'{c}', n{i}" for i, c in enumerate(df.columns))
    return row.select(F.expr(f"stack({len(df.columns)}, {entries}) AS (column, non_null)"))


def drop_null_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop columns whose every cell is missing.  The schema of the result
    depends on the data, so the per-column counts (one small row) are read
    on the driver."""
    counts = null_column_counts(df).collect()
    empty = [r["column"] for r in counts if r["non_null"] == 0]
    return df.drop(*empty), empty
