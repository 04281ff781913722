"""Table sources: CSV (header, UTF-8, inferred types, reader NA tokens) and
Parquet, plus the snapshot/reset handle.

A CSV is read with Spark's distributed reader; NA tokens are mapped to NULL
on string columns *before* type inference so that a column like
``"1", "NA", "3"`` still becomes numeric.  A file that cannot be read
raises :class:`SourceError` with the reader's message (never a silent
``None``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrix.operators.profile import NA_TOKENS


class SourceError(RuntimeError):
    pass


def _na_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(c.isin(NA_TOKENS), None).otherwise(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def _infer(df: DataFrame) -> DataFrame:
    """Cast all-string columns to long / double when every
    non-null value converts (the CSV reader's inference, re-run after NA
    mapping)."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        if not isinstance(f.dataType, T.StringType):
            continue
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"n{i}"),
                 F.count(F.expr(f"try_cast(`{f.name}` AS BIGINT)")).alias(f"l{i}"),
                 F.count(F.expr(f"try_cast(`{f.name}` AS DOUBLE)")).alias(f"d{i}")]
    if not aggs:
        return df
    r = df.agg(*aggs).first()
    cols = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and r[f"n{i}"] > 0:
            if r[f"l{i}"] == r[f"n{i}"]:
                cols.append(c.cast("bigint").alias(f.name))
                continue
            if r[f"d{i}"] == r[f"n{i}"]:
                cols.append(c.cast("double").alias(f.name))
                continue
        cols.append(c)
    return df.select(*cols)


CORRUPT = "_corrupt_record"


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may hold a newline: some line has an odd number of quotes
    (doubled quotes come in pairs)."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(path).where(odd).isEmpty()


def _raw_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All columns as text, quoted newlines and doubled quotes read as such,
    and ``_corrupt_record`` with the source of rows that have other fields than
    the header.  Files without a quoted newline are split, one task a block;
    others are read whole, one task a file."""
    if multi_line is None:
        multi_line = spans_lines(spark, path)
    options = dict(header=True, encoding="UTF-8", multiLine=multi_line, quote='"', escape='"',
                   mode="PERMISSIVE", inferSchema=False)
    names = spark.read.options(**options).csv(path).schema.fieldNames()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    return spark.read.options(**options, columnNameOfCorruptRecord=CORRUPT).schema(schema).csv(path)


def corrupt_rows(spark: SparkSession, path: str, multi_line: bool | None = None) -> int:
    """How many rows have more or fewer fields than the header."""
    df = _raw_csv(spark, path, multi_line)
    return df.select(F.count(CORRUPT), *[F.count(f"`{c}`") for c in df.columns]).first()[0]


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Header row, UTF-8, quoted fields with newlines and doubled quotes, NA
    tokens → NULL, numbers inferred.  Malformed rows are kept (PERMISSIVE) and
    counted by :func:`corrupt_rows`.  ``multi_line``: whether quoted fields hold
    newlines; by default a first pass over the lines finds out."""
    if not path.lower().endswith(".csv") and not path.endswith("/"):
        raise SourceError(f"not a .csv path: {path}")
    try:
        raw = _raw_csv(spark, path, multi_line).drop(CORRUPT)  # lists the files, so errors surface here
    except Exception as e:  # noqa: BLE001
        raise SourceError(f"cannot read {path}: {e}") from e
    df = _na_to_null(raw)
    return _infer(df) if infer else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018
        return df
    except Exception as e:  # noqa: BLE001
        raise SourceError(f"cannot read {path}: {e}") from e


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the suffix (case-sensitive ``.csv``, as the reference)."""
    if path.endswith(".csv"):
        return read_csv(spark, path)
    return read_parquet(spark, path)


@dataclass
class Snapshot:
    """The loaded table and its pristine handle.  Frames are immutable, so
    "reset" is just returning the original handle; ``cache`` persists the
    profiled frame so repeated analyses do not re-parse the file."""
    original: DataFrame
    current: DataFrame

    @classmethod
    def of(cls, df: DataFrame, cache: bool = False) -> "Snapshot":
        if cache:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        return cls(df, df)

    def apply(self, fn, *args, **kwargs) -> "Snapshot":
        out = fn(self.current, *args, **kwargs)
        self.current = out[0] if isinstance(out, tuple) else out
        return self

    def reset(self) -> "Snapshot":
        self.current = self.original
        return self
