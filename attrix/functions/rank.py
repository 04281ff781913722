"""A global row number without a single task.

``Window.orderBy`` without a partition key sorts the whole frame in one task.  Here the
rows are range-partitioned on the order, numbered inside their partitions and written
once (so that both passes see the same partitions); the partitions' row counts, one
number each, give the offsets."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.session import stash

#: Frames that the optimizer proves to be smaller than this many bytes are sorted in one task.
SMALL_BYTES = 64 << 20


def size_bound(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's bytes (file sizes at its leaves)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_one_task(source: DataFrame) -> bool:
    """Whether whatever is aggregated from ``source`` is proved to be small."""
    return size_bound(source) <= SMALL_BYTES


def with_row_number(df: DataFrame, order: list[Column], name: str = "rank", source: DataFrame | None = None) -> DataFrame:
    """Add ``name``: 1, 2, ... by ``order``.

    ``source``: what ``df`` was aggregated from; when its size is proved to be below
    ``SMALL_BYTES``, ``df`` cannot be larger, and one task sorts it without a write."""
    if source is not None and fits_one_task(source):
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    own = stash(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
                .withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranked")
    counts = sorted((r["_part"], r["n"]) for r in own.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = list(zip([p for p, _ in counts], accumulate([0] + [n for _, n in counts])))  # one row a partition
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return (own.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_local") + F.col("_start"))
            .drop("_part", "_local", "_start"))
