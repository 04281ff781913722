"""Vector sums over all partitions, combined by Spark rather than the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.text import map_arrow, record


def partition_sum(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part(batch)`` (a vector of ``size``) over all batches: each task
    sends one vector, Spark adds them cell by cell, ``size`` rows come back."""

    def fold(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(b)
        at = np.flatnonzero(total)
        yield record(cell=at.astype(np.int32), v=total[at])

    out = np.zeros(size)
    for r in map_arrow(df, fold, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long float arrays as a matrix."""
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)


def float_lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
