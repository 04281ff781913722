"""Text batches as numpy arrays: words, rolling hashes and sliding minima.

A *word* is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``
(``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes, which never splits a character).
All helpers work on a chunk of whole documents laid end to end; positions
never cross a document boundary.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.session import ship_package, stash  # noqa: F401

CHUNK_BYTES = 1 << 20
U64 = np.uint64
#: Odd multipliers of the rolling hashes and of the finaliser (arbitrary, fixed).
BASES = (U64(0x9E3779B97F4A7C15 | 3), U64(0xD1342543DE82EF95))
MIX = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Texts are long: so many bytes of rows go to a worker at once, not as many rows as usual.
BATCH_BYTES = 4 << 20


def lean_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``map_arrow`` with Arrow batches of at most ``BATCH_BYTES`` (a setting of the
    session, lowered if it is higher) and freed memory given back to the system when a
    task ends, as workers are used again."""
    spark = df.sparkSession
    have = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not have.isdigit() or int(have) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back_memory()

    return map_arrow(df, run, schema)


#: A setting of Spark: shuffle files go when the query that wrote them ends, instead of
#: when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark) -> Iterator[None]:
    """For steps that end in ``stash`` or on the driver; a frame that is handed on, and may
    be run again, is built afterwards."""
    had = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if had is None else spark.conf.set(FREED, had)


def give_back_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def id_and_text(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` as bytes; null text stays null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        *[F.col(c) for c in extra],
    )


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one aggregate; used to size sketches and shards)."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows of about ``limit`` text bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
            yield b.slice(int(lo), int(hi - lo))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Lower case, and ASCII punctuation as white space.
PLAIN = _LOWER.copy()
PLAIN[[i for i in range(0x80) if not chr(i).isalnum()]] = 0x20


def raw(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and each row's offsets."""
    col = batch.column(name)
    if col.null_count:
        col = col.fill_null(b"")
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0]:at[-1]] if body is not None else np.empty(0, np.uint8)
    return data, at - at[0]


class Words:
    """The words of a chunk of documents, in order.

    ``begin``/``end``: byte positions in the chunk; ``doc``: the row of each
    word; ``starts``/``lengths``: first word and number of words of each row;
    ``hashes``: 64-bit hash of each word.  ``table`` maps bytes beforehand."""

    def __init__(self, batch: pa.RecordBatch, lower: bool = False, table: np.ndarray | None = None):
        self.data, self.offsets = raw(batch)
        table = _LOWER if lower and table is None else table
        data = self.data if table is None else table[self.data]
        n = len(data)
        word = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[data], out=word[1:-1])
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        self.begin = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        self.end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        self.total = len(self.begin)
        bounds = np.searchsorted(self.begin, self.offsets)
        self.starts, self.lengths = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(batch.num_rows), self.lengths)
        self.hashes = np.empty(0, U64)
        if self.total:
            size = self.end - self.begin
            powers = np.cumprod(np.full(int(size.max()) + 1, BASES[1], U64), dtype=U64)
            first = int(self.begin[0])
            place = np.arange(first, n) - np.repeat(self.begin, np.diff(np.r_[self.begin, n]))
            value = (data[first:].astype(U64) + U64(1)) * powers[np.minimum(place, int(size.max()))]
            value[~word[1 + first:-1]] = 0
            self.hashes = mix(np.add.reduceat(value, self.begin - first))

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on all inputs."""
    x = x ^ (x >> U64(33))
    x *= MIX[0]
    x ^= x >> U64(33)
    x *= MIX[1]
    x ^= x >> U64(33)
    return x


_POWERS: dict = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = U64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[U64(1), np.full(size - 1, base, U64)], dtype=U64)
            down = np.cumprod(np.r_[U64(1), np.full(size - 1, inverse, U64)], dtype=U64)
        have = _POWERS[int(base)] = (up, down)
        if size > 1 << 23:  # a single huge text: do not keep its tables
            del _POWERS[int(base)]
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Mixed hash of ``values[i:i+length]`` for each i (polynomial mod 2**64)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = _powers(base, len(values))
    prefix = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=prefix[1:])
    return mix((prefix[length:] - prefix[:n]) * down[:n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have, out = 1, a
    while have < width and len(out):
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sliding_max(a: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, a
    while have < width and len(out):
        step = min(have, width - have)
        out = np.maximum(out[:-step], out[step:])
        have += step
    return out


def named_places(shingles: np.ndarray, name: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Shingle hashes that are the smallest of a valid window they lie in;
    ``name[i]`` is the smallest of the window that begins at shingle ``i``."""
    if not ok.any():
        return np.empty(0, U64)
    width = len(shingles) - len(name) + 1
    pad = np.zeros(width - 1, U64)
    most = sliding_max(np.r_[pad, np.where(ok, name, U64(0)), pad], width)
    return shingles[(shingles == most) & (most > 0)]


def within(starts: np.ndarray, lengths: np.ndarray, total: int, span: int) -> np.ndarray:
    """True for positions whose ``span`` elements lie in one document."""
    end = np.repeat(starts + lengths, lengths)
    return np.arange(total) + span <= end


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the runs of True."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(hits: np.ndarray, total: int, span: int) -> np.ndarray:
    """True for elements that lie in a window (of ``span``) starting at a hit."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, np.minimum(hits + span, total), -1)
    return np.cumsum(edge[:-1]) > 0


def record(**values) -> pa.RecordBatch:
    """A record batch from numpy arrays, lists or Arrow arrays."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v) for v in values.values()], names=list(values)
    )
