"""Count-min sketch over a whole corpus, built from merged partition sketches.

Tasks send the cells they touched, saturated at two; cells are merged band by
band (a band is a fixed slice of one sketch row, so every merge has bounded
memory), and one bit a cell -- "seen at least twice" -- comes back.  Estimates
never fall below the true count, so nothing that repeats is missed; how many
singles pass as well depends on the width only.  The bits are broadcast: at
most ``depth * 2**max_log2_width / 8`` bytes, 128 MB by default, however large
the corpus (a fuller sketch passes more singles on to the exact step).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attrix.llm.text import U64, map_arrow, record

BAND_BITS = 22
PARTS = "row int, band int, once binary, more binary"
ROW_MULTIPLIERS = (U64(0x9FB21C651E98DF25), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))


def log2_width(items: int, load: float = 0.25, max_log2_width: int = 29) -> int:
    """Cells for about ``items`` distinct values, as a power of two."""
    return int(min(max_log2_width, max(16, np.ceil(np.log2(max(1, items) / load)))))


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    x = values * ROW_MULTIPLIERS[row]
    x ^= x >> U64(32)
    return ((x * ROW_MULTIPLIERS[(row + 1) % 3]) >> U64(64 - bits)).astype(np.uint32)


def _pack(sorted_cells: np.ndarray) -> bytes:
    gaps = np.diff(sorted_cells, prepend=np.uint32(0)).astype(np.uint32)
    small = not len(gaps) or int(gaps.max()) < 1 << 16
    return (b"2" if small else b"4") + gaps.astype(np.uint16 if small else np.uint32).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data[1:], np.uint16 if data[:1] == b"2" else np.uint32), dtype=np.int64)


def parts(values: np.ndarray, bits: int, depth: int = 2) -> Iterator[pa.RecordBatch]:
    """The cells that ``values`` (uint64, repeats count) touch, band by band."""
    out: dict = {"row": [], "band": [], "once": [], "more": []}
    band_bits = min(BAND_BITS, bits)
    for row in range(depth):
        cell = np.sort(cells(values, row, bits))
        if not len(cell):
            continue
        first = np.r_[True, cell[1:] != cell[:-1]]
        at = np.flatnonzero(first)
        count = np.diff(np.r_[at, len(cell)])
        cell = cell[at]
        band = cell >> np.uint32(band_bits)
        low = cell & np.uint32((1 << band_bits) - 1)
        cuts = np.r_[0, np.flatnonzero(np.diff(band)) + 1, len(band)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            twice = count[lo:hi] > 1
            out["row"].append(row)
            out["band"].append(int(band[lo]))
            out["once"].append(_pack(low[lo:hi][~twice]))
            out["more"].append(_pack(low[lo:hi][twice]))
    if out["row"]:
        yield record(row=pa.array(out["row"], pa.int32()), band=pa.array(out["band"], pa.int32()),
                     once=pa.array(out["once"], pa.binary()), more=pa.array(out["more"], pa.binary()))


class Repeated:
    """Broadcastable answer to "may this value occur twice or more?"."""

    def __init__(self, bits: int, rows: list[np.ndarray]):
        self.bits, self.rows = bits, rows

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for r, row in enumerate(self.rows):
            c = cells(values, r, self.bits)
            out &= (row[c >> np.uint32(3)] >> (np.uint32(7) - (c & np.uint32(7))).astype(np.uint8)) & 1 == 1
        return out


def merge(part_rows: DataFrame, bits: int, depth: int = 2) -> Repeated:
    """Merge the tasks' cells.  Each band streams through one task, sorted, so
    a merge holds one band of counters whatever the number of parts."""
    band_bits = min(BAND_BITS, bits)

    def fold(batches):
        key, count = None, None

        def done():
            return record(row=pa.array([key[0]], pa.int32()), band=pa.array([key[1]], pa.int32()),
                          bits=pa.array([np.packbits(count >= 2).tobytes()], pa.binary()))

        for b in batches:
            for row, band, once, more in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (row, band) != key:
                    if key is not None:
                        yield done()
                    key, count = (row, band), np.zeros(1 << band_bits, np.uint8)
                at = _unpack(once)
                count[at] = np.minimum(count[at] + 1, 2)
                count[_unpack(more)] = 2
        if key is not None:
            yield done()

    merged = map_arrow(part_rows.repartition("row", "band").sortWithinPartitions("row", "band"),
                       fold, "row int, band int, bits binary")
    rows = [np.zeros(1 << max(0, bits - 3), np.uint8) for _ in range(depth)]
    size = (1 << band_bits) >> 3
    for r in merged.collect():
        rows[r["row"]][r["band"] * size:(r["band"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return Repeated(bits, rows)
