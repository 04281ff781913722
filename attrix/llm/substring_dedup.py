"""Remove passages whose 20-word windows were seen earlier in the corpus.

Method: a count-min prefilter, then exact grouping of the windows it lets by.

1. Every window of ``window`` words is named by the smallest hash among the
   8-word shingles inside it (equal windows have equal names).  The places
   that give names go into a count-min sketch; partition sketches are merged
   (:mod:`attrix.llm.sketch`).
2. Windows whose name is estimated at two places or more are grouped by a
   128-bit hash of their words; a group keeps its smallest ``doc_id``.  Repeats
   inside one document are found by the document itself, so a group holds each
   document once, and ``min(doc_id)`` combines before the shuffle: a passage
   shared by a third of all rows costs one row a task.
3. The windows each document keeps come back as one list a document; every
   other window that was grouped is a repeat, and its words go.

Defined results: null text has no words and an empty kept text; texts shorter
than a window lose nothing; windows are judged on the input; rows that share a
``doc_id`` are judged against smaller ids and against themselves, never against
each other; a null ``doc_id`` counts as the smallest id.  Extra columns are
ignored.  Window equality is equality of two independent 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm import sketch
from attrix.llm.text import (
    BASES, U64, Words, chunks, covered, id_and_text, lean_arrow, named_places, record, rolling, sliding_min,
    spans_of, text_bytes, within,
)

SHINGLE = 8
PART = 1 << 18  # bytes of text that a task takes at once where it looks windows up
NULL_ID = -(1 << 63)
RESULT = "doc_id long, n_words long, n_removed long, kept string, text string, spans array<struct<from:int,to:int>>"


class _Windows(Words):
    """The windows of a chunk of documents."""

    def __init__(self, batch: pa.RecordBatch, span: int):
        super().__init__(batch)
        n = max(0, self.total - span + 1)
        self.ok = within(self.starts, self.lengths, self.total, span)[:n]
        shingle = min(SHINGLE, span)
        self.shingles = rolling(self.hashes, shingle, BASES[0])
        self.name = sliding_min(self.shingles, span - shingle + 1)[:n]

    def names(self) -> np.ndarray:
        """The name at every place that names a window (equal windows at two
        places are named from two places, also inside one document)."""
        return named_places(self.shingles, self.name, self.ok)

    def candidates(self, repeated, span: int):
        """Positions of estimated repeats, their hashes, and whether the same
        document holds the window further left."""
        at = np.flatnonzero(self.ok)
        at = at[repeated(self.name[at])]
        a, b = (rolling(self.hashes, span, base)[at] for base in BASES)
        order = np.lexsort((at, b, a, self.doc[at]))
        same = np.zeros(len(at), bool)
        if len(at) > 1:
            x, y = order[1:], order[:-1]
            same[x] = (a[x] == a[y]) & (b[x] == b[y]) & (self.doc[at[x]] == self.doc[at[y]])
        return at, a, b, same


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def window_filter(rows: DataFrame, window: int, total_bytes: int) -> sketch.Repeated:
    bits = sketch.log2_width(total_bytes // 40)

    def count(batches):
        for b in chunks(batches):
            yield from sketch.parts(_Windows(b, window).names(), bits)

    return sketch.merge(lean_arrow(rows, count, sketch.PARTS), bits)


def substring_dedup(docs: DataFrame, window: int = 20, carry: tuple[str, ...] = (), with_kept: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept`` (kept words
    joined by one space; null unless ``with_kept``), ``text`` (the input without the
    removed words and the white space after each), ``spans`` (removed runs, in words)
    and the columns named in ``carry``."""
    kept = docs.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in carry])
    rows = id_and_text(docs)
    repeated = window_filter(rows, window, text_bytes(docs))
    shared = rows.sparkSession.sparkContext.broadcast(repeated)

    def offer(batches):
        for b in chunks(batches, PART):
            w = _Windows(b, window)
            at, a, c, same = w.candidates(shared.value, window)
            at, a, c = at[~same], a[~same], c[~same]
            if len(at):
                yield record(a=a.view(np.int64), b=c.view(np.int64), doc_id=_ids(b)[w.doc[at]])

    firsts = (
        lean_arrow(rows, offer, "a long, b long, doc_id long")
        .groupBy("a", "b").agg(F.min("doc_id").alias("key"))
        .groupBy("key").agg(F.collect_list("a").alias("firsts"))
    )

    def cut(batches):
        for b in chunks(batches, PART):
            w = _Windows(b, window)
            at, a, _, same = w.candidates(shared.value, window)
            keep = np.zeros(len(at), bool)
            lists, doc = b.column("firsts"), w.doc[at]
            bounds = np.searchsorted(doc, np.arange(b.num_rows + 1))
            for i in np.flatnonzero(np.diff(bounds)):
                if lists[int(i)].is_valid:
                    own = lists[int(i)].values.to_numpy(zero_copy_only=False).view(U64)
                    lo, hi = bounds[i], bounds[i + 1]
                    keep[lo:hi] = np.isin(a[lo:hi], own)
            gone = covered(at[same | ~keep], w.total, window)
            out = _result(b, w, gone, with_kept)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, *[b.column(f"_{c}") for c in carry]], names=[*out.schema.names, *carry])

    joined = (id_and_text(kept, *[f"_{c}" for c in carry])
              .withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID))).join(firsts, "key", "left"))
    shape = ", ".join([RESULT, *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]])
    return lean_arrow(joined.drop("key"), cut, shape)


def _result(batch: pa.RecordBatch, w: _Windows, gone: np.ndarray, with_kept: bool) -> pa.RecordBatch:
    kept, texts, spans = [], [], []
    removed = np.diff(np.r_[0, np.cumsum(gone)][np.r_[w.starts, w.total]])
    for i in range(batch.num_rows):
        text = w.text(i)
        words, cut = text.split(), []
        if removed[i]:
            first = w.starts[i]
            flags = gone[first:first + w.lengths[i]]
            kept.append(b" ".join([x for x, f in zip(words, flags.tolist()) if not f]) if with_kept else None)
            out, at = [], 0
            for lo, hi in zip(*(x.tolist() for x in spans_of(flags))):
                out.append(text[at:w.begin[first + lo] - w.offsets[i]])
                at = w.begin[first + hi] - w.offsets[i] if hi < len(words) else len(text)
                cut.append({"from": lo, "to": hi})
            texts.append(b"".join([*out, text[at:]]))
        else:
            kept.append(b" ".join(words) if with_kept else None)
            texts.append(text)
        spans.append(cut)
    nulls = batch.column("text").is_null().to_numpy(zero_copy_only=False)
    return record(
        doc_id=batch.column("doc_id"), n_words=w.lengths, n_removed=removed.astype(np.int64),
        kept=pa.array(kept, pa.binary()).cast(pa.string()),
        text=pa.array(texts, pa.binary(), mask=nulls).cast(pa.string()),
        spans=pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
    )
