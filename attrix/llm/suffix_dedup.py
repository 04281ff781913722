"""Remove every byte of a 200-byte string that occurs anywhere else.

Method: suffix arrays per shard, merged across shards.

1. Every 200-byte window is named by the smallest hash among the 32-byte grams
   in it; equal windows have equal names.  A count-min sketch over the naming
   places drops names that occur once (an overestimate: no repeat is lost).
2. The remaining windows travel as *pieces*: the bytes of neighbouring windows
   with one name.  Equal pieces of a task become one row with a count, so a text
   that a third of the rows copy is one row a task.  Pieces go to shards by name,
   hence equal windows meet.
3. Each shard sorts the suffixes of its pieces by Larsson-Sadakane refinement
   (ranks of h bytes order 2h bytes; only unsorted groups are sorted again) to
   depth 200, and takes common prefixes of neighbours by Kasai's rule: along a
   diagonal of the text the prefix shrinks by one, so each diagonal is extended
   once.  A window with a neighbour that shares 200 bytes is repeated.
4. A name met very often is dealt to several shards by piece.  The distinct
   windows of such a shard go on as a run of sorted 128-bit hashes, cut by hash
   range; the runs of a range are merged by binary search.
5. A window found alone occurs exactly once, so its finding returns to that one
   document; all other windows that travelled are repeats.

Defined results: null text is empty; texts under 200 bytes lose nothing;
overlapping repeats count; rows that repeat (also with one ``doc_id``) are
separate places, so equal rows remove each other; extra columns are ignored.
Gram names compare by 64-bit hash, pieces by 128 bits, windows by their bytes
(inside a shard) or 128 bits (across shards).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm import sketch
from attrix.llm.text import (
    BASES, U64, chunks, covered, id_and_text, map_arrow, named_places, raw, record, rolling, ship_package, sliding_min,
    spans_of, stash, text_bytes, within,
)

GRAM = 32
NULL_ID = -(1 << 63)
SHARD_BYTES, SUB_SHARD_PIECES, BLOCK_BYTES = 2 << 20, 4096, 16 << 20
MAX_FREQUENT = 1 << 16  # bound of the broadcast list of frequent names (1 MB)
PIECE = "shard int, heavy boolean, n long, doc_id long, start long, mark long, body binary"
ALONE = "doc_id long, start long, mark long, alone binary"
RUN = "range int, a binary, b binary, doc binary, start binary, mark binary, at binary"
RESULT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<from:long,to:long>>"


class _Windows:
    """Named windows of a chunk of texts, in bytes."""

    def __init__(self, batch: pa.RecordBatch, span: int):
        self.data, self.offsets = raw(batch)
        self.lengths = np.diff(self.offsets)
        self.starts = self.offsets[:-1]
        n = max(0, len(self.data) - span + 1)
        self.ok = within(self.starts, self.lengths, len(self.data), span)[:n]
        gram = min(GRAM, span)
        self.grams = rolling(self.data.astype(U64) + U64(1), gram, BASES[0])
        self.name = sliding_min(self.grams, span - gram + 1)[:n]

    def names(self) -> np.ndarray:
        return named_places(self.grams, self.name, self.ok)

    def pieces(self, repeated) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of neighbouring windows with one name that may repeat:
        row, first window and last window."""
        use = np.zeros(len(self.name), bool)
        at = np.flatnonzero(self.ok)
        if not len(at):
            return at, at, at
        fresh = np.r_[True, self.name[1:] != self.name[:-1]]
        run = np.cumsum(fresh) - 1
        use[at] = repeated(self.name[np.flatnonzero(fresh)])[run[at]]
        head = use & (fresh | ~np.r_[False, use[:-1]])
        tail = use & np.r_[fresh[1:] | ~use[1:], True]
        first, last = np.flatnonzero(head), np.flatnonzero(tail)
        return np.searchsorted(self.offsets, first, "right") - 1, first, last


def _mark(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def refine(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by the first ``depth`` bytes (Larsson and Sadakane)."""
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    key = np.zeros(n, U64)
    for j in range(8):
        key = (key << U64(8)) | padded[j:j + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    sorted_key = key[order]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1

    def regroup(slots: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Give each group the slot of its first member; slots still unsorted."""
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = first
        lone = new & np.r_[new[1:], True]
        return slots[~lone]

    slots = np.arange(n, dtype=np.int32)
    slots = regroup(slots, np.r_[True, sorted_key[1:] != sorted_key[:-1]][:n])
    del key, sorted_key
    have = min(8, depth)
    while have < depth and len(slots):
        step = min(have, depth - have)
        at = order[slots]
        key = (rank[at].astype(np.int64) << 32) + (rank[np.minimum(at.astype(np.int64) + step, n)] + 1)
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        order[slots] = at[turn]
        slots = regroup(slots, np.r_[True, key[1:] != key[:-1]])
        have += step
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the text, the bytes (``depth`` at most) its suffix
    shares with the one before it in the suffix array (Kasai et al.)."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    tail = np.ones(n, bool)
    tail[:-1] = before[1:] != before[:-1] + 1
    ends = np.flatnonzero(tail)
    grown = np.zeros(len(ends), np.int64)  # one extension for each diagonal
    live = np.flatnonzero(before[ends] >= 0)
    for _ in range(depth):
        x, y = ends[live] + grown[live], before[ends[live]] + grown[live]
        live = live[(np.maximum(x, y) < n) & (data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)])]
        if not len(live):
            break
        grown[live] += 1
    end = ends[np.searchsorted(ends, place)]
    reach = end + grown[np.searchsorted(ends, place)]
    differ = np.flatnonzero((before < 0) | (data != data[np.maximum(before, 0)]))
    spot = np.searchsorted(differ, place)
    stop = differ[np.minimum(spot, len(differ) - 1)] if len(differ) else np.full(n, n)
    inside = (spot < len(differ)) & (stop <= end)
    return np.minimum(np.where(inside, stop, reach) - place, depth)


def _pieces(repeated, frequent: np.ndarray, hits: np.ndarray, span: int, shards: int):
    def run(batches):
        held, size = {}, 0

        def flush():
            rows = list(held.values())
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["shard", "heavy", "n", "doc_id", "start", "mark", "body"]
            for lo in range(0, len(rows), 2000):
                part = list(zip(*rows[lo:lo + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names=names)

        for b in chunks(batches):
            w = _Windows(b, span)
            row, first, last = w.pieces(repeated.value)
            if not len(row):
                continue
            ids = _ids(b)[row].tolist()
            name = w.name[first]
            spot = np.minimum(np.searchsorted(frequent, name), max(0, len(frequent) - 1))
            often = (frequent[spot] == name) if len(frequent) else np.zeros(len(name), bool)
            parts = np.where(often, hits[spot] // SUB_SHARD_PIECES + 1, 1) if len(frequent) else np.ones(len(name), int)
            whole = w.data.tobytes()
            for i, (x, y) in enumerate(zip(first.tolist(), last.tolist())):
                body = whole[x:y + span]
                mark = _mark(body)
                have = held.get((mark, body))
                if have is not None:
                    have[2] += 1
                    continue
                many = int(parts[i])
                home = (int(name[i]) ^ (mark % many * 0x9E3779B97F4A7C15 if many > 1 else 0)) % ((1 << 61) - 1) % shards
                held[mark, body] = [home, many > 1, 1, ids[i], x - int(w.starts[row[i]]), mark, body]
                size += len(body)
            if size > BLOCK_BYTES:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return run


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _shard(span: int, ranges: int):
    """Windows that occur once in a shard: final, or as runs for the merge."""

    def run(table: pa.Table) -> pa.Table:
        bodies, count = table.column("body").to_pylist(), table.column("n").to_numpy().copy()
        heavy = table.column("heavy").to_numpy()
        info = [table.column(c).to_numpy() for c in ("doc_id", "start", "mark")]
        first: dict[bytes, int] = {}
        keep = []
        for i, body in enumerate(bodies):  # equal pieces of several tasks
            j = first.setdefault(body, i)
            if j == i:
                keep.append(i)
            else:
                count[j] += count[i]
        del first
        keep = np.array(keep)
        length = np.array([len(bodies[i]) for i in keep]) + 1  # a byte that UTF-8 never has ends each piece
        data = np.frombuffer(b"\xff".join([bodies[i] for i in keep]) + b"\xff", np.uint8)
        order = refine(data, span)
        again = common_prefixes(data, order, span) >= span
        nxt = np.zeros(len(data), bool)
        nxt[order[:-1]] = again[order[1:]]
        starts = np.cumsum(length) - length
        piece = np.repeat(np.arange(len(keep)), length)
        offset = np.arange(len(data)) - starts[piece]
        valid = offset + span < length[piece]
        alone = valid & ~again & ~nxt & (count[keep] == 1)[piece]
        often = heavy[keep][piece]
        at = np.flatnonzero(alone & ~often)
        out = {"doc_id": [], "start": [], "mark": [], "alone": []}
        bounds = np.searchsorted(piece[at], np.arange(len(keep) + 1))
        spots = offset[at].astype(np.uint32)
        for p in np.flatnonzero(np.diff(bounds)):
            i = keep[p]
            for k, v in zip(("doc_id", "start", "mark"), info):
                out[k].append(v[i])
            out["alone"].append(spots[bounds[p]:bounds[p + 1]].tobytes())
        runs = {k: [] for k in ("range", "a", "b", "doc", "start", "mark", "at")}
        at = np.flatnonzero(valid & ~again & often)  # each distinct window once
        if len(at):
            wide = data.astype(U64) + U64(1)
            a, b = (rolling(wide, span, base)[at] for base in BASES)
            turn = np.lexsort((b, a))
            at, a, b = at[turn], a[turn], b[turn]
            source = keep[piece[at]]
            slot = (a >> U64(40)).astype(np.int64) * ranges >> 24
            cuts = np.searchsorted(slot, np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[r], cuts[r + 1])
                runs["range"].append(int(r))
                runs["a"].append(a[s].tobytes())
                runs["b"].append(b[s].tobytes())
                for k, v in zip(("doc", "start", "mark"), info):
                    runs[k].append(v[source[s]].tobytes())
                runs["at"].append((offset[at[s]] * 2 + alone[at[s]]).astype(np.uint32).tobytes())
        return _found(out, runs)

    return run


def _found(out: dict, runs: dict) -> pa.Table:
    n, m = len(out["doc_id"]), len(runs["range"])
    return pa.table({
        "doc_id": pa.array(list(out["doc_id"]) + [None] * m, pa.int64()),
        "start": pa.array(list(out["start"]) + [None] * m, pa.int64()),
        "mark": pa.array(list(out["mark"]) + [None] * m, pa.int64()),
        "alone": pa.array(out["alone"] + [None] * m, pa.binary()),
        "range": pa.array([None] * n + runs["range"], pa.int32()),
        **{f"r_{k}": pa.array([None] * n + runs[k], pa.binary()) for k in ("a", "b", "doc", "start", "mark", "at")},
    })


def merge_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted runs of distinct (a, b) hashes: which entries no other run
    holds.  Runs are merged one by one by binary search."""
    pair = np.dtype([("a", "u8"), ("b", "u8")])
    merged = np.empty(0, pair)
    seen = np.empty(0, np.int64)
    for r in runs:
        at = np.searchsorted(merged, r)
        hit = (at < len(merged)) & (merged[np.minimum(at, max(0, len(merged) - 1))] == r) if len(merged) else np.zeros(len(r), bool)
        seen[at[hit]] += 1
        merged, seen = np.insert(merged, at[~hit], r[~hit]), np.insert(seen, at[~hit], 1)
    return [seen[np.searchsorted(merged, r)] == 1 for r in runs]


def _merge(table: pa.Table) -> pa.Table:
    pair = np.dtype([("a", "u8"), ("b", "u8")])
    runs, refs = [], []
    for row in zip(*(table.column(f"r_{k}").to_pylist() for k in ("a", "b", "doc", "start", "mark", "at"))):
        a, b, doc, start, mark = (np.frombuffer(x, t) for x, t in zip(row[:5], (U64, U64, "i8", "i8", "i8")))
        r = np.empty(len(a), pair)
        r["a"], r["b"] = a, b
        runs.append(r)
        refs.append((doc, start, mark, np.frombuffer(row[5], np.uint32)))
    alone = [once & (r[3] & 1 == 1) for once, r in zip(merge_runs(runs), refs)]
    doc, start, mark, at = (np.concatenate([r[k][f] for r, f in zip(refs, alone)]) for k in range(4))
    turn = np.lexsort((at, mark, start, doc))
    doc, start, mark, at = doc[turn], start[turn], mark[turn], at[turn]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (mark[1:] != mark[:-1])][:len(doc)]
    first = np.flatnonzero(new)
    cuts = np.r_[first, len(doc)]
    return pa.table({"doc_id": doc[first], "start": start[first], "mark": mark[first],
                     "alone": pa.array([(at[x:y] >> np.uint32(1)).tobytes() for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())})


def suffix_dedup(docs: DataFrame, span: int = 200) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, kept`` (the other
    bytes) and ``spans`` (maximal removed runs, in bytes)."""
    rows = id_and_text(docs)
    spark = rows.sparkSession
    total = text_bytes(docs)
    bits = sketch.log2_width(total // 60)
    shards = max(8, total // SHARD_BYTES)
    ranges = max(8, total // SHARD_BYTES)

    def count(batches):
        block, size = [], 0

        def frequent():
            name, hits = np.unique(np.concatenate(block), return_counts=True)
            name, hits = name[hits > 8], hits[hits > 8]
            return record(row=pa.array([-1], pa.int32()), band=pa.array([0], pa.int32()),
                          once=pa.array([name.tobytes()], pa.binary()),
                          more=pa.array([hits.astype(np.int64).tobytes()], pa.binary()))

        for b in chunks(batches):
            names = _Windows(b, span).names()
            yield from sketch.parts(names, bits)
            block.append(names)
            size += len(names)
            if size > 1 << 20:
                yield frequent()
                block, size = [], 0
        if size:
            yield frequent()

    counted = stash(map_arrow(rows, count, sketch.PARTS), "names")
    often = (map_arrow(counted.where("row < 0"), _unfold, "name long, hits long").groupBy("name")
             .agg(F.sum("hits").alias("hits")).where(F.col("hits") >= SUB_SHARD_PIECES)
             .orderBy(F.desc("hits"), "name").limit(MAX_FREQUENT).collect())
    frequent = np.array([r["name"] for r in often], np.int64).view(U64)
    hits = np.array([r["hits"] for r in often], np.int64)
    turn = np.argsort(frequent)
    frequent, hits = frequent[turn], hits[turn]
    repeated = spark.sparkContext.broadcast(sketch.merge(counted.where("row >= 0"), bits))
    ship_package(spark)

    pieces = map_arrow(rows, _pieces(repeated, frequent, hits, span, shards), PIECE)
    kinds = ALONE + ", range int, " + ", ".join(f"r_{k} binary" for k in ("a", "b", "doc", "start", "mark", "at"))
    found = stash(pieces.groupBy("shard").applyInArrow(_shard(span, ranges), kinds), "alone")
    merged = found.where("range is not null").groupBy("range").applyInArrow(_merge, ALONE)
    alone = (found.where("range is null").select("doc_id", "start", "mark", "alone").unionByName(merged)
             .groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("start", "mark", "alone")).alias("once")))

    def cut(batches):
        for b in chunks(batches):
            yield _result(b, _Windows(b, span), repeated.value, span)

    joined = rows.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID))).join(alone, "key", "left")
    return map_arrow(joined.select("doc_id", "text", "once"), cut, RESULT)


def _unfold(batches):
    for b in batches:
        for once, more in zip(b.column("once").to_pylist(), b.column("more").to_pylist()):
            yield record(name=np.frombuffer(once, np.int64), hits=np.frombuffer(more, np.int64))


def _result(batch: pa.RecordBatch, w: _Windows, repeated, span: int) -> pa.RecordBatch:
    row, first, last = w.pieces(repeated)
    hit = np.zeros(max(1, len(w.data)), bool)
    edge = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    hit = np.cumsum(edge[:-1]) > 0
    whole = w.data.tobytes()
    lists = batch.column("once").to_pylist()
    here = {}
    for r, x, y in zip(row.tolist(), first.tolist(), last.tolist()):
        if lists[r]:
            here[r, x - int(w.starts[r])] = (x, y)
    for r, found in enumerate(lists):
        for f in found or ():
            x, y = here.get((r, f["start"]), (0, -1))
            if y >= x and _mark(whole[x:y + span]) == f["mark"]:
                hit[x + np.frombuffer(f["alone"], np.uint32)] = False
    gone = covered(np.flatnonzero(hit), len(w.data), span)
    removed = np.diff(np.r_[0, np.cumsum(gone)][w.offsets])
    kept, spans = [], []
    for r in range(batch.num_rows):
        x, y = w.offsets[r], w.offsets[r + 1]
        if removed[r]:
            flags = gone[x:y]
            kept.append(w.data[x:y][~flags].tobytes())
            spans.append([{"from": lo, "to": hi} for lo, hi in zip(*(v.tolist() for v in spans_of(flags)))])
        else:
            kept.append(whole[x:y])
            spans.append([])
    return record(doc_id=batch.column("doc_id"), n_bytes=w.lengths, n_removed=removed.astype(np.int64),
                  kept=pa.array(kept, pa.binary()),
                  spans=pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))))
