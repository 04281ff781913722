"""Find benchmark items inside documents, up to a share of word edits.

Method: CGK random walks turn edit distance over words into Hamming distance;
each of ``R`` repetitions samples two places of the embedding of every
item-sized window and looks the pair up among the items' (bit-sampling LSH);
candidates are verified by an exact edit distance against the best aligned part
of the text.  Walks drift apart with every edit, so each repetition walks ``WALK``
steps from its own random word of the window, forwards or backwards: together they
sample all of it, and edits in one place cannot spoil every repetition.  ``R`` is found
for each item length by trials: the least number that finds the target recall of
``TRIALS`` random passages of each kind with ``floor(share * n)`` edits -- substitutions,
insertions and deletions anywhere, substitutions all in front, at the end, in the
middle, and in halves at both ends, and deletions at both ends -- and within ``MARGIN``
of it of as many fresh ones.  More than ``MOST`` is an error.  Windows
are embedded only where they can match at all: a passage with ``k`` edits holds
an unedited run of ``floor((n - k) / (k + 1))`` item words and ``n - 2k`` words
of items of that length (both lossless).

Words are compared without case and ASCII punctuation.  The benchmark is a
stated query set: it is read in blocks of at most ``BLOCK`` items, each held by
all tasks (about 1 kB an item), and all rows are searched for each block.

Defined results: null or blank texts and items match nothing; items with equal
words each match; several places of one item in one document are each
reported; rows and ids that repeat are treated one by one; extra columns are
ignored; an empty benchmark or table gives no hits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.text import BASES, PLAIN, U64, Words, chunks, id_and_text, map_arrow, mix, rolling

BLOCK, SAMPLED, WALK, SEED = 20_000, 2, 40, 7
TRIALS, MOST, KINDS, MARGIN = 120, 4000, 8, 0.02
CHUNK = 8 << 20
HITS = "array<struct<item_id:long,from:int,to:int,edits:int>>"


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, salt: np.ndarray, places) -> list[np.ndarray]:
    """The walk's symbols at ``places`` for windows of ``n`` words from each
    start; 0 stands for "past the window's end"."""
    at = starts.copy()
    stop = np.minimum(starts + n, ends)
    out = []
    for j in range(max(places) + 1):
        inside = at < stop
        symbol = np.where(inside, words[np.minimum(at, len(words) - 1)], U64(0))
        if j in places:
            out.append(symbol)
        at += ((mix(symbol ^ salt[j]) >> U64(63)) == 1) & inside
    return out


def window_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, rep: tuple) -> np.ndarray:
    """Keys of one repetition for windows of ``n`` words from each start."""
    places, salt, back, offset = rep
    if back:
        starts, ends = len(words) - np.minimum(starts + n, ends), len(words) - starts
        words = words[::-1]
    out = np.zeros(len(starts), U64)
    for symbol in embed(words, starts + offset, ends, n - offset, salt, places):
        out = mix(out * BASES[0] + symbol)
    return out


def edited(size: int, k: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Random items and passages of them with ``k`` edits, kind by kind."""
    def fresh(n):
        return rng.integers(1, 1 << 63, n).astype(U64)

    half, middle = k // 2, (size - k) // 2
    ends = np.r_[0:half, size - (k - half):size]
    spots = {3: np.arange(k), 4: np.arange(size - k, size), 5: np.arange(middle, middle + k), 6: ends}
    out = []
    for kind in range(KINDS):
        for _ in range(TRIALS):
            item = fresh(size)
            if kind == 1:
                passage = np.insert(item, rng.integers(0, size + 1, k), fresh(k))
            elif kind in (2, 7):
                passage = np.delete(item, rng.choice(size, k, replace=False) if kind == 2 else ends)
            else:
                passage = item.copy()
                passage[spots.get(kind, rng.choice(size, k, replace=False))] = fresh(k)
            out.append((item, passage))
    return out


class Trials:
    """Passages inside other words, and which of them some repetition has found."""

    def __init__(self, size: int, k: int, rng):
        pairs = edited(size, k, rng)
        self.size, self.items = size, np.concatenate([p[0] for p in pairs])
        pads = [rng.integers(1, 1 << 63, size + k + 2).astype(U64) for _ in range(2 * len(pairs))]
        texts = [np.r_[pads[2 * i], p[1], pads[2 * i + 1]] for i, p in enumerate(pairs)]
        stop = np.cumsum([len(t) for t in texts])
        begin = stop - np.array([len(t) for t in texts]) + size + k + 2
        self.starts = begin[:, None] + np.arange(-k - 2, k + 3)  # the windows that a search embeds there
        self.words, self.own = np.concatenate(texts), np.arange(len(pairs)) * size
        self.ends = np.repeat(stop, self.starts.shape[1])
        self.found = np.zeros(len(pairs), bool)

    def add(self, rep: tuple) -> None:
        left = np.flatnonzero(~self.found)
        if not len(left):
            return
        goal = window_keys(self.items, self.own[left], self.own[left] + self.size, self.size, rep)
        ends = self.ends.reshape(self.starts.shape)[left].ravel()
        keys = window_keys(self.words, self.starts[left].ravel(), ends, self.size, rep)
        self.found[left] = (keys.reshape(len(left), -1) == goal[:, None]).any(1)

    def recall(self) -> float:
        """Of the kind that is found least."""
        return float(self.found.reshape(KINDS, TRIALS).mean(1).min())


@lru_cache(1 << 12)
def repetitions(size: int, share: float, target_recall: float) -> list[tuple]:
    """Places, salt, direction and offset of each repetition that items of ``size``
    words need."""
    rng = np.random.default_rng([SEED, size])
    choose, confirm = (Trials(size, int(share * size), rng) for _ in range(2))
    reps: list[tuple] = []
    while not reps or choose.recall() < target_recall or confirm.recall() < target_recall - MARGIN:
        if len(reps) == MOST:
            raise ValueError(f"{MOST} repetitions find less than {target_recall} of items of {size} words with a share of {share} edits")
        offset = int(rng.integers(0, max(1, size - WALK // 2 + 1)))
        steps = min(2 * (size - offset), WALK)
        rep = (sorted(rng.choice(steps, min(SAMPLED, steps), replace=False).tolist()),
               rng.integers(0, 1 << 63, steps).astype(U64), len(reps) % 2 == 1, offset)
        reps.append(rep)
        choose.add(rep)
        confirm.add(rep)
    return reps


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between ``item`` and any part of ``text``, and that part."""
    m = len(text)
    steps = np.arange(m + 1)
    cost, begin = np.zeros(m + 1, np.int64), steps.copy()
    for i, w in enumerate(item):
        swap = cost[:-1] + (text != w)
        up = cost[1:] + 1
        new = np.empty(m + 1, np.int64)
        start = np.empty(m + 1, np.int64)
        new[0], start[0] = i + 1, 0
        new[1:], start[1:] = np.minimum(swap, up), np.where(swap <= up, begin[:-1], begin[1:])
        code = ((new - steps) << 32) + steps  # insertions: carry the best from the left
        left = np.minimum.accumulate(code) & 0xFFFFFFFF
        better = new[left] + steps - left < new
        source = np.where(better, left, steps)
        cost, begin = new[source] + steps - source, start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Lookup:
    """Membership in a set of hashes: a bit table first, then exactly."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << 18, bool)
        self.table[self.values >> U64(46)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.table[hashes >> U64(46)]
        may = np.flatnonzero(out)
        spot = np.minimum(np.searchsorted(self.values, hashes[may]), len(self.values) - 1)
        out[may] = self.values[spot] == hashes[may]
        return out


class Items:
    """The items of one block, by number of words."""

    def __init__(self, ids: list[int], texts: list[bytes], share: float, target_recall: float):
        words = Words(pa.record_batch([pa.array(texts, pa.binary())], names=["text"]), table=PLAIN)
        self.ids, self.by_size, grams = ids, {}, {}
        self.words = [words.hashes[s:s + n] for s, n in zip(words.starts, words.lengths)]
        for size in sorted({len(w) for w in self.words} - {0}):
            own = [i for i, w in enumerate(self.words) if len(w) == size]
            k = int(share * size)
            reps = []
            for rep in repetitions(size, share, target_recall):
                flat = np.concatenate([self.words[i] for i in own])
                starts = np.arange(len(own)) * size
                key = window_keys(flat, starts, starts + size, size, rep)
                order = np.argsort(key)
                reps.append((rep, key[order], np.array(own)[order]))
            run = min(4, max(1, (size - k) // (k + 1)))
            found = np.unique(np.concatenate([rolling(self.words[i], run, BASES[0]) for i in own]))
            grams.setdefault(run, []).append((size, found))
            self.by_size[size] = (k, Lookup(np.concatenate([self.words[i] for i in own])), reps)
        self.grams = {}
        for run, parts in grams.items():
            gram = np.concatenate([g for _, g in parts])
            size = np.concatenate([np.full(len(g), s) for s, g in parts])
            order = np.argsort(gram, kind="stable")
            self.grams[run] = (gram[order], size[order], Lookup(gram))

    def places(self, w: Words) -> dict[int, np.ndarray]:
        """Window starts to embed, for each item size."""
        ends = (w.starts + w.lengths)[w.doc]
        hits: dict[int, list[np.ndarray]] = {}
        for run, (gram, size, known) in self.grams.items():
            here = rolling(w.hashes, run, BASES[0])
            at = np.flatnonzero(known(here))
            at = at[at + run <= ends[at]]
            lo, hi = np.searchsorted(gram, here[at]), np.searchsorted(gram, here[at], "right")
            which = np.repeat(np.arange(len(at)), hi - lo)
            pick = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(len(which))
            for s in np.unique(size[pick]):
                hits.setdefault(int(s), []).append(at[which[size[pick] == s]])
        out = {}
        for size, parts in hits.items():
            k, vocabulary, _ = self.by_size[size]
            begin = w.starts[w.doc]
            near = np.unique(np.concatenate(parts))
            starts = np.unique((near[:, None] - np.arange(size)).ravel())
            starts = starts[starts >= 0]
            edge = np.zeros(w.total + 1, np.int64)
            first = np.maximum(near - size + 1, begin[near])
            np.add.at(edge, first, 1)
            np.add.at(edge, near + 1, -1)
            starts = starts[np.cumsum(edge[:-1])[starts] > 0]
            spot = starts[:, None] + np.arange(size)
            known = (vocabulary(w.hashes[np.minimum(spot, w.total - 1)].ravel()).reshape(spot.shape)
                     & (spot < ends[starts][:, None])).sum(1)
            out[size] = starts[known >= size - 2 * k]
        return out

    def search(self, w: Words) -> dict[int, list[dict]]:
        """Verified hits of a chunk, by row."""
        found: dict[int, list[dict]] = {}
        if not w.total or not self.by_size:
            return found
        ends = (w.starts + w.lengths)[w.doc]
        for size, starts in self.places(w).items():
            if not len(starts):
                continue
            k, _, reps = self.by_size[size]
            pairs = set()
            for rep, keys, owner in reps:
                key = window_keys(w.hashes, starts, ends[starts], size, rep)
                lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                for i in np.flatnonzero(hi > lo):
                    pairs.update((int(owner[x]), int(starts[i])) for x in range(lo[i], hi[i]))
            order = sorted((int(w.doc[start]), item, start) for item, start in pairs)
            for i, (row, item, start) in enumerate(order):  # starts of one place are verified together
                if i and order[i - 1][:2] == (row, item) and start - order[i - 1][2] <= size:
                    continue
                last = i
                while last + 1 < len(order) and order[last + 1][:2] == (row, item) and (
                        order[last + 1][2] - order[last][2] <= size):
                    last += 1
                base, end = int(w.starts[row]), int(w.starts[row] + w.lengths[row])
                todo = [(max(base, start - k), min(end, order[last][2] + size + k))]
                while todo:
                    lo, hi = todo.pop()
                    if hi - lo < size - k:
                        continue
                    edits, x, y = best_alignment(self.words[item], w.hashes[lo:hi])
                    if edits <= k:
                        found.setdefault(row, []).append(
                            {"item_id": self.ids[item], "from": lo + x - base, "to": lo + y - base, "edits": edits})
                        todo += [(lo, lo + x), (lo + y, hi)]
        return found


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, target_recall: float = 0.99,
                  carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``text`` if asked for, the ``carry``
    columns and ``hits`` (items found, the words they span, and the edits)."""
    named = docs.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in carry])
    rows = id_and_text(named, *[f"_{c}" for c in carry])
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("edits", pa.int32())]))
    out = rows.withColumn("hits", F.expr(f"cast(array() as {HITS})"))
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        got = sorted((-1 if r[0] is None else r[0], bytes(r[1])) for r in mine.collect())
        shared = rows.sparkSession.sparkContext.broadcast(
            Items([g[0] for g in got], [g[1] for g in got], share, target_recall))
        drop = block == blocks - 1 and not with_text
        fields = [f for f in out.schema.fields if not (drop and f.name == "text")]

        def run(batches, shared=shared, names=[f.name for f in fields]):
            for b in chunks(batches, CHUNK):
                hits = shared.value.search(Words(b, table=PLAIN))
                new = [(old or []) + hits.get(i, []) for i, old in enumerate(b.column("hits").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-1]], pa.array(new, kind)], names=names)

        out = map_arrow(out, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    text = [F.col("text").cast("string").alias("text")] if with_text else []
    return out.select("doc_id", *text, *[F.col(f"_{c}").alias(c) for c in carry], "hits")
