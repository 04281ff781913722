"""Language-model scores: prediction by partial matching over bytes, next to an
add-one unigram of words.

The model is a trie of byte contexts of up to ``ORDER`` symbols, pretrained on
the rows that may be learnt from.  It models the text as its words, A-Z in lower
case, with one space between and an end symbol after the last; contexts run across
the spaces and begin anew, with a start marker, only where a text begins.  A symbol is predicted by its
longest known context with escape method D (half a count for each distinct
symbol); after an escape, the symbols of the longer context are excluded from the
shorter one, whose counts are of the longer contexts a symbol follows (update
exclusion), down to a uniform choice among symbols never seen.  ``score`` is the log10 probability of the whole text.

No entry is dropped.  A *gram* is a symbol with its ``ORDER`` symbols before; its
probability depends on nothing else, and its shorter contexts are its suffixes.
Distinct grams of all rows are counted by Spark and dealt by the two symbols before
the last into ``SHARDS``, each of which holds all contexts of two symbols and more
that its grams need (a pair's grams are one task's work); those of one and none, at
most 65,792 entries, are broadcast.  So each shard settles its grams' probabilities.
Those of the ``MAX_GRAMS`` most frequent grams are broadcast, as are the counts of
the ``MAX_FREQUENT`` most frequent words; all other grams and words of a document
are joined with their tables.

Defined results: null text is empty and has one token, the end; with nothing to
learn from, every count is zero.  Rows that repeat are scored one by one; extra
columns are ignored.  Words are counted by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.text import _LOWER, _SPACE, U64, Words, chunks, id_and_text, lean_arrow, mix, record, stash

ORDER, SHARDS = 6, 4096
MAX_GRAMS, MAX_FREQUENT = 2_000_000, 1 << 18
#: Symbols that UTF-8 never uses.
END, START = 0xFF, 0xFE
BLOCK, ENTRIES = 1_000_000, 1_500_000
WORD, TRIE = 0, 1


def symbols(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a chunk end to end, and where each row's begin."""
    size = w.end - w.begin + 1
    empty = w.lengths == 0
    before = np.cumsum(empty) - empty  # rows without words have the end symbol only
    closing = np.cumsum(size) - 1 + before[w.doc]
    out = np.zeros(int(size.sum()) + np.count_nonzero(empty), np.uint8)
    inner = np.ones(len(out), bool)
    inner[closing] = False
    per_row = np.r_[0, np.cumsum(size)][np.r_[w.starts, w.total]]
    begin = np.r_[per_row[:-1] + before, len(out)]
    inner[begin[:-1][empty]] = False
    out[closing] = 0x20
    out[inner] = np.minimum(_LOWER[w.data[~_SPACE[w.data]]], START - 1)
    out[begin[1:] - 1] = END
    return out, begin[:-1]


def grams(symbol: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each symbol, in the low byte, with the ``ORDER`` before it, nearest first."""
    length = np.diff(np.r_[begin, len(symbol)])
    wide = symbol.astype(U64)
    out = wide.copy()
    for d in range(1, ORDER + 1):
        before = np.full(len(wide), START, U64)
        before[d:] = wide[:-d]
        for j in range(d):
            before[begin[length > j] + j] = START
        out |= before << U64(8 * d)
    return out


def gram_contexts(gram: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``context_keys`` of the last symbols of grams."""
    out = [(np.zeros(len(gram), U64), np.ones(len(gram), bool))]
    for d in range(1, ORDER + 1):
        past = (gram >> U64(8)) & U64((1 << 8 * d) - 1)
        twice = past >> U64(8 * max(0, d - 2)) == U64(START << 8 | START)
        out.append((past | U64(d << 56), ~twice if d > 1 else ~np.zeros(len(gram), bool)))
    return out


def context_keys(place: np.ndarray, symbol: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: keys of the contexts, and which symbols have one."""
    past = np.zeros(len(symbol), U64)
    out = [(past.copy(), np.ones(len(symbol), bool))]
    for d in range(1, ORDER + 1):
        before = np.full(len(symbol), START, np.uint8)
        before[d:] = symbol[:-d] if d < len(symbol) else before[d:]
        before[place < d] = START
        past = past | (before.astype(U64) << U64(8 * (d - 1)))
        out.append((past | U64(d << 56), place >= d - 1))
    return out


def entry_key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    top = context & U64(0xFF << 56)
    return top | ((context ^ top) << U64(8)) | symbol.astype(U64)


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blobs(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and counts, one row a shard."""
    shard = (mix((keys >> U64(9)) & U64(0xFFFF) if kind == TRIE else keys) % U64(SHARDS)).astype(np.int16)
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order].astype(np.int64), shard[order]
    cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][:len(keys)]), len(keys)]
    spans = list(zip(cut[:-1], cut[1:]))
    return record(kind=np.full(len(spans), kind, np.int32), shard=shard[cut[:-1]].astype(np.int32),
                  keys=pa.array([keys[i:j].tobytes() for i, j in spans], pa.binary()),
                  n=pa.array([counts[i:j].tobytes() for i, j in spans], pa.binary()))


class Tally:
    """Counts by key, folded as they come."""

    def __init__(self):
        self.parts, self.waiting, self.folded = [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(2 * self.folded, ENTRIES // 2):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.parts = [_add_up(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
            self.waiting = self.folded = len(self.parts[0][0])
            return self.parts[0]
        return np.empty(0, U64), np.empty(0, np.int64)


def _count(batches):
    """Partial counts of learnt words and of grams; a gram's key is followed by a
    bit that says whether it was met in a row to learn from."""
    words, trie, block, size = Tally(), Tally(), [], 0

    def fold_block():
        if block:
            keys = np.concatenate(block)
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            trie.add(keys[first], np.diff(np.r_[first, len(keys)]))

    for b in chunks(batches):
        w = Words(b, lower=True)
        lesson = b.column("lesson").to_numpy(zero_copy_only=False).astype(bool)
        words.add(*np.unique(w.hashes[lesson[w.doc]], return_counts=True))
        symbol, begin = symbols(w)
        learnt = np.repeat(lesson, np.diff(np.r_[begin, len(symbol)]))
        block.append((grams(symbol, begin) << U64(1)) | learnt)
        size += len(symbol)
        if size > BLOCK:
            fold_block()
            block.clear()
            size = 0
        if trie.folded + words.folded > ENTRIES:
            yield _blobs(WORD, *words.fold())
            yield _blobs(TRIE, *trie.fold())
            words, trie = Tally(), Tally()
    fold_block()
    yield _blobs(WORD, *words.fold())
    yield _blobs(TRIE, *trie.fold())


def _merge(batches):
    """One row for each shard; a partition's rows are sorted by shard, so that one
    shard is held at a time."""
    now, tally = None, Tally()
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("kind", "shard", "keys", "n"))):
            if r[:2] != now:
                if now is not None:
                    yield _blobs(now[0], *tally.fold())
                now, tally = r[:2], Tally()
            tally.add(np.frombuffer(r[2], U64), np.frombuffer(r[3], np.int64))
    if now is not None:
        yield _blobs(now[0], *tally.fold())


def _arrays(batches):
    for b in batches:
        for r in b.to_pylist():
            yield np.frombuffer(r["keys"], U64), np.frombuffer(r["n"], np.int64)


def _word_rows(batches):
    for keys, n in _arrays(batches):
        yield record(key=keys.view(np.int64), n=n)


def _short(batches):
    """Counts of the entries of order one, as update exclusion has them."""
    for keys, n in _arrays(batches):
        learnt = (keys & U64(1)) == 1
        gram, n = keys[learnt] >> U64(1), n[learnt]
        opens = (gram >> U64(8)) & U64(0xFF) == START  # a text's first symbol: nothing longer
        longer = np.unique(gram[~opens] & U64(0xFFFFFF)) & U64(0xFFFF)
        key, count = _add_up(np.r_[gram[opens] & U64(0xFFFF), longer], np.r_[n[opens], np.ones(len(longer), np.int64)])
        yield record(key=key.view(np.int64), n=count)


class HashIndex:
    """Key -> position, for arrays of 64-bit keys (open addressing)."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys = keys
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            miss = self.slots[at] != left
            left, at = left[miss], (at[miss] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at, live = self._home(keys), np.arange(len(keys))
        while len(live):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[live])
            out[live[hit]] = got[hit]
            go = (got >= 0) & ~hit
            live, at = live[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


class Trie:
    """Prediction by partial matching from (context, symbol) counts; a ``shard``
    has only some contexts of order two and more, and those below are counted already."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shard: bool = False):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        top = keys & U64(0xFF << 56)
        context = top | ((keys ^ top) >> U64(8))
        owner, self.of = np.unique(context, return_inverse=True)
        total = np.bincount(self.of, weights=counts, minlength=len(owner))
        kinds = np.bincount(self.of, minlength=len(owner))
        self.entries, self.contexts = HashIndex(keys), HashIndex(owner)
        order_of = (owner >> U64(56)).astype(np.int64)
        below = self.contexts(self.shorter(owner, order_of))
        symbol = keys & U64(0xFF)
        low = self.entries(entry_key(self.shorter(context, order_of[self.of]), symbol))
        has = (order_of[self.of] > 0) & (low >= 0)
        # a context that always extends counts the longer contexts a symbol follows
        oldest = (owner >> (U64(8) * (np.maximum(order_of, 1) - 1).astype(U64))) & U64(0xFF)
        extends = (order_of < ORDER) & ((order_of == 0) | (oldest != START)) & ((order_of > 1) | (not shard))
        kinds_after = np.bincount(low[has], minlength=len(counts))
        counts = np.where(extends[self.of], np.maximum(kinds_after, 1), counts)
        total = np.bincount(self.of, weights=counts, minlength=len(owner))
        excluded = np.bincount(self.of[has], weights=counts[low[has]], minlength=len(owner))
        novel = np.where(order_of > 0, kinds[below] - kinds, 0)
        rest = np.where(order_of > 0, total[below] - excluded, 0)
        self.log_count = np.log10(counts - 0.5)
        self.first = self.log_count - np.log10(total)[self.of]
        self.escape = np.log10(kinds / (2 * total))
        self.rest = np.log10(np.maximum(rest, 1e-300))
        self.again = np.where(novel > 0, np.log10(np.maximum(novel, 1e-300) / 2) - self.rest, 0.0)
        root = self.contexts(np.zeros(1, U64))[0]
        self.unseen = -np.log10(max(1, 256 - (kinds[root] if root >= 0 else 0)))
        del self.of

    @staticmethod
    def shorter(context: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The contexts without their oldest symbol."""
        d = np.maximum(order - 1, 0).astype(U64)
        mask = (U64(1) << (U64(8) * d)) - U64(1)
        return (d << U64(56)) | (context & mask)

    def log10(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol."""
        return self.look_up(context_keys(place, symbol), symbol)

    def look_up(self, contexts: list[tuple[np.ndarray, np.ndarray]], symbol: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbol))
        last = np.full(len(symbol), -1, np.int64)  # the context escaped from
        todo = np.arange(len(symbol))
        for context, use in reversed(contexts):
            now = todo[use[todo]]
            wait = todo[~use[todo]]
            hit = self.entries(entry_key(context[now], symbol[now]))
            found = now[hit >= 0]
            entry, since = hit[hit >= 0], last[found]
            out[found] += np.where(since < 0, self.first[entry], self.log_count[entry] - self.rest[since])
            miss = now[hit < 0]
            here = self.contexts(context[miss])
            known = here >= 0
            at, here = miss[known], here[known]
            since = last[at]
            if len(at):
                out[at] += np.where(since < 0, self.escape[here], self.again[since])
                last[at] = here
            todo = np.sort(np.r_[wait, miss])
        out[todo] += self.unseen
        return out


def gram_log10(gram: np.ndarray, lessons: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of the last symbol of each gram of a shard: ``lessons``
    counts the learnt ones, ``short`` the entries of order one of all shards."""
    known = lessons > 0
    learnt, n = gram[known], lessons[known]
    zero = np.unique(short[0] & U64(0xFF), return_counts=True)
    keys, counts = [entry_key(np.zeros(len(zero[0]), U64), zero[0]), short[0] | U64(1 << 56)], [zero[1], short[1]]
    for d, (context, use) in enumerate(gram_contexts(learnt)):
        if d > 1:
            key, count = _add_up(entry_key(context[use], learnt[use] & U64(0xFF)), n[use])
            keys.append(key)
            counts.append(count)
    trie = Trie(np.concatenate(keys), np.concatenate(counts), shard=True)
    return trie.look_up(gram_contexts(gram), gram & U64(0xFF))


def least_count(table: DataFrame) -> int:
    """The smallest count for which at most ``MAX_GRAMS`` rows have it or more."""
    tally = table.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("c")).collect()
    room = MAX_GRAMS
    for r in sorted(tally, reverse=True):
        room -= r["c"]
        if room < 0:
            return r["n"] + 1
    return 1


def _rare(doc: np.ndarray, key: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
    """Distinct keys of each row: row, kind, key, times."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][:len(doc)])
    return doc[first], np.full(len(first), kind, np.int32), key[first].view(np.int64), np.diff(np.r_[first, len(doc)])


def score_ppm(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, train_tokens,
    base_score, score``; ``learn`` (over ``doc_id``) says which rows the counts
    come from (default: all)."""
    rows = id_and_text(docs)
    spark = rows.sparkSession
    sc = spark.sparkContext
    lesson = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = "kind int, shard int, keys binary, n binary"
    counts = stash(lean_arrow(lean_arrow(rows.withColumn("lesson", lesson), _count, shape)
                             .repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard"), _merge, shape), "counts")
    words = lean_arrow(counts.where(F.col("kind") == WORD), _word_rows, "key long, n long")
    trie = counts.where(F.col("kind") == TRIE)
    first = lean_arrow(trie, _short, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    short = sc.broadcast((first["key"].to_numpy().view(U64), first["n"].to_numpy()))

    def settle(batches):
        for keys, n in _arrays(batches):
            gram, place = np.unique(keys >> U64(1), return_inverse=True)
            learnt = np.zeros(len(gram), np.int64)
            own = (keys & U64(1)) == 1
            learnt[place[own]] = n[own]
            yield record(key=gram.view(np.int64), n=np.bincount(place, weights=n, minlength=len(gram)).astype(np.int64),
                         value=gram_log10(gram, learnt, short.value))

    settled = stash(lean_arrow(trie, settle, "key long, n long, value double"), "grams")
    least = least_count(settled)
    often = settled.where(F.col("n") >= least).select("key", "value").toArrow()
    texts = rows.where(lesson).count()
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train, distinct = seen[0] + texts, seen[1] + (texts > 0)
    scale = float(np.log10(train + distinct + 1))
    frequent = words.orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).toArrow()
    table = sc.broadcast((HashIndex(frequent["key"].to_numpy().view(U64)), frequent["n"].to_numpy(),
                          HashIndex(often["key"].to_numpy().view(U64)), often["value"].to_numpy()))
    del often
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int32())]))

    def score(batches):
        index, count, gram_index, value = table.value
        for b in chunks(batches):
            w = Words(b, lower=True)
            spot = index(w.hashes)
            hit = spot >= 0
            gain = np.zeros(w.total)
            gain[hit] = np.log10(count[spot[hit]] + 1)
            base = np.bincount(w.doc, weights=gain, minlength=b.num_rows)
            known = np.bincount(w.doc, weights=hit, minlength=b.num_rows).astype(np.int64)
            symbol, begin = symbols(w)
            gram = grams(symbol, begin)
            at = gram_index(gram)
            there = at >= 0
            each = np.zeros(len(gram))
            each[there] = value[at[there]]
            total = np.add.reduceat(each, begin)
            lost = np.flatnonzero(~there)
            rare = [np.concatenate(x) for x in zip(
                _rare(w.doc[~hit], w.hashes[~hit], WORD),
                _rare(np.searchsorted(begin, lost, "right") - 1, gram[lost], TRIE))]
            order = np.argsort(rare[0], kind="stable")
            doc, which, key, times = (x[order] for x in rare)
            bounds = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [pa.array(which), pa.array(key), pa.array(times.astype(np.int32))], ["kind", "key", "n"])
            yield record(doc_id=b.column("doc_id"), tokens=w.lengths + 1, known=known, base=base, score=total,
                         rare=pa.ListArray.from_arrays(pa.array(bounds), flat).cast(kind))

    shape = ("doc_id long, tokens long, known long, base double, score double, "
             "rare array<struct<kind:int,key:long,n:int>>")
    scored = stash(lean_arrow(rows, score, shape).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.kind", "r.key", F.col("r.n").alias("times"))
    values = (words.select(F.lit(WORD).alias("kind"), "key", F.log10(F.col("n") + 1).alias("value"))
              .unionByName(settled.where(F.col("n") < least).select(F.lit(TRIE).alias("kind"), "key", "value")))
    part = F.col("times") * F.col("value")
    more = (rare.join(values, ["kind", "key"]).groupBy("row")
            .agg(F.sum(F.when(F.col("kind") == WORD, part)).alias("gain"),
                 F.sum(F.when(F.col("kind") == WORD, F.col("times"))).alias("found"),
                 F.sum(F.when(F.col("kind") == TRIE, part)).alias("rest")))
    end = float(np.log10(texts + 1))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("found", F.lit(0)) + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) + end - F.col("tokens") * scale).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))
