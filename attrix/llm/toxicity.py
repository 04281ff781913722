"""Toxicity scores from a subsequence string kernel and Nystroem landmarks.

Units are words reduced to letters (case, punctuation and digits-for-letters
undone; runs of single letters joined), so ``I.d.i.o.t`` and ``i d i o t`` are
``idiot``.  The kernel between two units is the gap-weighted
subsequence kernel of order 3 (every ordered triple of letters counts
``DECAY ** span``, spans up to ``SPAN``), normalised by the landmark's own kernel
and at most 1, which tolerates inserted, missing and appended letters.  Landmarks
are the units, and first letters of units, most tied to the label among the
labelled texts.  A sentence's similarity to a landmark is that of its best unit
(below ``FLOOR``: none); the Nystroem map of the landmark kernel turns
similarities into features of a linear squared-hinge support vector machine.  It
learns from sentences, which take their text's label (those of toxic texts
without any similarity say nothing and are left out), by Newton steps on sums
that Spark adds up.  A text scores as its worst sentence, calibrated by isotonic
regression over texts.

At most ``max_train`` labelled rows are learnt from, those with the smallest
hashes (a documented bound); every whole text is scored.

Defined results: null, empty and letterless texts have no units and the score of
a text without any similarity; a label that is null or not 0/1 is ignored, of
several labels for one ``doc_id`` the largest counts; without usable labels all
scores are 0.5; rows that share a ``doc_id`` are scored one by one; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.quality import calibrated, isotonic
from attrix.llm.sums import float_lists, matrix, partition_sum
from attrix.llm.text import BASES, U64, Words, chunks, id_and_text, map_arrow, mix, record, stash

DECAY, SPAN, FLOOR = 0.6, 5, 0.6
MAX_TRAIN, TIED, STEMS = 40_000, 160, (4, 5, 6)
LONGEST = 24  # letters of a landmark
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x61:0x7B] = np.arange(1, 27)
_LETTER[0x41:0x5B] = np.arange(1, 27)
for _digit, _as in zip(b"013457@", b"oieasta"):
    _LETTER[_digit] = _as - 0x60
_LETTER[0x80:] = 27 + np.arange(0x80) % 5
#: Gaps between the first and second, second and third letter.
GAPS = [(g, h) for g in range(1, SPAN) for h in range(1, SPAN) if g + h < SPAN]


class Units:
    """Distinct letter units of a chunk of texts; ``row`` is the sentence of
    each occurrence and ``doc`` the text of each sentence."""

    def __init__(self, batch: pa.RecordBatch):
        w = Words(batch)
        code = _LETTER[w.data]
        inside = np.zeros(len(w.data) + 1, np.int64)
        np.add.at(inside, w.begin, 1)
        word_of = np.cumsum(inside[:-1]) - 1
        use = (code > 0) & (word_of >= 0)
        if w.total:
            use &= np.arange(len(w.data)) < w.end[np.maximum(word_of, 0)]
        letters, word = code[use], word_of[use]
        size = np.bincount(word, minlength=w.total)
        # a sentence ends with a word of three bytes or more and . ! or ?
        last = np.isin(w.data[w.end - 1], list(b".!?")) & (w.end - w.begin > 2) if w.total else np.empty(0, bool)
        opens = np.r_[True, last[:-1] | (w.doc[1:] != w.doc[:-1])][:w.total]
        sentence = np.cumsum(opens) - 1
        self.doc = w.doc[np.flatnonzero(opens)]
        single = size == 1
        join = np.zeros(w.total, bool)
        if w.total > 1:
            join[1:] = single[1:] & single[:-1] & ~opens[1:]
        unit_of_word = np.cumsum(~join) - 1
        unit = unit_of_word[word]
        fresh = np.r_[True, unit[1:] != unit[:-1]][:len(unit)]
        begin = np.flatnonzero(fresh)
        length = np.diff(np.r_[begin, len(unit)])
        row = sentence[word[begin]]
        good = length >= 3
        self.rows = len(self.doc)
        self.begin = self.length = self.row = self.which = np.empty(0, np.int64)
        self.hashes = np.empty(0, U64)
        self.letters = letters
        if not good.any():
            return
        powers = np.cumprod(np.full(int(length.max()) + 1, BASES[1], U64), dtype=U64)
        place = np.arange(len(letters)) - np.repeat(begin, length)
        hashes = mix(np.add.reduceat(letters.astype(U64) * powers[place], begin))[good]
        self.hashes, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.begin, self.length, self.row = begin[good][first], length[good][first], row[good]

    def text(self, i: int) -> bytes:
        return self.letters[self.begin[i]:self.begin[i] + self.length[i]].tobytes()


def triples(letters: np.ndarray, begin: np.ndarray, length: np.ndarray):
    """``(unit, code, weight)`` of all letter triples of the units."""
    total = int(length.sum())
    unit = np.repeat(np.arange(len(length)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(total)
    flat = letters[np.repeat(begin - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(total)].astype(np.int32)
    for g, h in GAPS:
        at = np.flatnonzero(left > g + h)
        yield unit[at], (flat[at] << 10) | (flat[at + g] << 5) | flat[at + g + h], DECAY ** (g + h)


class Landmarks:
    """Landmark units and the kernel against them, by inverted lists of triples."""

    def __init__(self, units: list[bytes]):
        letters = np.frombuffer(b"".join(units), np.uint8)
        length = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(length) - length
        self.size = len(units)
        weights = np.zeros((1 << 15, self.size))
        for unit, code, weight in triples(letters, begin, length):
            np.add.at(weights, (code, unit), weight)
        weights /= np.maximum((weights ** 2).sum(0), 1e-9)
        code, self.mark = np.nonzero(weights)
        self.weight = weights[code, self.mark]
        self.at = np.searchsorted(code, np.arange((1 << 15) + 1))
        unit, mark, value = self.kernel(letters, begin, length)
        gram = np.zeros((self.size, self.size))
        gram[unit, mark] = value
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        self.root = vector / np.sqrt(np.maximum(value, 1e-2)) @ vector.T

    def kernel(self, letters: np.ndarray, begin: np.ndarray, length: np.ndarray, floor: float = 0.0):
        """``(unit, landmark, value)`` of the kernel where it exceeds ``floor``."""
        cells, parts = [], []
        for unit, code, weight in triples(letters, begin, length):
            many = self.at[code + 1] - self.at[code]
            has = many > 0
            unit, code, many = unit[has], code[has], many[has]
            entry = np.repeat(self.at[code] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            cells.append(np.repeat(unit, many) * self.size + self.mark[entry])
            parts.append(self.weight[entry] * weight)
        cell = np.concatenate(cells)
        total = np.bincount(cell, weights=np.concatenate(parts), minlength=1)
        hit = np.flatnonzero(total > floor)
        return hit // self.size, hit % self.size, np.minimum(total[hit], 1.0)

    def similarities(self, u: Units) -> np.ndarray:
        """Each sentence's best similarity to each landmark."""
        out = np.zeros((u.rows, self.size), np.float32)
        if not len(u.length):
            return out
        unit, mark, value = self.kernel(u.letters, u.begin, u.length, FLOOR)
        lo, hi = np.searchsorted(unit, np.arange(len(u.length))), np.searchsorted(unit, np.arange(len(u.length)), "right")
        many = (hi - lo)[u.which]
        entry = np.repeat(lo[u.which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        np.maximum.at(out, (np.repeat(u.row, many), mark[entry]), value[entry])
        return out


def candidates(u: Units) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Possible landmarks of a chunk: units and their first letters, and in
    which row each occurs (once a row)."""
    strings: dict[bytes, int] = {}
    owner, string = [], []
    for i in range(len(u.length)):
        whole = u.text(i)
        for n in {min(len(whole), LONGEST), *(k for k in STEMS if k < len(whole))}:
            owner.append(i)
            string.append(strings.setdefault(whole[:n], len(strings)))
    owner, string = np.array(owner, np.int64), np.array(string, np.int64)
    at = np.searchsorted(owner, np.arange(len(u.length) + 1))
    many = (at[1:] - at[:-1])[u.which] if len(u.length) else np.empty(0, np.int64)
    entry = np.repeat(at[u.which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    pair = np.unique(np.repeat(u.doc[u.row], many) * (len(strings) + 1) + string[entry]) if len(entry) else entry
    return list(strings), pair // (len(strings) + 1), pair % (len(strings) + 1)


def _tied(words: DataFrame, toxic: int, clean: int) -> list[bytes]:
    """The strings most surely tied to the label: the lower bound of the log
    odds, so that a common stem comes before its rare compounds."""
    pull = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    sure = pull - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    tied = words.withColumn("s", sure).where("s > 0.5").orderBy(F.desc("s"), "unit").limit(TIED)
    return [bytes(r["unit"]) for r in tied.collect()]


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None,
                   max_train: int = MAX_TRAIN, loss: float = 1.0) -> DataFrame:
    """``doc_id, score`` for every row; ``learn`` (over ``doc_id``) says which
    rows' labels may be used."""
    rows = id_and_text(docs)
    sc = rows.sparkSession.sparkContext
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
              .where("y in (0, 1)").where(F.lit(True) if learn is None else learn).where("doc_id is not null")
              .groupBy("doc_id").agg(F.max("y").alias("y")))
    chosen = sorted((r["doc_id"], r["y"]) for r in
                    usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).collect())
    known = sc.broadcast((np.array([c[0] for c in chosen], np.int64), np.array([c[1] for c in chosen], np.int64)))

    def with_label(b: pa.RecordBatch):
        ids, y = known.value
        own = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
        hit = (ids[at] == own) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(own), bool)
        return b.filter(pa.array(hit)), y[at[hit]] if len(ids) else y

    def count(batches):
        for b in batches:
            b, y = with_label(b)
            for part in chunks([b]):
                mine, y = y[:part.num_rows], y[part.num_rows:]
                found, row, which = candidates(Units(part))
                toxic = np.bincount(which, weights=mine[row], minlength=len(found)).astype(np.int64)
                both = np.bincount(which, minlength=len(found))
                yield record(unit=pa.array(found, pa.binary()), t=toxic, c=both - toxic)

    words = stash(map_arrow(rows, count, "unit binary, t long, c long").groupBy("unit")
                  .agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "units")
    toxic = int(known.value[1].sum())
    marks = Landmarks(_tied(words, toxic, len(chosen) - toxic) or [b"\x01\x02\x03"])
    shared = sc.broadcast(marks)
    size = marks.size

    def features(batches):
        for b in batches:
            b, y = with_label(b)
            for part in chunks([b]):
                mine, y = y[:part.num_rows], y[part.num_rows:]
                u = Units(part)
                near = shared.value.similarities(u)
                some = near.any(1)  # of the other sentences, one for each clean text
                none = np.flatnonzero(~np.isin(np.arange(part.num_rows), u.doc[some]) & (mine == 0))
                z = np.r_[near[some], np.zeros((len(none), near.shape[1]), np.float32)] @ shared.value.root
                yield record(x=float_lists(z), y=np.r_[mine[u.doc[some]], mine[none]].astype(float))

    train = stash(map_arrow(rows, features, "x array<float>, y double"), "toxic")
    d = size + 1
    weight = np.zeros(d)
    share = max(1, toxic) / max(1, len(chosen))

    def step(b):
        x = np.column_stack([matrix(b, "x"), np.ones(b.num_rows)])
        sign = 2 * b.column("y").to_numpy(zero_copy_only=False) - 1
        margin = 1 - sign * (x @ weight)
        active = (margin > 0) * np.where(sign > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share))
        return np.r_[-(x.T @ (active * sign * margin)), (x.T @ (x * active[:, None])).ravel()]

    if chosen:
        for _ in range(8):
            sums = partition_sum(train, step, d + d * d)
            ridge = np.r_[np.full(size, 1.0), 1e-3]
            gradient = weight * ridge + loss * sums[:d]
            move = np.linalg.solve(np.diag(ridge) + loss * sums[d:].reshape(d, d), gradient)
            weight = weight - move
            if np.abs(move).max() < 1e-4:
                break
    final = weight

    def worst(u: Units, texts: int) -> np.ndarray:
        near = shared.value.similarities(u)
        best = np.full(texts, final[-1])  # a text without any similarity
        some = near.any(1)
        np.maximum.at(best, u.doc[some], near[some] @ shared.value.root @ final[:-1] + final[-1])
        return best

    def raw(batches):
        for b in batches:
            b, y = with_label(b)
            for part in chunks([b]):
                mine, y = y[:part.num_rows], y[part.num_rows:]
                yield record(raw=worst(Units(part), part.num_rows), y=mine.astype(float))

    at, value = isotonic(map_arrow(rows, raw, "raw double, y double"), -4.0, 4.0)

    def score(batches):
        for b in chunks(batches):
            yield record(doc_id=b.column("doc_id"), score=calibrated(worst(Units(b), b.num_rows), at, value))

    return map_arrow(rows, score, "doc_id long, score double")
