"""Order MinHash fingerprints, in DataFrame functions only.

Order MinHash (a MinHash sensitive to edit distance) selects minimal
occurrence-numbered k-mers, keeps them in text order and hashes the tuple.  Here
the k-mers are runs of ``K`` words; each is hashed together with its occurrence
number (the earlier copies of the run in the text).  One hash per k-mer is
drawn and the hash range is cut into ``SLOTS`` equal slots, each with its own
minimum (the one-permutation form of drawing ``SLOTS`` functions).  Tuple ``j``
holds the minima of slots ``j`` and ``j+1``, in text order, so it agrees between
two texts only where both runs survive with their order.  A fingerprint is the
``SLOTS`` tuple hashes, eight hex digits each; ``--------`` marks two empty
slots.  Likeness is the share of equal tuples among those not empty in both.

Work is linear in the text but for one primitive sort; nothing is exploded, so
no shuffle is needed to fingerprint, and equal texts have equal fingerprints.

Defined results: null text counts as empty; an empty text has the all-empty
fingerprint, alike 1 to another empty one and 0 to any other; texts of fewer
than ``K`` words are one k-mer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SLOTS = 2, 64
#: A k-mer is one long: 39 bits of hash, then its place in the text.
PLACE_BITS, HASH_BITS = 24, 39
SLOT_SHIFT = HASH_BITS + PLACE_BITS - 6
EMPTY = "-" * 8


def _hash(*columns: Column) -> Column:
    """The upper 39 bits of a 64-bit hash, as a non-negative long."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _pack(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed, PLACE_BITS).bitwiseOR(place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add column ``out``, the fingerprint of string column ``text``."""
    words, kmers, runs, minima = (f"_{out}_{x}" for x in ("words", "kmers", "runs", "minima"))
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", "     ")
    df = df.withColumn(words, F.array_remove(F.split(plain, " "), ""))
    count = F.size(words)
    # every k-mer as hash and place, sorted: equal k-mers stand together, in text order
    df = df.withColumn(kmers, F.sort_array(F.transform(
        F.slice(F.col(words), 1, F.when(count >= K, count - (K - 1)).otherwise(F.least(count, F.lit(1)))),
        lambda w, i: _pack(_hash(w, *[F.get(F.col(words), i + j) for j in range(1, K)]), i.cast("long")))))
    # where each run of equal k-mers begins
    df = df.withColumn(runs, F.filter(
        F.transform(F.col(kmers), lambda x, i: F.when(
            (i > 0) & (F.shiftright(F.get(F.col(kmers), i - 1), PLACE_BITS) == F.shiftright(x, PLACE_BITS)),
            F.lit(-1)).otherwise(i)),
        lambda i: i >= 0))
    # number the occurrences inside each run, hash again, sort again
    numbered = F.flatten(F.transform(F.col(runs), lambda b, j: F.transform(
        F.slice(F.col(kmers), b + 1, F.coalesce(F.get(F.col(runs), j + 1), F.size(kmers)) - b),
        lambda x, occurrence: _pack(_hash(F.shiftright(x, PLACE_BITS), occurrence), _place(x)))))
    df = df.withColumn(kmers, F.sort_array(numbered))
    # the first of each slot is its minimum
    df = df.withColumn(minima, F.map_from_entries(F.transform(
        F.filter(F.col(kmers), lambda x, i: (i == 0) | (
            F.shiftright(F.get(F.col(kmers), i - 1), SLOT_SHIFT) != F.shiftright(x, SLOT_SHIFT))),
        lambda x: F.struct(F.shiftright(x, SLOT_SHIFT).cast("int"), x))))

    def tuple_hash(j: Column) -> Column:
        a, b = (F.try_element_at(F.col(minima), i.cast("int")) for i in (j, (j + 1) % SLOTS))
        first = F.when(_place(a) <= _place(b), a).otherwise(F.coalesce(b, a))
        second = F.when(_place(a) <= _place(b), b).otherwise(F.when(b.isNotNull(), a))
        digits = F.hex(F.xxhash64(F.shiftright(first, PLACE_BITS), F.shiftright(second, PLACE_BITS)))
        return F.when(a.isNull() & b.isNull(), F.lit(EMPTY)).otherwise(
            F.lower(F.right(F.lpad(digits, 16, "0"), F.lit(8))))

    df = df.withColumn(out, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), tuple_hash), ""))
    return df.drop(words, kmers, runs, minima)


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples of two fingerprints, 0 to 1."""
    part = [(F.substring(a, 8 * j + 1, 8), F.substring(b, 8 * j + 1, 8)) for j in range(SLOTS)]
    pairs = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in part])
    used = F.filter(pairs, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    same = F.filter(used, lambda p: p["x"] == p["y"])
    return F.when(F.size(used) == 0, F.lit(1.0)).otherwise(F.size(same) / F.size(used))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint`` of every row."""
    return with_fingerprint(docs.select("doc_id", "text"), "text", "fingerprint")


def with_next(rows: DataFrame, columns: list[str], ranges: int = 256) -> DataFrame:
    """Add ``next_<column>`` from the next row by descending ``doc_id`` (nulls
    last, ties by ``columns``); the last row's next is the first.

    ``doc_id`` is cut into ``ranges`` of about equal rows; the first row of each
    range is also dealt to the range before it, so every task sees one range
    and nothing but its row bounds reaches the driver."""
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"))
    share = [i / ranges for i in range(1, ranges)]
    cuts = ids.select(F.percentile_approx("doc_id", share, 10_000)).first()[0]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>") if cuts else F.array().cast("array<long>")
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    heads = sorted(ids.groupBy(place.alias("r")).agg(F.max("doc_id").alias("head")).collect())
    # the range before (higher ids); the highest range's first row closes the circle
    before = {r["r"]: heads[(i + 1) % len(heads)]["r"] for i, r in enumerate(heads)}
    deal = [F.when((F.col("_range") == r["r"]) & F.col("doc_id").eqNullSafe(F.lit(r["head"])), F.lit(before[r["r"]]))
            for r in heads]
    dealt = rows.withColumn("_range", place).withColumn("_copy", F.coalesce(*deal, F.lit(None).cast("int")))
    dealt = dealt.withColumn("_in", F.explode(F.filter(
        F.array(F.struct(F.lit(0).alias("last"), F.col("_range").alias("r")),
                F.struct(F.lit(1).alias("last"), F.col("_copy").alias("r"))), lambda x: x["r"].isNotNull())))
    here = Window.partitionBy("_in.r").orderBy("_in.last", F.col("doc_id").desc_nulls_last(), *columns)
    named = dealt.withColumns({f"next_{c}": F.lead(c).over(here) for c in columns})
    return named.where("_in.last = 0").drop("_range", "_copy", "_in")


def edited(text: str, other: str) -> Column:
    """``text`` with its last ``floor(n / 2)`` characters replaced by the first
    as many (or all) of ``other``; nulls count as empty."""
    a, b = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(other), F.lit(""))
    half = F.floor(F.length(a) / 2).cast("int")
    return F.concat(F.substr(a, F.lit(1), F.length(a) - half), F.substr(b, F.lit(1), half))


def edit_probe(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses."""
    rows = with_next(fingerprints(docs), ["text", "fingerprint"])
    rows = rows.withColumn("edited", edited("text", "next_text")).drop("next_text")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return (rows.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint"))
            .withColumn("near_next", likeness("fingerprint", "next_fingerprint")))
