"""Near-duplicate join: documents whose 5-word shingle sets have a Jaccard
similarity of 80 % or more, as components.  Exact, without all pairs.

Method: a size-aware heavy-light join.

* Documents with equal sets are one class; only one document of each class is
  searched with.
* **Small sets** enumerate all subsets of a fixed size: two sets of at most
  ``m`` members that link share ``ceil(0.8 m)`` of them, so both write down the
  same subset.  **Large sets** write down a prefix of ``n - ceil(0.8 n) + 1``
  members and some to spare (any linked pair shares one of the former) and scan
  the inverted lists.  The boundary is the largest size for which enumeration costs
  less than scanning lists of the mean length measured on the corpus; sets whose
  partners may lie on the other side do both.
* Members are ordered by weight: those that no other document holds first (they fill
  the prefix and need no list), heavy (frequent) ones last, so that common
  lines rarely enter a prefix.  The order decides the cost only: the prefix rule
  holds for any order.
* A count-min sketch over all members drops what no other document can hold,
  and with it every document of which less than 80 % may be shared; members of
  its own also bound the overlap of a pair (both lossless).
* Each list first links its documents to one pivot (linear), the one with the
  least text of its own, then another; verified links become components.
* Lists that still span several components take a pivot from their largest one.  Near
  it, a document is what it lacks of the pivot (``l`` members) and adds to it (``a``):
  two documents link if and only if these differences share at least
  ``(W + W' - N) / 9`` members, ``W = 5 l + 4 a`` and ``N`` the pivot's size.  A document
  links to the pivot if ``W <= N``; two that do are connected already, so one of a pair
  that matters does not, and the pair shares more than ``W' / 9`` members of the other's
  difference.  Only short prefixes of the differences are joined, rare members first.
* Pairs of which one is far from the pivot are joined on the lists themselves, across
  components, if their distances from the pivot differ by 0.2 at most (the Jaccard
  distance is a metric), keeping pairs that share as many prefix members as a link must.
  So thousands of near copies of one text never become pairs of each other, linked or
  just not linked, and no link between components is lost.

Every candidate is verified on the full sets: ``100 * shared >= 80 * union``.

Defined results: null or blank text has an empty set, links to nothing and is
its own component; with one to four words the whole sequence is the one
shingle; rows that share a ``doc_id`` are one document, a null ``doc_id`` is
one more; extra columns are ignored.  Shingles are compared by 64-bit hash,
whole sets by 128 bits.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrix.functions.graph import components
from attrix.llm import sketch
from attrix.llm.text import BASES, U64, Words, chunks, id_and_text, lean_arrow, mix, record, rolling, shuffles_freed, stash, text_bytes

K = 5
NULL_ID = -(1 << 63)
#: Bound of the broadcast list of heavy shingles (2 MB), and of subset sizes.
MAX_HEAVY, HEAVY_HITS, MAX_SMALL = 1 << 18, 64, 12
BLOCK = 1 << 21
ROUNDS = 2  # of linear star links before lists are joined across components
SALT = (U64(0x8CB92BA72F3D8DD7), U64(0xD6E8FEB86659FD93))


class Sets:
    """Distinct shingle hashes of each document of a chunk, sorted."""

    def __init__(self, batch: pa.RecordBatch):
        w = Words(batch, lower=True)
        h = rolling(w.hashes, K, BASES[0])
        at = np.arange(len(h))
        at = at[at + K <= (w.starts + w.lengths)[w.doc[at]]] if len(h) else at
        doc, h = w.doc[at], h[at]
        short = np.flatnonzero((w.lengths > 0) & (w.lengths < K))
        whole = []
        for i in short:  # fewer words than a shingle: the sequence as one
            own, n = w.hashes[w.starts[i]:w.starts[i] + w.lengths[i]], int(w.lengths[i])
            whole.append(rolling(own, n, BASES[0])[0] ^ U64(int(SALT[0]) * n % (1 << 64)))
        doc = np.r_[doc, short].astype(np.int64)
        h = np.r_[h, np.array(whole, U64)]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][:len(h)]
        self.doc, self.h = doc[new], h[new]
        self.bounds = np.searchsorted(self.doc, np.arange(batch.num_rows + 1))
        self.n = np.diff(self.bounds)

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each whole set (0 for the empty set)."""
        out = []
        for salt in SALT:
            total = np.r_[U64(0), np.cumsum(mix(self.h ^ salt), dtype=U64)]
            out.append((total[self.bounds[1:]] - total[self.bounds[:-1]]).view(np.int64))
        return out[0], out[1]

    def prefix(self, heavy: np.ndarray, small: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, place of member)`` of the long prefix of sets whose partners may be
        large: members that are not ``shared`` first, heavy ones last."""
        last = shared.astype(np.int8)
        if len(heavy):
            spot = np.minimum(np.searchsorted(heavy, self.h), len(heavy) - 1)
            last[shared & (heavy[spot] == self.h)] = 2
        order = np.lexsort((self.h, last, self.doc))
        doc = self.doc[order]
        rank = np.arange(len(doc)) - self.bounds[doc]
        n = self.n[doc]
        need = n - (4 * n + 4) // 5 + 1
        use = (rank < need + spare(n)) & (n * 5 // 4 > small)
        return doc[use], order[use]

    def subsets(self, small: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, key)`` of all subsets that small sets write down."""
        rows, keys = [np.empty(0, np.int64)], [np.empty(0, U64)]
        for i in np.flatnonzero((self.n > 0) & (self.n <= small)):
            own = mix(self.h[self.bounds[i]:self.bounds[i + 1]])
            size = len(own)
            for m in range(size, min(small, size * 5 // 4) + 1):
                pick = np.array(list(combinations(range(size), ceil(4 * m / 5))))
                found = mix(own[pick].sum(axis=1, dtype=U64) + U64(int(SALT[0]) * m % (1 << 64)))
                rows.append(np.full(len(found), i))
                keys.append(found)
        return np.concatenate(rows).astype(np.int64), np.concatenate(keys)

    def keys(self, heavy: np.ndarray, small: int, repeated) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, key, is_subset)`` of the signatures that another document
        may hold, for documents that can link at all; and how many of each
        row's members no other document holds."""
        shared = repeated(self.h)
        own = self.n - np.bincount(self.doc[shared], minlength=len(self.n))
        able = (self.n - own) * 5 >= self.n * 4
        doc, at = self.prefix(heavy, small, shared)
        use = able[doc] & shared[at]
        member = self.h[at]
        row, key = self.subsets(small)
        found = repeated(key)
        return (np.r_[doc[use], row[found]], np.r_[member[use], key[found]],
                np.r_[np.zeros(use.sum(), bool), np.ones(found.sum(), bool)], own)


def spare(n):
    """Places by which the long prefix exceeds the one that linking needs; the
    longer it is, the tighter the bound on what a pair shares beyond it."""
    return n // 5


def subset_cost(n: int) -> int:
    return sum(comb(n, ceil(4 * m / 5)) for m in range(n, n * 5 // 4 + 1))


def boundary(list_length: float) -> int:
    """Largest set size for which enumerating subsets costs at most what
    scanning a prefix's inverted lists does."""
    good = [n for n in range(1, MAX_SMALL + 1)
            if subset_cost(n) <= (n - ceil(4 * n / 5) + 1) * max(1.0, list_length)]
    return max(good, default=0)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _describe(batches):
    """Document rows, and shingles met again and again in a block of them."""
    block, size = [], 0

    def frequent():
        token, hits = np.unique(np.concatenate(block), return_counts=True)
        token, hits = token[hits > 2], hits[hits > 2]
        none = pa.nulls(len(token), pa.int64())
        return record(doc_id=none, n=none, a=none, b=none, token=token.view(np.int64), hits=hits)

    for b in chunks(batches):
        s = Sets(b)
        a, c = s.marks()
        none = pa.nulls(b.num_rows, pa.int64())
        yield record(doc_id=_ids(b), n=s.n, a=a, b=c, token=none, hits=none)
        block.append(s.h)
        size += len(s.h)
        if size > BLOCK:
            yield frequent()
            block, size = [], 0
    if size:
        yield frequent()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose full sets link."""

    def shared(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield b.filter(pa.array(good)).select(["u", "v"])

    left = sets.select(F.col("node").alias("u"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("y"))
    return lean_arrow(pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y"), shared, "u long, v long")


def _fits() -> F.Column:
    """Sizes that can reach the similarity: members that a set does not share
    with anyone (``own``) cannot be in the overlap."""
    shared = F.least(F.col("n") - F.col("own"), F.col("m") - F.col("own_m"))
    return shared * 180 >= (F.col("n") + F.col("m")) * 80


def _remainder(n: str) -> F.Column:
    """Members of a set outside its long prefix."""
    n = F.col(n)
    return F.greatest(F.lit(0), F.floor((4 * n + 4) / 5) - 1 - F.floor(n / 5))


def _spread(lists: DataFrame, label: DataFrame) -> DataFrame:
    """The lists that still hold documents of several components (``of``)."""
    of = lists.join(label, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
    several = of.groupBy("key").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y").select("key")
    return of.join(several, "key", "left_semi")


#: Of a document's difference from its pivot: the weight, whether they link, are near.
WEIGHT = "5 * lacks + 4 * adds"
LINKED = "5 * lacks + 4 * adds <= size"
NEAR = "2 * (size - lacks) >= size + adds"


def _deltas(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """How many members of its pivot a document lacks, and has besides, the pivot's
    ``size``, and which members they are if it is near."""

    def differ(batches):
        for b in batches:
            lacks, adds, size, diff = [], [], [], []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                either = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(either)) // 2
                lacks.append(len(y) - both)
                adds.append(len(x) - both)
                size.append(len(y))
                diff.append(either.view(np.int64) if 2 * both >= len(x) + len(y) - both else either[:0].view(np.int64))
            yield record(node=b.column("node"), pivot=b.column("pivot"), lacks=np.array(lacks, np.int64),
                         adds=np.array(adds, np.int64), size=np.array(size, np.int64), diff=pa.array(diff, pa.list_(pa.int64())))

    own = sets.select("node", F.col("members").alias("x"))
    pivots = sets.select(F.col("node").alias("pivot"), F.col("members").alias("y"))
    return lean_arrow(pairs.join(own, "node").join(pivots, "pivot").select("node", "pivot", "x", "y"), differ,
                      "node long, pivot long, lacks long, adds long, size long, diff array<long>")


def _near_pairs(deltas: DataFrame, label: DataFrame) -> DataFrame:
    """Candidates ``u, v`` of different components that are near one pivot."""
    near = deltas.where(NEAR).withColumn("w", F.expr(WEIGHT))
    x = near.select("pivot", "node", "w", "size", F.explode("diff").alias("x"))
    met = x.groupBy("pivot", "x").agg(F.count("*").alias("met")).where("met > 1")  # by another near document too
    mine = Window.partitionBy("pivot", "node")
    x = (x.join(met, ["pivot", "x"]).withColumn("at", F.row_number().over(mine.orderBy("met", "x")))
         .withColumn("held", F.count("*").over(mine)))
    # as one of a pair, or as the one of it that does not link to the pivot
    one = F.col("held") - F.floor(F.col("w") / 9)
    unlinked = F.col("held") - F.ceil((F.col("w") - F.col("size")) / 9) + 1
    x = (x.withColumn("one", F.col("at") <= one).withColumn("unlinked", (F.col("w") > F.col("size")) & (F.col("at") <= unlinked))
         .where("one or unlinked").join(label, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component"))
    x = stash(x, "differences")
    searched = x.where("one").select("pivot", "x", F.col("node").alias("v"), F.col("w").alias("w_v"),
                                     F.col("held").alias("held_v"), F.col("of").alias("to"))
    searching = x.where("unlinked")
    found = searching.join(searched, ["pivot", "x"]).where("of <> to and node <> v").where(
        9 * F.least("held", "held_v") >= F.col("w") + F.col("w_v") - F.col("size"))
    return found.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def _far_pairs(lists: DataFrame, deltas: DataFrame) -> DataFrame:
    """Candidates ``u, v`` of different components that meet in a list and of which one is
    far from its pivot."""
    apart = F.expr("1 - (size - lacks) / (size + adds)")
    lists = lists.join(deltas.select("node", "pivot", F.expr(NEAR).alias("near"), apart.alias("d")), ["node", "pivot"])
    far = lists.groupBy("key").agg(F.bool_or(~F.col("near")).alias("any")).where("any").select("key")
    lists = lists.join(far, "key", "left_semi")
    other = lists.select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("own").alias("own_m"),
                         F.col("of").alias("to"), F.col("near").alias("near_v"), F.col("d").alias("d_v"))
    swap = F.col("node") < F.col("v")
    pairs = (lists.where("of <> main").join(other, "key").where("of <> to and (node > v or to = main)")
             .where("not (near and near_v) and abs(d - d_v) <= 0.2000001").where(_fits())
             .groupBy(F.when(swap, F.col("v")).otherwise(F.col("node")).alias("u"),
                      F.when(swap, F.col("node")).otherwise(F.col("v")).alias("v"),
                      F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n"),
                      F.when(swap, F.col("n")).otherwise(F.col("m")).alias("m"))
             .agg(F.count("*").alias("c"), F.max("subset").alias("s")))
    # what is shared outside the long prefixes is at most the longer remainder; a pair
    # that is near the pivot of another of its lists is found there
    reach = F.col("c") + F.greatest(_remainder("n"), _remainder("m"))
    return (pairs.where((F.col("s") == 1) | (reach * 180 >= (F.col("n") + F.col("m")) * 80))
            .select("u", "v").distinct())


def _classes(documents: DataFrame) -> DataFrame:
    return documents.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("node"))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written document rows, and the component of each linked ``node``."""
    rows = id_and_text(docs)
    sc = rows.sparkSession.sparkContext
    described = stash(lean_arrow(rows, _describe, "doc_id long, n long, a long, b long, token long, hits long"), "sets")
    documents = described.where("token is null").drop("token", "hits")
    tokens = described.where("token is not null").groupBy("token").agg(F.sum("hits").alias("hits"))
    mean = tokens.agg((F.sum("hits") / F.count("*")).alias("m")).first()["m"]
    frequent = tokens.where(F.col("hits") >= HEAVY_HITS).orderBy(F.desc("hits"), "token").limit(MAX_HEAVY)
    heavy = np.sort(np.array([r["token"] for r in frequent.collect()], np.int64).view(U64))
    small = boundary(mean or 1.0)
    shared_heavy = sc.broadcast(heavy)
    bits = sketch.log2_width(text_bytes(docs) // 28)

    def count(batches):
        for b in chunks(batches):
            sets = Sets(b)
            yield from sketch.parts(np.r_[sets.h, sets.subsets(small)[1]], bits)

    repeated = sc.broadcast(sketch.merge(lean_arrow(rows, count, sketch.PARTS), bits))

    def offer(batches):
        for b in chunks(batches):
            s = Sets(b)
            row, key, subset, own = s.keys(shared_heavy.value, small, repeated.value)
            a, c = s.marks()
            ids = _ids(b)
            first = np.zeros(b.num_rows, bool)  # the smallest id of equal sets in a chunk
            by_set = np.lexsort((ids, a))
            first[by_set[np.r_[True, np.diff(a[by_set]) != 0]]] = True
            lists = []
            for of in (~subset, subset):
                order = np.argsort(row[of], kind="stable")
                k, bounds = key[of][order].view(np.int64), np.searchsorted(row[of][order], np.arange(b.num_rows + 1))
                lists.append([k[x:y] for x, y in zip(bounds[:-1], bounds[1:])])
            has = [i for i in range(b.num_rows) if first[i] and (len(lists[0][i]) or len(lists[1][i]))]
            yield record(
                doc_id=ids[has], n=s.n[has], own=own[has], a=a[has], b=c[has],
                keys=pa.array([lists[0][i] for i in has], pa.list_(pa.int64())),
                subsets=pa.array([lists[1][i] for i in has], pa.list_(pa.int64())),
                members=pa.array([s.h[s.bounds[i]:s.bounds[i + 1]].tobytes() for i in has], pa.binary()))

    classes = _classes(documents)
    offered = lean_arrow(rows, offer, "doc_id long, n long, own long, a long, b long, keys array<long>, subsets array<long>, "
                                     "members binary")
    sets = stash(offered.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "a", "b"], "left_semi")
                 .select(F.col("doc_id").alias("node"), "n", "own", "keys", "subsets", "members"), "members")
    repeated.destroy()  # what it was for is written
    shared_heavy.destroy()
    lists = stash(sets.select("node", "n", "own", F.explode(F.concat(
        F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(0).alias("subset"))),
        F.transform("subsets", lambda k: F.struct(k.alias("key"), F.lit(1).alias("subset"))))).alias("k"))
        .select("node", "n", "own", "k.key", "k.subset"), "lists")

    sizes = sets.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("own").alias("own_m"))
    label = tried = links = None
    spread = lists.withColumn("of", F.col("node"))
    for turn in range(ROUNDS):
        # the document with the least text of its own, then any
        order = F.struct("own", "node") if not turn else F.struct(F.xxhash64("node", F.lit(turn)), "node")
        pivots = spread.groupBy("key").agg(F.min(order)["node"].alias("pivot"))
        star = (spread.join(pivots, "key").where("node <> pivot").select("node", "n", "own", "pivot").distinct()
                .join(sizes, "pivot").where(_fits())
                .select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct())
        star = star if tried is None else star.join(tried, ["u", "v"], "left_anti")
        star = stash(star, "star")
        found = stash(_verify(star, sets), "links")
        tried = star if tried is None else tried.unionByName(star)
        links = found if links is None else links.unionByName(found)
        label = components(links)
        spread = stash(_spread(lists, label), "open")

    # the largest component of a list gives its pivot and is searched, all others search
    main = (spread.groupBy("key", "of").agg(F.count("*").alias("c"), F.min(F.struct("own", "node"))["node"].alias("pivot"))
            .groupBy("key").agg(F.max(F.struct("c", "of", "pivot")).alias("t")).select("key", F.col("t.of").alias("main"), "t.pivot"))
    spread = stash(spread.join(main, "key").where("node <> pivot"), "pivots")
    deltas = stash(_deltas(spread.select("node", "pivot").distinct(), sets), "deltas")
    to_pivot = deltas.where(LINKED).select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v"))
    rest = (_near_pairs(deltas, label).unionByName(_far_pairs(spread, deltas)).distinct()
            .join(tried, ["u", "v"], "left_anti"))
    more = _verify(rest, sets)
    label = components(links.unionByName(to_pivot).unionByName(more))
    return documents, label


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, class_id`` (smallest id of
    the documents with the same set) and ``component_id`` (smallest id
    reachable by links)."""
    with shuffles_freed(docs.sparkSession):
        documents, label = _linked(docs)
    classes = _classes(documents)
    named = classes.join(label, "node", "left").select(
        "a", "b", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    out = documents.join(named, ["a", "b"], "left")
    real = {c: F.when(F.col(c) != NULL_ID, F.col(c)) for c in ("doc_id", "class_id", "component_id")}
    return (out.withColumn("class_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
            .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
            .withColumns(real).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id"))
