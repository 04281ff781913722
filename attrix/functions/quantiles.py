"""Exact quantiles with bounded memory (linear interpolation, like
``numpy.percentile`` / ``quantile_cont``), as Spark tables.

Spark's exact ``percentile`` keeps every distinct value of a group in one
task at the final merge.  Here the two order statistics around rank
``p * (n - 1)`` of each (group, probability) are bracketed:

Groups of at most ``SMALL`` rows take no sketch: they are dealt, whole, to tasks of about
``PER_TASK`` rows, sorted there and read at their ranks.  So a task's memory is the same
however many groups there are.  For the larger ones (at most rows / ``SMALL`` of them):

1. One pass takes a KLL sketch of each group (mergeable, bounded).  Its values at
   the wanted ranks, widened by ``SLACK``, are the first brackets.
2. One pass counts the rows below and inside each bracket, with the inside's
   minimum, maximum and its own sketch.  A bracket of equal values is settled; one of
   at most ``SMALL`` rows is *narrow*; a wider one is narrowed by its sketch, or halved
   where that does not narrow it, and counted again; one that missed its ranks (a
   sketch errs with a small probability) goes on with the side that holds them.
3. One pass counts the distinct values inside narrow brackets, adds them up in
   order (at most ``SMALL`` rows a bracket) and picks the values at the ranks.

The brackets are a table, one row a group, joined to the rows on the group; the driver
sees how many brackets are open and how many rows small groups have, nothing else.  A value or a group holding a third of
all rows is combined map side in every pass.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.session import partitions_for, stash

#: KLL parameter, its rank error with a margin, and the rows of a narrow bracket.
KLL_K, SLACK, SMALL = 2000, 0.004, 100_000
#: Rows of small groups that one task sorts.
PER_TASK = 250_000
GRID = 256


def _number(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _sketch(x: Column) -> Column:
    return F.kll_sketch_agg_double(x, KLL_K)


def _at(sketch: Column, ranks: list[float]) -> Column:
    """The sketch's values at fixed ranks (null without rows)."""
    held = F.when(F.kll_sketch_get_n_double(sketch) > 0, sketch)
    return F.kll_sketch_get_quantile_double(held, F.array(*[F.lit(min(1.0, max(0.0, float(r)))) for r in ranks]))


def _interpolated(v0, v1, part):
    return v0 + (v1 - v0) * part


def by_size(rows: DataFrame, key: str, groups: DataFrame, small: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` of the groups (``key, n``) with more than ``small`` rows, the others dealt by
    group, and over how many tasks.  What is broadcast is at most rows / ``small`` groups."""
    small = SMALL if small is None else small
    large = F.broadcast(groups.where(F.col("n") > small).select(key))
    total = groups.where(F.col("n") <= small).agg(F.sum("n")).first()[0]
    tasks = partitions_for(total or 0, PER_TASK)
    return rows.join(large, key), rows.join(large, key, "left_anti").repartition(tasks, key), tasks


def group_quantiles(df: DataFrame, group: str, column: str, probs: list[float], small: int | None = None) -> DataFrame:
    """One row per non-null group: ``g`` (as string), ``n, min, max`` and ``q0, q1, ...``
    for ``probs``; NULL and NaN values are ignored, groups without values left out."""
    small = SMALL if small is None else small
    src = df.select(F.col(group).cast("string").alias("g"), _number(column).alias("x")).where("g IS NOT NULL AND x IS NOT NULL")
    js = range(len(probs))
    groups = stash(src.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max")), "groups")
    large, rest, _ = by_size(src, "g", groups, small)
    out = _sorted_groups(rest, probs)
    if groups.where(F.col("n") > small).isEmpty():
        return out
    src = large
    seen = groups.join(F.broadcast(src.groupBy("g").agg(_sketch(F.col("x")).alias("sk"))), "g")
    first = _at(F.col("sk"), [p + s for p in probs for s in (-SLACK, SLACK)])
    state = seen.withColumn("at", first).select("g", "n", "min", "max", *[e for j, p in enumerate(probs) for e in (
        F.floor(F.lit(p) * (F.col("n") - 1)).alias(f"r{j}"),
        F.lit(None).cast("double").alias(f"q{j}"), F.lit(False).alias(f"narrow{j}"), F.lit(0).cast("long").alias(f"below{j}"),
        F.get("at", F.lit(2 * j)).alias(f"lo{j}"), F.get("at", F.lit(2 * j + 1)).alias(f"hi{j}"),
        F.col("min").alias(f"from{j}"), F.col("max").alias(f"to{j}"))])  # surely around the ranks
    state = stash(state, "brackets")
    wide = reduce(lambda a, b: a | b, [F.col(f"q{j}").isNull() & ~F.col(f"narrow{j}") for j in js])
    while not (open_ := state.where(wide)).isEmpty():
        state = stash(state.where(~wide).unionByName(_narrowed(src, open_, probs, small)), "brackets")
    return out.unionByName(_settled(src, state, probs))


def _sorted_groups(rows: DataFrame, probs: list[float]) -> DataFrame:
    """Quantiles of groups that one task each sorts."""
    whole = Window.partitionBy("g")
    at = F.row_number().over(whole.orderBy("x")) - 1
    ranks = [F.floor(F.lit(p) * (F.col("n") - 1)) for p in probs]
    picks = [F.max(F.when(F.col("at") == rank, F.col("x"))).alias(f"{name}{j}") for j, r in enumerate(ranks)
             for name, rank in (("u", r), ("v", F.least(r + 1, F.col("n") - 1)))]
    picked = (rows.withColumn("at", at).withColumn("n", F.count("*").over(whole))
              .groupBy("g", "n").agg(F.min("x").alias("min"), F.max("x").alias("max"), *picks))
    return picked.select("g", "n", "min", "max", *[
        _interpolated(F.col(f"u{j}"), F.col(f"v{j}"), F.lit(p) * (F.col("n") - 1) - r).alias(f"q{j}")
        for j, (p, r) in enumerate(zip(probs, ranks))])


def _narrowed(src: DataFrame, open_: DataFrame, probs: list[float], small: int) -> DataFrame:
    """One counting pass over the groups with open brackets."""
    js = range(len(probs))
    x = F.col("x")
    rows = src.join(open_.select("g", *[f"{e}{j}" for j in js for e in ("lo", "hi")]), "g")
    aggs = []
    for j in js:
        lo, hi = F.col(f"lo{j}"), F.col(f"hi{j}")
        inside = F.when((x >= lo) & (x <= hi), x)
        aggs += [F.count(F.when(x < lo, 1)).alias(f"b{j}"), F.count(inside).alias(f"i{j}"), F.min(inside).alias(f"mn{j}"),
                 F.max(inside).alias(f"mx{j}"), F.max(F.when(x < lo, x)).alias(f"less{j}"),
                 F.min(F.when(x > hi, x)).alias(f"more{j}"), _sketch(inside).alias(f"sk{j}")]
    seen = rows.groupBy("g").agg(*aggs)
    seen = seen.select("g", *[f"{e}{j}" for j in js for e in ("b", "i", "mn", "mx", "less", "more")],
                       *[_at(F.col(f"sk{j}"), [i / GRID for i in range(GRID + 1)]).alias(f"grid{j}") for j in js])
    out = open_.join(seen, "g")
    cols = [F.col(c) for c in ("g", "n", "min", "max")]
    for j, p in enumerate(probs):
        rank, below, inside = F.col(f"r{j}"), F.col(f"b{j}"), F.col(f"i{j}")
        lo, hi, mn, mx, less, more, from_, to = (F.col(f"{e}{j}") for e in ("lo", "hi", "mn", "mx", "less", "more", "from", "to"))
        done = F.col(f"q{j}").isNotNull() | F.col(f"narrow{j}")
        last = F.least(rank + 1, F.col("n") - 1)  # the second order statistic
        end = below + inside
        hit = (below <= rank) & (last < end)
        part = F.lit(p) * (F.col("n") - 1) - rank
        value = (F.when(hit & (mn == mx), mn)
                 .when((rank < below) & (last >= below) & (inside > 0), _interpolated(less, mn, part))  # on both sides of an end
                 .when((rank < end) & (last >= end) & (inside > 0), _interpolated(mx, more, part))
                 .when((rank < below) & (last >= below), _interpolated(less, more, part)))
        narrow = hit & (inside <= small)
        grid = F.col(f"grid{j}")
        # relative ranks of the two order statistics inside the bracket, widened
        a = F.floor(((rank - below) / inside - SLACK) * GRID).cast("int")
        b = F.ceil(((last + 1 - below) / inside + SLACK) * GRID).cast("int")
        next_lo = F.greatest(F.get(grid, F.greatest(a, F.lit(0))), mn)
        next_hi = F.least(F.get(grid, F.least(b, F.lit(GRID))), mx)
        stuck = (next_lo <= mn) & (next_hi >= mx)
        cols += [rank.alias(f"r{j}"),
                 F.when(done, F.col(f"q{j}")).otherwise(value).alias(f"q{j}"),
                 F.when(done, F.col(f"narrow{j}")).otherwise(narrow & value.isNull()).alias(f"narrow{j}"),
                 F.when(done, F.col(f"below{j}")).otherwise(below).alias(f"below{j}"),
                 F.when(done | narrow, lo).when(hit, F.when(stuck, mn).otherwise(next_lo)).when(last < below, from_).otherwise(more).alias(f"lo{j}"),
                 F.when(done | narrow, hi).when(hit, F.when(stuck, mn / 2 + mx / 2).otherwise(next_hi)).when(last < below, less).otherwise(to).alias(f"hi{j}"),
                 F.when(hit, mn).when(last < below, from_).otherwise(F.coalesce(more, from_)).alias(f"from{j}"),
                 F.when(hit, mx).when(last < below, F.coalesce(less, to)).otherwise(to).alias(f"to{j}")]
    return out.select(*cols)


def _settled(src: DataFrame, state: DataFrame, probs: list[float]) -> DataFrame:
    """Pick the order statistics from the distinct values of narrow brackets."""
    js = range(len(probs))
    part = [F.lit(p) * (F.col("n") - 1) - F.col(f"r{j}") for j, p in enumerate(probs)]
    open_ = state.where(reduce(lambda a, b: a | b, [F.col(f"q{j}").isNull() for j in js]))
    x = F.col("x")
    holds = F.array_compact(F.array(*[F.when(
        F.col(f"q{j}").isNull() & (x >= F.col(f"lo{j}")) & (x <= F.col(f"hi{j}")), F.lit(j)) for j in js]))
    counts = (src.join(open_.select("g", *[f"{e}{j}" for j in js for e in ("q", "lo", "hi")]), "g")
              .select("g", "x", F.explode(holds).alias("b")).groupBy("g", "b", "x").agg(F.count("*").alias("c")))
    order = Window.partitionBy("g", "b").orderBy("x")
    placed = counts.withColumn("upto", F.sum("c").over(order)).join(
        open_.select("g", "n", *[f"{e}{j}" for j in js for e in ("r", "below")]), "g")
    picks = []
    for j in js:
        upto = F.col("upto") + F.col(f"below{j}")
        for name, rank in (("u", F.col(f"r{j}")), ("v", F.least(F.col(f"r{j}") + 1, F.col("n") - 1))):
            picks.append(F.max(F.when((F.col("b") == j) & (upto - F.col("c") <= rank) & (rank < upto), x)).alias(f"{name}{j}"))
    picked = placed.groupBy("g").agg(*picks)
    return state.join(picked, "g", "left").select("g", "n", "min", "max", *[
        F.coalesce(f"q{j}", _interpolated(F.col(f"u{j}"), F.col(f"v{j}"), part[j])).alias(f"q{j}") for j in js])


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], extra_aggs: list | None = None,
                    small: int | None = None):
    """``({(column, p): value}, first_aggregate_row)`` over the whole frame; NaN/NULL are
    ignored.  ``extra_aggs`` ride along with the sketches; the driver sees a few numbers
    a column and probability."""
    spark = df.sparkSession
    small = SMALL if small is None else small
    vals = {c: _number(c) for c in columns}
    ranks = [p + s for p in probs for s in (-SLACK, SLACK)]
    sketches = [_sketch(vals[c]).alias(f"_kll{i}") for i, c in enumerate(columns)]
    got = df.agg(*[F.count(vals[c]).alias(f"n{i}") for i, c in enumerate(columns)], *sketches, *(extra_aggs or []))
    row = got.select(*[c for c in got.columns if not c.startswith("_kll")],
                     *[_at(F.col(f"_kll{i}"), ranks).alias(f"b{i}") for i in range(len(columns))]).first()
    out: dict = {}
    entries = []
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        for j, p in enumerate(probs):
            if not n:
                out[(c, p)] = None
                continue
            at = math.floor(p * (n - 1))
            entries.append((c, p, n, at, min(at + 1, n - 1), row[f"b{i}"][2 * j], row[f"b{i}"][2 * j + 1]))
    stats = []
    for k, (c, _, _, _, _, lo, hi) in enumerate(entries):
        inside = F.when((vals[c] >= lo) & (vals[c] <= hi), vals[c])
        stats += [F.count(F.when(vals[c] < lo, 1)).alias(f"below{k}"), F.count(inside).alias(f"in{k}"),
                  F.min(inside).alias(f"mn{k}"), F.max(inside).alias(f"mx{k}")]
    st = df.agg(*stats).first() if stats else None
    narrow, hard = [], set()
    for k, (c, p, n, r0, r1, lo, hi) in enumerate(entries):
        below, inside = st[f"below{k}"], st[f"in{k}"]
        if not (below <= r0 and r1 < below + inside):
            hard.add(c)
        elif st[f"mn{k}"] == st[f"mx{k}"]:
            out[(c, p)] = st[f"mn{k}"]
        elif inside > small:
            hard.add(c)
        else:
            narrow.append((k, c, p, n, r0, r1, lo, hi, below))
    if narrow:
        out.update(_picked(spark, df, vals, narrow))
    for c in sorted(hard):
        settled = group_quantiles(df.select(F.lit("all").alias("_g"), F.col(c)), "_g", c, probs, small).first()
        out.update({(c, p): settled[f"q{j}"] for j, p in enumerate(probs)})
    return out, row


def _picked(spark, df: DataFrame, vals: dict, narrow: list[tuple]) -> dict:
    """Values at the ranks of narrow brackets (a row a column and probability)."""
    table = spark.createDataFrame([(k, float(lo), float(hi), r0, r1, below) for k, _, _, _, r0, r1, lo, hi, below in narrow],
                                  "k int, lo double, hi double, r0 long, r1 long, below long")
    parts = []
    for c in dict.fromkeys(t[1] for t in narrow):
        mine = [t for t in narrow if t[1] == c]
        holds = F.array_compact(F.array(*[F.when((F.col("v") >= lo) & (F.col("v") <= hi), F.lit(k))
                                          for k, _, _, _, _, _, lo, hi, _ in mine]))
        parts.append(df.select(vals[c].alias("v")).where(reduce(lambda a, b: a | b, [
            (F.col("v") >= lo) & (F.col("v") <= hi) for *_, lo, hi, _ in mine])).select("v", F.explode(holds).alias("k")))
    counts = reduce(lambda a, b: a.unionByName(b), parts).groupBy("k", "v").agg(F.count("*").alias("c"))
    upto = (counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("v")))
            .join(F.broadcast(table), "k").withColumn("upto", F.col("upto") + F.col("below")))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("upto") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))

    found = {r["k"]: r for r in upto.groupBy("k").agg(at("r0").alias("v0"), at("r1").alias("v1")).collect()}
    return {(c, p): _interpolated(found[k]["v0"], found[k]["v1"], p * (n - 1) - r0) for k, c, p, n, r0, *_ in narrow}
