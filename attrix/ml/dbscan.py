"""Exact DBSCAN (Euclidean, on population z-scores; min_samples counts the
point itself; noise = -1) on a grid.

1. Identical points collapse into one weighted point (map-side combined).
2. Space is cut into cells of side ``eps / sqrt(d)``: points of one cell are within
   ``eps`` of each other.  A cell of weight ``min_samples`` or more is *dense*, all its
   points are core at once.
3. Other cells hold fewer than ``min_samples`` points, so only those few visit the
   neighbouring cells to be counted: a join on the cell, at most neighbours x
   ``min_samples`` visitors a point.  Cells of more than ``SALT_ROWS`` points are cut into
   salts, which every visitor of the cell visits.
4. Core cells are the nodes of a graph.  Two neighbouring ones are linked when some
   pair of their core points is within ``eps``.  Boxes decide: tight bounding boxes of
   the cells' points, then of their sub-cells, halved level by level, for the pairs
   that are neither certainly within (farthest corners) nor certainly beyond (nearest
   faces).  So two cells of a million points each are linked without their pairs.
5. Components of the cell graph are the clusters; a point that is not core joins the
   first cluster with a core point within ``eps``.
6. Clusters are numbered by their smallest core point's coordinates.

Everything is DataFrame joins and aggregates.  Neighbouring cells are found through
their first ``GRID_DIMS`` coordinates and checked on all.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.functions.graph import components
from attrix.functions.rank import with_row_number
from attrix.ml.basics import complete_rows, require_rows
from attrix.ml.models import scaler_stats
from attrix.session import ensure_checkpoint_dir, stash

SALT_ROWS, GRID_DIMS = 100_000, 2


def _zcols(d: int) -> list[str]:
    return [f"z{i}" for i in range(d)]


def _squares(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _box(d: int) -> list[Column]:
    return [e for i in range(d) for e in (F.min(f"z{i}").alias(f"lo{i}"), F.max(f"z{i}").alias(f"hi{i}"))]


def _box_distances(d: int) -> tuple[Column, Column]:
    """Least and greatest squared distance of boxes ``a`` and ``b`` (prefixes)."""
    near, far = F.lit(0.0), F.lit(0.0)
    for i in range(d):
        alo, ahi, blo, bhi = (F.col(f"{s}{e}{i}") for s in "ab" for e in ("lo", "hi"))
        gap = F.greatest(blo - ahi, alo - bhi, F.lit(0.0))
        wide = F.greatest(bhi - alo, ahi - blo)
        near, far = near + gap * gap, far + wide * wide
    return near, far


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def _cell_pairs(cells: DataFrame, d: int) -> DataFrame:
    """``acell, bcell``: cells whose points may be within eps, each with itself too."""
    g = min(d, GRID_DIMS)
    reach = int(d ** 0.5) + 1
    # the gap between two cells is (|offset| - 1) sides; eps is sqrt(d) sides
    near = [o for o in product(range(-reach, reach + 1), repeat=g) if sum(max(abs(x) - 1, 0) ** 2 for x in o) <= d]
    offsets = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{i}") for i, x in enumerate(o)]) for o in near])
    at = [f"k{i}" for i in range(d)]
    a = cells.select(F.col("cell").alias("acell"), *[F.col(k).alias(f"a{k}") for k in at], F.explode(offsets).alias("o")).select(
        "acell", *[f"a{k}" for k in at], *[(F.col(f"ak{i}") + F.col(f"o.o{i}")).alias(f"k{i}") for i in range(g)])
    b = cells.select(F.col("cell").alias("bcell"), *at)
    joined = a.join(b, at[:g])
    gap = sum((F.pow(F.greatest(F.abs(F.col(f"ak{i}") - F.col(f"k{i}")) - 1, F.lit(0)), F.lit(2)) for i in range(d)), F.lit(0.0))
    return joined.where(gap <= d).select("acell", "bcell")


def _linked_cells(core: DataFrame, pairs: DataFrame, d: int, side: float, e2: float) -> DataFrame:
    """``u, v``: neighbouring core cells with a pair of points within eps."""
    near, far = _box_distances(d)
    open_ = pairs.where("acell < bcell").select("acell", "bcell", F.lit("").alias("apart"), F.lit("").alias("bpart"))
    found, level = None, 0
    while True:
        # sub-cells by halving: two letters a level and dimension would do, the index is plainer
        width = side / 2 ** level
        part = F.concat_ws(",", *[F.floor(F.col(f"z{i}") / width).cast("string") for i in range(d)]) if level else F.lit("")
        up = (F.concat_ws(",", *[F.floor(F.col(f"z{i}") / (2 * width)).cast("string") for i in range(d)]) if level > 1 else F.lit(""))
        wanted = open_.select(F.col("acell").alias("cell"), F.col("apart").alias("up")).unionByName(
            open_.select(F.col("bcell").alias("cell"), F.col("bpart").alias("up"))).distinct()
        boxes = stash(core.withColumn("part", part).withColumn("up", up).join(wanted, ["cell", "up"], "left_semi")
                      .groupBy("cell", "up", "part").agg(*_box(d), F.count("*").alias("n")), "boxes")
        a = _prefixed(boxes, "a", [])
        b = _prefixed(boxes, "b", [])
        tried = (open_.withColumnRenamed("apart", "aup").withColumnRenamed("bpart", "bup")
                 .join(a, ["acell", "aup"]).join(b, ["bcell", "bup"])
                 .select("acell", "bcell", "apart", "bpart", near.alias("near"), far.alias("far")))
        # boxes of one point each are decided by near = far
        tried = stash(tried.where(F.col("near") <= e2), "tried")
        sure = tried.where(F.col("far") <= e2).select(F.col("acell").alias("u"), F.col("bcell").alias("v")).distinct()
        found = sure if found is None else found.unionByName(sure)
        left = tried.join(sure.select(F.col("u").alias("acell"), F.col("v").alias("bcell")), ["acell", "bcell"], "left_anti")
        open_ = stash(left.where(F.col("far") > e2).select("acell", "bcell", "apart", "bpart"), "open")
        if open_.isEmpty():
            return found
        level += 1


def dbscan(df: DataFrame, features: list[str], eps: float = 0.5, min_samples: int = 5,
           keep: list[str] | None = None, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Rows (keep + features) with ``cluster`` (-1 = noise) and ``is_core``."""
    keep = list(keep or [])
    ensure_checkpoint_dir(df.sparkSession)
    src = complete_rows(df, features)
    require_rows(src, "clustering")
    d, e2 = len(features), eps * eps
    # slightly smaller cells: a cell's corners are within eps whatever the rounding
    side = eps / d ** 0.5 * (1 - 1e-9)
    stats = scaler_stats(src, features)
    zc = _zcols(d)
    rows = src.select(*keep, *features, *[((F.col(c).cast("double") - F.lit(m)) / F.lit(s) + F.lit(0.0)).alias(z)
                                          for z, c, (m, s) in zip(zc, features, stats)])
    at = [f"k{i}" for i in range(d)]
    weighed = rows.groupBy(*zc).agg(F.count("*").alias("w")).withColumns(
        {k: F.floor(F.col(z) / side).cast("long") for k, z in zip(at, zc)})
    found = stash(weighed.groupBy(*at).agg(F.sum("w").alias("weight"), F.count("*").alias("n"))
                  .withColumn("cell", F.monotonically_increasing_id()), "cells")
    pts = stash(weighed.join(found.select("cell", "weight", "n", *at), at).drop(*at)
                .withColumn("pid", F.monotonically_increasing_id())
                .withColumn("dense", F.col("weight") >= min_samples)
                .withColumn("salts", F.ceil(F.col("n") / salt_rows).cast("int"))
                .withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts")).cast("int")), "points")
    pairs = stash(_cell_pairs(found, d), "pairs")
    sizes = found.select(F.col("cell").alias("bcell"), F.ceil(F.col("n") / salt_rows).cast("int").alias("bsalts"))

    def visits(points: DataFrame, to: DataFrame) -> DataFrame:
        """Points with each neighbouring cell, all its salts, of those in ``to``."""
        v = points.select("pid", F.col("cell").alias("acell"), *[F.col(z).alias(f"a{z}") for z in zc])
        return (v.join(pairs, "acell").join(to, "bcell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("bsalts") - 1)))
                .withColumnRenamed("bcell", "cell"))

    within = _squares([F.col(f"a{z}") for z in zc], [F.col(z) for z in zc]) <= e2
    few = pts.where(~F.col("dense"))
    targets = pts.select("cell", "salt", "w", *zc)
    counted = (visits(few, sizes).join(targets, ["cell", "salt"]).where(within)
               .groupBy("pid").agg(F.sum("w").alias("around")).where(F.col("around") >= min_samples))
    flagged = stash(pts.join(counted.select("pid", F.lit(True).alias("_met")), "pid", "left")
                    .withColumn("core", F.col("dense") | F.coalesce("_met", F.lit(False))).drop("_met"), "flagged")
    core = flagged.where("core")
    core_cells = core.select("cell").distinct()
    between = (pairs.join(core_cells.withColumnRenamed("cell", "acell"), "acell", "left_semi")
               .join(core_cells.withColumnRenamed("cell", "bcell"), "bcell", "left_semi"))
    label = components(_linked_cells(core, between, d, side, e2))
    of_cell = core_cells.join(label, core_cells["cell"] == label["node"], "left").select(
        "cell", F.coalesce("component", "cell").alias("comp"))
    first = core.join(of_cell, "cell").groupBy("comp").agg(F.min(F.struct(*zc)).alias("first"))
    numbered = stash(with_row_number(first, [F.col("first")], "number").select(
        "comp", (F.col("number") - 1).cast("int").alias("cluster")), "clusters")
    of_cell = stash(of_cell.join(numbered, "comp").select("cell", "cluster"), "of-cell")
    near_core = (visits(flagged.where(~F.col("core")), sizes.join(of_cell.withColumnRenamed("cell", "bcell"), "bcell"))
                 .join(core.select("cell", "salt", *zc), ["cell", "salt"]).where(within)
                 .groupBy("pid").agg(F.min("cluster").alias("cluster")))
    named = (core.join(of_cell, "cell").select(*zc, "cluster", F.lit(True).alias("is_core"))
             .unionByName(flagged.where(~F.col("core")).join(near_core, "pid").select(*zc, "cluster", F.lit(False).alias("is_core"))))
    return rows.join(named, zc, "left").select(
        *keep, *features, F.coalesce(F.col("cluster"), F.lit(-1)).cast("int").alias("cluster"),
        F.coalesce(F.col("is_core"), F.lit(False)).alias("is_core"))
