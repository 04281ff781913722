"""Mix sources to target weights.

Every document gets a hash-random key; within its source, documents are ordered
by key and taken until the source's budget is used up, starting over (another
epoch) where the budget exceeds the source.  Prefix sums are distributed: a
source is cut into ``16**3`` key ranges, sums run inside a range, and the
ranges' totals (4,096 rows a source) give the offsets, so that a source with
most of the rows is spread over all tasks.  Only the table of sources, one row
each, is ordered in one place.

Targets: the corpus size is shared by weight; a target stops at ``epochs`` times
its source's size and the excess is shared again by weight, which ends at
``min(epochs * size, level * weight)`` for one water level.

Defined results: null text has size 0; a null source is a source (the last);
documents of size 0 are taken 0 times; rows that repeat are separate documents;
an empty table gives an empty result.  The same rows give the same mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.text import stash

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)


def word_count(column: str = "text") -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` (0 for null)."""
    plain = F.translate(F.coalesce(F.col(column), F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def targets(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """``source, source_size`` -> with ``target`` (double)."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    name = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", F.element_at(weights, (F.row_number().over(name) - 1) % len(WEIGHTS) + 1))
        .withColumn("most", F.lit(epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("heft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.max(F.col("left").cast("double") / F.col("heft")).over(everything))
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def mix_sources(docs: DataFrame, epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target``,
    ``epochs`` (whole passes over the source) and ``taken`` (words the mixture
    takes, repeats counted; the document at the cut is taken in part)."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = stash(docs.select("doc_id", "source", word_count().alias("size"), key.alias("key"))
                  .withColumn("range", F.substring("key", 1, 3)), "sizes")
    totals = sized.groupBy("source", "range").agg(F.sum("size").alias("total"))
    source = Window.partitionBy("source")
    offsets = totals.select(
        F.col("source").alias("s"), F.col("range").alias("r"),
        (F.sum("total").over(source.orderBy("range")) - F.col("total")).alias("offset"))
    goal = targets(totals.groupBy("source").agg(F.sum("total").alias("source_size")), epochs)
    plan = offsets.join(goal.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    here = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    running = sized.withColumn("until", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.col("size")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - F.col("epochs") * F.col("source_size") - (F.col("offset") + F.col("until") - size)
    return (
        running.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("epochs", passes.cast("long"))
        .withColumn("taken", (F.col("epochs") * size + F.greatest(F.lit(0), F.least(size, rest))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")
    )
