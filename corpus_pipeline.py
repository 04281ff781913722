"""The corpus pipeline: documents in, a mixture to target weights out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrix.llm.decontaminate import contamination
from attrix.llm.jaccard_join import jaccard_join
from attrix.llm.mixing import mix_sources
from attrix.llm.quality import filter_quality
from attrix.llm.substring_dedup import substring_dedup
from attrix.llm.text import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_BAR = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, fitted on ``labels``, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_quality(docs, labels, QUALITY_BAR, COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component;
    rows that repeat a document (same id and text) stay once."""
    joined = jaccard_join(docs)
    keep = joined.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(*COLUMNS).join(keep, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    once = Window.partitionBy("doc_id", "_text").orderBy("lang", "source", "n_chars")
    return (rows.withColumn("_text", F.xxhash64("text")).withColumn("_n", F.row_number().over(once))
            .where("_n = 1").select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that appear earlier."""
    out = substring_dedup(docs, carry=("lang", "source"), with_kept=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, benchmark, carry=("lang", "source", "n_chars"), with_text=True)
    return out.where(F.size("hits") == 0).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: SQL cannot express the classifier's fit; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over ``documents``; each stage's result is written
    to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
