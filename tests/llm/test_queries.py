"""The registered queries' columns, SQL twins, and the pipeline against brute force."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from attrix.llm.queries import ORACLE, QUERIES
from attrix.llm.quality import score_quality
from tests.conftest import SF001
from tests.llm.conftest import COLUMNS, key
from tests.llm.test_dedup import brute_components, brute_windows

WANT = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op6_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op12_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


def test_all_registered():
    have = E.queries()
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) <= set(have) and have["pipeline"] is P.run
    assert set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(WANT))
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, SF001)
    assert set(WANT[name]) <= set(out.columns)
    assert out.count() == (spark.read.parquet(f"{SF001}/embeddings.parquet").count() if name == "op12_centroids" else 200)
    assert out.where(F.col(WANT[name][0]).isNull()).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    out = QUERIES[name](spark, SF001)
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(tuple, rel.fetchall())) == sorted(tuple(r[c] for c in names) for r in out.collect())


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in score_quality(docs, labels).where(F.col("score") >= P.QUALITY_BAR).collect()}
    rows = [(d, texts[d]) for d in sorted(good)]
    one = {c for _, _, c in brute_components(rows)}
    rows = [r for r in rows if r[0] in one]
    cut = {d: kept for d, _, _, kept in brute_windows(rows, 20)}

    steps = {}
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF001).cache()
        assert now.columns == P.COLUMNS
        steps[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(steps["quality"]) == good
    assert set(steps["near_duplicates"]) == one
    assert {d: " ".join((t or "").split()) for d, t in steps["substrings"].items()} == {
        d: " ".join(t.split()) for d, t in cut.items()}

    def plain(t):
        return " " + " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())) + " "

    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    leaks = {d for d, t in cut.items() if any(i in plain(t) for i in items)}
    gone = set(cut) - set(steps["decontamination"])
    assert leaks <= gone and len(gone) <= len(leaks) + 2
    mixed = P.run(spark, SF001).collect()
    assert sorted(r["doc_id"] for r in mixed) == sorted(steps["decontamination"])
    target = {r["source"]: r["target"] for r in mixed}
    assert all(abs(sum(r["taken"] for r in mixed if r["source"] == s) - t) < 1 for s, t in target.items())


def test_pipeline_stages_on_odd_and_empty_tables(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in P.STAGES[1:]:
            now = stage(spark, now, str(tmp_path)).cache()
            now.collect()
    kept = P.near_duplicates(spark, docs, str(tmp_path)).collect()
    seen = sorted(((r["doc_id"], r["text"]) for r in kept), key=key)
    assert len(seen) == len(set(seen))
