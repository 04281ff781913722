"""The registered queries: each operator over its whole table, with the
columns of its contract derived from the operator's own output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm.alignment import cross_tokenizer_alignment
from attrix.llm.centroids import K, ROUNDS, centroid_clusters, with_inertia
from attrix.llm.decontaminate import contamination
from attrix.llm.fingerprints import edit_probe
from attrix.llm.jaccard_join import jaccard_join
from attrix.llm.licenses import license_scan
from attrix.llm.mixing import mix_sources
from attrix.llm.pii import BASE, LEAST, SHARE, STEM, SUPPORT, WIDTH, listed, personal_data
from attrix.llm.ppm import score_ppm
from attrix.llm.quality import score_quality
from attrix.llm.substring_dedup import substring_dedup
from attrix.llm.suffix_dedup import suffix_dedup
from attrix.llm.toxicity import score_toxicity


QUALITY_BAR = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(part_of(4) == 2, F.lit(False))
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held)
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= QUALITY_BAR).cast("int").alias("predicted"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as a file tree: source, language and the leading digits of
    the id are directories (12345 lies in ``1/12``); a text whose last line speaks
    of a licence is its directory's licence file."""
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    deep = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(digits) - 3)),
                       lambda i: F.substr(digits, F.lit(1), i))
    last = F.element_at(F.split(F.trim(F.coalesce(F.col("text"), F.lit(""))), "\n"), -1)
    name = F.concat(F.when(last.rlike("(?i)licen[cs]e"), F.lit("LICENSE-")).otherwise(F.lit("")), digits)
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")),
                       F.array_join(F.filter(deep, lambda d: d != ""), "/"), name)
    return docs.select("doc_id", F.regexp_replace(path, "//+", "/").alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(document_paths(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("hits.item_id")))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(items).alias("n_items"),
                      items.alias("items"), F.coalesce(F.array_min(F.col("hits.edits")), F.lit(-1)).alias("least_edits"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(part_of(7) == 2, F.lit(False))
    return score_ppm(table(spark, sf_dir, "documents"), learn=~held).withColumn("held_out", held)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(part_of(5) == 0, F.lit(False))
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edit_probe(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
                      F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*centroid_clusters(table(spark, sf_dir, "embeddings")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(table(spark, sf_dir, "documents"))[0]


QUERIES = {
    "op11_pii": op11_pii,
    "op12_centroids": op12_centroids,
    "op13_token_alignment": op13_token_alignment,
    "op2_license_scan": op2_license_scan,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op10_fingerprints": op10_fingerprints,
    "op5_decontamination": op5_decontamination,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op1_quality": op1_quality,
    "op4_jaccard_join": op4_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def pii_sql() -> str:
    """Places from the lengths of matches and gaps; the disclosing terms by the same counts."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "term": r"[\p{L}\p{N}]+"}
    searched = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, {k} AS k, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS g FROM d"
        for k, (kind, p) in enumerate(patterns.items()))
    short = "len(ltrim(p, '0')) <= 3 AND coalesce(try_cast(left(ltrim(p, '0'), 3) AS INT), 0) <= 255"
    digit = "reverse(left(digits, 19))[i]::INT"
    luhn = (f"list_sum(list_transform(range(1, least(len(digits), 19) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 2 * {digit} "
            f"- CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END)) % 10 = 0")
    terms = ("list_filter(list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)), "
             f"lambda w: len(w) >= {LEAST})").format
    share = "CASE WHEN ln({t} / n_e) > 0 THEN 1 - ln(greatest(1.0, {a} / {b}::DOUBLE)) / ln({t} / n_e) END".format
    total = "(SELECT sum(n_t) FROM w)::DOUBLE"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({searched}),
u AS (SELECT rid, kind, k, f[i] AS value, g[i] AS bef, g[i + 1] AS aft, i, len(g[i]) + CASE WHEN i > 1 THEN len(f[i - 1]) ELSE 0 END AS step
      FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m)),
s AS (SELECT *, sum(step) OVER (PARTITION BY rid, k ORDER BY i)::BIGINT AS start, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM u),
v AS (SELECT *, start + len(value) AS stop FROM s WHERE CASE kind
      WHEN 'email' THEN true WHEN 'ip' THEN list_bool_and(list_transform(string_split(value, '.'), lambda p: {short}))
      WHEN 'card' THEN len(digits) BETWEEN 12 AND 19 AND {luhn} WHEN 'phone' THEN len(digits) BETWEEN 9 AND 15 ELSE false END),
c AS (SELECT kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE lower(value) END AS entity,
             list_reverse(list_reverse({terms("bef")})[:{WIDTH}]) AS b, {terms("aft")}[:{WIDTH}] AS a, count(*) AS n FROM v GROUP BY ALL),
e AS (SELECT entity, sum(n) AS n_e FROM c GROUP BY entity),
cw AS (SELECT *, unnest(ws) AS term FROM (SELECT entity, n, row_number() OVER () AS id, list_distinct(list_concat(b, a)) AS ws FROM c)),
own AS (SELECT id, count(*) AS own FROM (SELECT entity, term, min(id) AS id FROM cw GROUP BY ALL HAVING count(*) = 1) GROUP BY id),
near AS (SELECT entity, term, sum(n) AS n_te, sum(apart) + max(1 - apart) AS seen
         FROM (SELECT cw.*, (4 * coalesce(own, 0) >= len(ws))::INT AS apart FROM cw LEFT JOIN own USING (id)) GROUP BY ALL),
w AS (SELECT term, count(*) AS n_t FROM (SELECT unnest({terms("text")}) AS term FROM d) GROUP BY term),
ws AS (SELECT left(term, {STEM}) AS stem, sum(n_t) AS n_s FROM w GROUP BY ALL),
ns AS (SELECT entity, left(term, {STEM}) AS stem, sum(n_te) AS n_se FROM near GROUP BY ALL),
strong AS (SELECT near.entity, term, left(term, {STEM}) AS stem FROM near JOIN w USING (term) JOIN e USING (entity)
           WHERE seen >= {SUPPORT} AND {share(t=total, a="n_t", b="n_te")} >= {SHARE}),
marked AS (SELECT term, max(CASE WHEN {share(t=total, a="n_s", b="n_se")} >= {SHARE} OR len(term) <= {STEM} THEN 'removed'
           ELSE 'generalised' END) AS kind FROM strong JOIN ns USING (entity, stem) JOIN ws USING (stem) JOIN e USING (entity) GROUP BY term),
t AS (SELECT s.rid, marked.kind, start, start + len(value) AS stop FROM s JOIN marked ON s.kind = 'term' AND lower(value) = marked.term
      WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.rid = s.rid AND v.start < s.start + len(s.value) AND v.stop > s.start)),
x AS (SELECT rid, kind, k, start, stop FROM v UNION ALL SELECT rid, kind, CASE kind WHEN 'generalised' THEN 4 ELSE 5 END, start, stop FROM t),
o AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) AS spans,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) FILTER (WHERE k < 4) AS base,
             {", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{kind}" for i, kind in enumerate(BASE))} FROM x GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (rid)
"""


def centroid_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds, unrolled; every distance is computed."""
    near = """a{r} AS (SELECT rid, min([d, c]) AS m FROM (
    SELECT e.rid, c{r}.c, list_sum(list_transform(list_zip(e.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM e, c{r}) GROUP BY rid),"""
    move = """s{r} AS (SELECT a.m[2] AS c, i, sum(e.v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM e JOIN a{r} a USING (rid), range(1, 65) t(i) GROUP BY ALL),
c{q} AS (SELECT c{r}.c, coalesce(f.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c) f ON f.c = c{r}.c),"""
    steps = "\n".join(near.format(r=r) + "\n" + move.format(r=r, q=r + 1) for r in range(rounds))
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id,
           list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY h, v) - 1)::BIGINT AS c, v FROM (
       SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e ORDER BY h, v LIMIT {k})),
{steps}
{near.format(r=rounds)}
i AS (SELECT m[2] AS c, sum(m[1])::BIGINT AS n FROM a{rounds} GROUP BY m[2])
SELECT vec_id, m[2]::INTEGER AS cluster, m[1] AS distance, i.n AS cluster_inertia, (SELECT sum(n)::BIGINT FROM i) AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (rid) JOIN i ON i.c = m[2] JOIN c{rounds} ON c{rounds}.c = m[2]
"""


ORACLE = {
    "op11_pii": pii_sql(),
    "op12_centroids": centroid_sql(K, ROUNDS),
    "op8_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, 3 * source_size / weight::DOUBLE AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()
          - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source ASC NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM o),
t AS (SELECT source, source_size, least(3.0 * source_size, max(lev) OVER () * weight)::DOUBLE AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source
""",
    "op4_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (h)
      WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM r WHERE n > 1),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT t.doc_id, t.i, t.x, c.i IS NOT NULL AS gone FROM t LEFT JOIN c USING (doc_id, i)),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
             string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""",
}
