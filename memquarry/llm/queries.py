"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memquarry.llm import compress_bands, langid, license_scan, mixture, ngram_join, paragraph_sketch, piece_codec, pii, repair, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark, sf_dir):
    return pii.find(_documents(spark, sf_dir))


def op2_mixture(spark, sf_dir):
    return mixture.select(_documents(spark, sf_dir))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(_documents(spark, sf_dir))


def op4_sentencepiece(spark, sf_dir):
    return piece_codec.encode(_documents(spark, sf_dir))


def op5_compression(spark, sf_dir):
    return compress_bands.rated(_documents(spark, sf_dir))


def op6_version_differences(spark, sf_dir):
    return paragraph_sketch.version_differences(_documents(spark, sf_dir))


def op7_repair_shards(spark, sf_dir):
    return repair.shards(_documents(spark, sf_dir))


def op8_ngram_jaccard(spark, sf_dir):
    return ngram_join.ngram_classes(_documents(spark, sf_dir))


def op9_license_notices(spark, sf_dir):
    return license_scan.notices(_documents(spark, sf_dir))


def op10_language(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixture, op3_token_counts, op4_sentencepiece, op5_compression, op6_version_differences, op7_repair_shards, op8_ngram_jaccard, op9_license_notices, op10_language)}

ORACLE_SQL = {
    "op6_version_differences": """
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), digests AS (
  SELECT DISTINCT doc_id, substr(md5(trim(line)), 1, 15) AS h FROM lines WHERE trim(line) <> ''
), sizes AS (
  SELECT doc_id, count(*) AS n FROM digests GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM digests a JOIN digests b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS (
  SELECT a, b, k / (x.n + y.n - k) AS jaccard FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k >= 0.5 * (x.n + y.n - k)
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), bases AS (
  SELECT b AS doc_id, a AS base_id FROM pairs QUALIFY row_number() OVER (PARTITION BY b ORDER BY jaccard DESC, a) = 1
), theirs AS (
  SELECT base_id, b.doc_id, h FROM bases b JOIN digests d ON d.doc_id = base_id
), ours AS (
  SELECT base_id, b.doc_id, h FROM bases b JOIN digests d ON d.doc_id = b.doc_id
), only_base AS (
  SELECT doc_id, count(*) AS n, string_agg(h, ',' ORDER BY h) AS hs FROM (SELECT * FROM theirs EXCEPT SELECT * FROM ours) GROUP BY doc_id
), only_doc AS (
  SELECT doc_id, count(*) AS n, string_agg(h, ',' ORDER BY h) AS hs FROM (SELECT * FROM ours EXCEPT SELECT * FROM theirs) GROUP BY doc_id
)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reached WHERE a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links, base_id,
  CASE WHEN base_id IS NOT NULL THEN coalesce(x.n, 0) END AS n_only_base, CASE WHEN base_id IS NOT NULL THEN coalesce(y.n, 0) END AS n_only_doc,
  CASE WHEN base_id IS NOT NULL THEN coalesce(x.hs, '') END AS only_base, CASE WHEN base_id IS NOT NULL THEN coalesce(y.hs, '') END AS only_doc
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN bases USING (doc_id) LEFT JOIN only_base x USING (doc_id) LEFT JOIN only_doc y USING (doc_id)
""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS (
  SELECT doc_a, doc_b FROM shared JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b WHERE k >= 0.5 * (x.n + y.n - k)
), links AS (
  SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reached WHERE a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
""",
}
