"""The operators bound to the tables of a data folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, exact, html, mixing, nearest, ngram, suffix, toxicity, unigram, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels, keep_segments=False).select("doc_id", "held_out", "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.searched(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents"), keep_bytes=False)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.near_groups(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_source_mixing, op2_toxic_segments, op3_byte_bpe, op4_html_extraction, op5_warc_archives, op6_token_counts, op7_nearest_neighbours, op8_suffix_dedup, op9_ngram_join, op10_exact_dedup)
}

LINE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS turn
  FROM documents),
l AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev
  FROM c WINDOW w AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lev, full_at) FROM f WHERE lev <= full_at) * weight, cap)) AS target,
         floor(least(cap, coalesce((SELECT arg_min(lev, full_at) FROM f WHERE lev <= full_at) * weight, cap)) + 0.5)::BIGINT AS words
  FROM f)
"""

ORACLES: dict[str, str] = {
    "op1_source_mixing": LINE
    + """,
q AS (
  SELECT source, source_size, target, words // source_size AS laps, words % source_size AS rest, (source_size + 4095) // 4096 AS blocks,
         (words // source_size) * ((source_size + 4095) // 4096) + (words % source_size + 4095) // 4096 AS quota
  FROM t WHERE source_size > 0),
u AS (SELECT *, sum(quota) OVER (ORDER BY source NULLS LAST)::BIGINT AS upto, sum(quota) OVER ()::BIGINT AS n FROM q),
e AS (
  SELECT *, floor(((upto - quota) * 4294967296)::DOUBLE / n)::BIGINT AS lo, floor((upto * 4294967296)::DOUBLE / n)::BIGINT AS hi FROM u),
p AS (SELECT slot, (slot * 2654435769) % 4294967296 AS point FROM range((SELECT coalesce(max(n), 0)::BIGINT FROM u)) r(slot)),
g AS (
  SELECT source, quota, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM p JOIN e ON point >= lo AND point < hi),
r AS (SELECT source, n, unnest(range(quota::BIGINT)) AS rank FROM e),
h AS (
  SELECT r.source, r.rank, coalesce(g.slot, r.n + r.rank) AS slot
  FROM r LEFT JOIN g ON g.source IS NOT DISTINCT FROM r.source AND g.rank = r.rank),
b AS (
  SELECT h.source, h.slot, (h.rank % e.blocks) * 4096 AS first,
         least((h.rank % e.blocks + 1) * 4096, CASE WHEN h.rank // e.blocks < e.laps THEN e.source_size ELSE e.rest END) AS last
  FROM h JOIN e ON h.source IS NOT DISTINCT FROM e.source),
m AS (
  SELECT doc_id, l.source, turn, start, size, sum(least(start + size, last) - greatest(start, first)) AS taken, min(slot) AS first_slot
  FROM l JOIN b ON l.source IS NOT DISTINCT FROM b.source AND start < last AND start + size > first
  WHERE size > 0 GROUP BY ALL)
SELECT l.doc_id, l.size, t.source_size, t.target, coalesce(m.taken, 0)::BIGINT AS taken, m.first_slot::BIGINT AS first_slot
FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
LEFT JOIN m ON l.source IS NOT DISTINCT FROM m.source AND l.start = m.start AND l.size = m.size AND l.doc_id IS NOT DISTINCT FROM m.doc_id
""",
    "op5_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT h, max(page_id) AS keep, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN n > 1 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND keep <> page_id THEN keep END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (
  SELECT a AS doc_id, b AS other FROM l
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM r GROUP BY doc_id) USING (doc_id)
""",
    "op10_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""",
}
