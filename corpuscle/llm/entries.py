"""Queries of the training-data operators, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import ann, exact, hmm, langid, mixing, packing, simhash, urlfilter, warc, windows

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op2_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 5, 1))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.passages(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


#: The rules of the URL filter.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).drop("listed")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_warc_index, op2_rotated_codes, op3_hidden_markov, op4_best_fit_packing, op5_simhash_near_dedup, op6_exact_dedup, op7_compact_windows, op8_language_id, op9_url_filter, op10_mixing)}


OP1_SQL = r"""
WITH u AS (
  SELECT *, split_part(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)://(.*)$', 1) ELSE coalesce(url, '') END, '#', 1) AS rest FROM pages
), p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^[^/?]*')), '.')), ',') || ')' || regexp_extract(rest, '(?s)^[^/?]*(.*)$', 1) AS url_key,
         strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
  FROM u
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, url_key, captured_at,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t
  FROM documents
), g AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY t) AS n,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, n AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""

OP9_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT u.*, CASE WHEN h IS NOT NULL THEN h || p END AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS place
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE place = 1
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN CAST(3 AS DOUBLE) WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(2 AS DOUBLE) * source_size AS cap FROM s
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, rank, source_size, least(cap, max(level) OVER () * weight) AS target,
         CASE (rank - 1) % 3 WHEN 0 THEN CAST(1.5 AS DOUBLE) WHEN 1 THEN 1 ELSE 0.5 END AS a,
         CASE (rank - 1) % 3 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN 1 ELSE 1.5 END AS z
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.*, d.h,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(greatest(0, ceil((target - (start + size / CAST(2 AS DOUBLE))) / source_size)) AS BIGINT) ELSE 0 END AS times FROM p
)
SELECT doc_id, size, source_size, target, times * size AS taken,
       CASE WHEN times > 0 THEN CASE WHEN a = z THEN start / target
            ELSE (sqrt(a * a + (z - a) * (a + z) * (start / target)) - a) / (z - a) END END AS first_position
FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_mixing": OP10_SQL}
