"""The training-data queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_dup, packing, quality_model, quality_rules, sharding, substring_dedup, token_counts, token_files, url_filter
from ._common import table, work_dir
from .encoders import vocabulary


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), work_dir(spark, "counts"), 512)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return token_files.read_token_files(spark, path, with_ids=False)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"), 40)


def op7_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op8_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("cleaned")


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_token_files, op3_url_filter, op4_compact_windows, op5_best_two_fit, op6_two_pass_shuffle, op7_forest_join,
        op8_line_first_rules, op9_benchmark_windows, op10_pairwise_quality,
    )
}

_PHRASES = "|".join(quality_rules.PHRASES)

SQL = {
    "op3_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
    "op8_line_first_rules": rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
ids AS (SELECT row_number() OVER () AS r, * FROM base),
grams AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM ids WHERE len(words) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams) WHERE n > 1),
rep AS (
  SELECT r, sum(least(3, i - last)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 3) AS last FROM twice) GROUP BY r),
line AS (SELECT r, k, lines[k] AS l FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS k FROM ids)),
told AS (
  SELECT r, k, l, NOT regexp_matches(l, '[^\x20\x09-\x0D]') AS blank,
         regexp_matches(l, '[^\x20\x09-\x0D]') AND (
           10 * (length(l) - length(translate(l, '#*$%&|<>', ''))) > length(l) OR NOT regexp_matches(l, '\p{{L}}')
           OR length(l) - length(replace(l, '|', '')) >= 3
           OR (NOT regexp_matches(l, '[.!?"'':;)]\s*\z') AND len(regexp_split_to_array(trim(l), '\s+')) <= 2)
           OR regexp_matches(lower(l), '{_PHRASES}')) AS bad
  FROM line),
sums AS (
  SELECT r, sum(length(l)) AS all_chars, count(*) FILTER (NOT blank) AS n, count(DISTINCT l) FILTER (NOT blank) AS d,
         count(DISTINCT l) FILTER (NOT blank AND NOT bad) AS good FROM told GROUP BY r),
lefts AS (SELECT r, sum(length(l)) AS left_chars FROM (SELECT DISTINCT r, l FROM told WHERE NOT bad) GROUP BY r),
stat AS (
  SELECT ids.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(sums.n - d AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(sums.n - good AS BIGINT) AS n_bad_lines, CAST(all_chars - coalesce(left_chars, 0) AS BIGINT) AS lost_chars, all_chars
  FROM (SELECT r, doc_id, t, words FROM ids) ids JOIN (SELECT r, all_chars, n, d, good FROM sums) sums USING (r)
  LEFT JOIN lefts USING (r) LEFT JOIN (SELECT r, n FROM rep) rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_chars <= all_chars AS kept,
       n_bad_lines, lost_chars
FROM stat
""",
    "op9_benchmark_windows": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
hit AS (
  SELECT r, i, g.k, item_id
  FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)) g
  JOIN win ON win.k = g.k AND win.g = g.g),
word AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(0, k)) AS j FROM hit) GROUP BY r),
item AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
""",
}
