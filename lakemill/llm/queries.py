"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html, langid, media, minhash, mixing, repeats, tokens, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_read(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), parts=4, part=2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), parts=5, part=0)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), RULES)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_read(spark, sf_dir, "documents"))


QUERIES = {"op1_source_mix": op1_source_mix, "op2_minhash_near_dedup": op2_minhash_near_dedup, "op3_repeated_spans": op3_repeated_spans, "op4_token_output": op4_token_output, "op5_url_filter": op5_url_filter, "op6_toxicity": op6_toxicity, "op7_benchmark_leaks": op7_benchmark_leaks, "op8_language_id": op8_language_id, "op9_html_text": op9_html_text, "op10_media_archive": op10_media_archive}

OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS lim FROM s),
o AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(source_size) OVER () * 150 AS budget FROM w),
l AS (SELECT max(CAST(budget - stopped * 100 AS DOUBLE) / CAST(rest * 100 AS DOUBLE)) AS level FROM o
      WHERE CAST(budget - stopped * 100 AS DOUBLE) / CAST(rest * 100 AS DOUBLE) <= lim / weight),
t AS (SELECT source, source_size, CASE WHEN level * weight < lim THEN level * weight ELSE CAST(lim AS DOUBLE) END AS target FROM o, l),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (SELECT q.*, p.pass, CAST(upto + p.pass * source_size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) p(pass) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, key, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS run FROM turns),
k AS (SELECT doc_id, source, size, count(*) AS copies FROM r WHERE run <= (SELECT sum(size) * 150 // 100 FROM d) GROUP BY doc_id, source, size)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id AND q.source IS NOT DISTINCT FROM k.source AND q.size = k.size
"""

_NORMAL = """regexp_replace(host, '^www[.]', '') || regexp_replace(regexp_replace(path, '[.]html?$', ''), '/+$', '') ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""
OP5_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z_]*|ref|fbclid|gclid)='))) AS kept
  FROM pages),
r AS (SELECT *, CASE WHEN host = '' THEN NULL ELSE {_NORMAL} END AS node,
  CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM r),
k AS (SELECT node, min(own) AS spread FROM v WHERE node IS NOT NULL GROUP BY node)
SELECT page_id, host, path, rule, coalesce(own, spread, 'allow') AS verdict FROM v LEFT JOIN k USING (node)
"""  # no page of these tables declares a link, so components are the normal forms


ORACLES: dict[str, str] = {"op5_url_filter": OP5_SQL, "op1_source_mix": OP1_SQL}
