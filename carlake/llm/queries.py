"""The operators as registered queries over their whole tables, and SQL for the results it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from carlake.llm import (
    bpe, decontaminate, jaccard, langid, quality, sharding, simhash, spelling, sql, substrings, toxicity, trie, urls, warc,
)

RANKS = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_read(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")  # which rule rejects first depends on measured times


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digest(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_read(spark, sf_dir, "documents"), spelling.planted_typos)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.borrowed_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_decontamination, op3_simhash, op4_toxicity, op5_substring_dedup, op6_language_id,
        op7_url_filters, op8_byte_bpe, op9_sharding, op10_warc, op11_spelling_variants,
        op12_jaccard_join, op13_conversation_trie,
    )
}

SPACE = r"\x20\x09-\x0D"
_WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')"
_LINES = rf"[x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^{SPACE}]')]"
_COUNT = "length(regexp_replace(coalesce(text, ''), '{}', '', 'g'))"

ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w, {_LINES} AS lines,
    {_COUNT.format(f"[{SPACE}]")} AS word_chars, length(text) - {_COUNT.format("[#*$%&|<>]")} AS n_symbols,
    {_COUNT.format(r"[^\p{L}]")} AS letters,
    length(text) - {_COUNT.format(r"[\x00-\x08\x0E-\x1F]")} AS controls
  FROM documents),
windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
words AS (SELECT r, max(n) AS top FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, letters, controls, length(text) AS n_chars,
    coalesce(top, 0) AS top
  FROM d LEFT JOIN covered USING (r) LEFT JOIN words USING (r)),
based AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > {quality.SYMBOLS_PER_WORD} * n_words OR 2 * n_dup_lines > n_lines
    OR word_chars > {quality.MAX_WORD_CHARS} * n_words OR 100 * letters < {quality.LETTER_PERCENT} * word_chars
    OR 100 * top > {quality.TOP_WORD_PERCENT} * n_words OR 100 * controls > {quality.CONTROL_PERCENT} * n_chars) AS kept
FROM based""",
    "op2_decontamination": r"""
WITH item AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
own AS (
  SELECT DISTINCT r, item_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s, least(5, len(w)) AS n
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sized AS (SELECT r, count(*) AS n_shingles FROM own GROUP BY r),
doc AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
held AS (
  SELECT DISTINCT d, doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT d, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM own))),
met AS (SELECT d, doc_id, r, item_id, count(*) AS n_shared FROM held JOIN own USING (s, n) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM met JOIN sized USING (r) WHERE n_shared * 10 >= n_shingles * 8""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f""",
    "op5_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
later AS (SELECT r, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY s)),
gone AS (SELECT DISTINCT r, i + k AS pos FROM later, (SELECT unnest(range(0, 50)) AS k)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op11_spelling_variants": sql.OP11,
    "op12_jaccard_join": sql.OP12,
    "op13_conversation_trie": sql.OP13,
}
