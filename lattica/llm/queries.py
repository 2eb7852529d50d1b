"""The queries of this subpackage: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import quality

    return quality.measures(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), g AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2, w3, w4) AS n FROM g WHERE w4 IS NOT NULL
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(5) t(k) WHERE n > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), q AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), v AS (
  SELECT doc_id, i, w, lower(rtrim(w, ',.')) AS p, lag(lower(rtrim(w, ',.'))) OVER (PARTITION BY doc_id ORDER BY i) AS before,
         upper(w) = w AND lower(w) <> w AND length(w) > 1 AS loud FROM w
), u AS (
  SELECT doc_id, count(*) FILTER (p = before) AS n_runs, count(*) FILTER (loud) AS n_upper FROM v GROUP BY doc_id
), f AS (
  SELECT doc_id, max(n) AS top FROM (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_runs, 0) AS n_runs, coalesce(n_upper, 0) AS n_upper, coalesce(top, 0) AS top
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN f USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 2 * n_upper > n_words OR 5 * n_runs > n_words OR 10 * top > 4 * n_words) AS kept
FROM b
"""


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import toxicity

    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import embdedup

    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op8_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), r(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.v) AS component_id, e.vec_id = min(r.v) AS kept
FROM embeddings e JOIN r ON r.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id GROUP BY e.vec_id
"""


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import lm

    return lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import rlindex

    return rlindex.digests(table(spark, sf_dir, "documents"))


@query
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import chat

    return chat.conversations(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op10_chat_formatting"] = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM conversations
), l AS (
  SELECT r, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), k AS (
  SELECT r, conv_id, turn, k, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         trim(lower(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '[ \t\x0B\f\r]+', ' ', 'g'))) AS plain FROM l
), c AS (
  SELECT *, level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY k) AS new FROM k
), b AS (
  SELECT *, count(*) FILTER (new) OVER (PARTITION BY r ORDER BY k) AS run FROM c
), p AS (
  SELECT r, conv_id, turn, run, level, string_agg(plain, chr(10) ORDER BY k) AS passage, count(*) AS n FROM b WHERE plain <> '' GROUP BY r, conv_id, turn, run, level
), whole AS (
  SELECT conv_id, level + 1 AS level, passage, min(turn) AS source FROM p GROUP BY ALL
), said AS (
  SELECT conv_id, plain, min(turn) AS source FROM b WHERE level = 0 AND plain <> '' GROUP BY conv_id, plain
), t AS (
  SELECT p.*, w.source FROM p LEFT JOIN whole w ON w.conv_id = p.conv_id AND w.level = p.level AND w.passage = p.passage AND w.source < p.turn WHERE p.level > 0
), f AS (
  SELECT conv_id, turn, level, source, sum(n) AS n FROM (
    SELECT conv_id, turn, level, source, n FROM t WHERE source IS NOT NULL
    UNION ALL
    SELECT b.conv_id, b.turn, b.level, s.source, 1 FROM t JOIN b ON b.r = t.r AND b.run = t.run JOIN said s ON s.conv_id = b.conv_id AND s.plain = b.plain WHERE t.source IS NULL AND b.plain <> '' AND s.source < b.turn
  ) GROUP BY ALL
), links AS (
  SELECT conv_id, turn, source AS reply_to FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1
), up(conv_id, turn, thread) AS (
  SELECT conv_id, turn, reply_to FROM links UNION ALL SELECT u.conv_id, u.turn, k.reply_to FROM up u JOIN links k ON k.conv_id = u.conv_id AND k.turn = u.thread
), roots AS (SELECT conv_id, turn, min(thread) AS thread FROM up GROUP BY conv_id, turn)
SELECT m.conv_id, CASE WHEN m.conv_id IS NOT NULL THEN row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(r.thread, m.turn), m.turn, m.role) - 1 END AS position,
       m.turn, m.role, array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)) AS text,
       CAST(coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '^(?:[ \t]*>)+'))), 0) AS BIGINT) AS n_quoted, k.reply_to, coalesce(r.thread, m.turn) AS thread
FROM m LEFT JOIN links k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn
"""
