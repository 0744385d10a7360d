"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.components import connected_groups
from strandlake.llm.encode import encode_corpus
from strandlake.llm.leaks import find_leaks, remove_leaks
from strandlake.llm.packing import batch_totals, pack_sequences
from strandlake.llm.spam import find_spam_pages
from strandlake.llm.topn import current_top_hits
from strandlake.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_top_hits(table(spark, sf_dir, "hits"))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "seqindex"), table(spark, sf_dir, "emb_checkpoint"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence whole and once, no batch above its capacity."""
    return batch_totals(p2_batches(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(table(spark, sf_dir, "match_pairs"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, without the passages of the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_leaks(docs, table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spam_pages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_batches, p2_totals, p4_found, p6_ids, p7_found, p7_removed, p8_found)
}

SQL: dict[str, str] = {
    "p1_found": """
        WITH current AS (
          SELECT hit_id, qid, score, match_len FROM (
            SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC) AS n FROM hits) t WHERE n = 1),
        ranked AS (
          SELECT qid, hit_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, match_len DESC, hit_id) AS n
          FROM current WHERE qid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))
        SELECT qid, hit_id FROM ranked WHERE n <= 10""",
    "p2_totals": """
        WITH last AS (
          SELECT run_index, job_id, greatest(coalesce(seqlens, length(seq), 0), 0) AS len,
            row_number() OVER (PARTITION BY run_index ORDER BY loaded_at DESC, job_id DESC, coalesce(seqlens, length(seq), 0) DESC) AS n
          FROM seqindex WHERE run_index IS NOT NULL AND job_id IS NOT NULL)
        SELECT job_id, count(*) AS sequences, CAST(sum(len) AS BIGINT) AS residues, CAST(0 AS BIGINT) AS overfull FROM last WHERE n = 1 GROUP BY job_id""",
    "p4_found": """
        WITH RECURSIVE raw AS (SELECT upper(trim(qid, ' ')) AS a, upper(trim(sid, ' ')) AS b FROM match_pairs),
        links AS (SELECT a, b FROM raw WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM raw WHERE a IS NOT NULL AND b IS NOT NULL),
        ids AS (SELECT a AS id FROM raw WHERE a IS NOT NULL UNION SELECT b FROM raw WHERE b IS NOT NULL),
        reach AS (SELECT id, id AS other FROM ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT id, min(other) AS group_id FROM reach GROUP BY id""",
    "p7_found": r"""
        WITH texts AS (
          SELECT 'd' AS kind, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'i', item_id, prompt FROM eval_items),
        words AS (
          SELECT kind, id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w FROM texts WHERE t IS NOT NULL),
        flat AS (SELECT kind, id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words),
        grams AS (
          SELECT kind, id, string_agg(word, ' ') OVER win AS g, count(*) OVER win AS n FROM flat
          WINDOW win AS (PARTITION BY kind, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
        SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' AND d.n = 12 AND i.n = 12""",
}
