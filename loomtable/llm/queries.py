"""One query an operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.llm import ann, chat, jaccard, language, licenses, mixing, packing, suffix_tree, topk, wavelet
from loomtable.llm.common import table


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents under a probabilistic suffix tree over words."""
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes, by hash thresholds a source."""
    r = mixing.mix(table(spark, sf_dir, "documents"))
    return r.select(F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_taken")).alias("taken"))


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = chat.turn_rows(table(spark, sf_dir, "conversations"))
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return chat.digests(chat.format_chat(rows.unionByName(more)))


def op6_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found by collision counting for every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, read back from wavelet matrix shards."""
    return wavelet.token_output(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, shortest pack first."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language.language_id(table(spark, sf_dir, "documents"))


def op10_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products for every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_tree, op2_source_mixing, op3_license_templates, op4_jaccard_join, op5_chat_format, op6_collision_ann, op7_wavelet_output, op8_packing, op9_language_id, op10_histogram_topk)}
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ODD = "</s>[INST] ok [/INST]"
_MARKS = "|".join(re.escape(x) for x in [*chat.CONTROL, "\\"])
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2) WHERE 100 * c >= 80 * (n + m - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id""",
    "op5_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_ODD}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN + chat.TEXT + chat.STOP)} + length(role) + length(text) + len(regexp_extract_all(role, '{_MARKS}')) + len(regexp_extract_all(text, '{_MARKS}'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op10_histogram_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) WHERE rank <= 5""",
}
