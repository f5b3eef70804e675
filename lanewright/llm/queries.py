"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lanewright.llm import chat, decontaminate, html, language, merkle, neardup, packing, quality, repeats, secrets


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_read(spark, sf_dir, "pages"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_main_text": op1_main_text,
        "op2_fingerprint": op2_fingerprint,
        "op3_decontaminate": op3_decontaminate,
        "op4_packing": op4_packing,
        "op5_secrets": op5_secrets,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_quality": op7_quality,
        "op8_near_dedup": op8_near_dedup,
        "op9_language": op9_language,
        "op10_chat": op10_chat,
    }


OP10_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS l FROM t GROUP BY conv_id
), s AS (
  SELECT conv_id, (pos - 1) // 1024 AS segment,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>', chr(10) ORDER BY pos) AS body
  FROM t GROUP BY ALL
), u AS (
  SELECT l, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l, n_turns
)
SELECT u.conv_id, n_turns, n_copies, CAST(segment AS BIGINT) AS segment, body AS text
FROM u JOIN s ON s.conv_id IS NOT DISTINCT FROM u.conv_id
WHERE NOT EXISTS (SELECT 1 FROM u AS b WHERE b.n_turns > u.n_turns AND list_slice(b.l, 1, u.n_turns) = u.l)
"""


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {"op10_chat": OP10_SQL}
