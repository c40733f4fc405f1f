"""The operators as registered queries, and what SQL says of them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, bpe, chat, linededup, naming, neardup, packing, prefixtrie, quality, secrets, sql, urlgraph, vectorcodes, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(_table(spark, sf_dir, "documents"), min_chars=10)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.filter_urls(_table(spark, sf_dir, "pages"), urlgraph.rule_table(spark))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"), size=5, percent=85)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.shards_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))))),
    )
    return chat.chat_digest(told.unionByName(tricky))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_digest(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.best_fit_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, tokens=2048)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie_digest(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_line_dedup, op3_url_filter, op4_quality, op5_bpe, op6_secrets, op7_near_dedup, op8_token_files, op9_chat, op10_exact_dedup, op11_vector_codes, op12_best_fit, op13_prefix_trie)}


_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (
  SELECT keyed.doc_id, pos, line, owner IS NOT NULL AND owner <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_EXACT_DEDUP = r"""
WITH normed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
ranked AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
  FROM normed)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _LINE_DEDUP, "op10_exact_dedup": _EXACT_DEDUP, "op11_vector_codes": sql.vector_codes(), "op13_prefix_trie": sql.TRIE}
