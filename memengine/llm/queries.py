"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.llm import cdc, chat, decontam, langid, licenses, pieces, quality, simhash, topk, toxicity
from memengine.llm._common import split_of

#: Model file of the tokenizer that op2 and the pipeline use.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.training_rows(docs))
    return found.select("doc_id", (split_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeated_spans(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, quality.training_rows(labels), quality.training_rows(docs))
    return scored.select("doc_id", (split_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, toxicity.training_rows(labels))
    return scored.select("doc_id", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


#: Both turns of conversation -1, which op9 formats besides those of the table.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))))
    more = spark.range(1).select(F.explode(roles).alias("x")).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("x.turn").cast("long").alias("turn"), "x.role", F.lit(CONTROL_TEXT).alias("text")
    )
    return chat.read_back(chat.format_chats(chats.unionByName(more)))


OP9_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, t.turn, t.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
    CAST(sum(
        length('<|im_start|>') + 1 + length('<|im_end|>') + 1
        + length(regexp_replace(replace(replace(role, chr(92), chr(92) || 's'), chr(10), chr(92) || 'n'), '<(~*)\|', '<\1~|', 'g'))
        + length(regexp_replace(text, '<(~*)\|', '<\1~|', 'g'))
    ) AS BIGINT) AS formatted_chars,
    true AS round_trip
FROM turns GROUP BY conv_id
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality": op3_quality,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_language_id": op5_language_id,
    "op7_toxicity": op7_toxicity,
    "op10_exact_top_k": op10_exact_top_k,
    "op8_license_scan": op8_license_scan,
    "op9_chat_formatting": op9_chat_formatting,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op9_chat_formatting": OP9_SQL,
    "op10_exact_top_k": OP10_SQL,
}
