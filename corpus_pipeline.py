"""Cleaning pipeline over ``documents``: toxicity, near-dedup, substring dedup, decontamination, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame. Stages but the last return the columns of documents.
SQL can't express the stages, so there is no ORACLE_SQL; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.llm import cdc, decontam, pieces, simhash, toxicity
from memengine.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject. Rows with a null id are scored too."""
    labels = toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filter_toxic(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, of rows that share it the least by hash.

    Rows are told apart by a hash of all their columns, so rows that share an id, or have none, are judged
    each by its own text; of rows equal in every column one stays. Texts without a word share fingerprint 0,
    so one of them stays.
    """
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that came elsewhere before; n_chars follows. A text that loses all goes."""
    kept = cdc.remove_repeats(docs, changed_col="__changed")
    left = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    kept = kept.filter(~F.col("__changed") | left)
    size = F.when(F.col("__changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    both = pieces.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, decoded_col="decoded")
    return both.select(
        "doc_id",
        "lang",
        "source",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", to_tokens),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each cut off from the last by a checkpoint."""
    from memengine.llm._common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
