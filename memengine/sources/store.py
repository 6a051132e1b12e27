"""Scans, writes and exports of the memory table. Writes are new snapshots: a path is never overwritten while it is read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.config import DAY_MS, DEFAULT, Config
from memengine.functions import scoring

# --------------------------------------------------------------------------- scans


def scan(mem: DataFrame, status: str | None = None, kind: str | None = None, cluster: str | None = None, pinned: bool | None = None) -> DataFrame:
    """Rows by status, type, cluster and pin; each condition that is given holds."""
    for given, cond in (
        (status, F.col("status") == status),
        (kind, F.array_contains("types", kind) if kind else None),
        (cluster, F.col("cluster_id") == cluster),
        (pinned, F.col("pinned") == pinned),
    ):
        if given is not None:
            mem = mem.filter(cond)
    return mem


def by_id(mem: DataFrame, ident: str) -> DataFrame:
    return mem.filter(F.col("id") == ident).limit(1)


def exists(mem: DataFrame, ident: str) -> DataFrame:
    return mem.filter(F.col("id") == ident).agg((F.count(F.lit(1)) > 0).alias("found"))


def active_by_recency(mem: DataFrame, n: int, now_ms: int) -> DataFrame:
    fine = (F.col("status") == "active") & (F.col("last_accessed_at") >= 0) & (F.col("last_accessed_at") < now_ms)
    return mem.filter(fine).orderBy(F.desc("last_accessed_at"), "id").limit(n)


def by_mentions(mem: DataFrame, least: int, n: int) -> DataFrame:
    return mem.filter(F.col("mention_count") >= least).orderBy(F.desc("mention_count"), "id").limit(n)


def half_open(mem: DataFrame, column: str, low: float, high: float, status: str | None = None) -> DataFrame:
    out = mem.filter((F.col(column) >= low) & (F.col(column) < high))
    return out if status is None else out.filter(F.col("status") == status)


def expired(mem: DataFrame, now_ms: int) -> DataFrame:
    return mem.filter(F.col("valid_to") < now_ms)


def expired_superseded(mem: DataFrame, now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    old = F.col("superseded_at") < now_ms - cfg.superseded_days * DAY_MS
    return mem.filter((F.col("status") == "superseded") & old & F.col("deleted_at").isNull())


# --------------------------------------------------------------------------- writes


def create(mem: DataFrame, new: DataFrame) -> DataFrame:
    """Append; a key that is there already, or twice among the new rows, fails the write when it runs."""
    known = mem.select(F.col("id").alias("__id"), F.lit(True).alias("__known"))
    twice = new.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    checked = new.join(twice, "id").join(known, F.col("id") == F.col("__id"), "left")
    guard = F.when(F.col("__known") | (F.col("__n") > 1), F.raise_error(F.concat(F.lit("duplicate id "), F.col("id")))).otherwise(F.col("id"))
    return mem.unionByName(checked.withColumn("id", guard).select(*mem.columns))


def upsert(mem: DataFrame, rows: DataFrame) -> DataFrame:
    return mem.join(rows.select("id"), "id", "left_anti").unionByName(rows.select(*mem.columns))


def delete(mem: DataFrame, ids: DataFrame) -> DataFrame:
    return mem.join(ids.select("id"), "id", "left_anti")


def patch(mem: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the columns of ``changes`` (id and others) where it has a value for the id."""
    cols = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *(F.col(c).alias(f"__{c}") for c in cols))
    joined = mem.join(new, "id", "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in mem.columns))


def touch(mem: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    joined = mem.join(hit, "id", "left")
    return joined.withColumns(
        {
            "last_accessed_at": F.when(F.col("__hit"), F.lit(now_ms)).otherwise(F.col("last_accessed_at")),
            "mention_count": F.col("mention_count") + F.when(F.col("__hit"), 1).otherwise(0),
        }
    ).select(*mem.columns)


def set_where(mem: DataFrame, ids: DataFrame, now_ms: int, **values: Column) -> DataFrame:
    """update, pin, archive and the like: columns of the named rows, with updated_at = now."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    joined = mem.join(hit, "id", "left")
    new = values | {"updated_at": F.lit(now_ms)}
    return joined.select(*(F.when(F.col("__hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in mem.columns))


def pin(mem: DataFrame, ids: DataFrame, now_ms: int, pinned: bool = True) -> DataFrame:
    return set_where(mem, ids, now_ms, pinned=F.lit(pinned))


def archive(mem: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    return set_where(mem, ids, now_ms, status=F.lit("archived"))


def unarchive(mem: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    return set_where(mem, ids, now_ms, status=F.lit("active"))


def bulk_outcome(mem: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, succeeded) for each id that a bulk call names."""
    known = mem.select("id", F.lit(True).alias("k"))
    return ids.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("succeeded"))


def import_merge(mem: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged table, and one row (imported, skipped); ids that are there already win."""
    new = incoming.join(mem.select("id"), "id", "left_anti")
    known = incoming.join(mem.select(F.col("id"), F.lit(1).alias("k")), "id", "left")
    counts = known.agg(F.count_if(F.col("k").isNull()).alias("imported"), F.count("k").alias("skipped"))
    return mem.unionByName(new.select(*mem.columns)), counts


def import_replace(mem: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.select(*mem.columns)


def dto(mem: DataFrame) -> DataFrame:
    """Public rows: without the vector."""
    return mem.drop("embedding")


def new_memories(rows: DataFrame, now_ms: int) -> DataFrame:
    """Full rows with defaults from (id, content, types, embedding)."""
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "id", "content", "types", F.lit("active").alias("status"), F.lit(now_ms).alias("created_at"), F.lit(now_ms).alias("updated_at"),
        F.lit(now_ms).alias("valid_from"), null("bigint").alias("valid_to"), F.lit(1.0).alias("base_strength"), F.lit(1.0).alias("current_strength"),
        F.lit(False).alias("pinned"), F.lit(1).cast("bigint").alias("mention_count"), F.lit(now_ms).alias("last_accessed_at"), null("string").alias("cluster_id"),
        F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("source_conversation_ids"), null("string").alias("superseded_by"),
        null("bigint").alias("superseded_at"), null("bigint").alias("faded_at"), null("bigint").alias("deleted_at"), scoring.domain(F.col("types")).alias("conflict_domain"),
        "embedding",
    )


# --------------------------------------------------------------------------- export


def base64_vectors(mem: DataFrame) -> DataFrame:
    """memories with ``embedding_base64`` (little-endian 32-bit floats) in place of the vector."""
    keep = [c for c in mem.columns if c != "embedding"]
    fields = ", ".join(f"`{c}` {mem.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        for b in batches:
            col = b.column(len(keep))
            off = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False).astype("<f4")
            coded = [None if not col[i].is_valid else base64.b64encode(np.ascontiguousarray(flat[x:y]).tobytes()).decode() for i, (x, y) in enumerate(zip(off, off[1:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(coded, pa.string())], names=[*keep, "embedding_base64"])

    return mem.select(*keep, "embedding").mapInArrow(run, f"{fields}, embedding_base64 string")


def export_json(mem: DataFrame) -> DataFrame:
    """One JSON object a row (``value``), ready for df.write.text."""
    rows = base64_vectors(mem)
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("value"))


def export_markdown(mem: DataFrame) -> DataFrame:
    """One line a memory under its type, in order (``kind, ord, line``); sorted by the writer, not gathered."""
    lines = mem.select(F.explode("types").alias("kind"), "id", "content", "current_strength", "pinned")
    told = F.concat(F.lit("- "), F.col("content"), F.format_string(" (strength: %.2f)", "current_strength"), F.when(F.col("pinned"), F.lit(" (pinned)")).otherwise(F.lit("")))
    return lines.select("kind", F.col("id").alias("ord"), told.alias("line"))


def clear(spark: SparkSession, mem: DataFrame) -> DataFrame:
    return spark.createDataFrame([], mem.schema)


def error_kind(message: Column) -> Column:
    """quota, corruption, migration or unknown, by the words of a storage error."""
    low = F.lower(message)
    return F.when(low.contains("quota"), "quota").when(low.rlike("corrupt|invalid"), "corruption").when(low.rlike("version|migrat|upgrade"), "migration").otherwise("unknown")
