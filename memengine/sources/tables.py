"""Schemas, and the memory tables that are derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.config import DAY_MS, HOUR_MS, TYPES
from memengine.functions import scoring, text

#: 2024-02-01T00:00:00Z, the moment at which derived queries run.
NOW_MS = 1_706_745_600_000
BIRTH_MS = 1_704_067_200_000

MEMORY_SCHEMA = """
    id string, content string, types array<string>, status string, created_at bigint, updated_at bigint, valid_from bigint, valid_to bigint,
    base_strength double, current_strength double, pinned boolean, mention_count bigint, last_accessed_at bigint, cluster_id string,
    entities array<string>, source_conversation_ids array<string>, superseded_by string, superseded_at bigint, faded_at bigint, deleted_at bigint,
    conflict_domain string, embedding array<float>
"""
EDGE_SCHEMA = "id string, source_memory_id string, target_memory_id string, similarity double, created_at bigint"
EPISODE_SCHEMA = "id string, summary string, start_memory_id string, end_memory_id string, created_at bigint"
CLUSTER_SCHEMA = "id string, embedding array<double>, memory_ids array<string>, created_at bigint"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_memories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MEMORY_SCHEMA)


def key(n: Column) -> Column:
    return F.concat(F.lit("m"), F.lpad(n.cast("string"), 9, "0"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts_ms, event_id): one row for each access of a memory."""
    e = read(spark, sf_dir, "events")
    return e.select(key(F.col("user_id")).alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory table derived from embeddings, documents and events."""
    e = read(spark, sf_dir, "embeddings")
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = d.agg(F.count(F.lit(1)).alias("n_docs"))
    seen = accesses(spark, sf_dir).groupBy("id").agg(F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("accesses"))
    v, label = F.col("vec_id"), F.col("label")
    kinds = F.array(*(F.lit(t) for t in TYPES))
    created = F.lit(BIRTH_MS) + (v % 700) * HOUR_MS - F.when(v % 7 == 0, F.lit(200 * DAY_MS)).otherwise(F.lit(0))
    base = e.crossJoin(F.broadcast(n)).withColumn("doc_id", v % F.col("n_docs")).join(d, "doc_id").withColumn("id", key(v)).withColumn("created_at", created.cast("long"))
    base = base.join(seen, "id", "left")
    types = F.array(F.get(kinds, (label % 8).cast("int")), F.get(kinds, ((label + v) % 8).cast("int")))
    status = F.when(v % 20 == 0, "faded").when(v % 20 == 1, "archived").when(v % 20 == 2, "superseded").otherwise("active")
    out = base.select(
        "id",
        v.alias("seq"),
        F.col("text").alias("content"),
        types.alias("types"),
        status.alias("status"),
        "created_at",
        (F.col("created_at") + (v % 11) * DAY_MS).cast("long").alias("updated_at"),
        F.col("created_at").alias("valid_from"),
        F.when(v % 13 == 0, F.col("created_at") + 30 * DAY_MS).cast("long").alias("valid_to"),
        (F.lit(1.0) + (v % 5) * F.lit(0.5)).alias("base_strength"),
        ((v * 37 % 100) / F.lit(100.0)).alias("current_strength"),
        (v % 17 == 0).alias("pinned"),
        F.coalesce("accesses", F.lit(0)).cast("long").alias("mention_count"),
        F.coalesce("last_ms", "created_at").cast("long").alias("last_accessed_at"),
        F.when(v % 23 != 0, F.concat(F.lit("cluster-"), label.cast("string"))).alias("cluster_id"),
        F.array(*(F.concat(F.lit(f"e{k}_"), (v % k).cast("string")) for k in (3, 4, 5))).alias("entities"),
        F.array(F.concat(F.lit("c"), (v % 40).cast("string"))).alias("source_conversation_ids"),
        F.when(v % 20 == 2, key(v + 1)).alias("superseded_by"),
        F.when(v % 20 == 2, F.lit(NOW_MS) - (v % 60) * DAY_MS).cast("long").alias("superseded_at"),
        F.when(v % 20 == 0, F.lit(NOW_MS) - (v % 60) * DAY_MS).cast("long").alias("faded_at"),
        F.lit(None).cast("long").alias("deleted_at"),
        "embedding",
        label.alias("label"),
    )
    return out.withColumn("conflict_domain", scoring.domain(F.col("types")))


def canonical(mem: DataFrame) -> DataFrame:
    """memories with scope (their first conversation), predicate, object, bucket and canonical key."""
    out = mem.withColumn("predicate", text.predicate(F.col("types")))
    out = out.withColumn("object", F.array_join(F.array_sort("entities"), "+")).withColumn("bucket", text.temporal_bucket(F.col("content")))
    out = out.withColumn("scope", F.get("source_conversation_ids", F.lit(0)))
    return out.withColumn("canonical_key", text.canonical_key(F.col("scope"), F.lit("user"), F.col("predicate"), F.col("object"), F.col("bucket")))


CITIES = ["Lisbon", "Denver", "Oslo", "Kyoto", "Lyon", "Quito", "Perth", "Riga", "Cairo", "Turin", "Leeds", "Accra", "Bern"]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores, where they come in fewer parts; work that multiplies them would else run in a few tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, pos, text): templated sentences of each customer, for the learning operators."""
    return utterances_of(dealt(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey"))


def utterances_of(customers: DataFrame) -> DataFrame:
    """The same from any frame of customers, batch or stream."""
    c = customers.select("c_custkey", "c_nationkey")
    cities = F.array(*(F.lit(x) for x in CITIES))
    a = F.get(cities, (F.col("c_nationkey") % len(CITIES)).cast("int"))
    b = F.get(cities, ((F.col("c_nationkey") + 5) % len(CITIES)).cast("int"))
    said = F.array(
        F.concat(F.lit("I live in "), a, F.lit(".")),
        F.concat(F.lit("I used to live in "), a, F.lit(" but now I live in "), b, F.lit(".")),
        F.concat(F.lit("I prefer tea over coffee no "), (F.col("c_custkey") % 3).cast("string"), F.lit(".")),
        F.concat(F.lit("My name is Customer"), F.col("c_custkey").cast("string"), F.lit(".")),
        F.lit("thanks thanks thanks thanks"),
    )
    return c.select(F.col("c_custkey").alias("conv_id"), F.posexplode(said).alias("pos", "text"))


# Sentences for each rule pack, with a number or a city in place of {n} and {c}.
SAYINGS = {
    "identity": ["I'm {n} years old.", "My pronouns are they/them.", "My native language is german."],
    "contact": ["My email is user{n}@example.com.", "My address is {n} Main Street.", "You can call me at (415) 628-12{n}."],
    "education": ["I earned a BS in computer science from {c} University.", "I'm currently studying law at {c} College."],
    "health": ["I'm allergic to penicillin.", "I have diabetes and I take metformin daily.", "My heart rate was 8{n}."],
    "relational": ["My wife's name is Parastoo.", "John Smith is my colleague.", "I have 3 kids."],
    "places": ["I live in {c}.", "I moved to {c} last year."],
    "jobs": ["I work at Company{n}.", "I work as a software engineer."],
    "numbers": ["It costs $ {n}.50 or 1,2{n} in total, 7% off."],
    "preferences": ["I prefer tea over coffee no {n}.", "My favorite color is green."],
    "temporal": ["My event is on January 15, 2024 at 3:30pm.", "We met on 2023-11-{n}."],
    "routines": ["I drink coffee every morning.", "I wake up at 7am."],
    "negation": ["I don't eat peanuts, but actually I like almonds.", "I never smoke."],
    "names": ["My name is Customer{n}.", "You can call me Alex."],
}


def sayings(spark: SparkSession, sf_dir: str, pack: str | None = None) -> DataFrame:
    """(conv_id, pos, text): each customer says the sentences of a rule pack, or those of all."""
    c = dealt(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    city = F.get(F.array(*(F.lit(x) for x in CITIES)), (F.col("c_nationkey") % len(CITIES)).cast("int"))
    number = (F.lit(20) + F.col("c_custkey") % 9).cast("string")
    texts = [t for name, some in SAYINGS.items() if pack in (None, name) for t in some]
    said = F.array(*(F.replace(F.replace(F.lit(t), F.lit("{n}"), number), F.lit("{c}"), city) for t in texts))
    return c.select(F.col("c_custkey").alias("conv_id"), F.posexplode(said).alias("pos", "text"))
