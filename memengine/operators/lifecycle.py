"""Decay, sweeps, reinforcement, supersession, lineage, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memengine.config import DAY_MS, DEFAULT, Config
from memengine.functions import scoring, text, vectors
from memengine.functions.checkpoint import cut as _cut


def decay(mem: DataFrame, now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    new = scoring.decayed(F.col("base_strength"), F.col("types"), F.col("pinned"), F.col("last_accessed_at"), F.col("created_at"), now_ms, cfg)
    return mem.withColumn("current_strength", new)


def sweep(mem: DataFrame, now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """All rows decay; weak active ones fade; those that faded long ago go. One pass over the table."""
    out = decay(mem, now_ms, cfg)
    fades = (F.col("status") == "active") & (F.col("current_strength") < cfg.fade_below) & ~F.col("pinned")
    out = out.withColumn("faded_at", F.when(fades, F.lit(now_ms)).otherwise(F.col("faded_at")))
    out = out.withColumn("status", F.when(fades, F.lit("faded")).otherwise(F.col("status")))
    gone = (F.col("status") == "faded") & (F.col("faded_at") < now_ms - cfg.faded_days * DAY_MS)
    return out.filter(~F.coalesce(gone, F.lit(False)))


def debounce(accesses: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, window_ms): one row for all accesses of a memory in a window."""
    return accesses.select("id", (F.floor(F.col("ts_ms") / cfg.debounce_ms) * cfg.debounce_ms).cast("long").alias("window_ms")).distinct()


def reinforce(mem: DataFrame, accesses: DataFrame, now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """Each memory with an access gains its type's amount once; a gain past the maximum is dropped."""
    hit = accesses.select("id").distinct().withColumn("__hit", F.lit(True))
    joined = mem.join(hit, "id", "left")
    amount = F.coalesce(F.try_element_at(scoring.literal_map(cfg.reinforce), F.get("types", F.lit(0))), F.lit(cfg.default_reinforce))
    does = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("base_strength") + amount <= cfg.max_base)
    return joined.withColumns(
        {
            "base_strength": F.when(does, F.col("base_strength") + amount).otherwise(F.col("base_strength")),
            "mention_count": F.col("mention_count") + F.when(does, 1).otherwise(0),
            "last_accessed_at": F.when(does, F.lit(now_ms)).otherwise(F.col("last_accessed_at")),
        }
    ).select(*mem.columns)


def supersede(mem: DataFrame, links: DataFrame, now_ms: int) -> DataFrame:
    """links (old_id, new_id, temporal): the old row points to the new one; with a temporal marker validity follows."""
    old = links.select(F.col("old_id").alias("id"), F.col("new_id").alias("__new"), F.col("temporal").alias("__t"))
    fresh = links.filter("temporal").select(F.col("new_id").alias("id"), F.lit(True).alias("__fresh")).distinct()
    j = mem.join(old, "id", "left").join(fresh, "id", "left")
    hit = F.col("__new").isNotNull()
    return j.withColumns(
        {
            "status": F.when(hit, F.lit("superseded")).otherwise(F.col("status")),
            "superseded_by": F.coalesce("__new", "superseded_by"),
            "superseded_at": F.when(hit, F.lit(now_ms)).otherwise(F.col("superseded_at")),
            "valid_to": F.when(hit & F.col("__t"), F.lit(now_ms)).otherwise(F.col("valid_to")),
            "valid_from": F.when(F.col("__fresh"), F.lit(now_ms)).otherwise(F.col("valid_from")),
        }
    ).select(*mem.columns)


def tombstone(mem: DataFrame, now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """Rows superseded long ago lose content, vector and strength; the hash of the content stays."""
    old = (F.col("status") == "superseded") & (F.col("superseded_at") < now_ms - cfg.superseded_days * DAY_MS) & F.col("deleted_at").isNull()
    old = F.coalesce(old, F.lit(False))
    out = mem.withColumn("content_hash", F.when(old, text.content_hash(F.col("content"))))
    return out.withColumns(
        {
            "content": F.when(old, F.lit("")).otherwise(F.col("content")),
            "embedding": F.when(~old, F.col("embedding")),
            "base_strength": F.when(old, F.lit(0.0)).otherwise(F.col("base_strength")),
            "current_strength": F.when(old, F.lit(0.0)).otherwise(F.col("current_strength")),
            "deleted_at": F.when(old, F.lit(now_ms)).otherwise(F.col("deleted_at")),
        }
    )


def lineage(mem: DataFrame) -> DataFrame:
    """(id, last_id, hops): where the chain of superseded_by ends, however long; pointers double each round.

    A chain that meets a row that is not there ends at the last row that is. One that runs into a cycle has no
    end: its last_id is the smallest id of the cycle, and hops is null.
    """
    known = mem.select(F.col("id").alias("next_id"))
    edge = mem.select("id", F.col("superseded_by").alias("next_id")).join(known, "next_id", "left_semi")
    at = mem.select("id").join(edge, "id", "left")
    moves = F.when(F.col("next_id").isNull(), 0).otherwise(1).cast("long")
    # low: the smallest id on the way.
    at = _cut(at.select("id", F.coalesce("next_id", "id").alias("last_id"), moves.alias("hops"), F.col("id").alias("low")))
    rows, reach = at.count(), 1
    going = F.col("hops") == reach
    while reach <= rows and at.filter(going).take(1):
        step = at.select(F.col("id").alias("last_id"), F.col("last_id").alias("to_id"), F.col("hops").alias("more"), F.col("low").alias("lower"))
        far = at.filter(going).join(step, "last_id").select("id", F.col("to_id").alias("last_id"), (F.col("hops") + F.col("more")).alias("hops"), F.least("low", "lower").alias("low"))
        at = _cut(at.filter(~going).unionByName(far))
        reach *= 2
        going = F.col("hops") == reach
    # More hops than rows: only pointers on cycles go that far, and they have seen the whole cycle.
    endless = at.filter(F.col("hops") > rows)
    ends = at.filter(F.col("hops") <= rows).select("id", "last_id", F.col("hops").cast("int").alias("hops"))
    lows = endless.select(F.col("id").alias("last_id"), F.col("low").alias("least_id"))
    return ends.unionByName(endless.join(lows, "last_id").select("id", F.col("least_id").alias("last_id"), F.lit(None).cast("int").alias("hops")))


# --------------------------------------------------------------------------- clusters


def assign(points: DataFrame, centroids: list[tuple[str, list[float]]]) -> DataFrame:
    """points (id, embedding) with the nearest centroid, ties to the first; centroids are a few constants."""
    options = F.array(*(F.struct(vectors.euclidean(F.col("embedding"), vectors.literal(c)).alias("d"), F.lit(k).alias("k")) for k, (_, c) in enumerate(centroids)))
    names = F.array(*(F.lit(n) for n, _ in centroids))
    return points.withColumn("cluster_id", F.get(names, F.array_min(options)["k"]))


def centroids_of(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n, centroid): means by dimension, summed map-side."""
    long = assigned.select("cluster_id", F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = means.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c"), F.max("n").alias("n"))
    return out.select("cluster_id", "n", F.col("c.m").alias("centroid"))


def kmeans(mem: DataFrame, seed: int = 7, cfg: Config = DEFAULT) -> DataFrame:
    """(id, cluster_id) by Lloyd's steps from a seeded k-means++ start; fewer rows than k: no rows.

    Only k centroids are on the driver. Empty clusters become the zero vector.
    """
    points = mem.filter("status = 'active' and embedding is not null").select("id", "embedding").persist()
    try:
        k = cfg.clusters
        if points.limit(k).count() < k:
            return points.select("id", F.lit(None).cast("string").alias("cluster_id")).limit(0)
        first = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").first()
        chosen = [list(map(float, first["embedding"]))]
        for step in range(1, k):
            gap = F.array_min(F.array(*(vectors.euclidean(F.col("embedding"), vectors.literal(c)) for c in chosen)))
            # Weighted choice without a running sum: the largest u^(1/w) wins.
            u = (F.pmod(F.xxhash64(F.lit(seed + step), "id"), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
            row = points.withColumn("w", gap * gap).filter("w > 0").orderBy(F.desc(F.log(u) / F.col("w")), "id").first()
            chosen.append(list(map(float, row["embedding"])) if row else [0.0] * len(chosen[0]))
        names = [f"cluster-{i}" for i in range(k)]
        for _ in range(cfg.max_iterations):
            found = {r["cluster_id"]: r["centroid"] for r in centroids_of(assign(points, list(zip(names, chosen)))).collect()}
            new = [found.get(n, [0.0] * len(chosen[0])) for n in names]
            shift = max(sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5 for x, y in zip(new, chosen))
            chosen = new
            if shift <= cfg.epsilon:
                break
        return _cut(assign(points, list(zip(names, chosen))).select("id", "cluster_id"))
    finally:
        points.unpersist()


def similarity_edges(mem: DataFrame, least: float = 0.7) -> DataFrame:
    """(source, target, similarity) of active rows of one cluster at more than ``least``, each pair once."""
    rows = mem.filter("status = 'active' and cluster_id is not null").select("id", "embedding", "cluster_id")
    found = vectors.nearest_of_each(rows, rows, None, least, "cluster_id")
    return found.filter((F.col("new_id") < F.col("id")) & (F.col("similarity") > least)).select(F.col("new_id").alias("source"), F.col("id").alias("target"), "similarity")


def successors(mem: DataFrame) -> DataFrame:
    """(id, next_id, next_status): one step of each supersession chain, to rows that are there."""
    after = mem.select(F.col("id").alias("next_id"), F.col("status").alias("next_status"))
    return mem.select("id", F.col("superseded_by").alias("next_id")).join(after, "next_id").select("id", "next_id", "next_status")


def lifecycle_stats(mem: DataFrame, accesses: DataFrame, now_ms: int, interval_ms: int = 3_600_000) -> DataFrame:
    pending = accesses.agg(F.countDistinct("id").alias("pending"))
    out = mem.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("active", "faded", "archived", "superseded")))
    return out.crossJoin(pending).withColumn("last_sweep", F.lit(now_ms)).withColumn("next_sweep", F.lit(now_ms + interval_ms))


def latest(mem: DataFrame, keys: list[str], by: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), "id")
    return mem.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def has_temporal(content: Column) -> Column:
    return text.has_marker(content)
