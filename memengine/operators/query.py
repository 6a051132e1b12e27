"""Listing, search, grouping and statistics over the memory table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memengine.config import DEFAULT, Config
from memengine.functions import scoring
from memengine.functions.checkpoint import cut

ORDERS = {"recent": "last_accessed_at", "strength": "current_strength", "created": "created_at"}


def filtered(
    mem: DataFrame,
    types_any: Sequence[str] | None = None,
    strength: tuple[float, float] | None = None,
    pinned: bool | None = None,
    cluster: str | None = None,
    conversation: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Conditions are and-ed; strength is the current one, both ends included."""
    if types_any is not None:
        mem = mem.filter(F.arrays_overlap("types", F.array(*(F.lit(t) for t in types_any))))
    if strength is not None:
        mem = mem.filter(F.col("current_strength").between(*strength))
    if pinned is not None:
        mem = mem.filter(F.col("pinned") == pinned)
    if cluster is not None:
        mem = mem.filter(F.col("cluster_id") == cluster)
    if conversation is not None:
        mem = mem.filter(F.array_contains("source_conversation_ids", conversation))
    if status is not None:
        mem = mem.filter(F.col("status") == status)
    return mem


def ordered(mem: DataFrame, by: str = "recent", raw: bool = False) -> DataFrame:
    """Rows by one of ``ORDERS``, or (raw) by a column, the largest first."""
    return mem.orderBy(F.desc(by if raw else ORDERS[by]), "id")


def places(mem: DataFrame, by: str = "recent") -> DataFrame:
    """(id, place) of every row in the order of the list, however many there are.

    Rows are sorted over ranges; a place is the rank within the range and the rows of all ranges before, of
    which only the counts, one a range, come together.
    """
    rows = cut(ordered(mem.select("id", F.col(ORDERS[by]).alias("__o")), "__o", raw=True).withColumn("__part", F.spark_partition_id()))
    before = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("__o"), "id"))
    return rows.withColumn("__rank", rank).join(F.broadcast(before), "__part").select("id", (F.col("__rank") + F.col("__before")).cast("long").alias("place"))


def page(mem: DataFrame, by: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page with its place, and on each row the total and whether more follows."""
    total = mem.agg(F.count(F.lit(1)).alias("total"))
    # The cut runs as a top-(offset + limit); ranks are given to that many rows only.
    top = ordered(mem, by).limit(offset + limit)
    place = F.row_number().over(Window.orderBy(F.desc(ORDERS[by]), "id"))
    rows = top.withColumn("place", place).filter(F.col("place") > offset)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def contains(text: Column, query: str, mode: str = "exact", case_sensitive: bool = False) -> Column:
    """Substring search: the whole query, all of its terms, or any of them; an empty query finds all."""
    subject = text if case_sensitive else F.lower(text)
    wanted = query if case_sensitive else query.lower()
    terms = [wanted] if mode == "exact" else wanted.split() or [""]
    hits = [subject.contains(t) for t in terms]
    out = hits[0]
    for h in hits[1:]:
        out = (out & h) if mode == "and" else (out | h)
    return out


def recent(mem: DataFrame, n: int = 50) -> DataFrame:
    return ordered(mem.filter("status = 'active'"), "recent").limit(n)


def strongest(mem: DataFrame, n: int = 50) -> DataFrame:
    return ordered(mem.filter("status = 'active' and current_strength >= 0.5"), "strength").limit(n)


def pinned_first(mem: DataFrame, n: int = 100) -> DataFrame:
    return ordered(mem.filter("pinned"), "recent").limit(n)


def timeline(mem: DataFrame, unit: str = "day", limit: int | None = None) -> DataFrame:
    """(period, n, place, id): the rows of each period of creation in list order, and how many it has.

    A row for each memory: no period's rows come together in a list.
    """
    rows = mem if limit is None else ordered(mem, "recent").limit(limit)
    period = F.to_date(F.date_trunc(unit, F.timestamp_millis("created_at"))).cast("string")
    return _in_groups(rows.select(period.alias("period"), "id", "last_accessed_at"), "period")


def grouped_by_type(mem: DataFrame, limit: int | None = None) -> DataFrame:
    """(kind, n, place, id): the rows of each type in list order, and how many it has."""
    rows = mem if limit is None else ordered(mem, "recent").limit(limit)
    return _in_groups(rows.select(F.explode("types").alias("kind"), "id", "last_accessed_at"), "kind")


def _in_groups(rows: DataFrame, key: str) -> DataFrame:
    # The count is an aggregate of its own, combined before the shuffle: a window over a whole group would hold it.
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("last_accessed_at"), "id"))
    return rows.withColumn("place", place).join(counts, key).select(key, "n", "place", "id")


def count(mem: DataFrame, min_base: float | None = None, **conditions) -> DataFrame:
    out = filtered(mem, **conditions)
    if min_base is not None:
        out = out.filter(F.col("base_strength") >= min_base)
    return out.agg(F.count(F.lit(1)).alias("n"))


def by_status(mem: DataFrame) -> DataFrame:
    return mem.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stats(mem: DataFrame) -> DataFrame:
    return mem.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "faded").alias("faded"),
        F.count_if(F.col("pinned")).alias("pinned"),
        F.coalesce(F.avg("current_strength"), F.lit(0.0)).alias("avg_strength"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def token_sum(turns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(conv_id, used_tokens, available_tokens)."""
    used = F.sum(scoring.tokens(F.coalesce("text", F.lit("")), cfg)) + F.count(F.lit(1)) * cfg.message_overhead
    out = turns.groupBy("conv_id").agg(used.cast("long").alias("used_tokens"))
    return out.withColumn("available_tokens", F.greatest(F.lit(0), F.lit(cfg.context_tokens - cfg.response_reserve) - F.col("used_tokens")).cast("long"))


def best_per_key(rows: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score of each key, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def ratios(checks: DataFrame, passed: str) -> DataFrame:
    """(metric, ratio): passed over all, 1 where nothing was checked."""
    out = checks.groupBy("metric").agg(F.count_if(F.col(passed)).alias("ok"), F.count(passed).alias("n"))
    return out.select("metric", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("ok") / F.col("n")).alias("ratio"))


def cache_stats(log: DataFrame) -> DataFrame:
    """Hits of an unbounded cache over an access log (key): every access but the first of a key."""
    per = log.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("lookups"), (F.sum("n") - F.count(F.lit(1))).alias("hits")).withColumn(
        "hit_rate", F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups")).otherwise(F.lit(0.0))
    )
