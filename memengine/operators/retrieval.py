"""Vector retrieval, budgets, prompt blocks.

A single query is a constant in the plan: the scan is one pass with a bounded top-k, no join. Rankings
over the result are taken over at most k rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memengine.config import DEFAULT, Config
from memengine.functions import scoring, vectors


def scored(mem: DataFrame, query: Sequence[float], now_ms: int, session: Sequence[str] = (), composite: bool = True, cfg: Config = DEFAULT) -> DataFrame:
    """Active rows with semantic similarity and score, at the floor or above."""
    active = mem.filter("status = 'active'")
    out = active.withColumn("semantic", vectors.cosine(F.col("embedding"), vectors.literal(query)))
    in_session = F.col("id").isin(*session) if session else F.lit(False)
    total = scoring.composite(F.col("semantic"), F.col("last_accessed_at"), F.col("current_strength"), F.col("pinned"), in_session, now_ms, cfg)
    return out.withColumn("score", total if composite else F.col("semantic")).filter(F.col("score") >= cfg.floor)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    top = rows.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def vector_search(
    mem: DataFrame, query: Sequence[float], now_ms: int, k: int | None = None, session: Sequence[str] = (), composite: bool = True, cfg: Config = DEFAULT
) -> DataFrame:
    """Top k by composite score; rows in the cluster of the best one get a bonus and are ranked again."""
    return _ranked(lifted(mem, query, now_ms, session, composite, cfg), cfg.k if k is None else k)


def lifted(mem: DataFrame, query: Sequence[float], now_ms: int, session: Sequence[str] = (), composite: bool = True, cfg: Config = DEFAULT) -> DataFrame:
    """All rows at the floor or above, those in the cluster of the best one with its bonus; not ranked."""
    rows = scored(mem, query, now_ms, session, composite, cfg)
    best = rows.orderBy(F.desc("score"), "id").limit(1).select(F.col("id").alias("best_id"), F.col("cluster_id").alias("best_cluster"))
    near = rows.join(F.broadcast(best), (F.col("cluster_id") == F.col("best_cluster")) & (F.col("id") != F.col("best_id")), "left")
    bonus = F.when(F.col("best_id").isNotNull(), F.lit(cfg.cluster_bonus)).otherwise(F.lit(0.0))
    return near.withColumn("score", F.col("score") + bonus).drop("best_id", "best_cluster")


def semantic_search(mem: DataFrame, query: Sequence[float], now_ms: int, k: int = 50, composite: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    return vector_search(mem, query, now_ms, k, (), composite, cfg)


def lookup(hits: DataFrame, mem: DataFrame) -> DataFrame:
    """Rows of ranked hits (id, rank, score), in their order; hits without a row go."""
    found = mem.drop("embedding", "score", "rank", "semantic")
    return hits.select("id", "rank", "score").join(found, "id").orderBy("rank")


def top_k_per_domain(new: DataFrame, mem: DataFrame, k: int, least: float) -> DataFrame:
    """(new_id, id, similarity, rank): for each new row its k nearest active rows of the same domain."""
    return vectors.nearest_of_each(new, mem.filter("status = 'active'"), k, least, "conflict_domain")


def domain_pairs(new: DataFrame, mem: DataFrame, least: float) -> DataFrame:
    """(new_id, id, similarity): all active rows of a new row's domain that are as similar as ``least``."""
    return vectors.nearest_of_each(new, mem.filter("status = 'active'"), None, least, "conflict_domain").drop("rank")


def search_by_domain(mem: DataFrame, query: Sequence[float], domain: str, own_id: str | None, k: int, least: float) -> DataFrame:
    """(id, similarity): the k nearest active rows of one domain, a row of its own id apart."""
    rows = in_domain(mem, domain).filter(F.col("id") != own_id if own_id is not None else F.lit(True))
    found = rows.select("id", vectors.cosine(F.col("embedding"), vectors.literal(query)).alias("similarity"))
    return found.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


def in_domain(mem: DataFrame, domain: str) -> DataFrame:
    """Active rows of one conflict domain."""
    return mem.filter((F.col("status") == "active") & (F.col("conflict_domain") == domain))


def within_budget(ranked: DataFrame, budget: int, cfg: Config = DEFAULT) -> DataFrame:
    """Ranked rows (k at most) up to the first that would pass the token budget."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranked.withColumn("tokens", scoring.tokens(F.col("content"), cfg)).withColumn("running_tokens", F.sum("tokens").over(w))
    return rows.filter(F.col("running_tokens") <= budget)


def injection_preview(
    mem: DataFrame, query: Sequence[float], now_ms: int, available: int | None = None, max_tokens: int | None = None, cfg: Config = DEFAULT
) -> DataFrame:
    budget = max_tokens if max_tokens is not None else available if available is not None else cfg.no_history_budget
    return within_budget(vector_search(mem, query, now_ms, cfg.k, (), True, cfg), max(0, budget), cfg)


def confidence(strength: Column, pinned: Column) -> Column:
    level = F.when(strength >= 0.8, "high").when(strength >= 0.5, "medium").otherwise("low")
    return F.concat(level, F.when(pinned, F.lit(" (pinned)")).otherwise(F.lit("")))


# What stands around the memories in a prompt.
HEADER, FOOTER = "[Memory Context — what you know about this user]", "[End Memory Context]"


def format_block(rows: DataFrame) -> DataFrame:
    """(block): one text of all rows in rank order; empty without rows. The rows are a bounded preview."""
    line = F.concat(F.lit("- "), F.col("content"), F.lit(" (confidence: "), confidence(F.col("current_strength"), F.col("pinned")), F.lit(")"))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    out = rows.agg(lines.alias("l"))
    body = F.array_join(F.concat(F.array(F.lit(HEADER)), F.col("l.line"), F.array(F.lit(FOOTER))), "\n")
    return out.select(F.when(F.size("l") > 0, body).otherwise(F.lit("")).alias("block"))


def inject_system(turns: DataFrame, block: Column) -> DataFrame:
    """turns (conv_id, turn, role, text) with the block before the leading system turn, or as a turn of its own.

    An empty block changes nothing.
    """
    first = F.first("role").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    least = F.min("turn").over(Window.partitionBy("conv_id"))
    rows = turns.withColumn("__first", first).withColumn("__least", least)
    leads = (F.col("turn") == F.col("__least")) & (F.col("role") == "system") & (block != "")
    changed = rows.withColumn("text", F.when(leads, F.concat(block, F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    heads = rows.filter((F.col("turn") == F.col("__least")) & (F.col("__first") != "system") & (block != ""))
    added = heads.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("system").alias("role"), block.alias("text"))
    return changed.select("conv_id", "turn", "role", "text").unionByName(added)


def excluded(mem: DataFrame, injected: DataFrame, query: Sequence[float], now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """(id, reason) of active rows that were not injected: below the floor, or beyond the budget."""
    active = mem.filter("status = 'active'")
    at_floor = scored(mem, query, now_ms, cfg=cfg).select("id", F.lit(True).alias("at_floor"))
    rest = active.select("id").join(injected.select("id"), "id", "left_anti").join(at_floor, "id", "left")
    return rest.select("id", F.when(F.col("at_floor"), "token_budget").otherwise("below_floor").alias("reason"))


def novelty(mem: DataFrame, query: Sequence[float], now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """1 - similarity of the best composite hit; 1 without a hit."""
    best = vector_search(mem, query, now_ms, 1, (), True, cfg)
    return best.agg((F.lit(1.0) - F.coalesce(F.max("semantic"), F.lit(0.0))).alias("novelty"))


def augment(mem: DataFrame, turns: DataFrame, conv_id: int, query: Sequence[float], now_ms: int, cfg: Config = DEFAULT, max_tokens: int | None = None) -> DataFrame:
    """The turns of a conversation with the memories that fit its budget in front."""
    return augment_all(mem, turns.filter(F.col("conv_id") == conv_id), query, now_ms, cfg, max_tokens)


def augment_all(mem: DataFrame, turns: DataFrame, query: Sequence[float], now_ms: int, cfg: Config = DEFAULT, max_tokens: int | None = None) -> DataFrame:
    """The turns of every conversation with the memories in front that fit its own budget."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = vector_search(mem, query, now_ms, cfg.k, (), True, cfg).withColumn("running", F.sum(scoring.tokens(F.col("content"), cfg)).over(w))
    line = F.concat(F.lit("- "), F.col("content"), F.lit(" (confidence: "), confidence(F.col("current_strength"), F.col("pinned")), F.lit(")"))
    hits = hits.agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line"), "running"))).alias("__hits"))  # k at most
    mine = Window.partitionBy("conv_id")
    spent = F.sum(scoring.tokens(F.coalesce("text", F.lit("")), cfg)).over(mine) + cfg.message_overhead * F.count(F.lit(1)).over(mine)
    budget = F.lit(max(0, max_tokens)) if max_tokens is not None else F.greatest(F.lit(0), F.lit(cfg.context_tokens - cfg.response_reserve) - spent)
    rows = turns.withColumn("__budget", budget).withColumn("__lead", F.row_number().over(mine.orderBy("turn")) == 1).crossJoin(F.broadcast(hits))
    fit = F.transform(F.filter("__hits", lambda x: x["running"] <= F.col("__budget")), lambda x: x["line"])
    body = F.array_join(F.concat(F.array(F.lit(HEADER)), fit, F.array(F.lit(FOOTER))), "\n")
    rows = rows.withColumn("block", F.when(F.col("__lead") & (F.size(fit) > 0), body).otherwise(F.lit("")))
    told = F.when(F.col("__lead") & (F.col("role") == "system") & (F.col("block") != ""), F.concat("block", F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    new = rows.filter(F.col("__lead") & (F.col("role") != "system") & (F.col("block") != ""))
    new = new.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("system").alias("role"), F.col("block").alias("text"))
    return rows.select("conv_id", "turn", "role", told.alias("text")).unionByName(new)
