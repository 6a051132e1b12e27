"""Scores and rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memengine.config import DEFAULT, HOUR_MS, TYPES, Config


def age_hours(ts: Column, now_ms: int) -> Column:
    return (F.lit(now_ms) - ts) / F.lit(float(HOUR_MS))


def recency(last_ms: Column, now_ms: int, cfg: Config = DEFAULT) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * age_hours(last_ms, now_ms) / F.lit(cfg.half_life_h))


def composite(semantic: Column, last_ms: Column, strength: Column, pinned: Column, in_session: Column, now_ms: int, cfg: Config = DEFAULT) -> Column:
    return (
        F.lit(cfg.w_semantic) * semantic
        + F.lit(cfg.w_recency) * recency(last_ms, now_ms, cfg)
        + F.lit(cfg.w_strength) * F.when(pinned, F.lit(1.0)).otherwise(strength)
        + F.lit(cfg.w_continuity) * F.when(in_session, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def rate(types: Column, pinned: Column, cfg: Config = DEFAULT) -> Column:
    """Decay rate per hour: the least of the types' rates, and of the default if ``strict``."""
    table = literal_map(cfg.lambdas)
    own = F.array_min(F.transform(types, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(cfg.default_lambda))))
    least = F.least(F.lit(cfg.default_lambda), own) if cfg.strict else own
    return F.when(pinned, F.lit(cfg.pinned_lambda)).otherwise(F.coalesce(least, F.lit(cfg.default_lambda)))


def decayed(base: Column, types: Column, pinned: Column, last_ms: Column, created_ms: Column, now_ms: int, cfg: Config = DEFAULT) -> Column:
    since = F.when(last_ms == 0, created_ms).otherwise(last_ms)
    return base * F.exp(-rate(types, pinned, cfg) * age_hours(since, now_ms))


def domain(types: Column) -> Column:
    """First known type, else preference."""
    known = F.array(*(F.lit(t) for t in TYPES))
    return F.coalesce(F.get(F.filter(types, lambda t: F.array_contains(known, t)), F.lit(0)), F.lit("preference"))


def attribute_match(types_a: Column, types_b: Column, entities_a: Column, entities_b: Column, domain_a: Column, domain_b: Column) -> Column:
    shared = F.size(F.array_intersect(F.array_distinct(entities_a), entities_b))
    first_a, first_b = F.get(types_a, F.lit(0)), F.get(types_b, F.lit(0))
    total = (
        F.when(first_a == first_b, F.lit(0.3)).otherwise(F.lit(0.0))
        + F.least(F.lit(0.5), shared * F.lit(0.15))
        + F.when(domain_a == domain_b, F.lit(0.2)).otherwise(F.lit(0.0))
    )
    return F.least(F.lit(1.0), total)


def quality(novelty: Column, specificity: Column, recurrence: Column, cfg: Config = DEFAULT) -> Column:
    return F.lit(cfg.w_novelty) * novelty + F.lit(cfg.w_specificity) * specificity + F.lit(cfg.w_recurrence) * recurrence


def type_threshold(types: Column, cfg: Config = DEFAULT) -> Column:
    table = literal_map(cfg.type_threshold)
    own = F.array_min(F.transform(types, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(cfg.threshold))))
    return F.coalesce(own, F.lit(cfg.threshold))


def tokens(text: Column, cfg: Config = DEFAULT) -> Column:
    return F.ceil(F.length(text) / F.lit(float(cfg.chars_per_token)))
