"""Constants of the engine, in one frozen object; every operator takes its own overrides."""

from __future__ import annotations

from dataclasses import dataclass, field

# Memory types in order, and what each means for decay, reinforcement and predicates.
TYPES = ["identity", "location", "profession", "preference", "project", "temporal", "relational", "emotional"]
LAMBDA = {"identity": 1e-4, "location": 5e-4, "profession": 3e-4, "preference": 1e-3, "project": 5e-3, "temporal": 2e-2, "relational": 4e-4, "emotional": 1e-2}
REINFORCE = {"identity": 0.5, "location": 0.3, "profession": 0.4, "preference": 0.4, "project": 0.3, "temporal": 0.1, "relational": 0.3, "emotional": 0.2}
PREDICATE = {
    "identity": "is", "location": "lives_in", "profession": "works_as", "preference": "prefers",
    "project": "works_on", "temporal": "time_state", "relational": "related_to", "emotional": "feels",
}
TYPE_THRESHOLD = {"identity": 0.36, "preference": 0.38, "relational": 0.36, "profession": 0.36, "temporal": 0.33}
STATUSES = ["active", "faded", "archived", "superseded"]
HOUR_MS, DAY_MS = 3_600_000, 86_400_000


@dataclass(frozen=True)
class Config:
    # Retrieval.
    w_semantic: float = 0.40
    w_recency: float = 0.20
    w_strength: float = 0.25
    w_continuity: float = 0.15
    half_life_h: float = 72.0
    floor: float = 0.3
    cluster_bonus: float = 0.05
    k: int = 50
    # Contradictions.
    contradiction_cos: float = 0.80
    contradiction_k: int = 7
    match_cutoff: float = 0.7
    # Extraction.
    threshold: float = 0.45
    min_novelty: float = 0.15
    w_novelty: float = 0.35
    w_specificity: float = 0.45
    w_recurrence: float = 0.20
    recurrence_cos: float = 0.85
    type_threshold: dict[str, float] = field(default_factory=lambda: dict(TYPE_THRESHOLD))
    # Lifecycle.
    lambdas: dict[str, float] = field(default_factory=lambda: dict(LAMBDA))
    default_lambda: float = 1e-3
    pinned_lambda: float = 0.0
    fade_below: float = 0.1
    faded_days: int = 30
    superseded_days: int = 30
    reinforce: dict[str, float] = field(default_factory=lambda: dict(REINFORCE))
    default_reinforce: float = 0.3
    max_base: float = 3.0
    debounce_ms: int = 5000
    #: True: the rates as the published engine applies them (a rate above the default never counts).
    strict: bool = True
    # Tokens.
    chars_per_token: int = 4
    message_overhead: int = 4
    response_reserve: int = 1024
    context_tokens: int = 8192
    no_history_budget: int = 512
    # Clusters.
    clusters: int = 10
    max_iterations: int = 100
    epsilon: float = 1e-3


DEFAULT = Config()


def validate_lambdas(lambdas: dict[str, float]) -> None:
    """Reject rates below zero."""
    bad = {k: v for k, v in lambdas.items() if v < 0}
    if bad:
        raise ValueError(f"decay rates below zero: {bad}")
