"""DuckDB twins of the derived tables, and small builders of SQL text."""

from __future__ import annotations

from memengine.config import DAY_MS, HOUR_MS, TYPES
from memengine.sources.tables import BIRTH_MS, CITIES, NOW_MS

NOW = f"CAST({NOW_MS} AS BIGINT)"
_KINDS = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
MEM = f"""WITH doc_count AS (SELECT count(*) AS n_docs FROM documents),
acc AS (SELECT user_id, max(epoch_us(ts) // 1000) AS last_ms, count(*) AS accesses FROM events GROUP BY user_id),
raw AS (SELECT e.vec_id AS seq, e.label, e.embedding, d.text AS content, {BIRTH_MS} + (e.vec_id % 700) * {HOUR_MS} - CASE WHEN e.vec_id % 7 = 0 THEN {200 * DAY_MS} ELSE 0 END AS created_at, acc.last_ms, acc.accesses
    FROM embeddings e CROSS JOIN doc_count JOIN documents d ON d.doc_id = e.vec_id % doc_count.n_docs LEFT JOIN acc ON acc.user_id = e.vec_id),
memories AS (SELECT 'm' || lpad(CAST(seq AS VARCHAR), 9, '0') AS id, seq, content, [{_KINDS}[label % 8 + 1], {_KINDS}[(label + seq) % 8 + 1]] AS types,
    CASE seq % 20 WHEN 0 THEN 'faded' WHEN 1 THEN 'archived' WHEN 2 THEN 'superseded' ELSE 'active' END AS status, created_at, created_at + (seq % 11) * {DAY_MS} AS updated_at, created_at AS valid_from,
    CASE WHEN seq % 13 = 0 THEN created_at + {30 * DAY_MS} END AS valid_to, CAST(1.0 + (seq % 5) * 0.5 AS DOUBLE) AS base_strength, CAST((seq * 37 % 100) / 100.0 AS DOUBLE) AS current_strength, seq % 17 = 0 AS pinned,
    coalesce(accesses, 0) AS mention_count, coalesce(last_ms, created_at) AS last_accessed_at, CASE WHEN seq % 23 <> 0 THEN 'cluster-' || CAST(label AS VARCHAR) END AS cluster_id,
    ['e3_' || CAST(seq % 3 AS VARCHAR), 'e4_' || CAST(seq % 4 AS VARCHAR), 'e5_' || CAST(seq % 5 AS VARCHAR)] AS entities, ['c' || CAST(seq % 40 AS VARCHAR)] AS source_conversation_ids,
    CASE WHEN seq % 20 = 2 THEN 'm' || lpad(CAST(seq + 1 AS VARCHAR), 9, '0') END AS superseded_by, CASE WHEN seq % 20 = 2 THEN {NOW_MS} - (seq % 60) * {DAY_MS} END AS superseded_at,
    CASE WHEN seq % 20 = 0 THEN {NOW_MS} - (seq % 60) * {DAY_MS} END AS faded_at, CAST(NULL AS BIGINT) AS deleted_at, embedding, label, {_KINDS}[label % 8 + 1] AS conflict_domain FROM raw) """

_CITY = "[" + ", ".join(f"'{c}'" for c in CITIES) + "]"
_SAID = ["'I live in ' || a || '.'", "'I used to live in ' || a || ' but now I live in ' || b || '.'", "'I prefer tea over coffee no ' || CAST(c_custkey % 3 AS VARCHAR) || '.'", "'My name is Customer' || CAST(c_custkey AS VARCHAR) || '.'", "'thanks thanks thanks thanks'"]
UTTER = f"WITH places AS (SELECT c_custkey, {_CITY}[c_nationkey % {len(CITIES)} + 1] AS a, {_CITY}[(c_nationkey + 5) % {len(CITIES)} + 1] AS b FROM customer), utterances AS (" + " UNION ALL ".join(f"SELECT c_custkey AS conv_id, CAST({k} AS INTEGER) AS pos, {s} AS text FROM places" for k, s in enumerate(_SAID)) + ")"


def duck_regex(pattern: str) -> str:
    """A pattern as the inside of a SQL literal."""
    return pattern.replace("'", "''")


def duck_case(subject: str, table: dict, default: str = "NULL", match: bool = False) -> str:
    """CASE over a literal map: keys to values, or (match) names to patterns, first match first."""
    show = lambda v: str(v) if isinstance(v, (int, float)) else f"'{v}'"
    if match:
        rows = [f"WHEN regexp_matches({subject}, '{duck_regex(p)}') THEN '{n}'" for n, p in table.items()]
    else:
        rows = [f"WHEN {subject} = '{k}' THEN {show(v)}" for k, v in table.items()]
    return "CASE " + " ".join(rows) + f" ELSE {default} END"
