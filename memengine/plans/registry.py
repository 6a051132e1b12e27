"""Registered queries of the memory engine and the DuckDB SQL that checks them.

Queries run over whole tables. ``_add(name, query, sql)`` registers both; where SQL can't express an
operator, there is no SQL and tests hold it against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memengine.config import DAY_MS, DEFAULT, LAMBDA, PREDICATE, REINFORCE, TYPE_THRESHOLD, TYPES, validate_lambdas
from memengine.functions import ner, packs, scoring, text, vectors
from memengine.functions.checkpoint import cut
from memengine.operators import evals, learning, lifecycle, query, retrieval
from memengine.plans.sql import MEM, NOW, UTTER, duck_case, duck_regex
from memengine.sources import store
from memengine.sources.tables import NOW_MS, accesses, canonical, memories, read, sayings, utterances, utterances_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _mem(name: str, f: Callable[[DataFrame], DataFrame], body: str | None, prefix: str = MEM) -> None:
    _add(name, lambda s, d: f(memories(s, d)), None if body is None else prefix + body)


def _vector(s: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    row = read(s, d, "embeddings").filter(F.col("vec_id") == vec_id).first()
    return [float(x) for x in row["embedding"]]


def _r(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


BASIC = ["id", "status", "created_at", "mention_count"]
B = "id, status, created_at, mention_count"

# --------------------------------------------------------------------------- scans
_mem("scan_all", lambda m: m.select(*BASIC, F.length("content").alias("n"), F.array_join("types", ",").alias("kinds"), "pinned", "base_strength", "current_strength", "last_accessed_at", "cluster_id", "conflict_domain", "valid_to", "superseded_by", "superseded_at", "faded_at"),
     f"SELECT {B}, length(content) AS n, array_to_string(types, ',') AS kinds, pinned, base_strength, current_strength, last_accessed_at, cluster_id, conflict_domain, valid_to, superseded_by, superseded_at, faded_at FROM memories")
_mem("scan_ids", lambda m: m.select("id"), "SELECT id FROM memories")
_mem("point_get", lambda m: store.by_id(m, "m000000007").select(*BASIC), f"SELECT {B} FROM memories WHERE id = 'm000000007'")
_mem("key_exists", lambda m: store.exists(m, "m000000007"), "SELECT count(*) > 0 AS found FROM memories WHERE id = 'm000000007'")
_mem("scan_by_status", lambda m: store.scan(m, status="superseded").select(*BASIC), f"SELECT {B} FROM memories WHERE status = 'superseded'")
_mem("scan_by_type_status", lambda m: store.scan(m, status="active", kind="location").select(*BASIC), f"SELECT {B} FROM memories WHERE list_contains(types, 'location') AND status = 'active'")
_mem("scan_active_recency", lambda m: store.active_by_recency(m, 25, NOW_MS).select(*BASIC), f"SELECT {B} FROM memories WHERE status = 'active' AND last_accessed_at >= 0 AND last_accessed_at < {NOW} ORDER BY last_accessed_at DESC, id LIMIT 25")
_mem("scan_by_cluster", lambda m: store.scan(m, cluster="cluster-3", status="active").select(*BASIC), f"SELECT {B} FROM memories WHERE cluster_id = 'cluster-3' AND status = 'active'")
_mem("scan_pinned", lambda m: store.scan(m, pinned=True).select(*BASIC), f"SELECT {B} FROM memories WHERE pinned")
_mem("scan_by_mentions", lambda m: store.by_mentions(m, 5, 30).select(*BASIC), f"SELECT {B} FROM memories WHERE mention_count >= 5 ORDER BY mention_count DESC, id LIMIT 30")
_mem("scan_strength_range", lambda m: store.half_open(m, "base_strength", 1.5, 2.5, "active").select(*BASIC), f"SELECT {B} FROM memories WHERE base_strength >= 1.5 AND base_strength < 2.5 AND status = 'active'")
_mem("scan_valid_range", lambda m: store.half_open(m, "valid_from", NOW_MS - 20 * DAY_MS, NOW_MS - 5 * DAY_MS).select(*BASIC), f"SELECT {B} FROM memories WHERE valid_from >= {NOW_MS - 20 * DAY_MS} AND valid_from < {NOW_MS - 5 * DAY_MS}")
_mem("scan_expired", lambda m: store.expired(m, NOW_MS).select(*BASIC), f"SELECT {B} FROM memories WHERE valid_to < {NOW}")
_mem("scan_expired_superseded", lambda m: store.expired_superseded(m, NOW_MS).select(*BASIC), f"SELECT {B} FROM memories WHERE status = 'superseded' AND superseded_at < {NOW_MS - 30 * DAY_MS} AND deleted_at IS NULL")

# --------------------------------------------------------------------------- writes
_third = lambda m: m.filter("seq % 3 = 0").select("id")
_new = lambda m: m.filter("seq % 3 = 0").withColumn("current_strength", F.lit(0.25))
_cols = lambda m: m.select("id", "status", _r("current_strength").alias("current_strength"), "cluster_id", "mention_count", "last_accessed_at", "updated_at", "pinned")
_C = "id, status, round(current_strength, 6) AS current_strength, cluster_id, mention_count, last_accessed_at, updated_at, pinned"
_mem("sink_create", lambda m: _cols(store.create(m.filter("seq % 3 <> 0"), m.filter("seq % 3 = 0"))), f"SELECT {_C} FROM memories")
_mem("sink_upsert", lambda m: _cols(store.upsert(m, _new(m))), f"SELECT {_C.replace('round(current_strength, 6)', 'CASE WHEN seq % 3 = 0 THEN 0.25 ELSE round(current_strength, 6) END')} FROM memories")
_mem("sink_delete", lambda m: _cols(store.delete(m, _third(m))), f"SELECT {_C} FROM memories WHERE seq % 3 <> 0")
_mem("patch_cluster_ids", lambda m: _cols(store.patch(m, m.filter("seq % 3 = 0").select("id", F.lit("cluster-x").alias("cluster_id")))), f"SELECT {_C.replace('cluster_id', chr(67) + 'ASE WHEN seq % 3 = 0 THEN ' + chr(39) + 'cluster-x' + chr(39) + ' ELSE cluster_id END AS cluster_id')} FROM memories")
_mem("touch", lambda m: _cols(store.touch(m, _third(m), NOW_MS)), f"SELECT id, status, round(current_strength, 6) AS current_strength, cluster_id, mention_count + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS mention_count, CASE WHEN seq % 3 = 0 THEN {NOW} ELSE last_accessed_at END AS last_accessed_at, updated_at, pinned FROM memories")
_touched = lambda col, new: f"SELECT {_C.replace(col, f'CASE WHEN seq % 3 = 0 THEN {new} ELSE {col} END AS {col}').replace('updated_at', f'CASE WHEN seq % 3 = 0 THEN {NOW} ELSE updated_at END AS updated_at')} FROM memories"
_mem("pin", lambda m: _cols(store.pin(m, _third(m), NOW_MS)), _touched("pinned", "true"))
_mem("unpin", lambda m: _cols(store.pin(m, _third(m), NOW_MS, False)), _touched("pinned", "false"))
_mem("archive", lambda m: _cols(store.archive(m, _third(m), NOW_MS)), _touched("status", "'archived'"))
_mem("unarchive", lambda m: _cols(store.unarchive(m, _third(m), NOW_MS)), _touched("status", "'active'"))
_mem("update", lambda m: _cols(store.set_where(m, _third(m), NOW_MS, mention_count=F.lit(99).cast("long"))), _touched("mention_count", "99"))
_mem("bulk_outcome", lambda m: store.bulk_outcome(m.filter("seq % 2 = 0"), _third(m)), "SELECT id, seq % 2 = 0 AS succeeded FROM memories WHERE seq % 3 = 0")
_mem("import_merge", lambda m: _cols(store.import_merge(m.filter("seq % 2 = 0"), _new(m))[0]), f"SELECT {_C.replace('round(current_strength, 6)', 'CASE WHEN seq % 2 = 0 THEN round(current_strength, 6) ELSE 0.25 END')} FROM memories WHERE seq % 2 = 0 OR seq % 3 = 0")
_mem("import_counts", lambda m: store.import_merge(m.filter("seq % 2 = 0"), _new(m))[1], "SELECT count(*) FILTER (WHERE seq % 2 <> 0) AS imported, count(*) FILTER (WHERE seq % 2 = 0) AS skipped FROM memories WHERE seq % 3 = 0")
_mem("import_replace", lambda m: _cols(store.import_replace(m, _new(m))), f"SELECT {_C.replace('round(current_strength, 6)', '0.25')} FROM memories WHERE seq % 3 = 0")
_mem("export_json", lambda m: store.export_json(m.drop("seq", "label")).select("id", F.get_json_object("value", "$.status").alias("status"), F.length(F.get_json_object("value", "$.embedding_base64")).alias("n")), "SELECT id, status, CAST(ceil(len(embedding) * 4 / 3.0) * 4 AS INTEGER) AS n FROM memories")
_mem("export_markdown", lambda m: store.export_markdown(m), "SELECT unnest(types) AS kind, id AS ord, '- ' || content || printf(' (strength: %.2f)', current_strength) || CASE WHEN pinned THEN ' (pinned)' ELSE '' END AS line FROM memories")
_mem("clear_all", lambda m: store.clear(m.sparkSession, m).select(*BASIC), f"SELECT {B} FROM memories WHERE false")
_mem("project_dto", lambda m: store.dto(m).select(*BASIC, "conflict_domain"), f"SELECT {B}, conflict_domain FROM memories")
_mem("from_dto", lambda m: store.new_memories(m, NOW_MS).select(*BASIC, "base_strength", "conflict_domain"), f"SELECT id, 'active' AS status, {NOW} AS created_at, CAST(1 AS BIGINT) AS mention_count, CAST(1.0 AS DOUBLE) AS base_strength, conflict_domain FROM memories")

# --------------------------------------------------------------------------- filters, search, pages
_mem("filter_types_any", lambda m: query.filtered(m, types_any=["location", "emotional"]).select(*BASIC), f"SELECT {B} FROM memories WHERE list_has_any(types, ['location', 'emotional'])")
_mem("filter_strength_range", lambda m: query.filtered(m, strength=(0.2, 0.5)).select(*BASIC), f"SELECT {B} FROM memories WHERE current_strength BETWEEN 0.2 AND 0.5")
_mem("filter_pinned", lambda m: query.filtered(m, pinned=True, status="active").select(*BASIC), f"SELECT {B} FROM memories WHERE pinned AND status = 'active'")
_mem("filter_cluster", lambda m: query.filtered(m, cluster="cluster-1").select(*BASIC), f"SELECT {B} FROM memories WHERE cluster_id = 'cluster-1'")
_mem("filter_conversation", lambda m: query.filtered(m, conversation="c4").select(*BASIC), f"SELECT {B} FROM memories WHERE list_contains(source_conversation_ids, 'c4')")
for _mode, _sql in (
    ("exact", "contains(lower(content), 'the th')"),
    ("and", "contains(lower(content), 'the') AND contains(lower(content), 'ing')"),
    ("or", "contains(lower(content), 'the') OR contains(lower(content), 'keit')"),
):
    _q = {"exact": "The Th", "and": "the ING", "or": "the keit"}[_mode]
    _mem(f"fulltext_{_mode}", lambda m, q=_q, mode=_mode: m.filter(query.contains(F.col("content"), q, mode)).select(*BASIC), f"SELECT {B} FROM memories WHERE {_sql}")
_mem("fulltext_case", lambda m: m.filter(query.contains(F.col("content"), "The ", "exact", True)).select(*BASIC), f"SELECT {B} FROM memories WHERE contains(content, 'The ')")
for _by, _col in query.ORDERS.items():
    _mem(f"sort_{_by}", lambda m, by=_by: query.places(m, by), f"SELECT id, row_number() OVER (ORDER BY {_col} DESC, id) AS place FROM memories")
_mem("paginate", lambda m: query.page(m, "recent", 20, 30).select("id", "place", "total", "has_more"), "SELECT id, place, total, 50 < total AS has_more FROM (SELECT id, CAST(row_number() OVER (ORDER BY last_accessed_at DESC, id) AS INTEGER) AS place, count(*) OVER () AS total FROM memories) WHERE place > 30 AND place <= 50")
_mem("get_recent", lambda m: query.recent(m).select(*BASIC), f"SELECT {B} FROM memories WHERE status = 'active' ORDER BY last_accessed_at DESC, id LIMIT 50")
_mem("get_top", lambda m: query.strongest(m).select(*BASIC), f"SELECT {B} FROM memories WHERE status = 'active' AND current_strength >= 0.5 ORDER BY current_strength DESC, id LIMIT 50")
_mem("get_pinned", lambda m: query.pinned_first(m).select(*BASIC), f"SELECT {B} FROM memories WHERE pinned ORDER BY last_accessed_at DESC, id LIMIT 100")
for _unit in ("day", "week", "month"):
    _mem(f"timeline_{_unit}" if _unit != "day" else "timeline", lambda m, u=_unit: query.timeline(m, u),
         f"SELECT CAST(CAST(date_trunc('{_unit}', epoch_ms(created_at)) AS DATE) AS VARCHAR) AS period, count(*) OVER (PARTITION BY period) AS n, CAST(row_number() OVER (PARTITION BY period ORDER BY last_accessed_at DESC, id) AS INTEGER) AS place, id FROM memories")
_mem("grouped_by_type", lambda m: query.grouped_by_type(m), "SELECT kind, count(*) OVER (PARTITION BY kind) AS n, CAST(row_number() OVER (PARTITION BY kind ORDER BY last_accessed_at DESC, id) AS INTEGER) AS place, id FROM (SELECT id, last_accessed_at, unnest(types) AS kind FROM memories)")
_mem("count_filtered", lambda m: query.count(m, min_base=1.5, types_any=["preference"], status="active"), "SELECT count(*) AS n FROM memories WHERE list_contains(types, 'preference') AND status = 'active' AND base_strength >= 1.5")
_mem("count_by_status", query.by_status, "SELECT status, count(*) AS n FROM memories GROUP BY status")
_mem("stats", lambda m: query.stats(m).withColumn("avg_strength", _r("avg_strength")), "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'faded') AS faded, count(*) FILTER (WHERE pinned) AS pinned, round(coalesce(avg(current_strength), 0), 6) AS avg_strength, min(created_at) AS oldest, max(created_at) AS newest FROM memories")
_add("lifecycle_stats", lambda s, d: lifecycle.lifecycle_stats(memories(s, d), accesses(s, d), NOW_MS), MEM + f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'faded') AS faded, count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'superseded') AS superseded, (SELECT count(DISTINCT user_id) FROM events) AS pending, {NOW} AS last_sweep, {NOW} + 3600000 AS next_sweep FROM memories")

# --------------------------------------------------------------------------- vectors and retrieval
_COS = "greatest(0.0, least(1.0, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))))"
_SCORE = f"0.4 * semantic + 0.2 * exp(-ln(2.0) * (({NOW} - last_accessed_at) / 3600000.0) / 72.0) + 0.25 * CASE WHEN pinned THEN 1.0 ELSE current_strength END + 0.0"
_SEARCH = (
    MEM + f", sem AS (SELECT *, {_COS} AS semantic FROM memories WHERE status = 'active'), sc AS (SELECT *, {_SCORE} AS score0 FROM sem), fl AS (SELECT * FROM sc WHERE score0 >= 0.3), "
    "best AS (SELECT id AS best_id, cluster_id AS best_cluster FROM fl ORDER BY score0 DESC, id LIMIT 1), "
    "lifted AS (SELECT fl.*, score0 + CASE WHEN best_id IS NOT NULL THEN 0.05 ELSE 0.0 END AS score FROM fl LEFT JOIN best ON fl.cluster_id = best_cluster AND fl.id <> best_id), "
    "ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM lifted) "
)
_add("vector_search", lambda s, d: retrieval.vector_search(memories(s, d), _vector(s, d), NOW_MS).select("id", "rank", _r("semantic").alias("semantic"), _r("score").alias("score")), _SEARCH + "SELECT id, rank, round(semantic, 6) AS semantic, round(score, 6) AS score FROM ranked WHERE rank <= 50")
_add("cluster_bonus", lambda s, d: retrieval.lifted(memories(s, d), _vector(s, d), NOW_MS).select("id", "cluster_id", _r("score").alias("score")), _SEARCH + "SELECT id, cluster_id, round(score, 6) AS score FROM ranked")
_add("composite_score", lambda s, d: memories(s, d).select("id", _r(scoring.composite(vectors.cosine(F.col("embedding"), vectors.literal(_vector(s, d))), F.col("last_accessed_at"), F.col("current_strength"), F.col("pinned"), F.lit(False), NOW_MS)).alias("score")), MEM + f"SELECT id, round({_SCORE}, 6) AS score FROM (SELECT *, {_COS} AS semantic FROM memories)")
_add("cosine", lambda s, d: memories(s, d).select("id", _r(vectors.cosine(F.col("embedding"), vectors.literal(_vector(s, d)))).alias("similarity")), MEM + f"SELECT id, round({_COS}, 6) AS similarity FROM memories")
_add("euclidean", lambda s, d: memories(s, d).select("id", _r(vectors.euclidean(F.col("embedding"), vectors.literal(_vector(s, d)))).alias("distance")), MEM + "SELECT id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM memories")
_add("predicate_floor", lambda s, d: retrieval.scored(memories(s, d), _vector(s, d), NOW_MS).select("id"), _SEARCH + "SELECT id FROM fl")
_add("topk_similarity", lambda s, d: memories(s, d).select("id", vectors.cosine(F.col("embedding"), vectors.literal(_vector(s, d))).alias("c")).orderBy(F.desc("c"), "id").limit(10).select("id", _r("c").alias("similarity")), MEM + f"SELECT id, round({_COS}, 6) AS similarity FROM memories ORDER BY {_COS} DESC, id LIMIT 10")
_add("semantic_search", lambda s, d: retrieval.lookup(retrieval.semantic_search(memories(s, d), _vector(s, d), NOW_MS, 20), memories(s, d)).select("id", "rank", _r("score").alias("score"), "created_at"), _SEARCH.replace(_SCORE, "semantic") + "SELECT id, rank, round(score, 6) AS score, created_at FROM ranked WHERE rank <= 20")
_add("lookup_join", lambda s, d: retrieval.lookup(retrieval.vector_search(memories(s, d), _vector(s, d), NOW_MS, 15), memories(s, d)).select("id", "rank", "status", "last_accessed_at"), _SEARCH + "SELECT id, rank, status, last_accessed_at FROM ranked WHERE rank <= 15")
_add("novelty", lambda s, d: retrieval.novelty(memories(s, d), _vector(s, d), NOW_MS).select(_r("novelty").alias("novelty")), _SEARCH + "SELECT round(1 - coalesce(max(semantic), 0), 6) AS novelty FROM ranked WHERE rank = 1")


def _many(s: SparkSession, d: str) -> DataFrame:
    """The stated set of questions of a search: vectors whose id is divisible by 100."""
    asked = read(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return vectors.nearest_of_each(asked, memories(s, d), 5, 0.0).select(F.col("new_id").alias("query"), "id", "rank", _r("similarity").alias("similarity"))


_add(
    "vector_cross_join",
    _many,
    MEM + """SELECT query, id, rank, round(sim, 6) AS similarity FROM (
        SELECT query, id, sim, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS INTEGER) AS rank
        FROM (SELECT 'q' || CAST(q.vec_id AS VARCHAR) AS query, m.id, greatest(0.0, least(1.0, list_inner_product(m.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS sim FROM memories m, embeddings q WHERE q.vec_id % 100 = 0)
    ) WHERE rank <= 5""",
)
_PAIRS = "pairs AS (SELECT a.id AS new_id, b.id, greatest(0.0, least(1.0, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS sim, a.types AS ta, b.types AS tb, a.entities AS ea, b.entities AS eb, a.conflict_domain AS da, b.conflict_domain AS db, a.content AS ca FROM memories a JOIN memories b ON a.conflict_domain = b.conflict_domain AND a.id <> b.id AND b.status = 'active'), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, id) AS INTEGER) AS rank FROM pairs WHERE sim >= 0.05) "
_mem(
    "topk_per_domain",
    lambda m: retrieval.top_k_per_domain(m, m, 7, 0.05).select("new_id", "id", "rank", _r("similarity").alias("similarity")),
    ", " + _PAIRS + "SELECT new_id, id, rank, round(sim, 6) AS similarity FROM top WHERE rank <= 7",
)
_mem(
    "domain_equi_join",
    lambda m: retrieval.domain_pairs(m, m, 0.35).select("new_id", "id", _r("similarity").alias("similarity")),
    ", " + _PAIRS + "SELECT new_id, id, round(sim, 6) AS similarity FROM pairs WHERE sim >= 0.35",
)
_add(
    "search_by_domain",
    lambda s, d: retrieval.search_by_domain(memories(s, d), _vector(s, d), "profession", "m000000000", 7, 0.05).select("id", _r("similarity").alias("similarity")),
    MEM + f"SELECT id, round({_COS}, 6) AS similarity FROM memories WHERE status = 'active' AND conflict_domain = 'profession' AND id <> 'm000000000' AND {_COS} >= 0.05 ORDER BY {_COS} DESC, id LIMIT 7",
)
_mem("predicate_domain", lambda m: retrieval.in_domain(m, "location").select(*BASIC), f"SELECT {B} FROM memories WHERE status = 'active' AND conflict_domain = 'location'")
_BUDGET = 4000
_add("greedy_budget_prefix", lambda s, d: retrieval.within_budget(retrieval.vector_search(memories(s, d), _vector(s, d), NOW_MS), _BUDGET).select("id", "rank", F.col("tokens").cast("long").alias("tokens"), F.col("running_tokens").cast("long").alias("running_tokens")), _SEARCH + f"SELECT id, rank, CAST(tokens AS BIGINT) AS tokens, CAST(running AS BIGINT) AS running_tokens FROM (SELECT id, rank, ceil(length(content) / 4.0) AS tokens, sum(ceil(length(content) / 4.0)) OVER (ORDER BY rank) AS running FROM ranked WHERE rank <= 50) WHERE running <= {_BUDGET}")
_add("injection_preview", lambda s, d: retrieval.injection_preview(memories(s, d), _vector(s, d), NOW_MS, max_tokens=9000).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("used_tokens")), _SEARCH + "SELECT count(*) AS n, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS used_tokens FROM (SELECT ceil(length(content) / 4.0) AS tokens, sum(ceil(length(content) / 4.0)) OVER (ORDER BY rank) AS running FROM ranked WHERE rank <= 50) WHERE running <= 9000")
_LINE = "'- ' || content || ' (confidence: ' || CASE WHEN current_strength >= 0.8 THEN 'high' WHEN current_strength >= 0.5 THEN 'medium' ELSE 'low' END || CASE WHEN pinned THEN ' (pinned)' ELSE '' END || ')'"
_BLOCK = f"SELECT CASE WHEN count(*) = 0 THEN '' ELSE '{retrieval.HEADER}' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY rank) || chr(10) || '{retrieval.FOOTER}' END AS block FROM ranked WHERE rank <= 5"
_add("format_block", lambda s, d: retrieval.format_block(retrieval.vector_search(memories(s, d), _vector(s, d), NOW_MS, 5)), _SEARCH + _BLOCK)
_add("inject_system", lambda s, d: retrieval.inject_system(read(s, d, "conversations").select("conv_id", "turn", "role", "text"), F.lit("[block]")),
     "WITH f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS least FROM conversations), h AS (SELECT conv_id, turn, role FROM f WHERE turn = least) SELECT conv_id, turn, role, CASE WHEN turn = least AND role = 'system' THEN '[block]' || chr(10) || chr(10) || coalesce(text, '') ELSE text END AS text FROM f UNION ALL SELECT conv_id, turn - 1, 'system', '[block]' FROM h WHERE role <> 'system'")
_add("augment", lambda s, d: retrieval.augment_all(memories(s, d), read(s, d, "conversations").select("conv_id", "turn", "role", "text"), _vector(s, d), NOW_MS))
_add("augment_debug", lambda s, d: retrieval.excluded(memories(s, d), retrieval.vector_search(memories(s, d), _vector(s, d), NOW_MS, 20).select("id"), _vector(s, d), NOW_MS), _SEARCH + "SELECT m.id, CASE WHEN fl.id IS NOT NULL THEN 'token_budget' ELSE 'below_floor' END AS reason FROM memories m LEFT JOIN fl ON fl.id = m.id WHERE m.status = 'active' AND m.id NOT IN (SELECT id FROM ranked WHERE rank <= 20)")
_mem("semi_anti", lambda m: m.filter("status = 'active'").join(_third(m), "id", "left_anti").select("id"), "SELECT id FROM memories WHERE status = 'active' AND seq % 3 <> 0")

# --------------------------------------------------------------------------- aggregates and windows
_turns = lambda s, d: read(s, d, "conversations").select("conv_id", "turn", "role", "text")
_add("source_chat", lambda s, d: _turns(s, d).filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("n")), "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'")
_add("token_estimate", lambda s, d: _turns(s, d).select("conv_id", "turn", scoring.tokens(F.col("text")).cast("long").alias("tokens")), "SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations")
_TOK = "SELECT conv_id, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) + 4 * count(*) AS BIGINT) AS used_tokens FROM conversations GROUP BY conv_id"
_add("token_sum", lambda s, d: query.token_sum(_turns(s, d)).select("conv_id", "used_tokens"), _TOK)
_add("token_budget", lambda s, d: query.token_sum(_turns(s, d)), f"SELECT conv_id, used_tokens, CAST(greatest(0, 7168 - used_tokens) AS BIGINT) AS available_tokens FROM ({_TOK})")
_mem("dedupe_best", lambda m: query.best_per_key(m.select("id", "cluster_id", "conflict_domain", "current_strength"), ["cluster_id", "conflict_domain"], "current_strength", "id").select("id", "cluster_id", "conflict_domain"), "SELECT id, cluster_id, conflict_domain FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, conflict_domain ORDER BY current_strength DESC, id) AS rn FROM memories) WHERE rn = 1")
_mem("dedupe_facts", lambda m: query.best_per_key(m.select("id", F.lower(F.trim("content")).alias("fact"), "current_strength"), ["fact"], "current_strength", "id").select("id"), "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(trim(content)) ORDER BY current_strength DESC, id) AS rn FROM memories) WHERE rn = 1")
_mem("latest_same_predicate", lambda m: lifecycle.latest(m.filter("status = 'active'").withColumn("predicate", text.predicate(F.col("types"))), ["predicate"], "updated_at").select("id", "predicate", "updated_at"), f"SELECT id, predicate, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY updated_at DESC, id) AS rn FROM (SELECT *, {duck_case('types[1]', PREDICATE)} AS predicate FROM memories WHERE status = 'active')) WHERE rn = 1")
_add("session_recurrence", lambda s, d: learning.session_recurrence(read(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("content"), F.col("event_id").alias("pos")), F.lit(1.0)).select(F.col("pos").alias("event_id"), "recurrence"), "SELECT event_id, CASE WHEN lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS recurrence FROM events")
_add("last_seen_entity", lambda s, d: learning.last_seen(read(s, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("pos"), F.when(F.col("value") > 50, F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string"))).alias("entity"))).select(F.col("pos").alias("event_id"), "last_entity"), "SELECT event_id, last_value(CASE WHEN value > 50 THEN 'e' || CAST(event_id % 7 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_entity FROM events")
_add("debounce", lambda s, d: lifecycle.debounce(accesses(s, d)), "SELECT DISTINCT 'm' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS id, epoch_us(ts) // 5000000 * 5000 AS window_ms FROM events")
_add("cache_stats", lambda s, d: query.cache_stats(read(s, d, "events").select(F.col("user_id").alias("key"))).withColumn("hit_rate", _r("hit_rate")), "SELECT CAST(sum(n) AS BIGINT) AS lookups, CAST(sum(n) - count(*) AS BIGINT) AS hits, round((sum(n) - count(*)) / sum(n), 6) AS hit_rate FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
_add("eval_ratio", lambda s, d: query.ratios(read(s, d, "labels").select(F.explode(F.array(F.struct(F.lit("quality").alias("metric"), (F.col("quality") == 1).alias("ok")), F.struct(F.lit("toxic").alias("metric"), (F.col("toxic") == 1).alias("ok")))).alias("x")).select("x.*"), "ok").withColumn("ratio", _r("ratio")), "SELECT 'quality' AS metric, round(count(*) FILTER (WHERE quality = 1) / count(quality), 6) AS ratio FROM labels UNION ALL SELECT 'toxic', round(count(*) FILTER (WHERE toxic = 1) / count(toxic), 6) FROM labels")
_mem("entity_intersection", lambda m: m.select("id", F.size(F.array_intersect(F.array_distinct("entities"), F.array(F.lit("e3_1"), F.lit("e4_2"), F.lit("e5_3")))).alias("n")), "SELECT id, CAST(len(list_intersect(entities, ['e3_1', 'e4_2', 'e5_3'])) AS INTEGER) AS n FROM memories")
_add("token_repetition", lambda s, d: read(s, d, "documents").select("doc_id", _r(text.repetition(F.col("text"))).alias("repetition")),
     r"WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '[^a-z0-9''@.\-]', '', 'g')), lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x FROM t), c AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM u GROUP BY doc_id, x) GROUP BY doc_id) SELECT t.doc_id, round(CASE WHEN len(w) < 4 THEN 0.0 ELSE n / len(w) END, 6) AS repetition FROM t LEFT JOIN c ON c.doc_id = t.doc_id")

# --------------------------------------------------------------------------- lifecycle
_RATE = f"CASE WHEN pinned THEN 0.0 ELSE least(0.001, {duck_case('types[1]', LAMBDA)}, {duck_case('types[2]', LAMBDA)}) END"
_DECAY = f"base_strength * exp(-({_RATE}) * (({NOW} - last_accessed_at) / 3600000.0))"
_mem("decay", lambda m: lifecycle.decay(m, NOW_MS).select("id", _r("current_strength").alias("current_strength")), f"SELECT id, round({_DECAY}, 6) AS current_strength FROM memories")
_mem("maintenance_sweep", lambda m: lifecycle.sweep(m, NOW_MS).select("id", "status", _r("current_strength").alias("current_strength"), "faded_at"),
     f", d AS (SELECT *, {_DECAY} AS cs FROM memories), f AS (SELECT id, cs, CASE WHEN status = 'active' AND cs < 0.1 AND NOT pinned THEN 'faded' ELSE status END AS st, CASE WHEN status = 'active' AND cs < 0.1 AND NOT pinned THEN {NOW} ELSE faded_at END AS fa FROM d) SELECT id, st AS status, round(cs, 6) AS current_strength, fa AS faded_at FROM f WHERE NOT coalesce(st = 'faded' AND fa < {NOW_MS - 30 * DAY_MS}, false)")
_AMOUNT = duck_case("types[1]", REINFORCE)
_add("reinforce", lambda s, d: lifecycle.reinforce(memories(s, d), accesses(s, d), NOW_MS).select("id", _r("base_strength").alias("base_strength"), "mention_count", "last_accessed_at"),
     MEM + f", r AS (SELECT *, seq IN (SELECT user_id FROM events) AND base_strength + {_AMOUNT} <= 3.0 AS does FROM memories) SELECT id, round(CASE WHEN does THEN base_strength + {_AMOUNT} ELSE base_strength END, 6) AS base_strength, mention_count + CASE WHEN does THEN 1 ELSE 0 END AS mention_count, CASE WHEN does THEN {NOW} ELSE last_accessed_at END AS last_accessed_at FROM r")
_mem("supersede", lambda m: lifecycle.supersede(m, m.filter("seq % 10 = 4").select(F.col("id").alias("old_id"), F.concat(F.lit("m"), F.lpad((F.col("seq") + 1).cast("string"), 9, "0")).alias("new_id"), (F.col("seq") % 20 == 4).alias("temporal")), NOW_MS).select("id", "status", "superseded_by", "superseded_at", "valid_to", "valid_from"),
     f"SELECT id, CASE WHEN seq % 10 = 4 THEN 'superseded' ELSE status END AS status, CASE WHEN seq % 10 = 4 THEN 'm' || lpad(CAST(seq + 1 AS VARCHAR), 9, '0') ELSE superseded_by END AS superseded_by, CASE WHEN seq % 10 = 4 THEN {NOW} ELSE superseded_at END AS superseded_at, CASE WHEN seq % 20 = 4 THEN {NOW} ELSE valid_to END AS valid_to, CASE WHEN seq % 20 = 5 THEN {NOW} ELSE valid_from END AS valid_from FROM memories")
_OLD = f"(status = 'superseded' AND superseded_at < {NOW_MS - 30 * DAY_MS} AND deleted_at IS NULL)"
_mem("tombstone", lambda m: lifecycle.tombstone(m, NOW_MS).select("id", F.length("content").alias("n"), "base_strength", "deleted_at", F.col("embedding").isNull().alias("bare")), f"SELECT id, CASE WHEN {_OLD} THEN 0 ELSE length(content) END AS n, CASE WHEN {_OLD} THEN 0.0 ELSE base_strength END AS base_strength, CASE WHEN {_OLD} THEN {NOW} END AS deleted_at, {_OLD} AS bare FROM memories")
_CHAIN = "c AS (SELECT id, seq, CASE WHEN seq % 7 <> 6 AND seq + 1 < (SELECT count(*) FROM embeddings) THEN 'm' || lpad(CAST(seq + 1 AS VARCHAR), 9, '0') END AS nxt FROM memories), r AS (SELECT id, id AS last_id, 0 AS hops FROM c UNION ALL SELECT r.id, c.nxt, r.hops + 1 FROM r JOIN c ON c.id = r.last_id WHERE c.nxt IS NOT NULL) SELECT id, last_id, CAST(hops AS INTEGER) AS hops FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops DESC) AS rn FROM r) WHERE rn = 1"
_chain = lambda m: lifecycle.lineage(m.withColumn("superseded_by", F.when(F.col("seq") % 7 != 6, F.concat(F.lit("m"), F.lpad((F.col("seq") + 1).cast("string"), 9, "0")))))
_mem("supersession_chain", _chain, ", " + _CHAIN, MEM.replace("WITH ", "WITH RECURSIVE ", 1))
_mem("lineage_self_join", lifecycle.successors, "SELECT a.id, b.id AS next_id, b.status AS next_status FROM memories a JOIN memories b ON b.id = a.superseded_by")
_cents = lambda s, d: [(f"cluster-{i}", _vector(s, d, i)) for i in range(5)]
_add("kmeans_assign_join", lambda s, d: lifecycle.assign(memories(s, d).select("id", "embedding"), _cents(s, d)).select("id", "cluster_id"), MEM + "SELECT id, cluster_id FROM (SELECT m.id, 'cluster-' || CAST(q.vec_id AS VARCHAR) AS cluster_id, row_number() OVER (PARTITION BY m.id ORDER BY list_distance(m.embedding::DOUBLE[], q.embedding::DOUBLE[]), q.vec_id) AS rn FROM memories m, embeddings q WHERE q.vec_id < 5) WHERE rn = 1")
_mem("centroid_mean", lambda m: lifecycle.centroids_of(m.select("cluster_id", "embedding")).select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", "pos", _r("x", 5).alias("mean")), "SELECT cluster_id, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 5) AS mean FROM (SELECT cluster_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM memories) GROUP BY cluster_id, pos")
_mem("kmeans", lambda m: lifecycle.kmeans(m), None)
_mem("similarity_edges", lambda m: lifecycle.similarity_edges(m, 0.3).select("source", "target", _r("similarity").alias("similarity")), "SELECT source, target, round(sim, 6) AS similarity FROM (SELECT a.id AS source, b.id AS target, greatest(0.0, least(1.0, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS sim FROM memories a JOIN memories b ON a.cluster_id = b.cluster_id AND a.id < b.id WHERE a.status = 'active' AND b.status = 'active') WHERE sim > 0.3")

# --------------------------------------------------------------------------- contradictions, scoring, policy
_MATCH = "least(1.0, CASE WHEN ta[1] = tb[1] THEN 0.3 ELSE 0.0 END + least(0.5, len(list_intersect(ea, eb)) * 0.15) + CASE WHEN da = db THEN 0.2 ELSE 0.0 END)"
_MARKED = f"regexp_matches(ca, '(?i)' || '{duck_regex('|'.join(rf'\b{p}\b' for p, _, _ in text.MARKERS))}')"
_RES = f"CASE WHEN marked AND ta[1] IN ('identity', 'location') THEN 'supersede' WHEN match > 0.7 THEN CASE WHEN marked THEN 'supersede' ELSE 'pending' END ELSE 'parallel' END"
_low = DEFAULT.__class__(contradiction_cos=0.05)
_mem("detect_contradictions", lambda m: learning.contradictions(m, m, cfg=_low).select("new_id", "id", _r("similarity").alias("similarity"), _r("match").alias("match"), "resolution"), ", " + _PAIRS + f", x AS (SELECT *, {_MATCH} AS match, {_MARKED} AS marked FROM top WHERE rank <= 7), y AS (SELECT *, {_RES} AS resolution FROM x) SELECT new_id, id, round(sim, 6) AS similarity, round(match, 6) AS match, resolution FROM y WHERE resolution <> 'parallel'")


def _neighbours(m: DataFrame) -> DataFrame:
    a = m.select("id", "seq", F.col("types").alias("ta"), F.col("entities").alias("ea"), F.col("conflict_domain").alias("da"), F.col("content").alias("ca"))
    b = m.select((F.col("seq") - 60).alias("seq"), F.col("types").alias("tb"), F.col("entities").alias("eb"), F.col("conflict_domain").alias("db"))
    j = a.join(b, "seq")
    return j.withColumn("match", scoring.attribute_match(*(F.col(c) for c in ("ta", "tb", "ea", "eb", "da", "db")))).withColumn("marked", text.has_marker(F.col("ca")))


_NEIGH = f", n AS (SELECT a.id, a.types AS ta, b.types AS tb, a.entities AS ea, b.entities AS eb, a.conflict_domain AS da, b.conflict_domain AS db, a.content AS ca FROM memories a JOIN memories b ON b.seq = a.seq + 60), x AS (SELECT *, {_MATCH} AS match, {_MARKED} AS marked FROM n) "
_mem("attribute_match", lambda m: _neighbours(m).select("id", _r("match").alias("match")), _NEIGH + "SELECT id, round(match, 6) AS match FROM x")
_mem("resolve_contradiction", lambda m: _neighbours(m).select("id", learning.resolution(F.col("ta"), F.col("marked"), F.col("match")).alias("resolution")), _NEIGH + f"SELECT id, {_RES} AS resolution FROM x")
_mem("quality_score", lambda m: m.select("id", _r(scoring.quality(F.col("current_strength"), F.col("base_strength") / 3, F.when(F.col("pinned"), 1.0).otherwise(0.0))).alias("score"), _r(scoring.type_threshold(F.col("types"))).alias("threshold")), f"SELECT id, round(0.35 * current_strength + 0.45 * (base_strength / 3) + 0.2 * CASE WHEN pinned THEN 1.0 ELSE 0.0 END, 6) AS score, round(least({duck_case('types[1]', TYPE_THRESHOLD, '0.45')}, {duck_case('types[2]', TYPE_THRESHOLD, '0.45')}), 6) AS threshold FROM memories")


def _candidates(m: DataFrame) -> DataFrame:
    return m.select(F.concat(F.lit("k"), (F.col("seq") % 97).cast("string")).alias("canonical_key"), F.when(F.col("seq") % 3 == 0, F.lit("fallback")).otherwise(F.lit("deterministic")).alias("source"), F.col("current_strength").alias("score"), F.lit(0.45).alias("threshold"), (F.col("current_strength") > 0.5).alias("accepted"), F.when(F.col("seq") % 3 == 0, F.col("seq") % 100 / 100.0).alias("confidence"), F.col("seq").alias("ord"))


_FUSE = """, c AS (SELECT 'k' || CAST(seq % 97 AS VARCHAR) AS canonical_key, CASE WHEN seq % 3 = 0 THEN 'fallback' ELSE 'deterministic' END AS source, current_strength AS score, current_strength > 0.5 AS accepted, CASE WHEN seq % 3 = 0 THEN seq % 100 / 100.0 END AS confidence, seq AS ord FROM memories),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY ord) AS rn FROM c WHERE source = 'deterministic') WHERE rn = 1),
f AS (SELECT *, accepted OR score >= 0.45 + 0.03 OR coalesce(confidence, 0) >= 0.72 AS loose, accepted AND (score >= 0.45 + 0.08 OR coalesce(confidence, 0) >= 0.72) AS strict FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY ord) AS rn FROM c WHERE source = 'fallback') WHERE rn = 1)
SELECT coalesce(d.canonical_key, f.canonical_key) AS canonical_key, CASE WHEN d.canonical_key IS NOT NULL AND f.canonical_key IS NOT NULL THEN d.accepted OR f.loose WHEN d.canonical_key IS NOT NULL THEN d.accepted ELSE f.strict END AS accepted,
CASE WHEN d.canonical_key IS NOT NULL AND f.canonical_key IS NOT NULL THEN CASE WHEN d.accepted THEN 'deterministic' ELSE 'fallback' END WHEN d.canonical_key IS NOT NULL THEN 'deterministic' ELSE 'fallback' END AS source,
CASE WHEN d.canonical_key IS NOT NULL AND f.canonical_key IS NOT NULL THEN d.accepted AND f.loose ELSE false END AS agreement FROM d FULL OUTER JOIN f ON d.canonical_key = f.canonical_key"""
_mem("candidate_fusion", lambda m: learning.fuse(_candidates(m)), _FUSE)
_mem(
    "fusion_self_join",
    lambda m: learning.fusion_pairs(_candidates(m)).select("canonical_key", F.col("d.score").alias("d_score"), F.col("d.accepted").alias("d_accepted"), F.col("f.score").alias("f_score"), F.col("f.confidence").alias("f_confidence")),
    _FUSE.split("SELECT coalesce(d.canonical_key")[0]
    + "SELECT coalesce(d.canonical_key, f.canonical_key) AS canonical_key, d.score AS d_score, d.accepted AS d_accepted, f.score AS f_score, f.confidence AS f_confidence FROM d FULL OUTER JOIN f ON d.canonical_key = f.canonical_key",
)


def _policy(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row as stored, and as a candidate whose key ends one further, so that some keys meet and others don't."""
    scope = F.get("source_conversation_ids", F.lit(0)).alias("scope")
    base = m.select("*", scope, text.predicate(F.col("types")).alias("predicate"), F.array_join(F.array_sort("entities"), "+").alias("object"), text.temporal_bucket(F.col("content")).alias("bucket"))
    key = lambda n: F.concat_ws("|", "predicate", "object", ((F.col("seq") + n) % 3).cast("string"))
    asked = base.select("id", "scope", key(60).alias("canonical_key"), "predicate", F.concat("object", F.when(F.col("seq") % 4 == 0, "").otherwise("x")).alias("object"), "bucket")
    return asked, base.withColumn("canonical_key", key(1))


_POLICY = f""", b AS (SELECT *, source_conversation_ids[1] AS scope, {duck_case('types[1]', PREDICATE)} AS predicate, array_to_string(list_sort(entities), '+') AS object,
    {duck_case('lower(content)', dict(text.BUCKETS), "'unspecified'", True)} AS bucket FROM memories),
k AS (SELECT id, seq, scope, predicate, object || CASE WHEN seq % 4 = 0 THEN '' ELSE 'x' END AS object, bucket, predicate || '|' || object || '|' || CAST((seq + 60) % 3 AS VARCHAR) AS canonical_key FROM b),
a AS (SELECT *, predicate || '|' || object || '|' || CAST((seq + 1) % 3 AS VARCHAR) AS canonical_key FROM b WHERE status = 'active'),
s AS (SELECT scope, canonical_key, min(id) AS same_id FROM a GROUP BY scope, canonical_key),
n AS (SELECT * FROM (SELECT scope, predicate, id AS best_id, object AS best_object, row_number() OVER (PARTITION BY scope, predicate ORDER BY updated_at DESC, seq) AS rn FROM a) WHERE rn = 1),
j AS (SELECT k.id, k.object, k.bucket, same_id, best_id, best_object,
    CASE WHEN same_id IS NOT NULL THEN 'IGNORE' WHEN best_id IS NULL THEN 'ADD' WHEN bucket IN ('transition', 'past') THEN 'SUPERSEDE' WHEN best_object <> k.object THEN 'UPDATE' ELSE 'ADD' END AS action
    FROM k LEFT JOIN s ON s.scope = k.scope AND s.canonical_key = k.canonical_key LEFT JOIN n ON n.scope = k.scope AND n.predicate = k.predicate)
"""
_mem(
    "write_policy",
    lambda m: learning.decide(*_policy(m)),
    _POLICY + """SELECT id, action, CASE WHEN same_id IS NOT NULL THEN 'EXACT_CANONICAL_DUPLICATE' WHEN best_id IS NULL THEN 'NO_ACTIVE_MATCH' WHEN bucket IN ('transition', 'past') THEN 'TRANSITIONAL_REPLACEMENT'
    WHEN best_object <> object THEN 'SAME_PREDICATE_NEW_VALUE' ELSE 'LOW_CONFIDENCE_MATCH' END AS reason, CASE WHEN same_id IS NOT NULL THEN same_id WHEN action IN ('SUPERSEDE', 'UPDATE') THEN best_id END AS target_id FROM j""",
)
_mem(
    "policy_match_join",
    lambda m: learning.policy_matches(*_policy(m)).select("id", "same_id", F.col("best.id").alias("best_id"), F.col("best.object").alias("best_object")),
    _POLICY + "SELECT id, same_id, best_id, best_object FROM j",
)

# --------------------------------------------------------------------------- text
_docs = lambda s, d: read(s, d, "documents").select("doc_id", "text")
_utter = lambda s, d: utterances(s, d)


def _text(name: str, col: str, f: Callable[[Column], Column], sql: str) -> None:
    """A scalar of documents' texts or of the utterances, with its SQL over ``t``."""
    _add(name, lambda s, d: _docs(s, d).select("doc_id", f(F.col("text")).alias(col)), f"SELECT doc_id, {sql.replace('{t}', 'text')} AS {col} FROM documents")
    _add(f"{name}_utterances", lambda s, d: _utter(s, d).select("conv_id", "pos", f(F.col("text")).alias(col)), f"{UTTER} SELECT conv_id, pos, {sql.replace('{t}', 'text')} AS {col} FROM utterances")


_SPACE = r"trim(regexp_replace({t}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_text("canonical_token", "token", text.canonical_token, _SPACE.replace("{t}", "lower({t})"))
_text("temporal_bucket", "bucket", text.temporal_bucket, duck_case("lower({t})", dict(text.BUCKETS), "'unspecified'", True))
_text("temporal_markers", "n", lambda c: F.size(text.markers(c)), "CAST(" + " + ".join(f"len(regexp_extract_all({{t}}, '(?i)\\b({duck_regex(p)})\\b'))" for p, _, _ in text.MARKERS) + " AS INTEGER)")
_ANY = f"regexp_matches({{t}}, '(?i)' || '{duck_regex('|'.join(rf'\b{p}\b' for p, _, _ in text.MARKERS))}')"
_text("change_type", "about", text.change_type, f"CASE WHEN {_ANY} THEN {duck_case('lower({t})', dict(text.CHANGES), chr(39) + 'general' + chr(39), True)} END")
_text("is_temporal_update", "updates", lambda c: text.is_temporal_update(c, F.lit("location")), f"coalesce(CASE WHEN {_ANY} THEN {duck_case('lower({t})', dict(text.CHANGES), chr(39) + 'general' + chr(39), True)} END IN ('location', 'general'), false)")
_text("ner_numbers", "found", lambda c: F.array_join(ner.numbers(c), ";"), "array_to_string(list_transform(list_concat(" + "list_concat(" + f"regexp_extract_all({{t}}, '(?i){duck_regex(packs.NUMBERS[0][1])}', 1), regexp_extract_all({{t}}, '(?i){duck_regex(packs.NUMBERS[1][1])}', 1)), list_concat(regexp_extract_all({{t}}, '(?i){duck_regex(packs.NUMBERS[2][1])}', 1), regexp_extract_all({{t}}, '{{plain}}', 1))), lambda x: replace(x, ',', '')), ';')".replace("{plain}", duck_regex(packs.NUMBERS[3][1])))
_text("ner_emails", "found", lambda c: F.array_join(ner.emails(c), ";"), f"array_to_string(list_transform(regexp_extract_all({{t}}, '{duck_regex(packs.EMAIL)}', 1), lambda x: lower(x)), ';')")
_text("ner_named", "found", lambda c: F.array_join(ner.named(c), ";"), f"array_to_string(list_transform(regexp_extract_all({{t}}, '{duck_regex(packs.NAMED)}', 1), lambda x: lower(x)), ';')")
_text("classify_types", "kinds", lambda c: F.array_join(ner.types_by_words(c), ","), "concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(lower({{t}}), '{duck_regex(p)}')" + (f" OR regexp_matches(lower({{t}}), '\\b(?:{'|'.join(packs.PROFESSIONS)})\\b')" if n == "profession" else "") + (f" OR (regexp_matches(lower({{t}}), '{packs.STATUS}') AND NOT regexp_matches(lower({{t}}), '{packs.IDIOM}'))" if n == "relational" else "") + f" THEN '{n}' END" for n, p in packs.CLASSIFY) + ")")
_add("ner_possessions", lambda s, d: _utter(s, d).select("conv_id", "pos", F.array_join(ner.possessions(F.col("text")), ";").alias("found")), f"{UTTER} SELECT conv_id, pos, array_to_string(list_transform(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in packs.POSSESSIONS[:2]) + f"), regexp_extract_all(text, '(?i){packs.POSSESSIONS[2]}', 1)), lambda x: lower(x)), ';') AS found FROM utterances")


def _normal_sql(t: str) -> str:
    out = f"lower(trim(regexp_replace(regexp_replace({t}, '[''`‘’]', '''', 'g'), '\\s+', ' ', 'g')))"
    for p, n in text.CONTRACTIONS:
        out = f"regexp_replace({out}, '(?i)\\b{p}\\b', '{n.replace(chr(39), chr(39) * 2)}', 'g')"
    return out


_add("normalize_text", lambda s, d: _utter(s, d).select("conv_id", "pos", text.match_form(F.col("text")).alias("normal")), f"{UTTER} SELECT conv_id, pos, {_normal_sql('text')} AS normal FROM utterances")
_add("normalize_text_extraction", lambda s, d: _docs(s, d).select("doc_id", text.extraction_form(F.col("text"), False).alias("normal")))
_add("normalization_ops", lambda s, d: _utter(s, d).select("conv_id", "pos", F.array_join(text.normal_operations(F.col("text")), ",").alias("ops")), f"{UTTER} SELECT conv_id, pos, concat_ws(',', CASE WHEN regexp_replace(text, '[''`‘’]', '''', 'g') <> text THEN 'apostrophe_normalized' END, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> text THEN 'whitespace_collapsed' END, CASE WHEN {_normal_sql('text')} <> lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) THEN 'contractions_normalized' END, CASE WHEN lower(text) <> text THEN 'lowercased' END) AS ops FROM utterances")
_mem("canonical_predicate", lambda m: m.select("id", text.predicate(F.col("types")).alias("predicate")), f"SELECT id, {duck_case('types[1]', PREDICATE)} AS predicate FROM memories")
_mem("entity_signature", lambda m: m.select("id", F.array_join(F.array_sort("entities"), "+").alias("object")), "SELECT id, array_to_string(list_sort(entities), '+') AS object FROM memories")
_mem("join_types", lambda m: m.select("id", F.array_join("types", ", ").alias("kinds")), "SELECT id, array_to_string(types, ', ') AS kinds FROM memories")
_B36 = "(SELECT string_agg(substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((x // (36 ** (6 - i))::BIGINT) % 36 AS INTEGER) + 1, 1), '' ORDER BY i) FROM range(0, 7) AS g(i))"
_base36 = lambda v: f"(SELECT CASE WHEN h < 0 THEN '-' ELSE '' END || CASE WHEN h = 0 THEN '0' ELSE ltrim({_B36.replace('x //', 'abs(h) //')}, '0') END FROM (SELECT {v} AS h))"
_codes = lambda t: f"list_prepend(CAST({{seed}} AS BIGINT), list_transform(list_filter(string_split({t}, ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS BIGINT)))"
_fold = lambda t, seed, step: f"list_reduce({_codes(t).replace('{seed}', str(seed))}, lambda h, c: {step})"
_sign = lambda v: f"(SELECT CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END FROM (SELECT {v} AS u))"
_HASHED = "replace(id, 'm', 'x') || '|' || conflict_domain"


def _hashed() -> Column:
    return F.concat(F.replace(F.col("id"), F.lit("m"), F.lit("x")), F.lit("|"), F.col("conflict_domain"))


_mem("content_hash", lambda m: m.select("id", text.content_hash(_hashed()).alias("hash")), f"SELECT id, {_base36(_sign(_fold(_HASHED, 0, '(h * 31 + c) & 4294967295')))} AS hash FROM memories")
_mem("entity_id", lambda m: m.select("id", text.entity_id(F.lit("person"), _hashed()).alias("entity")), f"SELECT id, 'ent_person_' || {_base36(_fold(_HASHED, 2166136261, '(xor(h, c) * 16777619) & 4294967295'))} AS entity FROM memories")
_mem("canonical_key", lambda m: m.select("id", text.canonical_key(F.lit("global"), F.lit("user"), text.predicate(F.col("types")), _hashed(), F.lit("unspecified")).alias("key")), f"SELECT id, 'ck_' || {_base36('abs(' + _sign(_fold('concat_ws(' + chr(39) + '|' + chr(39) + ', ' + chr(39) + 'global' + chr(39) + ', ' + chr(39) + 'user' + chr(39) + ', ' + duck_case('types[1]', PREDICATE) + ', ' + _HASHED + ', ' + chr(39) + 'unspecified' + chr(39) + ')', 5381, '(h * 33 + c) & 4294967295')) + ')')} AS key FROM memories")
_add("normalize_mention", lambda s, d: read(s, d, "customer").select("c_custkey", text.mention_form(F.lit("person"), F.concat(F.lit(" My  Friend "), F.col("c_name"))).alias("said")), r"SELECT c_custkey, trim(regexp_replace(trim(regexp_replace(lower(' My  Friend ' || c_name), '\s+', ' ', 'g')), '^(?:my|our)\s+(?:wife|husband|partner|friend)\s+', '')) AS said FROM customer")
_add("is_pronoun", lambda s, d: read(s, d, "customer").select("c_custkey", text.is_pronoun(F.when(F.col("c_custkey") % 2 == 0, F.lit(" They")).otherwise(F.col("c_name"))).alias("pronoun")), "SELECT c_custkey, c_custkey % 2 = 0 AS pronoun FROM customer")
_add("levenshtein", lambda s, d: read(s, d, "customer").select("c_custkey", F.levenshtein("c_name", F.lit("Customer#000000042"), 2).alias("edits")), "SELECT c_custkey, CAST(CASE WHEN levenshtein(c_name, 'Customer#000000042') <= 2 THEN levenshtein(c_name, 'Customer#000000042') ELSE -1 END AS INTEGER) AS edits FROM customer")
_RISKS = f"concat_ws(',', CASE WHEN rep >= 0.6 THEN 'REPETITIVE_NOISE' END, CASE WHEN pos % 2 = 0 THEN 'LOW_STRUCTURE_HIGH_SCORE' END, CASE WHEN regexp_matches(lower(text), '{text.RISK_MARKERS}') AND bucket = 'unspecified' THEN 'AMBIGUOUS_TEMPORAL' END)"
_BUCKET = duck_case("lower(text)", dict(text.BUCKETS), "'unspecified'", True)
_add("risk_validate", lambda s, d: _utter(s, d).select("conv_id", "pos", F.array_join(text.risk_signals(F.col("text"), F.lit(0.5), F.lit(0.45), (F.col("pos") % 2), F.lit(0), text.temporal_bucket(F.col("text"))), ",").alias("signals")), f"{UTTER} SELECT conv_id, pos, {_RISKS} AS signals FROM (SELECT *, {_BUCKET} AS bucket, CASE WHEN pos = 4 THEN 1.0 ELSE 0.0 END AS rep FROM utterances)")
_FIRST, _CUES = duck_regex(text.FIRST_PERSON), duck_regex(text.FACT_CUES)
_add("ambiguity_trigger", lambda s, d: _utter(s, d).select("conv_id", "pos", F.array_join(text.ambiguity_reasons(F.col("text"), F.lit(0.5), F.lit(0.45), F.array(F.lit("identity")), F.col("pos") % 2, text.temporal_bucket(F.col("text"))), ",").alias("reasons")), f"{UTTER} SELECT conv_id, pos, concat_ws(',', 'GRAY_ZONE_SCORE', CASE WHEN regexp_matches(lower(text), '{_FIRST}') AND regexp_matches(lower(text), '{_CUES}') AND pos % 2 = 0 THEN 'PERSONAL_FACT_CUE' END, CASE WHEN regexp_matches(lower(text), '{text.PRONOUNS}') AND pos % 2 = 0 THEN 'PRONOUN_RELATION_AMBIGUITY' END, CASE WHEN regexp_matches(lower(text), '{text.TRIGGER_MARKERS}') AND bucket = 'unspecified' THEN 'UNRESOLVED_TEMPORAL_SHIFT' END) AS reasons FROM (SELECT *, {_BUCKET} AS bucket FROM utterances)")
_FB = ", ".join(f"CASE WHEN trim(regexp_extract(trim(text), '{p}', 1)) <> '' THEN '{told}' || trim(regexp_extract(trim(text), '{p}', 1)) || '@{c}' END" for p, told, c in text.FALLBACKS)
_add("fallback_pattern", lambda s, d: _utter(s, d).select("conv_id", "pos", F.array_join(F.transform(text.fallback_facts(F.col("text")), lambda x: F.concat(x["text"], F.lit("@"), x["confidence"].cast("string"))), ";").alias("facts")), f"{UTTER} SELECT conv_id, pos, concat_ws(';', {_FB}) AS facts FROM utterances")
_add("basic_specificity", lambda s, d: _utter(s, d).select("conv_id", "pos", _r(ner.basic_specificity(F.col("text"))).alias("score")), f"{UTTER} SELECT conv_id, pos, round(CASE WHEN regexp_matches(text, '(?i){duck_regex(packs.NUMBERS[0][1])}') OR regexp_matches(text, '(?i){duck_regex(packs.NUMBERS[1][1])}') OR regexp_matches(text, '{duck_regex(packs.NUMBERS[2][1])}') OR regexp_matches(text, '{duck_regex(packs.NUMBERS[3][1])}') THEN 0.2 ELSE 0.0 END + CASE WHEN " + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in packs.POSSESSIONS) + " THEN 0.1 ELSE 0.0 END, 6) AS score FROM utterances")

# --------------------------------------------------------------------------- packs, learning, streams: no SQL
_analyzed = lambda s, d: _utter(s, d).withColumn("a", ner.analyze(F.col("text"), F.lit(NOW_MS)))
_add("specificity_score", lambda s, d: _analyzed(s, d).select("conv_id", "pos", _r("a.specificity").alias("specificity"), F.array_join("a.types", ",").alias("kinds")))
def _signals(s: SparkSession, d: str, pack: str) -> DataFrame:
    """What a rule pack finds in its own sentences and in all documents."""
    said = sayings(s, d, pack).select(F.concat_ws(":", F.lit("said"), "conv_id", "pos").alias("source_id"), "text")
    texts = said.unionByName(_docs(s, d).select(F.concat_ws(":", F.lit("doc"), "doc_id").alias("source_id"), "text"))
    found = texts.select("source_id", ner.analyze(F.col("text"), F.lit(NOW_MS), pack).alias("a"))
    return found.select("source_id", F.explode("a.signals").alias("x")).select("source_id", "x.kind", "x.value")


for _pack in packs.PACKS:
    _add(f"ner_{_pack}" if _pack != "numbers" else "ner_number_signals", lambda s, d, p=_pack: _signals(s, d, p))
_add("evaluate_candidate", lambda s, d: learning.evaluate(_utter(s, d), NOW_MS).select("conv_id", "pos", _r("score").alias("score"), "predicate", "object", "bucket", "canonical_key", "accepted"))
_add("entity_link", lambda s, d: learning.link_entities(_analyzed(s, d).select(F.col("conv_id").alias("scope"), "conv_id", "pos", F.explode("a.entities").alias("e")).select("scope", "conv_id", "pos", "e.kind", "e.value")))
_add("learn", lambda s, d: learning.learn(_utter(s, d), canonical(memories(s, d)), NOW_MS).drop("types", "entities"))


def _learned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memory table, the table after learning all utterances, contradictions)."""
    m = cut(canonical(memories(s, d)))  # read by each step
    return m, *learning.write(learning.learn(_utter(s, d), m, NOW_MS), m, NOW_MS, _low)


def _learn_events(s: SparkSession, d: str) -> DataFrame:
    from memengine.streaming.streams import all_changes

    return all_changes(*_learned(s, d), NOW_MS).select("event_type", "memory_id", "ts")


_add("learn_write", lambda s, d: _learned(s, d)[1].select("id", "status", "created_at", "superseded_by", "superseded_at", "valid_to", "scope", "predicate", "object"))
_add("learn_events", _learn_events)
_add("fallback_llm", lambda s, d: learning.model_fallback(_utter(s, d), lambda said: '```json\n{"facts": [{"text": "said"}]}\n```' if said.startswith("I live") else "none"))
_LIVES = lambda said: '{"facts": ["lives there"]}' if said.startswith("I live") else "no"
_add("fallback_chained", lambda s, d: learning.chained(_utter(s, d), [lambda f: learning.model_fallback(f, _LIVES), learning.pattern_fallback]))
_add("eval_gates", lambda s, d: evals.measure(s, NOW_MS))
_add("fallback_noop", lambda s, d: learning.noop(_utter(s, d)), "SELECT CAST(0 AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS pos, '' AS text, CAST(0 AS DOUBLE) AS confidence WHERE false")


def _events(s: SparkSession, d: str) -> DataFrame:
    from memengine.streaming.streams import changes

    m = memories(s, d)
    return changes(m, lifecycle.sweep(m, NOW_MS), NOW_MS).select("event_type", "memory_id", "ts")


_add("events", _events, MEM + f", d AS (SELECT *, {_DECAY} AS cs FROM memories), f AS (SELECT id, status AS bs, CASE WHEN status = 'active' AND cs < 0.1 AND NOT pinned THEN 'faded' ELSE status END AS st, faded_at FROM d) SELECT CASE WHEN bs = 'faded' THEN 'MEMORY_DELETED' ELSE 'MEMORY_FADED' END AS event_type, id AS memory_id, {NOW} AS ts FROM f WHERE (bs = 'faded' AND faded_at < {NOW_MS - 30 * DAY_MS}) OR (bs <> 'faded' AND st = 'faded')")
_add("session_windows", lambda s, d: read(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n"),
     "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM h GROUP BY user_id, s")


def _learn_stream(s: SparkSession, d: str) -> DataFrame:
    from memengine.streaming import replay, streams

    said = utterances_of(replay.table_stream(s, d, "customer")).select("conv_id", F.col("pos").cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    return replay.replay(streams.learn_stream(said, NOW_MS))


def _debounce_stream(s: SparkSession, d: str) -> DataFrame:
    """The same windows as ``debounce``, from a stream; a last row far ahead closes all windows."""
    from memengine.streaming import replay, streams

    rows = read(s, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    e = replay.stream_of(rows.repartition(4, "id"), rows.agg(F.lit("").alias("id"), (F.max("ts") + F.expr("interval 1 day")).alias("ts")))
    return replay.replay(streams.debounced(e)).select("id", F.col("window_ms").cast("long").alias("window_ms"), "n")


def _event_bridge(s: SparkSession, d: str) -> DataFrame:
    """Changes of a sweep as a stream, handed on by type; what each sink got."""
    from memengine.streaming import replay, streams

    folder = replay.shared_folder(s)
    sinks = {name: (lambda batch, name=name: batch.write.mode("append").parquet(f"{folder}/{name}")) for name in streams.EVENTS}
    q = streams.bridge(replay.stream_of(_events(s, d)), sinks, f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [s.read.schema("event_type string, memory_id string, ts long").parquet(f"{folder}/{name}") for name in streams.EVENTS]
    out = got[0]
    for more in got[1:]:
        out = out.unionByName(more)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _periodic_sweep(s: SparkSession, d: str) -> DataFrame:
    """Two ticks of a clock, a day apart: the table after the second sweep."""
    from memengine.streaming import replay, streams

    folder = replay.shared_folder(s)
    memories(s, d).write.parquet(f"{folder}/table-0")
    done = []

    def store_next(after: DataFrame) -> None:
        after.write.parquet(f"{folder}/table-{len(done) + 1}")
        done.append(1)

    ticks = [s.range(1).select(F.timestamp_millis(F.lit(NOW_MS + k * DAY_MS)).alias("timestamp")) for k in (0, 1)]
    clock = replay.stream_of(*ticks)
    q = streams.periodic_sweep(clock, lambda: s.read.parquet(f"{folder}/table-{len(done)}"), store_next, f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{folder}/table-{len(done)}").select("id", "status", _r("current_strength").alias("current_strength"), "faded_at")


_add("learn_stream", _learn_stream)
_add("debounce_stream", _debounce_stream, "SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) // 5000000 * 5000 AS window_ms, count(*) AS n FROM events GROUP BY ALL")
_add(
    "periodic_sweep",
    _periodic_sweep,
    MEM + f", d1 AS (SELECT *, {_DECAY} AS cs FROM memories), f1 AS (SELECT * REPLACE (CASE WHEN status = 'active' AND cs < 0.1 AND NOT pinned THEN 'faded' ELSE status END AS status, CASE WHEN status = 'active' AND cs < 0.1 AND NOT pinned THEN {NOW} ELSE faded_at END AS faded_at) FROM d1), "
    f"k1 AS (SELECT * FROM f1 WHERE NOT coalesce(status = 'faded' AND faded_at < {NOW_MS - 30 * DAY_MS}, false)), d2 AS (SELECT *, {_DECAY.replace(str(NOW_MS), str(NOW_MS + DAY_MS))} AS cs2 FROM k1), "
    f"f2 AS (SELECT * REPLACE (CASE WHEN status = 'active' AND cs2 < 0.1 AND NOT pinned THEN 'faded' ELSE status END AS status, CASE WHEN status = 'active' AND cs2 < 0.1 AND NOT pinned THEN {NOW_MS + DAY_MS} ELSE faded_at END AS faded_at) FROM d2) "
    f"SELECT id, status, round(cs2, 6) AS current_strength, faded_at FROM f2 WHERE NOT coalesce(status = 'faded' AND faded_at < {NOW_MS + DAY_MS - 30 * DAY_MS}, false)",
)
_add("event_bridge", _event_bridge, f"SELECT event_type, count(*) AS n FROM ({ORACLE_SQL['events']}) GROUP BY event_type")
_add("storage_health", lambda s, d: read(s, d, "documents").select("doc_id", store.error_kind(F.col("text")).alias("kind")), "SELECT doc_id, CASE WHEN contains(lower(text), 'quota') THEN 'quota' WHEN regexp_matches(lower(text), 'corrupt|invalid') THEN 'corruption' WHEN regexp_matches(lower(text), 'version|migrat|upgrade') THEN 'migration' ELSE 'unknown' END AS kind FROM documents")
_mem("embed", lambda m: m.select("id", vectors_of(F.col("content")).alias("v")).select("id", F.posexplode("v").alias("pos", "x")).filter("x <> 0").select("id", "pos", _r("x", 5).alias("x")), None)
_add("validate_lambda", lambda s, d: _rates(s), "SELECT * FROM (VALUES ('negative', false), ('published', true), ('zero', true)) AS t(rates, accepted)")


def _rates(s: SparkSession) -> DataFrame:
    """Which sets of decay rates the check accepts."""

    def fine(rates: dict[str, float]) -> bool:
        try:
            validate_lambdas(rates)
        except ValueError:
            return False
        return True

    return s.createDataFrame([("published", fine(LAMBDA)), ("zero", fine({"identity": 0.0})), ("negative", fine({"identity": 1e-3, "location": -1e-9}))], "rates string, accepted boolean")


def vectors_of(c: Column) -> Column:
    from memengine.functions.embed import hashed_vector

    return hashed_vector(c)
