"""Operators without SQL, and edge cases, against plain Python."""

import base64
import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memengine.config import DAY_MS, Config, validate_lambdas
from memengine.functions import embed, ner, scoring, text, vectors
from memengine.operators import learning, lifecycle, query, retrieval
from memengine.sources import store
from memengine.sources.tables import MEMORY_SCHEMA, empty_memories
from memengine.streaming import streams

NOW = 1_706_745_600_000
HOUR = 3_600_000


def row(i, **kw):
    base = dict(
        id=f"m{i}", content=f"fact {i}", types=["preference"], status="active", created_at=NOW - 10 * HOUR, updated_at=NOW - 10 * HOUR, valid_from=NOW, valid_to=None,
        base_strength=1.0, current_strength=1.0, pinned=False, mention_count=1, last_accessed_at=NOW - HOUR, cluster_id=None, entities=[], source_conversation_ids=["c"],
        superseded_by=None, superseded_at=None, faded_at=None, deleted_at=None, conflict_domain="preference", embedding=[1.0, 0.0],
    )
    return base | kw


def table(spark, *rows):
    names = [c.split()[0] for c in MEMORY_SCHEMA.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], MEMORY_SCHEMA)


def by_id(frame):
    return {r.id: r for r in frame.collect()}


def test_decay_at_the_edges(spark):
    t = table(
        spark,
        row(1, pinned=True, last_accessed_at=NOW - 10**6 * HOUR),
        row(2, types=["emotional"], last_accessed_at=NOW - 100 * HOUR),
        row(3, types=[], last_accessed_at=NOW - 100 * HOUR),
        row(4, last_accessed_at=0, created_at=NOW - 50 * HOUR),
        row(5, types=["identity", "location"], last_accessed_at=NOW - 1000 * HOUR),
    )
    got = by_id(lifecycle.decay(t, NOW))
    assert got["m1"].current_strength == 1.0
    assert got["m2"].current_strength == pytest.approx(math.exp(-0.1)) and got["m3"].current_strength == pytest.approx(math.exp(-0.1))
    assert got["m4"].current_strength == pytest.approx(math.exp(-0.05)) and got["m5"].current_strength == pytest.approx(math.exp(-0.1))
    assert by_id(lifecycle.decay(t, NOW, Config(strict=False)))["m2"].current_strength == pytest.approx(math.exp(-1))
    with pytest.raises(ValueError):
        validate_lambdas({"identity": -1})


def test_sweep(spark):
    old = NOW - 10**5 * HOUR
    t = table(
        spark,
        row(1, last_accessed_at=old), row(2, last_accessed_at=old, pinned=True), row(3, status="faded", faded_at=NOW - 29 * DAY_MS), row(4, status="faded", faded_at=NOW - 31 * DAY_MS),
        row(5, status="archived", last_accessed_at=old), row(6, status="faded", faded_at=None),
    )
    once = lifecycle.sweep(t, NOW)
    got = by_id(once)
    assert set(got) == {"m1", "m2", "m3", "m5", "m6"} and got["m1"].status == "faded" and got["m1"].faded_at == NOW and got["m2"].status == "active" and got["m5"].status == "archived"
    assert sorted(map(str, lifecycle.sweep(once, NOW).collect())) == sorted(map(str, once.collect()))


def test_reinforce_drops_a_gain_past_the_maximum(spark):
    t = table(spark, row(1, base_strength=2.8, types=["identity"]), row(2, base_strength=2.5, types=["identity"]), row(3, types=["temporal"]))
    hits = spark.createDataFrame([("m1", 1), ("m2", 2), ("m2", 3), ("m9", 4)], "id string, ts_ms long")
    got = by_id(lifecycle.reinforce(t, hits, NOW))
    assert (got["m1"].base_strength, got["m2"].base_strength, got["m3"].base_strength) == (2.8, 3.0, 1.0)
    assert got["m2"].mention_count == 2 and got["m1"].mention_count == 1


def test_lineage_stops_at_ends_and_cycles(spark):
    t = table(spark, row(1, superseded_by="m2"), row(2, superseded_by="m3"), row(3, superseded_by="m4"), row(4), row(5, superseded_by="gone"), row(6, superseded_by="m7"), row(7, superseded_by="m6"))
    got = by_id(lifecycle.lineage(t))
    assert (got["m1"].last_id, got["m1"].hops) == ("m4", 3) and got["m4"].hops == 0 and got["m5"].last_id == "m5"
    assert got["m6"].last_id in ("m6", "m7")


def test_empty_store(spark):
    e = empty_memories(spark)
    assert lifecycle.sweep(e, NOW).count() == 0 and query.stats(e).first().avg_strength == 0 and lifecycle.kmeans(e).count() == 0
    assert retrieval.vector_search(e, [1.0, 0.0], NOW).count() == 0 and retrieval.format_block(retrieval.vector_search(e, [1.0, 0.0], NOW)).first().block == ""
    assert retrieval.novelty(e, [1.0, 0.0], NOW).first().novelty == 1.0


def test_vector_search_floor_bonus_and_ties(spark):
    t = table(
        spark,
        row(1, embedding=[1.0, 0.0], cluster_id="a"), row(2, embedding=[0.8, 0.6], cluster_id="a"), row(3, embedding=[0.8, 0.6]), row(4, embedding=[0.0, 0.0], current_strength=0.0, last_accessed_at=NOW - 10**4 * HOUR),
        row(5, embedding=[0.8, 0.6], status="faded"), row(6, embedding=[0.8, 0.6, 0.0]),
    )
    got = retrieval.vector_search(t, [1.0, 0.0], NOW).collect()
    assert [r.id for r in got] == ["m1", "m2", "m3"] and got[1].score - got[2].score == pytest.approx(0.05)
    assert [r.id for r in retrieval.vector_search(t, [1.0, 0.0], NOW, 1).collect()] == ["m1"]
    near = vectors.nearest(t.filter("status = 'active'"), np.array([[1.0, 0.0], [0.0, 1.0]]), ["x", "y"], 2)
    assert [(r.query, r.id) for r in near.orderBy("query", "rank").collect()] == [("x", "m1"), ("x", "m2"), ("y", "m2"), ("y", "m3")]


def test_budget_stops_at_the_first_overflow(spark):
    ranked = table(spark, row(1, content="x" * 40), row(2, content="y" * 400), row(3, content="z")).withColumn("rank", F.substring("id", 2, 1).cast("int"))
    assert [r.id for r in retrieval.within_budget(ranked, 50).collect()] == ["m1"]
    assert retrieval.within_budget(ranked, 0).count() == 0 and retrieval.within_budget(ranked, 10**6).count() == 3


def test_block_and_system_turn(spark):
    t = table(spark, row(1, current_strength=0.9, pinned=True), row(2, current_strength=0.5), row(3, current_strength=0.1)).withColumn("rank", F.substring("id", 2, 1).cast("int"))
    block = retrieval.format_block(t).first().block.split("\n")
    assert block[1:4] == ["- fact 1 (confidence: high (pinned))", "- fact 2 (confidence: medium)", "- fact 3 (confidence: low)"] and len(block) == 5
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (2, 5, "user", "yo")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, retrieval.inject_system(turns, F.lit("B")).collect()))
    assert got == [(1, 0, "system", "B\n\nbe kind"), (1, 1, "user", "hi"), (2, 4, "system", "B"), (2, 5, "user", "yo")]
    assert retrieval.inject_system(turns, F.lit("")).count() == 3


def test_create_refuses_duplicates(spark):
    a = table(spark, row(1))
    assert store.create(a, table(spark, row(2))).count() == 2
    for bad in (table(spark, row(1)), table(spark, row(2), row(2))):
        with pytest.raises(Exception, match="duplicate id"):
            store.create(a, bad).collect()


def test_export(spark):
    r = store.export_json(table(spark, row(1, embedding=[0.5, -1.0]), row(2, embedding=None))).orderBy("id").collect()
    one = json.loads(r[0].value)
    assert struct.unpack("<2f", base64.b64decode(one["embedding_base64"])) == (0.5, -1.0) and "embedding_base64" not in json.loads(r[1].value)


def test_kmeans_separates_groups(spark):
    rng = np.random.default_rng(1)
    rows = [row(i, embedding=[float(x) for x in rng.normal(0, 0.05, 2) + (5, 5) * np.array([i % 2, i // 2 % 2])]) for i in range(80)]
    out = by_id(lifecycle.kmeans(table(spark, *rows), cfg=Config(clusters=4)))
    groups = {}
    for i in range(80):
        groups.setdefault(i % 4, set()).add(out[f"m{i}"].cluster_id)
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == 4


def py_fold(value, seed, step):
    for c in value:
        seed = step(seed, ord(c)) & 0xFFFFFFFF
    return seed


def to36(n):
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = text.DIGITS36[r] + out
    return out or "0"


def test_hashes(spark):
    words = ["", "a", "hello world", "x" * 200, "global|user|is|e1|current"]
    f = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.content_hash(F.col("w")).alias("h"), text.entity_id(F.lit("p"), F.col("w")).alias("e"), text.base36(F.abs(text.djb2(F.col("w")))).alias("d"))
    for r in f.collect():
        h = py_fold(r.w, 0, lambda a, c: a * 31 + c)
        h -= 2**32 if h >= 2**31 else 0
        d = py_fold(r.w, 5381, lambda a, c: a * 33 + c)
        d -= 2**32 if d >= 2**31 else 0
        assert r.h == ("-" if h < 0 else "") + to36(abs(h)) and r.d == to36(abs(d))
        assert r.e == "ent_p_" + to36(py_fold(r.w, 2166136261, lambda a, c: (a ^ c) * 16777619)) == ner.entity_id("p", r.w)


def test_normal_forms(spark):
    f = spark.createDataFrame([("Im here,  dont  GO",), ("It’s ﬁne ok",), ("ILL be DONT",)], "t string")
    got = f.select(text.match_form(F.col("t"), False).alias("m"), text.extraction_form(F.col("t"), False).alias("x")).collect()
    assert got[0].m == "i'm here, don't go" and got[0].x == "I'm here, don't GO" and got[1].m == "it's fine ok" and got[2].x == "I'LL be DON'T"


SENTENCES = [
    ("I live in Lisbon.", "location", ("place", "lisbon")),
    ("My name is Maria Lopez.", "identity", ("person", "maria lopez")),
    ("I work as a nurse.", "profession", ("organization", "nurse")),
    ("I prefer tea over coffee.", "preference", ("preference", "tea over coffee")),
    ("I was born in 1990 and moved to Berlin", "location", ("place", "berlin")),
    ("Call me at 212-456-7890.", "identity", ("number", "+12124567890")),
    ("I'm allergic to peanuts.", "preference", ("preference", "peanuts")),
    ("My sister's name is Ana.", "relational", ("person", "ana")),
    ("See you at 5:30 pm", "temporal", ("date", "17:30")),
    ("I no longer drink coffee.", "temporal", ("negation", "no longer")),
    ("I graduated from Oxford in 2010.", "identity", ("organization", "oxford")),
    ("I go to bed at 11 pm", "temporal", ("preference", "11 pm")),
    ("write to ann@example.org", "identity", ("person", "ann@example.org")),
]


@pytest.mark.parametrize(("said", "kind", "entity"), SENTENCES)
def test_packs(said, kind, entity):
    a = ner.analyze_text(said, NOW)
    assert kind in a["types"] and entity in {(e["kind"], e["value"]) for e in a["entities"]} and 0 < a["specificity"] <= 1


@pytest.mark.parametrize("said", ["thanks a lot", "hello there", "ok", "", None, "I'm married to my work"])
def test_packs_stay_silent(said):
    a = ner.analyze_text(said, NOW)
    assert not [e for e in a["entities"] if e["kind"] in ("person", "place", "organization")]


def test_times():
    from datetime import datetime, timezone

    now = datetime(2024, 1, 31, tzinfo=timezone.utc)  # a Wednesday
    assert ner.relative_period("next", "month", now) == "2024-03-02" and ner.relative_period("last", "wednesday", now) == "2024-01-24"
    assert ner.resolve_time("relativeCount", "3 days ago", now) == "2024-01-28" and ner.resolve_time("duration", "2 weeks", now) == "1209600s"
    assert ner.resolve_time("absoluteDate", "March 5th, 2020", now) == "2020-03-05" and ner.resolve_time("dateNumeric", "2/30/20", now) == "2/30/20"


def test_linker():
    k = learning.Linker()
    a, how = k.link("c", "person", "Sarah")
    assert how == "new" and k.link("c", "person", "my friend sarah") == (a, "exact") and k.link("c", "person", "sarha") == (a, "fuzzy")
    assert k.link("c", "person", "she") == (a, "pronoun") and k.link("c", "place", "sarah")[1] == "new" and k.link("d", "person", "he")[1] == "new"


def test_linking_frame_is_ordered_within_scopes(spark):
    rows = [("u", 1, 2, "person", "sarha"), ("u", 1, 1, "person", "sarah"), ("u", 1, 3, "person", "her"), ("v", 1, 1, "person", "sarha")]
    got = {(r.scope, r.pos): r for r in learning.link_entities(spark.createDataFrame(rows, "scope string, conv_id long, pos long, kind string, value string")).collect()}
    assert [got["u", p].how for p in (1, 2, 3)] == ["new", "fuzzy", "pronoun"] and len({got["u", p].canonical_id for p in (1, 2, 3)}) == 1 and got["v", 1].how == "new"


def test_policy(spark):
    schema = "id string, canonical_key string, predicate string, object string, bucket string, status string, updated_at long, seq long, scope string"
    stored = spark.createDataFrame([("a", "k1", "is", "x", "current", "active", 1, 1, "u"), ("b", "k2", "is", "y", "current", "active", 2, 2, "u"), ("c", "k3", "feels", "z", "current", "faded", 3, 3, "u")], schema)
    new = spark.createDataFrame([("n1", "k1", "is", "x", "current"), ("n2", "k9", "is", "q", "current"), ("n3", "k9", "is", "y", "past"), ("n4", "k9", "is", "y", "current"), ("n5", "k9", "feels", "z", "current")], "id string, canonical_key string, predicate string, object string, bucket string").withColumn("scope", F.lit("u"))
    got = {r.id: (r.action, r.target_id) for r in learning.decide(new, stored).collect()}
    assert got == {"n1": ("IGNORE", "a"), "n2": ("UPDATE", "b"), "n3": ("SUPERSEDE", "b"), "n4": ("ADD", None), "n5": ("ADD", None)}
    # Another user's rows are no targets.
    assert {(r.action, r.target_id) for r in learning.decide(new.withColumn("scope", F.lit("v")), stored).collect()} == {("ADD", None)}


def test_learning_end_to_end(spark):
    said = spark.createDataFrame([(1, 0, "My name is Maria Lopez."), (1, 1, "I live in Lisbon."), (1, 2, "thanks thanks thanks thanks"), (1, 3, "I used to live in Oslo but now I live in Riga."), (2, 0, None), (2, 1, "")], "conv_id long, pos int, text string")
    from memengine.sources.tables import canonical

    mine = dict(types=["location"], content="I live in Oslo", entities=["ent_place_x"], conflict_domain="location")
    mem = canonical(table(spark, row(1, **mine, source_conversation_ids=["c1"]), row(2, **mine, source_conversation_ids=["c9"])).withColumn("seq", F.when(F.col("id") == "m1", 1).otherwise(2)))
    got = {(r.conv_id, r.pos): r for r in learning.learn(said, mem, NOW).collect() if r.origin == "deterministic"}
    assert got[1, 0].action == "ADD" and got[1, 1].action == "UPDATE" and got[1, 3].action == "SUPERSEDE" and (1, 2) not in got and (2, 0) not in got
    decided = learning.learn(said, mem, NOW)
    own = mem.filter("scope = 'c1'").first().id
    assert {r.target_id for r in decided.collect()} <= {None, own}
    after, found = learning.write(decided, mem, NOW)
    rows = {r.id: r for r in after.collect()}
    new = [r for r in rows.values() if r.created_at == NOW and r.content != "I live in Oslo"]
    assert {r.content for r in new} >= {"My name is Maria Lopez.", "I used to live in Oslo but now I live in Riga."} and "I live in Lisbon." not in {r.content for r in new}
    assert (rows[own].status, rows[own].superseded_at) == ("superseded", NOW) and rows[own].superseded_by in {r.id for r in new}
    assert [r.status for r in rows.values() if r.scope == "c9"] == ["active"]
    kinds = [r.event_type for r in streams.all_changes(mem, after, found, NOW).collect()]
    assert kinds.count("MEMORY_ADDED") == len(new) and kinds.count("MEMORY_SUPERSEDED") == 1 and kinds.count("STATS_CHANGED") == 1


def test_quality_gates(spark):
    from memengine.operators import evals

    rows = {r.metric: r for r in evals.measure(spark, NOW).collect()}
    assert set(rows) == set(evals.GATES) and all(r.passed for r in rows.values()), rows


def test_chained_fallbacks(spark):
    said = spark.createDataFrame([(1, 0, "I live in Rome."), (1, 1, "I prefer tea"), (2, 0, "no")], "conv_id long, pos int, text string")
    first = lambda f: learning.model_fallback(f, lambda t: '["fact"]' if t.startswith("I live") else "")
    got = {(r.conv_id, r.pos, r.text) for r in learning.chained(said, [first, learning.pattern_fallback]).collect()}
    assert (1, 0, "fact") in got and not any(k[:2] == (1, 0) and k[2] != "fact" for k in got)
    assert learning.chained(said, []).count() == learning.noop(said).count() == 0


def test_nearest_of_each_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{k:03d}", "g" + str(k % 3), rng.normal(size=6).tolist()) for k in range(120)]
    rows = [(i, g, (np.array(v) / np.linalg.norm(v)).tolist()) for i, g, v in rows] + [("z1", "g1", None), ("z2", None, [1.0] * 6), ("z3", "g1", [0.5, 0.5]), ("z4", "g2", rows[2][2])]
    frame = spark.createDataFrame(rows, "id string, grp string, embedding array<double>")
    fine = [(i, g, np.array(v)) for i, g, v in rows if v and g]

    def want(k, least):
        out = set()
        for a, g, x in fine:
            near = sorted((-round(float(np.clip(x @ y, 0, 1)), 12), b) for b, h, y in fine if h == g and b != a and x.size == y.size)
            out |= {(a, b) for s, b in [n for n in near if -n[0] >= least][:k]}
        return out

    for k, least, size in ((1, 0.0, 8 << 20), (7, 0.05, 2000), (None, 0.4, 3000)):
        got = vectors.nearest_of_each(frame, frame, k, least, "grp", size).collect()
        assert {(r.new_id, r.id) for r in got} == want(k, least) and len(got) == len(want(k, least))


def test_model_answers():
    assert ner.recover_facts('x {"facts": [{"text": "A", "confidence": 2}, {"text": "a ", "confidence": 0.1}, "B", 3]} y', 0.74) == [("A", 1.0), ("B", 0.74)]
    assert ner.recover_facts('```json\n["C"]\n```', 0.7) == [("C", 0.7)] and ner.recover_facts("nothing", 0.7) == [] and ner.recover_facts('{"facts": 3}', 0.7) == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_edit_distance(a, b):
    row_ = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row_[0] = row_[0], i
        for j, y in enumerate(b, 1):
            prev, row_[j] = row_[j], min(prev + (x != y), row_[j] + 1, row_[j - 1] + 1)
    assert ner.edit_distance(a, b, 2) == (row_[-1] if row_[-1] <= 2 else 3)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_embedding_is_a_unit_vector(t):
    n = float(np.linalg.norm(embed.embed_text(t)))
    assert n == 0 or abs(n - 1) < 1e-5


def test_streams(spark, tmp_path):
    from memengine.streaming import streams

    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "user", "I live in Oslo."), (1, 2, "assistant", "I live in Rome."), (1, 3, "user", "I used to live in Oslo but now I live in Riga."), (2, 1, "user", "hello")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(src))
    q = streams.learn_stream(stream, NOW).writeStream.format("memory").queryName("learned").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.turn, r.action) for r in spark.table("learned").orderBy("turn").collect()] == [(1, "ADD"), (3, "SUPERSEDE")]
    a = tmp_path / "acc"
    spark.sql("select 'm1' id, timestamp'2024-01-01 00:00:01' ts union all select 'm1', timestamp'2024-01-01 00:00:03' union all select 'm1', timestamp'2024-01-01 00:00:09' union all select 'm2', timestamp'2024-01-01 01:00:00'").coalesce(1).write.parquet(str(a))
    q = streams.debounced(spark.readStream.schema("id string, ts timestamp").parquet(str(a))).writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.n) for r in spark.table("deb").collect()) == [("m1", 1), ("m1", 2)]


def test_change_events(spark):
    a = table(spark, row(1), row(2), row(3), row(4))
    b = table(spark, row(1, status="faded"), row(2, status="superseded"), row(3, updated_at=NOW), row(5))
    from memengine.streaming.streams import changes

    got = {r.memory_id: r.event_type for r in changes(a, b, NOW, True).collect()}
    assert got == {"m1": "MEMORY_FADED", "m2": "MEMORY_SUPERSEDED", "m3": "MEMORY_UPDATED", "m4": "MEMORY_DELETED", "m5": "MEMORY_ADDED"}


def test_scores_stay_in_range(spark):
    f = spark.range(50).select((F.col("id") * 10**7).alias("last"), F.rand(3).alias("s"), F.rand(4).alias("c"))
    r = f.select(scoring.composite(F.col("c"), F.col("last"), F.col("s"), F.lit(False), F.lit(True), NOW).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert 0 <= r[0] and r[1] <= 1.000001
