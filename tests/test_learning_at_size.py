"""Learning at size: inputs are read once, facts keep novelty of their own, only groups with rows are asked for."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import NOW, row, table

from memengine.functions import vectors
from memengine.functions.checkpoint import cut
from memengine.functions.embed import embed_text
from memengine.operators import learning
from memengine.sources.tables import canonical
from memengine.streaming import streams


def hashed_of(said):
    return [float(x) for x in embed_text(said)]


def hashed(k):
    return hashed_of(f"I live in place{k}.")


def test_learning_reads_its_inputs_once(spark):
    said = spark.createDataFrame([(k % 8, k, f"I live in {'Oslo' if k % 2 else 'Riga'}. My name is Person{k}.") for k in range(64)], "conv_id long, pos long, text string")
    sc = spark.sparkContext
    reads = {"said": sc.accumulator(0), "mem": sc.accumulator(0)}

    def counted(frame, name):
        def run(batches, seen=reads[name]):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return frame.mapInArrow(run, frame.schema)

    stored = canonical(table(spark, *(row(k, content="I live in Oslo.", types=["location"], source_conversation_ids=[f"c{k % 5}"], embedding=hashed(k)) for k in range(20))).withColumn("seq", F.expr("cast(substring(id, 2) as long)")))
    mem = cut(counted(stored, "mem"))
    after, found = learning.write(learning.learn(counted(said, "said"), mem, NOW), mem, NOW)
    events = streams.all_changes(mem, after, found, NOW).groupBy("event_type").count().collect()
    assert reads["said"].value == 64 and reads["mem"].value == 20
    added = {r["event_type"]: r["count"] for r in events}
    assert added["MEMORY_ADDED"] == after.count() - 20 > 0 and added["STATS_CHANGED"] == 1


def test_facts_of_one_utterance_have_novelty_of_their_own(spark):
    a, b = "I prefer tea", "My name is Ada"
    stored = spark.createDataFrame([("m1", "c1", "active", hashed_of(a))], "id string, scope string, status string, embedding array<float>")
    said = spark.createDataFrame([(1, 0, a), (1, 0, b), (2, 0, a)], "conv_id long, pos long, text string")
    got = {(r.conv_id, r.text): r.novelty for r in learning.novelty(said, stored).collect()}
    assert abs(got[1, a]) < 1e-6 and got[1, b] > 0.5 and got[2, a] == 1.0 and len(got) == 3


def test_nearest_asks_only_for_groups_that_have_rows(spark):
    rng = np.random.default_rng(1)
    unit = np.abs(rng.normal(size=(430, 4)))
    unit = (unit / np.linalg.norm(unit, axis=1)[:, None]).tolist()
    asked = [(f"q{k}", f"g{k}", unit[k]) for k in range(400)]
    rows = [(f"r{k}", f"g{k % 3}", unit[400 + k]) for k in range(30)]
    made = [spark.createDataFrame(x, "id string, g string, embedding array<double>") for x in (asked, rows)]
    jobs = []
    got = vectors.nearest_of_each(*made, 2, 0.0, "g", slice_bytes=512).collect()
    want = {(q[0], r[0]) for q in asked for r in sorted((x for x in rows if x[1] == q[1]), key=lambda x: (-round(float(np.clip(np.dot(x[2], q[2]), 0, 1)), 12), x[0]))[:2]}
    assert {(r.new_id, r.id) for r in got} == want and len(got) == 6
    seen = vectors._blocks
    try:
        vectors._blocks = lambda t: (jobs.append(t.num_rows), seen(t))[1]
        vectors.nearest_of_each(*made, 2, 0.0, "g").collect()
    finally:
        vectors._blocks = seen
    assert jobs == [3]  # what goes to all tasks
