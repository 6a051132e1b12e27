"""Operators of the engine do the whole job: chains of any length, streams over several triggers, every conversation."""

from test_operators import NOW, by_id, row, table

from memengine.config import DEFAULT
from memengine.operators import lifecycle, retrieval


def test_lineage_follows_long_chains_to_their_end(spark):
    chain = [row(k, superseded_by=f"m{k + 1}") for k in range(300)] + [row(300)]
    ring = [row(k, superseded_by=f"m{k + 1 if k < 440 else 401}") for k in range(395, 441)]  # a tail of 6 before a cycle of 40
    exact = [row(500 + k, superseded_by=f"m{501 + k}") for k in range(64)] + [row(564, superseded_by="gone")]
    got = by_id(lifecycle.lineage(table(spark, *chain, *ring, *exact)))
    assert len(got) == len(chain) + len(ring) + len(exact)
    assert all((got[f"m{k}"].last_id, got[f"m{k}"].hops) == ("m300", 300 - k) for k in range(301))
    assert all((got[f"m{500 + k}"].last_id, got[f"m{500 + k}"].hops) == ("m564", 64 - k) for k in range(65))
    assert all((got[f"m{k}"].last_id, got[f"m{k}"].hops) == ("m401", None) for k in range(395, 441))


def test_learn_stream_does_not_depend_on_triggers_or_arrow_batches(spark, tmp_path):
    from memengine.streaming import streams

    schema = "conv_id long, turn long, role string, text string"
    first = [(1, 1, "user", "My name is Katherine.")]
    second = [(1, 3, "user", "I live in Riga."), (1, 2, "user", "I live in Oslo."), (1, 4, "user", "My name is Kathrine.")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def decisions(name, *triggers):
        q = None
        for rows in triggers:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            if q is None:
                stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
                q = streams.learn_stream(stream, NOW).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}_ck")).start()
            q.processAllAvailable()
        q.stop()
        return [(r.turn, r.predicate, r.object, r.action) for r in spark.table(name).orderBy("turn").collect()]

    try:
        parted, whole = decisions("parted", first, second), decisions("whole", first + second)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert parted == whole and [x[3] for x in whole] == ["ADD", "ADD", "UPDATE", "IGNORE"] and whole[0][2] == whole[3][2]


def test_augment_covers_every_conversation_under_its_own_budget(spark):
    mem = table(spark, *(row(k, content=f"fact {k} " + "x" * 400) for k in range(6)))
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (2, 1, "system", "be kind"), (2, 2, "user", "y" * 27_500), (3, 1, "user", "z" * 40_000)], "conv_id long, turn long, role string, text string")
    hits = retrieval.vector_search(mem, [1.0, 0.0], NOW).orderBy("rank").collect()
    got = {(r.conv_id, r.turn): r.text for r in retrieval.augment_all(mem, turns, [1.0, 0.0], NOW).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 1), (2, 2), (3, 1)} and len(hits) == 6
    for conv, at, spent in ((1, 0, 1 + 4), (2, 1, 2 + 6875 + 8)):
        left, want = DEFAULT.context_tokens - DEFAULT.response_reserve - spent, []
        for h in hits:
            left -= -(-len(h.content) // 4)
            if left < 0:
                break
            want.append(h.content)
        assert [x for x in (h.content for h in hits) if f"- {x} (" in got[conv, at]] == want and want
    assert len([1 for h in hits if h.content in got[2, 1]]) < 6 and got[2, 1].endswith("be kind")
