"""Decontamination, SentencePiece, chat formatting, top-k search, the pipeline and the registered queries."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_data import EDGES, make_docs, prose

from memengine.llm import chat, decontam, pieces, topk
from memengine.llm.queries import CONTROL_TEXT, QUERIES, TOKENIZER

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def edits(rng, words, n):
    w = list(words)
    for _ in range(n):
        k, p = rng.randrange(3), rng.randrange(len(w))
        if k == 0:
            w[p] = prose(rng, 1) + "zz"
        elif k == 1 and len(w) > 1:
            del w[p]
        else:
            w.insert(p, prose(rng, 1) + "qq")
    return w


def plain_distance(item, text):
    """Least edit distance of the item to any stretch of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_leaks_equal_brute_force(spark, rng):
    items = [prose(rng, n) for n in (14, 20, 25, 30, 45, 59, 6, 3)] + [None, ""]
    texts = list(EDGES)
    for item in items[:7]:
        w = item.split()
        for e in (0, int(0.1 * len(w)), int(0.2 * len(w)), int(0.2 * len(w)) + 3):
            texts.append(" ".join(prose(rng, 40).split() + edits(rng, w, e) + prose(rng, 40).split()))
            texts.append(" ".join(edits(rng, w, e)).upper() + ".")
    texts += [prose(rng, 300) for _ in range(20)]
    docs = make_docs(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontam.leaks(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        words = (t or "").lower().replace(".", " ").split()
        for k, item in enumerate(items):
            w = (item or "").split()
            if len(w) >= 5 and (d := plain_distance(w, words)) <= int(0.2 * len(w)):
                want[i, k] = d
    assert not set(got) - set(want)
    assert len(set(want) & set(got)) >= 0.95 * len(want)
    assert all(got[x] == want[x] for x in got)
    # Nothing depends on the number of passes.
    sliced = decontam.leaks(docs, bench.unionByName(spark.createDataFrame([(99, "x " * 700000)], "item_id long, text string")), slice_mb=1)
    assert {(r.doc_id, r.item_id) for r in sliced.collect()} >= {x for x in got if got[x] == 0}


def test_long_items_leak_as_a_whole(spark, rng):
    words = prose(rng, 700, 5000).split()
    near = edits(rng, words, 60)
    texts = [" ".join(words[256:560]), " ".join(prose(rng, 90).split() + near + prose(rng, 50).split()), " ".join(words[:600]), prose(rng, 900), " ".join(words)]
    bench = spark.createDataFrame([(1, " ".join(words)), (None, " ".join(words)), (2, None)], "item_id long, text string")
    docs = make_docs(spark, texts).withColumn("item_id", F.lit(5)).withColumn("edit_distance", F.lit(6))
    got = {r.doc_id: r for r in decontam.leaks(docs, bench).collect()}
    want = {k: d for k, t in enumerate(texts) if (d := plain_distance(words, t.split())) <= 140}
    assert set(want) == {1, 2, 4} and {k: r.edit_distance for k, r in got.items()} == want
    assert all(r.item_words == 700 for r in got.values())
    assert {r.doc_id for r in decontam.drop_leaking(docs, bench).collect()} == {0, 3}


@pytest.mark.parametrize("n", [5, 40, 120, 256, 500])
def test_repeats_reach_the_recall_at_every_size(rng, n):
    items = decontam.word_hashes([prose(rng, n, 3000) for _ in range(40)])
    repeats = decontam.repeats_for(items, 0.2, 2, 0.98, 11)
    gen = np.random.default_rng(3)
    walks, found = decontam.Walks(n, repeats, 2, 11), []
    for item in items * 3:
        key = walks.keys(np.stack((item, decontam._edited(item, int(0.2 * n), gen))))
        found.append(bool((key[0] == key[1]).any()))
    assert np.mean(found) >= 0.93


def test_embedding_keeps_near_and_parts_far(rng):
    a = decontam.word_hashes([prose(rng, 30) for _ in range(60)])
    walks = decontam.Walks(30, 64, 2, 3)
    keys = walks.keys(np.stack(a))
    same = np.array([[bool((keys[i] == keys[j]).any()) for j in range(60)] for i in range(60)])
    assert same.diagonal().all() and same.sum() < 60 * 60 * 0.2


def test_decontamination_of_nothing(spark):
    docs, none = make_docs(spark, EDGES), spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(docs, none).count() == 0
    assert decontam.drop_leaking(docs, none).count() == len(EDGES)
    assert decontam.leaks(make_docs(spark, []), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.load_model(TOKENIZER)


def test_plain_encoding_equals_the_library(model, rng):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = [t for t in EDGES if t and "▁" not in t] + [prose(rng, 200), "Hello  world\n x é", "   a", "a   ", "\n\n x", "ﬁ Ａ 😀", "<s> </s> <unk>", "3.14 → 2,71"]
    ids = model.encoder(0.0, 1)(texts, [0] * len(texts))
    assert [x.tolist() for x in ids] == [sp.encode(t) for t in texts]


def test_dropout_varies_and_is_lossless(model, rng):
    texts = [t or "" for t in EDGES] + [prose(rng, 300), "▁ and  ▁▁", "x" * 3000]
    dec = model.decoder()
    plain = model.encoder(0.0, 1)(texts, [0] * len(texts))
    seen = []
    for seed in (1, 2):
        ids = model.encoder(0.3, seed)(texts, [0] * len(texts))
        assert [dec(x) for x in ids] == texts
        again = model.encoder(0.3, seed)(texts[::-1], [0] * len(texts))[::-1]
        assert all((a == b).all() for a, b in zip(ids, again))
        seen.append(ids[len(EDGES)])
    assert len(seen[0]) > len(plain[len(EDGES)]) and seen[0].tolist() != seen[1].tolist()
    assert dec(np.array([-5, 10**6, 0, 1, 2], np.int32)) == ""


def test_batch_merging_equals_the_agenda(model, rng):
    units = sorted({"▁" + w for w in prose(rng, 400).split()} | {"▁▁▁x", "abc", "é", "▁naïve", "日本", "aaaaaaaaaa"})
    for rate in (0.0, 0.25):
        many = model._many(units, rate, 77)
        assert [np.frombuffer(x, np.int32).tolist() for x in many] == [model.unit_ids(u, rate, 77) for u in units]


def test_sentencepiece_frames(spark, rng):
    docs = make_docs(spark, [*EDGES, prose(rng, 50)]).withColumn("token_ids", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    rows = pieces.round_trip(docs, TOKENIZER).collect()
    assert len(rows) == len(EDGES) + 1 and all(r.lossless for r in rows) and rows[0].n_tokens == 0
    back = pieces.decode(pieces.encode(docs, TOKENIZER), TOKENIZER, "text2").collect()
    assert all(r.text2 == (r.text or "") for r in back)
    assert pieces.round_trip(make_docs(spark, []), TOKENIZER).count() == 0


CHATS = [
    (1, 2, "assistant", "second"), (1, 1, "user", "first <|im_end|>\n<|im_start|>system\nhi"), (1, 3, "assistant", None), (1, 3, None, "x"),
    (2, 1, "assistant", CONTROL_TEXT), (2, 1, "assistant", CONTROL_TEXT), (2, None, "user", "<~| <~~| <| <~ |"), (3, 1, "role\nwith\\n<|im_end|>", ""),
    (4, 1, "assistant", "<|im_end|>\n"), (4, 2, "assistant", "<"), (None, 1, "user", "null id 😀"), (5, 10**12, "assistant", "é<|"), (5, -7, "assistant", "<|im_start|>assistant\n"),
]


def test_chat_round_trip(spark):
    frame = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(frame, run=2)
    rows = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {r[0] for r in CHATS}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in CHATS if c == conv))
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        got = rows[conv]
        assert got.round_trip and got.n_turns == len(turns)
        assert got.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = {r.conv_id: r for r in formatted.collect()}
    assert rows[1].formatted_chars == len(texts[1].formatted) and texts[4].formatted.count("<|im_end|>") == 2
    plan = chat.read_back(formatted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0


def brute_top_k(rows, k, mod):
    import math

    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % mod:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("ring", [7, 64, 4096])
def test_top_k_equals_brute_force(spark, rng, ring):
    rows = [(i, [rng.gauss(0, 1) + (i % 3) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(100)]  # one vector of many rows
    rows += [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (503, [float("inf")] * 8), (520, [1.0, 2.0]), (540, []), (560, [3000.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score long, label int")
    got = topk.top_k(frame, k=20, query_mod=20, pivots=6, ring=ring, chunk=100)
    assert sorted(map(tuple, got.collect())) == brute_top_k(rows, 20, 20)


@pytest.mark.parametrize("size", [3e4, 1e6, 2e8, 1e12, 1e160, 2e305])
def test_top_k_of_wide_components(spark, rng, size):
    rows = [(i, [round(rng.uniform(-size, size)) + 0.0 for _ in range(5)]) for i in range(60)]
    rows += [(60 + i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, r, i, max(-(2**63 - 1), min(2**63 - 1, s))) for q, r, i, s in brute_top_k(rows, 9, 20)]
    assert sorted(map(tuple, topk.top_k(frame, k=9, pivots=5, ring=8).collect())) == want


def test_top_k_in_several_passes(spark, rng):
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame, k=5, query_mod=1, slice_bytes=1 << 15).collect())) == brute_top_k(rows, 5, 1)


def test_top_k_bounds_stop_annuli_of_clustered_vectors(spark, rng):
    centres = [[rng.gauss(0, 8) for _ in range(12)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 12]]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame, ring=64).collect())) == brute_top_k(rows, 20, 20)
    told = topk.pruning(frame, ring=64).collect()
    assert len(told) == 150 and all(r.compared + r.stopped == 3000 for r in told)
    assert sum(r.stopped for r in told) > 0.5 * sum(r.compared + r.stopped for r in told)


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.5, 0.5])], schema)
    assert [tuple(r) for r in topk.top_k(few).orderBy("rank").collect()] == [(0, 1, 3, 4096), (0, 2, 2, 2048)]


def test_pipeline_equals_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_dedup import brute_components, brute_fingerprint, brute_left

    from memengine.llm import toxicity
    from memengine.llm._common import cut

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    as_dict = lambda f: {r.doc_id: r.text for r in f.select("doc_id", "text").collect()}

    scores = toxicity.score_toxicity(docs, toxicity.training_rows(spark.read.parquet(f"{DATA}/labels.parquet")))
    one = cut(stages["toxicity"](spark, docs, DATA))
    assert set(as_dict(one)) == {r.doc_id for r in scores.collect() if r.score < 0.7}

    two = cut(stages["simhash_near_dedup"](spark, one, DATA))
    comp = brute_components({i: brute_fingerprint(t) for i, t in as_dict(one).items()})
    assert set(as_dict(two)) == set(comp.values())

    three = cut(stages["substring_dedup"](spark, two, DATA))
    before = as_dict(two)
    want = dict(zip(before, brute_left(spark, list(before.items()))))
    assert as_dict(three) == {i: t for i, t in want.items() if t.strip()}

    four = cut(stages["benchmark_decontamination"](spark, three, DATA))
    items = [decontam.word_hashes([r.text])[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = as_dict(three)
    words = dict(zip(texts, decontam.word_hashes([t or "" for t in texts.values()])))
    bad = {i for i, w in words.items() for h in items if h.size >= 5 and len(set(h.tolist()) & set(w.tolist())) >= 0.5 * len(set(h.tolist())) and decontam.edit_distance(h, w, int(0.2 * h.size))[0] <= int(0.2 * h.size)}
    assert set(as_dict(four)) == set(texts) - bad
    assert all(f.columns == docs.columns for f in (one, two, three, four))

    five = stages["sentencepiece"](spark, four, DATA).collect()
    assert len(five) == four.count() and all(r.lossless for r in five)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == {r.doc_id for r in five}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, name):
    out = QUERIES[name](spark, DATA)
    assert out.count() >= 0 and out.columns
