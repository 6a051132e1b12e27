"""SimHash near-dedup, components, substring dedup."""

import re

import numpy as np
import pytest
import xxhash
from llm_data import EDGES, make_docs, prose

from memengine.llm import cdc, simhash
from memengine.llm.components import connected_components


def brute_fingerprint(text, shingle=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_copies(rng, base, n):
    words = base.split()
    out = []
    for _ in range(n):
        w = list(words)
        w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def test_simhash_equals_brute_force(spark, rng):
    base = prose(rng, 300)
    texts = [*EDGES, *(prose(rng, rng.randrange(1, 60)) for _ in range(40)), *[base] * 6, *near_copies(rng, base, 30), base.upper()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(spark, texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    comp = brute_components(fps)
    assert got == {i: (format(fps[i], "016x"), comp[i]) for i in fps}


def test_simhash_hot_bucket_keeps_all_links(spark, rng):
    # Fingerprints in a chain and a dense ball, cut into many blocks.
    seed = rng.getrandbits(64)
    fps = {seed}
    at = seed
    for _ in range(60):
        at ^= 1 << rng.randrange(64)
        fps.add(at)
    for _ in range(80):
        fps.add(seed ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(8)))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    plan = simhash.search_plan(np.array(fps, np.uint64), len(fps), 4)
    root = connected_components(simhash.links(frame, plan, 4, block=8), "src", "dst")
    found = {r.node: r.root for r in root.collect()}
    comp = brute_components(dict(enumerate(fps)))
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(comp[i], set()).add(found.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("distance", [3, 4, 5])
def test_thresholds_obey_the_pigeonhole(distance):
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (100, 10**6, 10**9):
        plan = simhash.search_plan(sample, n, distance)
        unused = 0
        used = {b for bits, _ in plan for b in bits}
        assert len(used) == sum(len(b) for b, _ in plan)
        if len(used) == 64:
            assert sum(t for _, t in plan) + unused == distance - len(plan) + 1


def test_empty_tables(spark):
    empty = make_docs(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert cdc.repeated_spans(empty).count() == 0
    assert cdc.remove_repeats(empty).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (5, 4), (5, 4), (9, 8), (8, 7), (7, 6), (None, 1)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6, **{k: 100 for k in range(100, 160)}}


def test_cuts_depend_on_content_alone(rng):
    import pyarrow as pa

    text = prose(rng, 3000)

    def pieces(t):
        data = np.frombuffer(t.encode(), np.uint8)
        ends, rows = cdc.cut_points(data, np.array([0, data.size]), cdc.REACH, cdc.MAX_BYTES)
        assert ends[-1] == data.size and (np.diff(np.concatenate(([0], ends))) <= cdc.MAX_BYTES).all() and (rows == 0).all()
        return [t.encode()[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    plain, shifted = pieces(text), pieces("inserted é " + text[:9000] + "!" + text[9000:])
    assert b"".join(plain) == text.encode()
    assert len(set(plain) - set(shifted)) <= 6
    both = pa.array(["abc", text])
    from memengine.llm._common import buffers

    ends, rows = cdc.cut_points(*buffers(both), cdc.REACH, cdc.MAX_BYTES)
    assert [int(e) - 3 for e, r in zip(ends, rows) if r == 1] == list(np.cumsum([len(p) for p in plain]))


def brute_chunks(text, reach=cdc.REACH, most=cdc.MAX_BYTES):
    """(place, bytes) of each chunk, byte by byte."""
    raw = text.encode()
    gear = [int(x) for x in cdc.GEAR]
    h = [sum(gear[raw[i - k]] << k for k in range(min(i + 1, 32))) % 2**32 for i in range(len(raw))]
    cuts = []
    for i in range(31, len(raw)):
        if i + 1 < len(raw) and raw[i + 1] & 0xC0 == 0x80:
            continue
        def at(j):
            return h[j] if 31 <= j < len(raw) and not (j + 1 < len(raw) and raw[j + 1] & 0xC0 == 0x80) else 2**32 - 1
        if all(h[i] < at(j) for j in range(i - reach, i)) and all(h[i] <= at(j) for j in range(i + 1, i + reach)):
            cuts.append(i + 1)
    out, a = [], 0
    for b in sorted({*cuts, len(raw)} - {0}):
        while b - a > most:
            c = a + most
            while raw[c] & 0xC0 == 0x80:
                c -= 1
            out.append((a, raw[a:c]))
            a = c
        out.append((a, raw[a:b]))
        a = b
    return out


def brute_left(spark, rows, min_run=cdc.MIN_RUN_BYTES):
    """Texts after dedup of rows (id, text), in order."""
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string")
    names = {r.k: r.name for r in frame.select("k", cdc._row("doc_id", "text").alias("name")).collect()}
    order = {names[k]: (i is None, i or 0, names[k]) for k, (i, _) in enumerate(rows)}
    places, chunked = {}, {}
    for k, (_, t) in enumerate(rows):
        chunked[k] = brute_chunks(t or "")
        for pos, c in chunked[k]:
            places.setdefault(c, set()).add((order[names[k]], pos))
    out = []
    for k, (_, t) in enumerate(rows):
        runs, now = [], []
        for pos, c in [*chunked[k], (-1, None)]:
            if c is not None and len(places[c]) > 1:
                now.append((pos, c))
            elif now:
                runs.append(now)
                now = []
        gone = {pos for r in runs if sum(len(c) for _, c in r) >= min_run for pos, c in r if min(places[c]) != (order[names[k]], pos)}
        left = b"".join(c for pos, c in chunked[k] if pos not in gone).decode()
        out.append(t if t is None else left)
    return out


@pytest.mark.parametrize("min_run", [cdc.MIN_RUN_BYTES, 0])
def test_repeats_equal_brute_force(spark, rng, min_run):
    passage, short, line = prose(rng, 60), prose(rng, 8), prose(rng, 14)
    unique = [prose(rng, 120) for _ in range(8)]
    texts = [*EDGES, *unique[:3], *(f"{u[:300]} {passage} {u[300:]}" for u in unique[3:]), *(f"{prose(rng, 30)} {short}" for _ in range(3)), "\n".join([line] * 4)]
    rows = [*enumerate(texts), (20, texts[20]), (20, prose(rng, 40) + passage), (None, passage), (None, unique[0]), (3, unique[1] + " more"), (99, "ä" * 3000)]
    docs = make_docs(spark, []).unionByName(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string"), allowMissingColumns=True)
    want = brute_left(spark, rows, min_run)
    got = [(r.doc_id, r.text) for r in cdc.remove_repeats(docs, min_run_bytes=min_run).collect()]
    assert sorted(got, key=repr) == sorted(zip((i for i, _ in rows), want), key=repr)
    cut = sum(len((t or "").encode()) - len((w or "").encode()) for (_, t), w in zip(rows, want))
    assert cut > 1500 and sum(r.removed_bytes for r in cdc.repeated_spans(docs, min_run_bytes=min_run).collect()) == cut
    assert len({t for t in unique if any(t in (w or "") for w in want)}) == len(unique[:3])


def test_rows_that_share_an_id_keep_their_own_text(spark, rng):
    passage, unique = prose(rng, 80), prose(rng, 160)
    schema = "doc_id long, text string, __row string, __doc long, __cut string, row string, span string, spans string, __salt int"
    rows = [(1, passage), (2, f"{passage} tail of two"), (2, unique), (None, f"{passage} tail of none"), (None, None)]
    docs = spark.createDataFrame([(i, t, "a", 5, "b", "c", "d", "e", 6) for i, t in rows], schema)
    out = cdc.remove_repeats(docs).collect()
    assert len(out) == 5 and all((r["__row"], r["__doc"], r["__salt"]) == ("a", 5, 6) for r in out)
    left = [r.text for r in out]
    assert unique in left and None in left
    assert sum(passage in (t or "") for t in left) == 1


def test_hot_digest_goes_to_many_tasks(spark, rng):
    passage = prose(rng, 40)
    docs = make_docs(spark, [f"{passage} {prose(rng, 30)}" for _ in range(1500)])
    out = [r.text for r in cdc.remove_repeats(docs).collect()]
    middle = passage[60:180]
    assert sum(middle in t for t in out) == 1 and len(out) == 1500


def test_very_long_text_is_chunked_whole(spark, rng):
    long, other = prose(rng, 120_000, 20_000), prose(rng, 200)
    docs = make_docs(spark, [long, f"{other} {long[500_000:520_000]} {other[::-1]}"])
    spans = {r.doc_id: r for r in cdc.repeated_spans(docs).collect()}
    assert sum(r.removed_bytes for r in spans.values()) > 19_000


def test_exact_copies_lose_everything_but_one(spark, rng):
    text = prose(rng, 100)
    docs = make_docs(spark, [text] * 5)
    assert sorted(len(r.text) for r in cdc.remove_repeats(docs).collect()) == [0, 0, 0, 0, len(text)]
    # Rows equal in id and text are one row: they lose the same, here nothing.
    assert [r.text for r in cdc.remove_repeats(docs.filter("doc_id = 1").unionByName(docs.filter("doc_id = 1"))).collect()] == [text, text]


def test_near_duplicates_drop_rows_by_their_own_text(spark, rng):
    base, unique = prose(rng, 300), [prose(rng, 50) for _ in range(4)]
    rows = [(1, base), (2, base + " end"), (2, unique[0]), (2, unique[0]), (None, unique[1]), (None, unique[1] + " x"), (7, unique[2]), (7, unique[3]), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, root string, __k1 long, fp long")
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs, distance=12).collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(dict(enumerate(fps)), 12)
    assert len(kept) == len(set(root.values()))
    assert (1, base) in kept and kept.count((2, unique[0])) == 1 and {(7, unique[2]), (7, unique[3]), (8, None)} <= set(kept) and (9, "") not in kept
    assert sum(i is None for i, _ in kept) == len({root[4], root[5]})


def test_simhash_ids_that_repeat_with_unlike_texts(spark, rng):
    texts = [prose(rng, 40) for _ in range(3)]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[1]), (None, texts[2]), (4, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    hexed = [format(brute_fingerprint(t), "016x") for _, t in rows]
    assert got == {(5, hexed[0], 5), (5, hexed[1], 5), (6, hexed[2], 5), (None, hexed[3], 4), (4, hexed[4], 4)}


def test_hub_edges_are_dealt(spark):
    edges = [(0, k) for k in range(1, 1300)] + [(k, 5000 + k) for k in range(1, 40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert set(got.values()) == {0} and len(got) == 1300 + 39
