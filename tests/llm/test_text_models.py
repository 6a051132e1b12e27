"""Toxicity, quality, language ID, licence scans."""

import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from llm_data import EDGES, make_docs, prose

from pyspark.sql import functions as F

from memengine.llm import langid, licenses, quality, toxicity
from memengine.llm._common import byte_words


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_automaton_equals_edit_distance(rng):
    terms, stems = ["idiot", "moron", "clown", "scum", "worthless", "disgusting"], ["lowe", "vequ", "grobna"]
    auto = toxicity.Automaton(terms, stems)
    words = set(terms) | {"lowetum", "lowe", "vequé", "low", "x"}
    letters = "abdiotmrnsluwhegé1"
    for t in [*terms, *stems]:
        for _ in range(120):
            w = list(t)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(3)
                p = rng.randrange(len(w) + 1)
                if k == 0 and w:
                    w[min(p, len(w) - 1)] = rng.choice(letters)
                elif k == 1 and len(w) > 1:
                    del w[min(p, len(w) - 1)]
                else:
                    w.insert(p, rng.choice(letters))
            words.add("".join(w))
    for w in sorted(words):
        got = toxicity.word_values([auto], byte_words(pa.array([w])))[0]
        assert got == value_by_hand(w, terms, stems), w
    # A lexicon that is too large for one table is parted.
    parts = toxicity.automata(terms, stems, max_states=40)
    assert len(parts) > 2
    for w in sorted(words):
        assert toxicity.word_values(parts, byte_words(pa.array([w])))[0] == value_by_hand(w, terms, stems), w


def value_by_hand(w, terms, stems):
    if w in terms or any(w.startswith(s) for s in stems):
        return 2
    near = any(edit_distance(w, t) <= toxicity.edits_for(t) for t in terms)
    return int(near or any(edit_distance(w[:k], s) <= toxicity.stem_edits_for(s) for s in stems for k in range(1, len(w) + 1)))


def score_by_hand(text, terms, stems, plain, weights, window=8):
    """Toxicity score of one text by plain Python."""
    low = text.lower()
    # Words: runs of letters, digits and other characters beyond ASCII that are no punctuation.
    inside = [c.isascii() and c.isalnum() or ord(c) >= 0xC0 and not 0x2000 <= ord(c) < 0x2100 for c in low]
    words, at = [], 0
    while at < len(low):
        if inside[at]:
            end = at
            while end < len(low) and inside[end]:
                end += 1
            words.append((at, end, low[at:end]))
            at = end
        at += 1
    said = {w for w in toxicity.REPORTING}
    sums, best = [0.0] * 3, 0.0
    for i, (a, b, w) in enumerate(words):
        v = value_by_hand(w, terms, stems)
        if not v or v == 1 and w in plain:
            continue
        lo, hi = max(0, i - window), min(len(words) - 1, i + window)
        mark = lambda x: any(c in '"«»‘’‚‛“”„‟' for c in x)
        quoted = 0.6 * (mark(low[words[lo][0] : a]) and mark(low[b : words[hi][1]])) + 0.3 * any(x in said for _, _, x in words[lo:i])
        abuse = min(1.2, max(0.1, 1 - quoted + 0.2 * any(x in toxicity.SECOND_PERSON for _, _, x in words[lo : hi + 1])))
        sums[0 if v == 2 else 1] += abuse
        sums[2] += quoted
        best = max(best, abuse if v == 2 else 0.5 * abuse)
    n = max(1, len(words))
    x = [math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), sums[0] > 0, sums[1] > 0, best, math.log1p(100 * sums[0] / n), math.log1p(100 * sums[1] / n)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights)) - weights[-1]))


def test_toxicity_scores_equal_plain_python(rng):
    terms, stems = ["idiot", "worthless", "scum"], ["grobna"]
    plain = ["idiom", "grobne"]
    texts = [*(t for t in EDGES if t), 'He said: "you idiot"!', "«grobnek» dit-il à toi", "an idiom of idiots, worthles grobnex", "SCUM scums scum " * 9, "é" * 9 + " idiot’s “worthless” quote"]
    for _ in range(60):
        words = prose(rng, rng.randrange(1, 60)).split() + rng.choices([*terms, "idiott", "grobnak", "grobxak", "idiom", "said", "you", '"', "«x»"], k=rng.randrange(5))
        rng.shuffle(words)
        texts.append(" ".join(words))
    w = np.array([rng.uniform(-2, 3) for _ in range(toxicity.FEATURES + 1)])
    hashed = frozenset(int(x) for x in toxicity._hash_words(plain))
    got = toxicity.Model(toxicity.automata(terms, stems), hashed, w).scorer()(pa.array(texts))
    assert np.allclose(got, [score_by_hand(t, terms, stems, plain, w) for t in texts], atol=1e-12)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def toxic_fixture(rng, n=160):
    insult = ["idiot", "moron", "grobnak", "grobnek", "grobnix"]
    texts, marks = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 120)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(insult))
        texts.append(" ".join(words))
        marks.append(int(bad))
    return texts, marks


def test_toxicity_learns_and_catches_misspellings(spark, rng):
    texts, marks = toxic_fixture(rng)
    more = ["you are an idiiot and a mooron, idot", 'He wrote: "idiot" and left the big room in a hurry', "grobnuk said nothing", "GROBNOK!", *EDGES]
    docs = make_docs(spark, texts + more)
    labels = labelled(spark, [(i, None, m) for i, m in enumerate(marks)] + [(10**6, 1, 1), (5, None, None)])
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(texts) + len(more)
    assert np.mean([got[i].predicted == m for i, m in enumerate(marks)]) > 0.97
    n = len(texts)
    assert got[n].score > got[n + 1].score and got[n + 3].predicted == 1
    clean = {got[n + 4 + k].score for k in range(len(EDGES))}
    assert len(clean) == 1 and clean.pop() < 0.5
    kept = {r.doc_id for r in toxicity.filter_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}


def test_quotation_weighs_less(rng):
    x = toxicity.extractor(toxicity.automata(["idiot"], []), frozenset())(pa.array(['she said: "idiot" in the film', "you are an idiot of the worst kind", "«idiot» dit le film"]))
    assert x[0, 5] < x[1, 5] and x[2, 5] < x[1, 5] and x[0, 2] > 0 and x[1, 2] == 0


def test_no_labels_or_no_rows(spark):
    docs, none = make_docs(spark, EDGES), labelled(spark, [])
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert {r.score for r in quality.score_quality(docs, none, docs).collect()} == {0.5}
    empty = make_docs(spark, [])
    assert toxicity.score_toxicity(empty, none).count() == 0
    assert quality.score_quality(empty, none, empty).count() == 0
    assert langid.identify(empty, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert licenses.scan(empty).count() == 0


def test_quality_learns_from_positives_and_unlabelled(spark, rng):
    texts, good = [], []
    for i in range(600):
        ok = i % 5 != 0
        words = prose(rng, rng.randrange(10, 150)).split()
        if not ok:
            kind = i % 3
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w for w in words for _ in range(4)] if kind == 1 else [w + "$$$" for w in words]
        texts.append(" ".join(words))
        good.append(int(ok))
    docs = make_docs(spark, [*texts, *EDGES])
    labels = labelled(spark, [(i, g, 0) for i, g in enumerate(good) if i % 2])
    scored = {r.doc_id: r for r in quality.score_quality(docs, labels, docs).collect()}
    held = [i for i in range(600) if i % 2 == 0]
    assert np.mean([scored[i].predicted == good[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in scored.values()) and len(scored) == 600 + len(EDGES)


def test_quality_features_by_hand():
    x = quality.features(pa.array(["AB cd cd\ncd |", "", None, "x\nx\nx"]).fill_null(""))
    at = {n: k for k, n in enumerate(quality.NAMES)}
    assert x[0, at["upper_words"]] == 1 / 4 and x[0, at["adjacent"]] == 2 / 4 and x[0, at["distinct"]] == 2 / 4
    assert x[0, at["kind8"]] == pytest.approx(1 / 13) and x[3, at["line_repeat"]] == pytest.approx(2 / 3) and not x[1].any()


def test_prior_estimate():
    r = np.random.default_rng(3)
    pos = r.normal(1, 1, 4000)
    unl = np.concatenate([r.normal(1, 1, 2400), r.normal(-3, 1, 1600)])
    assert abs(quality.estimate_prior(pos, unl) - 0.6) < 0.08


def brute_presence(text, dims):
    # The same kernel over plain sets: letters, others as one space.
    out, prev = [], " "
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        if not (c == " " and prev == " "):
            out.append(c)
        prev = c
    s = "".join(out)
    return {s[i : i + n] for n in range(1, 5) for i in range(len(s) - n + 1)}


def test_presence_matches_plain_sets(rng):
    texts = ["Grüße, 12 Welt!", "", "   ", prose(rng, 50), "naïve  café — déjà", "a"]
    flags, has = langid.presence(pa.array(texts), dims=1 << 20)
    assert has.tolist() == [True, False, False, True, True, True]
    for row, t in zip(flags, texts):
        want = brute_presence(t, 1 << 20) if any(unicodedata.category(c).startswith("L") for c in t) else set()
        want = {w for w in want if w} if want else want
        if want:
            assert abs(int(row.sum()) - len(want)) <= 6  # a leading space, or two n-grams in one place


def test_language_by_kernel(spark):
    r = random.Random(2)
    kinds = {"aa": ("bdg", "aeo"), "bb": ("ptk", "iuy"), "cc": ("mnl", "äöü")}
    texts, langs = [], []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        c, v = kinds[lang]
        texts.append(" ".join("".join(r.choice(c) + r.choice(v) for _ in range(3)) for _ in range(r.randrange(3, 60))))
        langs.append(lang)
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))] + [(900 + k, t, None) for k, t in enumerate(EDGES)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(docs, langid.training_rows(docs)).collect()}
    assert np.mean([got[i].lang_pred == x for i, x in enumerate(langs)]) > 0.98
    assert all(got[900 + k].lang_pred == "und" and got[900 + k].score == 0 for k in (0, 1, 2, 9))
    assert all(0 <= x.score <= 1 for x in got.values())


def test_licence_scan(spark):
    lines = [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("All rights reserved.", "proprietary"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including", "mit"),
        ("He lost his driving license on the way.", None),
        ("A licensed physician asked for permission.", None),
    ]
    docs = make_docs(spark, [f"first line\n{t}\nlast line" for t, _ in lines] + EDGES + ["Released under the MIT License.\nAll rights reserved."])
    got = [(r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs).collect() if r.confirmed]
    want = [(i, 1, f) for i, (_, f) in enumerate(lines) if f]
    n = len(lines) + len(EDGES)
    assert sorted(got) == [*want, (n, 0, "mit"), (n, 1, "proprietary")]
    assert licenses.scan(docs.unionByName(docs)).count() == licenses.scan(docs).count()
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def grams_by_hand(text, dims=langid.DIMS, orders=langid.ORDERS):
    """Hashed places of the n-grams of a text, one at a time."""
    out, keep = [], []
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or not keep or keep[-1] != " ":
            keep.append(c)
    code, bits = [ord(c) for c in keep], int(dims).bit_length() - 1
    for i in range(len(code)):
        h = 0
        for n in range(orders):
            if i + n >= len(code):
                break
            h = (h * 0x01000193 + code[i + n] * 0x9E3779B1) % 2**32
            out.append(((h ^ (h >> 15)) * (0x85EBCA77 + 2 * n)) % 2**32 >> (32 - bits))
    return set(out)


def test_language_scores_equal_kernel_regression(rng):
    texts = [prose(rng, rng.randrange(3, 30)) for _ in range(24)] + ["die schöne Straße " * 3, "où êtes-vous, ça va", "𐌰𐌱 gothic 𐌲"]
    langs = np.array(["aa", "bb", "cc"] * 9)
    flags, has = langid.presence(pa.array(texts))
    sets = [grams_by_hand(t) for t in texts]
    assert has.all() and [set(np.flatnonzero(f).tolist()) for f in flags] == sets
    model = langid.KernelModel(np.packbits(flags, axis=1), langs, landmarks=12, ridge=1e-2)

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    marks = [sets[k] for x in "abc" for k in np.flatnonzero(langs == x * 2)[:4]]
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vector @ np.diag(np.maximum(value, 1e-6) ** -0.5) @ vector.T
    z = np.hstack([np.array([[kernel(a, b) for b in marks] for a in sets]) @ root, np.ones((27, 1))])
    y = np.where(langs[:, None] == np.array(["aa", "bb", "cc"])[None, :], 1.0, -1.0)
    want = z @ np.linalg.solve(z.T @ z + 1e-2 * 27 * np.eye(13), z.T @ y)
    assert np.allclose(model.margins(flags), want, atol=2e-3)


def test_language_of_letters_beyond_the_first_plane_and_ties(spark):
    docs = make_docs(spark, ["𐌰𐌱𐌲𐌳 𐌰𐌱", "𝟙𝟚😀", "123", "zzz", "x" * 300_000])
    train = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate([("𐌰𐌱𐌲 𐌳𐌰", "got"), ("abc def", "xx"), ("zzz", "bb"), ("zzz", "aa")])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, train).collect()}
    assert got[0].lang_pred == "got" and (got[1].lang_pred, got[1].score) == ("und", 0.0) and got[2].lang_pred == "und"
    assert got[3].lang_pred == "aa" and got[4].lang_pred != "und"


def quality_by_hand(text):
    raw = text.encode()
    kinds = np.bincount(quality.KINDS[np.frombuffer(raw, np.uint8)], minlength=12)
    words, now = [], []
    for c in [*text, " "]:
        if c.isascii() and c.isalnum() or ord(c) >= 0xC0 and not 0x2000 <= ord(c) < 0x2100:
            now.append(c)
        elif now:
            words.append("".join(now))
            now = []
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    size = [len(w.encode()) for w in words]
    n, pairs = max(1, len(words)), list(zip(words, words[1:]))
    upper = [w[0].isascii() and w[0].isupper() and w[-1].isascii() and w[-1].isupper() and k > 1 for w, k in zip(words, size)]
    return [
        *(kinds / max(1, len(raw))), math.log1p(len(raw)), math.log1p(len(words)), sum(size) / n, sum(k <= 3 for k in size) / n, sum(k > 20 for k in size) / n, sum(upper) / n,
        len(set(words)) / n, math.log1p(len(words)) - math.log1p(len(set(words))), sum(a == b for a, b in pairs) / n, (len(pairs) - len(set(pairs))) / max(1, len(pairs)),
        math.log1p(len(lines)), math.log1p(len(raw) / max(1, len(lines))), (len(lines) - len(set(lines))) / max(1, len(lines)),
        math.log1p((kinds[8] + kinds[9]) / n), math.log1p(kinds[6] / n),
    ]


def test_quality_scores_equal_plain_python(rng):
    texts = [t for t in EDGES if t]
    for _ in range(60):
        words = prose(rng, rng.randrange(1, 80), 30).split() + rng.choices(["HTTP", "Ab", "#$%", "ÄÖÜ", "a|b", "!!", "x" * 30], k=rng.randrange(6))
        rng.shuffle(words)
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\n\n", ", "]) for w in words))
    x = quality.features(pa.array(texts))
    want = np.array([quality_by_hand(t) for t in texts])
    assert np.allclose(x, want, atol=1e-9)
    label = np.array([rng.choice([1, 0, -1]) for _ in texts])
    model = quality.learn(x, label)
    steps, w = model.steps, model.w
    for row, got in zip(x, model.score(x)):
        parts = [min(4, max(-4, (v - m) / s)) for v, m, s in zip(row, steps.mean, steps.sd)]
        parts += [float(row[j] > c) for j in range(len(row)) for c in steps.cuts[j]]
        g = sum(a * b for a, b in zip(parts, w)) + w[-1]
        assert abs(got - 1 / (1 + math.exp(-(model.line[0] * g + model.line[1])))) < 1e-6


def test_rows_without_an_id_are_in_no_split(spark):
    from memengine.llm._common import split_of

    rows = spark.createDataFrame([(None, "a"), (3, "b")], "doc_id long, t string")
    assert [r[0] for r in rows.select(split_of(F.col("doc_id"), 4) == 2).collect()][0] is False


def test_held_out_accuracy_of_the_registered_queries(spark):
    from memengine.llm import queries

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}

    def held(query, label):
        rows = [(getattr(labels[r.doc_id], label), r.score, r.predicted) for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
        rows = [r for r in rows if r[0] in (0, 1)]
        good, bad = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0]
        auc = np.mean([(a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in good for b in bad])
        return auc, np.mean([r[2] for r in good]), np.mean([r[2] for r in bad])

    auc, found, wrong = held(queries.op7_toxicity, "toxic")
    assert auc >= 0.95 and found >= 0.9 and wrong <= 0.01  # some rows are marked toxic without a toxic word
    auc, found, wrong = held(queries.op3_quality, "quality")
    assert auc >= 0.97 and found >= 0.9 and wrong <= 0.2
    said = [(langs[r.doc_id], r.lang_pred) for r in queries.op5_language_id(spark, sf).collect() if r.held_out and langs[r.doc_id]]
    assert np.mean([a == b for a, b in said]) >= 0.97
