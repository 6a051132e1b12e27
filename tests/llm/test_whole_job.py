"""Operators do the whole job: dropout by occurrence, licences without a cue."""

import numpy as np
from llm_data import make_docs, prose

from memengine.llm import licenses, pieces
from memengine.llm.queries import TOKENIZER


def test_dropout_varies_by_occurrence_at_every_length():
    model = pieces.load_model(TOKENIZER)
    enc, dec = model.encoder(0.1, 7), model.decoder()
    for word in ("the", "garden", "international", "x" + "information" * 4):
        unit, text = pieces.SPACE + word, " ".join([word] * 2000)
        first, second = enc([text, text], [1, 2])
        assert first.tolist() != second.tolist() and dec(first) == dec(second) == text
        places = pieces._places(pieces._doc_key(1, 7), 2000).tolist()
        want = [model.unit_ids(unit, 0.1, k) for k in places]  # each occurrence on its own
        assert first.tolist() == [x for ids in want for x in ids]
        assert len({tuple(x) for x in want}) > 1
        # Candidates that come up without a skip: one for each merge. All of them pass with 0.9 to their number.
        plain = model.unit_ids(unit, 0.0, 0)
        steps = int(model._merge([unit], np.zeros((1, 0), np.int64))[2][0])
        passed = np.mean([next(pieces._skips(k, 0.1)) >= steps for k in places])
        assert abs(passed - 0.9**steps) < 0.045 and all(x == plain for x, k in zip(want, places) if next(pieces._skips(k, 0.1)) >= steps)


def test_dropout_does_not_depend_on_the_cache():
    model = pieces.load_model(TOKENIZER)
    texts = [" ".join(f"{w}{k % 7}" for w in ("naïve", "remembering", "日本", "river", "a▁b")) for k in range(40)] + ["plain words alone " * 9]
    whole = model.encoder(0.2, 3)(texts, list(range(len(texts))))
    small = model.encoder(0.2, 3, cache_size=1)
    alone = [small([t], [k])[0] for k, t in enumerate(texts)]
    assert all(a.tolist() == b.tolist() for a, b in zip(whole, alone))


def test_dropout_frames_vary_between_documents(spark):
    docs = make_docs(spark, ["extraordinary circumstances " * 50] * 4)
    rows = pieces.round_trip(docs, TOKENIZER).collect()
    assert all(r.lossless for r in rows) and len({r.tokens_sha256 for r in rows}) == 4


WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated
documentation files, to deal in the
Software without restriction"""


def test_licences_without_a_cue_and_wrapped(spark):
    texts = [(f, c.format(n)) for f, names in licenses.NAMES.items() for n in names for c in ("Released under the {}.", "Published under {}.", "{}")]
    texts += [(f, t) for f, notices in licenses.NOTICES.items() for t in notices]
    docs = make_docs(spark, [t for _, t in texts])
    got = {(r.doc_id, r.family) for r in licenses.scan(docs).collect() if r.confirmed}
    assert got == {(k, f) for k, (f, _) in enumerate(texts)}
    more = make_docs(spark, [f"\n some text\n \n\n{WRAPPED}\n\t\nlast", "Mit und.", "Ein Haus mit Garten.", f"{WRAPPED}\n"])
    found = licenses.scan(more).collect()
    assert {(r.doc_id, r.paragraph, r.lines, r.family) for r in found if r.confirmed} == {(0, 4, 4, "mit"), (3, 0, 4, "mit")}
    assert {r.doc_id for r in found} == {0, 3}


def test_licence_filter_passes_all_that_the_classifier_names(spark, rng):
    classes, terms, w, b, temperature, least = licenses.model()
    at = {t: k for k, t in enumerate(terms)}
    words = sorted({x for t in terms for x in t.split()})
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) + " " + " ".join(rng.sample(terms, 3)) + " " + prose(rng, rng.randrange(9)) for _ in range(1500)]
    # Notices with words lost and added.
    for _, t, _ in rng.sample(licenses.training_set(), 600):
        kept = [x for x in t.split() if rng.random() < 0.85] + rng.choices(words, k=rng.randrange(5))
        texts.append(" ".join(rng.sample(kept, len(kept)) if rng.random() < 0.3 else kept))

    def named(t):
        s = sorted(licenses._terms(t))
        z = sum((w[at[x]].round(6) for x in s if x in at), np.zeros(len(classes))) / np.sqrt(max(1, len(s))) + b
        p = licenses._softmax(z[None] / temperature)[0]
        return classes[int(z.argmax())] if p.max() >= least else licenses.UNKNOWN

    want = {(k, named(t)) for k, t in enumerate(texts)}
    want = {(k, f) for k, f in want if f != licenses.UNKNOWN}
    got = {(r.doc_id, r.family) for r in licenses.scan(make_docs(spark, texts)).collect()}
    assert len(want) > 100 and got == want


#: Licences of which the training knows neither name nor text, and carriers that it does not know.
UNSEEN = ["Eclipse Public License 2.0", "Artistic License 2.0", "Boost Software License 1.0", "CeCILL 2.1", "IBM Public License 1.0", "Vim License", "Netscape Public License 1.1", "OpenSSL License", "Unicode License v3"]
NEW_CARRIERS = ["This library is made available under the {}.", "Code licensed under {}", "Lizenz: {}", "Sous licence {}", "Licencia: {}", "The authors chose the {} for it."]
HEADERS = {
    "bsd": "Redistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:\n1. Redistributions of source code must retain the above copyright",
    "apache-2.0": "You may not use this file except in compliance\nwith the License. You may obtain a copy of\nthe License at\nhttp://www.apache.org/licenses/LICENSE-2.0",
    "mit": WRAPPED,
}


def test_licences_of_no_family_are_unknown_and_others_are_found(spark):
    strange = [c.format(n) for n in UNSEEN for c in [*NEW_CARRIERS, "Licensed under the {}.", "Released under the {}."]]
    known = [(f, c.format(n)) for f, names in licenses.NAMES.items() for n in names for c in NEW_CARRIERS]
    docs = make_docs(spark, [*strange, *(t for _, t in known), *HEADERS.values()])
    rows = licenses.scan(docs).collect()
    assert len({r.doc_id for r in rows if r.doc_id < len(strange)}) <= 0.05 * len(strange)
    got = {r.doc_id - len(strange): r for r in rows if r.doc_id >= len(strange)}
    right = [got[k].family == f for k, (f, _) in enumerate(known) if k in got]
    assert sum(right) >= 0.9 * len(known) and sum(right) >= 0.97 * len(right)
    for k, family in enumerate(HEADERS):
        assert any(r.family == family and r.confirmed and r.lines > 1 for r in rows if r.doc_id == len(strange) + len(known) + k)


def test_licence_probabilities_are_calibrated_by_family():
    classes, _, _, _, temperature, least = licenses.model()
    assert sorted(x for kin in licenses.KIN for x in kin) == sorted(set(classes) - {licenses.UNKNOWN})
    assert 0.1 <= temperature <= 5 and 0.2 <= least < 0.95
