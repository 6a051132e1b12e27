"""Operator 8: licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line, or a block of several lines up to a blank one, as licence texts are wrapped. All
are described by their distinct words and word pairs. A multinomial logistic regression over these sparse
features, fitted on licence notices built from ``NAMES``, ``CARRIERS`` and ``NOTICES``, on notices of licences
without a family here (``STRANGERS``) and on sentences that use the same words otherwise, gives a probability
to each licence family and to unknown. Unknown has half of the weight.

Calibration. Kin families are left out of the fit in turn, with the carriers of one remainder: their notices
are what an unseen licence looks like, those of the other families under these carriers what a seen one does.
A temperature is fitted to the margins, and the least probability at which a family is predicted is where the
shares of seen notices that are named rightly and of unseen ones that are not named are best together. A family
is predicted if it is as likely as that, and likelier than unknown and all others. Before any shuffle a filter (``_could_be``) drops paragraphs whose terms can't
outweigh the bias of unknown for any family, however they are weighed; it passes all others.

A prediction is confirmed if a template of the family lies in the paragraph: at least ``similarity`` of
its shingles of five words (a shorter template is one shingle).

A block is given only where no line of it is confirmed for the same family.

The weights are a table of a few thousand terms, bounded by the texts in this file; it alone is broadcast.

Defined results: null and empty texts have no paragraph; a document may have several rows; rows that
repeat a document give its rows once; equal probabilities go to the first family by name; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import cut

# Names of the families.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL version 3", "Affero General Public License v3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License", "Apache Software License", "Apache-Lizenz 2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "BSD-Lizenz"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero", "CC0-1.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GNU GPL version 2", "GPLv2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GNU GPL version 3", "GPLv3", "GNU General Public License v3.0"],
    "isc": ["ISC License", "ISC licence"],
    "lgpl": ["GNU Lesser General Public License, version 3", "LGPL-2.1", "GNU LGPL version 2.1", "LGPLv3"],
    "mit": ["MIT License", "MIT licence", "MIT-style license", "MIT", "Expat License", "MIT-Lizenz"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License 2.0"],
    "unlicense": ["Unlicense", "public domain", "The Unlicense"],
}
# Sentences around a name.
CARRIERS = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.",
    "Distributed under the {}. See LICENSE for more information.", "SPDX-License-Identifier: {}", "License: {}", "Copyright (c) 2021 Jane Doe. Released under the {}.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the {}.", "Available under the {} license.", "Published under {}.", "{}",
    "Veröffentlicht unter der {}.", "Lizenziert unter {}.", "Dieses Werk steht unter der {}.", "Publié sous licence {}.", "Distribué sous les termes de la licence {}.", "Ce logiciel est régi par la {}.",
    "Publicado bajo la licencia {}.", "Distribuido bajo los términos de la {}.", "Esta obra está bajo una licencia {}.",
]
# Longer notices, by family (sentences of the public licence texts).
NOTICES = {
    "apache-2.0": [
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "gpl-3.0": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential. All rights reserved.", "(c) 2019 The Authors. All Rights Reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
# The same words in other senses.
OTHERS = [
    "He lost his driving license on the way home.", "A licensed physician must be present.", "The city issues a license for each dog.", "The library has a section on copyright law.",
    "Copyright is a branch of law that students rarely enjoy.", "She asked for permission to leave the room.", "Permission was granted by the head of the school.", "The police had a warrant for the search.",
    "The machine comes with a warranty of two years.", "Her rights reserved for citizens were taken away.", "The story has been in the public domain of gossip for years.", "The fishing licence costs ten crowns a year.",
    "They redistributed the grain among the villages.", "The restaurant lost its liquor license under the new mayor.", "The version of the general who held the license to act was published.", "A license plate was found under the bridge.",
    "The terms of the licence deal between the two clubs are secret.", "Software licensing is a large market.", "The copyright dispute between the publishers goes on.", "You need permission to use this road.",
    "Er kam mit dem Zug nach Hause.", "Mit der Zeit und mit Geduld.", "Nicht mit uns.", "Sie ging mit ihm in den Garten.", "Die Stadt mit einem Hafen und mit vielen Kirchen.", "Das ist mit.", "Komm mit und lies.",
]
# Licences without a family here.
STRANGERS = [
    "Common Public License 1.0", "European Union Public Licence 1.2", "Microsoft Public License", "Lucent Public License 1.02", "Sun Public License 1.0", "Q Public License 1.0", "Common Development and Distribution License 1.0",
    "zlib License", "PostgreSQL License", "SIL Open Font License 1.1", "Academic Free License 3.0", "Open Software License 3.0", "PHP License 3.01", "Ruby License", "Python Software Foundation License", "Server Side Public License, version 1",
    "Business Source License 1.1", "Elastic License 2.0", "Reciprocal Public License 1.5", "Open Data Commons Attribution License", "GNU Free Documentation License 1.3", "NCSA License", "W3C Software Notice and License", "WTFPL",
]
# Plain sentences, which show common words without a licence.
PLAIN = [
    "It was the best of the days that they had spent by the sea, and all of them were free to go where they liked.", "The following morning he found a copy of the book in the public library, or so he said.",
    "This is the first time that the two of us have been to the market in the general direction of the river.", "You can use this road for any purpose, but not for the transport of animals or of other goods.",
    "He is a member of the commons, and she is a creative writer with a domain of her own in the south.", "We have been working on it for 3 years, and version 2 of the plan was finished in 2019 or 2020.",
    "This is by far the best, and it was done by one of them, by the way, not by any of you, if this is what you can see.", "This house and this road were built by the same man, by hand, and this is how they are used to this day.",
    "There are 4 or 5 ways to do it, with or without the help of the others, and each of them is as good as any.", "All of the rights and duties that come with the house were reserved for his eldest son, the founder.",
    "The software that she wrote is distributed to all schools of the country and includes a file for each pupil.", "If you want to see it, you may obtain a ticket at the door, as is usual in this part of the town.",
    "Es ist nicht unter der Brücke, sondern in der Stadt, und die Lizenz zum Angeln steht in diesem Werk.", "Die Kinder spielen unter den Bäumen, und das Buch wurde unter einem anderen Namen veröffentlicht.",
    "Il est parti sous la pluie avec les enfants, et la licence de pêche est restée dans la maison.", "Ce livre a été publié sous un autre nom, et les termes de la lettre sont clairs pour tous.",
    "El niño vive bajo el puente con su madre, y la licencia de conducir está en esta obra de teatro.", "Los términos de la carta son claros, y el libro fue publicado bajo otro nombre en la ciudad.",
]
# Common words of several languages, the commonest first.
COMMON = (
    "the of and to in a de is that it la for was on be as with by an this are at der les or los est una par not from his her he she have has had but all they which you one we were und die das von den des "
    "el que las del se por con para un le et que du dans pour qui sur ist nicht ein eine auf zu im sich es any can may will no if its other than been there their who into out up only new some time these two then do"
).split()
# Kin families: one is mistaken for another, so they are left out of a fit together.
KIN = [{"agpl-3.0", "gpl-2.0", "gpl-3.0", "lgpl"}, {"cc-by", "cc-by-nc", "cc-by-sa", "cc0"}, {"apache-2.0", "mpl-2.0", "isc"}, {"bsd", "mit", "proprietary", "unlicense"}]
UNKNOWN = "unknown"
_TOKEN = r"[a-z0-9ß-ɏ]+(?:[.\-][a-z0-9ß-ɏ]+)*"


def _tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _terms(text: str) -> set[str]:
    w = _tokens(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def templates() -> dict[str, list[str]]:
    """Normalised templates of each family: its names as they follow a carrier, and its notices."""
    out: dict[str, list[str]] = {}
    for family in sorted({*NAMES, *NOTICES}):
        texts = [*NAMES.get(family, []), *NOTICES.get(family, [])]
        out[family] = sorted({" ".join(_tokens(t)) for t in texts})
    return out


def training_set() -> list[tuple[str, str, int]]:
    """(family, text, number of the carrier, or -1)."""
    rows = [(f, c.format(n), k) for f, names in NAMES.items() for n in names for k, c in enumerate(CARRIERS)]
    rows += [(f, t, -1) for f, texts in NOTICES.items() for t in texts for _ in range(6)]
    rows += [(f, f"{a} {b}", -1) for f, texts in NOTICES.items() for a in texts for b in texts if a != b]
    rows += [(UNKNOWN, t, -1) for t in [*OTHERS, *PLAIN] for _ in range(4)]
    # Common words tell nothing, one by one or several.
    rows += [(UNKNOWN, " ".join(COMMON[a : a + n]), -1) for n in (1, 4) for a in range(0, len(COMMON), n)]
    # Carriers alone, around names that are no licence, and around those of other licences, tell nothing.
    rows += [(UNKNOWN, c.format(n), k) for k, c in enumerate(CARRIERS) for n in ("", "new mayor", "agreement between the parties", "Acme Example License 7", *STRANGERS)]
    return rows


def _weights(families: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Half of the weight to unknown, the other half in equal parts to the families."""
    names, at = np.unique(families, return_inverse=True)
    share = np.where(names == UNKNOWN, 0.5, 0.5 / max(1, len(names) - 1)) / np.bincount(at, times)
    return (share[at] * times * len(families)).astype(np.float32)


def _fit(gram: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient steps with momentum: weights as sums of rows, and the bias.

    Weights lie in the span of the rows all the way, so that only products of rows are needed.
    """
    a, b = np.zeros(y.shape, np.float32), np.zeros(y.shape[1], np.float32)
    va, vb = np.zeros_like(a), np.zeros_like(b)
    for _ in range(250):
        z = gram @ a + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y) * weight[:, None] / len(y)
        va = 0.9 * va - 4.0 * (g + 1e-5 * a)
        vb = 0.9 * vb - 4.0 * g.sum(axis=0)
        a, b = a + va, b + vb
    return a, b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@cache
def model() -> tuple[list[str], list[str], np.ndarray, np.ndarray, float, float]:
    """Classes, terms, weights (terms, classes), bias, temperature, least probability of a prediction."""
    counted = Counter(training_set())
    rows, times = list(counted), np.array(list(counted.values()))
    family, carrier = np.array([f for f, _, _ in rows]), np.array([k for _, _, k in rows])
    classes = sorted(set(family.tolist()))
    sets = [_terms(t) for _, t, _ in rows]
    terms = sorted(set().union(*sets))
    at = {t: k for k, t in enumerate(terms)}
    x = np.zeros((len(rows), len(terms)), np.float32)
    for i, found in enumerate(sets):
        x[i, [at[t] for t in found]] = 1 / np.sqrt(max(1, len(found)))
    y = (family[:, None] == np.array(classes)[None, :]).astype(np.float32)
    gram, u = x @ x.T, classes.index(UNKNOWN)

    # Margins of notices that a fit has not seen: (logits, true class); families that it has not seen are unknown.
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for fold, kin in enumerate(KIN):
        strange = np.isin(family, list(kin))
        apart = carrier % len(KIN) == fold
        train = np.flatnonzero(~strange & ~(apart & (carrier >= 0)))
        test = np.flatnonzero(strange | (apart & (carrier >= 0)))
        a, b = _fit(gram[np.ix_(train, train)], y[train], _weights(family[train], times[train]))
        z = gram[np.ix_(test, train)] @ a + b
        gone = [classes.index(f) for f in kin]
        z[:, gone] = -1e9
        held.append((z, np.where(strange[test], u, y[test].argmax(axis=1))))
    z, true = np.vstack([h[0] for h in held]), np.concatenate([h[1] for h in held])
    known = true != u
    share = np.where(known, 0.5 / known.sum(), 0.5 / (~known).sum())

    def loss(t: float) -> float:
        return float(-(share * np.log(_softmax(z / t)[np.arange(len(z)), true] + 1e-12)).sum())

    temperature = float(min(np.geomspace(0.1, 5, 60), key=loss))
    p = _softmax(z / temperature)
    best, top = p.argmax(axis=1), p.max(axis=1)

    def worth(least: float) -> float:
        named = (best != u) & (top >= least)
        return float((named & (best == true))[known].mean() + (~named)[~known].mean())

    least = float(max(np.linspace(0.2, 0.95, 76), key=worth))
    a, b = _fit(gram, y, _weights(family, times))
    return classes, terms, (x.T @ a).astype(np.float64), b.astype(np.float64), temperature, least


def _leads() -> tuple[list[str], np.ndarray, float]:
    """Terms, the lead of each over unknown for the family that it helps most, and the lead that a family needs."""
    classes, terms, weights, bias, _, _ = model()
    u = classes.index(UNKNOWN)
    others = [k for k in range(len(classes)) if k != u]
    w = weights.round(6)
    return terms, (w[:, others] - w[:, [u]]).max(axis=1), float(bias[u] - bias[others].max())


@cache
def _key_words() -> list[str] | None:
    """Words of which a paragraph of any family has one at least; None if there is no such list.

    All words of terms that help a family, but for words of ``COMMON`` that can't make a family alone: for
    each family, the sum of the m largest leads among terms of such words stays below what m distinct terms
    need, for every m.
    """
    classes, terms, weights, bias, _, _ = model()
    u = classes.index(UNKNOWN)
    lead = weights.round(6) - weights.round(6)[:, [u]]
    need = bias[u] - bias
    others = [k for k in range(len(classes)) if k != u]
    if need[others].min() <= 0:  # then a paragraph without a known term can have a family
        return None

    def harmless(free: set[str]) -> bool:
        some = [k for k, t in enumerate(terms) if all(x in free for x in t.split())]
        best = np.sort(np.maximum(lead[np.ix_(some, others)], 0), axis=0)[::-1]
        return bool((best.cumsum(axis=0) < 0.98 * need[others] * np.sqrt(np.arange(1, len(some) + 1))[:, None]).all())

    free: set[str] = set()
    for word in COMMON:
        if harmless(free | {word}):
            free.add(word)
    helps = {x for k, t in enumerate(terms) if lead[k, others].max() > 0 for x in t.split()}
    return sorted(helps - free)


def _has_key(words: Column) -> Column:
    """Whether the words can be of a family at all; passes all paragraphs that are."""
    keys = _key_words()
    return F.size(words) > 0 if keys is None else F.exists(words, lambda x: x.isin(keys))


def _could_be(found: Column) -> Column:
    """Whether paragraphs of these terms can be of a family: an upper bound of its lead over unknown.

    A term's lead counts as the largest of its step, for the family that it helps most.
    """
    terms, lead, need = _leads()
    if need <= 0:  # then even a paragraph without a known term has a family
        return F.lit(True)
    helps = [t for t, v in zip(terms, lead) if v > 0]
    edges = [0.0, *np.quantile(lead[lead > 0], [0.2, 0.4, 0.6, 0.75, 0.85, 0.93, 0.97]), float(lead.max())]
    steps = [([t for t, v in zip(terms, lead) if a < v <= b], float(b)) for a, b in zip(edges, edges[1:])]

    def bound(x: Column) -> Column:
        out = F.lit(0.0)
        for some, most in reversed(steps):
            if some:
                out = F.when(x.isin(some), F.lit(most)).otherwise(out)
        return out

    most = F.aggregate(F.filter(found, lambda x: x.isin(helps)), F.lit(0.0), lambda a, x: a + bound(x))
    return most + 1e-3 >= F.lit(need) * F.sqrt(F.size(found))


def _paragraphs(t: Column) -> Column:
    """Lines, and blocks of several lines, as (n: first line, lines, p)."""
    lines = F.split(t, "\n")
    singles = F.transform(lines, lambda x, i: F.struct(i.alias("n"), F.lit(1).alias("lines"), x.alias("p")))
    full = F.transform(lines, lambda x: x.rlike(r"\S"))
    starts = F.filter(F.transform(full, lambda x, i: F.when(x & ~F.coalesce(F.get(full, i - 1), F.lit(False)), i)), lambda x: x.isNotNull())
    blocks = F.filter(F.split(t, r"\n(?:[^\S\n]*\n)+"), lambda x: x.rlike(r"\S"))
    blocks = F.transform(blocks, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    several = F.transform(F.arrays_zip(starts.alias("n"), blocks.alias("p")), lambda x: F.struct(x["n"].alias("n"), F.size(F.split(x["p"], "\n")).alias("lines"), x["p"].alias("p")))
    return F.concat(singles, F.filter(several, lambda x: x["lines"] > 1))


def _terms_of(words: Column) -> Column:
    pairs = F.transform(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))).alias("a"), F.slice(words, 2, F.size(words)).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id, paragraph, lines, family, probability, similarity, confirmed): a row for each licence paragraph."""
    spark = docs.sparkSession
    classes, terms, weights, bias, temperature, least = model()
    table = spark.createDataFrame([(t, [float(v) for v in w]) for t, w in zip(terms, weights.round(6))], "term string, w array<double>")
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("t"))
    par = low.select("id", F.explode(_paragraphs(F.col("t"))).alias("x")).select("id", F.col("x.n").alias("paragraph"), F.col("x.lines").alias("lines"), F.col("x.p").alias("p"))
    # An array of one, exploded: computed once, where a projection would be computed anew in each filter.
    words = F.regexp_extract_all("p", F.lit(_TOKEN), F.lit(0))
    par = par.select("id", "paragraph", "lines", F.explode(F.array(words)).alias("words")).filter(_has_key(F.col("words")))
    par = par.select("id", "paragraph", "lines", "words", F.explode(F.array(_terms_of(F.col("words")))).alias("found")).filter(_could_be(F.col("found")))
    par = par.select("id", "paragraph", "lines", F.array_join("words", " ").alias("norm"), "found").distinct()
    described = par.select("id", "paragraph", "lines", F.size("found").alias("n"), "norm", F.explode("found").alias("term"))
    sums = [F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(len(classes))]
    scored = described.join(F.broadcast(table), "term", "left").groupBy("id", "paragraph", "lines", "n", "norm").agg(*sums)
    logits = [((F.col(f"s{k}") / F.sqrt("n") + F.lit(float(bias[k]))) / F.lit(temperature)) for k in range(len(classes))]
    scored = scored.select("id", "paragraph", "lines", "norm", F.array(*logits).alias("z"))
    top = F.array_max("z")
    share = F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - top))
    names = F.array(*(F.lit(c) for c in classes))
    best = scored.select("id", "paragraph", "lines", "norm", F.get(names, F.array_position("z", top).cast("int") - 1).alias("family"), share.alias("probability"))
    best = best.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    found = _containment(F.col("family"), F.col("norm"))
    rows = best.select("id", "paragraph", "lines", "family", F.round("probability", 6).alias("probability"), F.round(found, 6).alias("similarity"), (found >= similarity).alias("confirmed"))
    rows = cut(rows)  # read twice below
    line = rows.filter("lines = 1 and confirmed").select(F.col("id").alias("__id"), F.col("paragraph").alias("__at"), F.col("family").alias("__family"))
    said = F.col("id").eqNullSafe(F.col("__id")) & (F.col("family") == F.col("__family"))
    said = said & (F.col("lines") > 1) & F.col("__at").between(F.col("paragraph"), F.col("paragraph") + F.col("lines") - 1)
    return rows.join(line, said, "left_anti").withColumnRenamed("id", id_col)


def _containment(family: Column, norm: Column) -> Column:
    """Largest share, over the family's templates, of a template's shingles that the paragraph has."""
    named = []
    for name, texts in templates().items():
        for t in texts:
            w = t.split()
            named.append({"f": name, "s": [f" {' '.join(w[i : i + 5])} " for i in range(max(1, len(w) - 4))]})
    # One constant, so that the expression stays small however many templates there are.
    every = F.from_json(F.lit(json.dumps(named)), "array<struct<f string, s array<string>>>")
    inside = F.concat(F.lit(" "), norm, F.lit(" "))
    share = F.transform(F.filter(every, lambda x: x["f"] == family), lambda x: F.size(F.filter(x["s"], lambda v: F.contains(inside, v))) / F.size(x["s"]))
    return F.coalesce(F.array_max(share), F.lit(0.0))
