"""Operator 7: toxicity by Levenshtein automata over a lexicon trie, with context windows.

Lexicon. To a short list of insults (a parameter) come terms learned from labelled rows of the training split:
whole words and word stems (prefixes of 4 to 7 letters) that mark label 1 by a G-test, the strongest first, one
per group of near copies (rows whose rarest word hash agrees count once).

Matching. The Levenshtein automata of all terms (words: one edit from 5 letters on, two from 9; stems: one edit
from 6 letters on, whatever follows) run against the trie of the terms and are determinised into one table, so
that a pass over the bytes' characters follows all words of a slice at once. A lexicon whose table would pass
``max_states`` is parted over several tables. A word that training rows labelled 0 also use is no misspelling.

Scoring. Each hit is scored by a window of 8 words: quotation marks around it and verbs of reporting
before it speak for quotation, second-person words for abuse. Per document the sums of exact, misspelled
and quoted hits, their density and the best window feed a logistic regression, fitted on at most
``per_class`` rows of each label. Rows labelled 1 count once more with their exact hits taken as misspelled,
and rows are measured with the plain words of the other half of the sample, so that the fit sees misspellings
as unseen texts have them.

Defined results: null and empty texts, and all texts if no label was learned, get the score of a text
without hits; repeated rows get a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import SLICE_BYTES, Words, bounded_sample, byte_words, code_points, range_hashes, slices, split_of, string_array, text_batches

# Verbs that introduce a quotation, and words that address a reader.
REPORTING = ("said says wrote writes called quoted quote quoting replied shouted reads dijo dice escribió cita sagte sagt schrieb zitat dit écrit citation a-dit").split()
SECOND_PERSON = "you your yours youre tu te ti usted ustedes vous votre toi du dich dir sie euch".split()
FEATURES = 8
# Common English insults that the lexicon starts from; training adds the rest.
SEED_TERMS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumbass jerk bastard".split()


def edits_for(term: str) -> int:
    """Edits that a whole word may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def stem_edits_for(stem: str) -> int:
    """Edits that the beginning of a word may have against a stem."""
    return 0 if len(stem) < 6 else 1


class TooLarge(Exception):
    """The table of a lexicon has more states than it may."""


def automata(words: list[str], stems: list[str], max_states: int = 60_000) -> list[Automaton]:
    """One automaton for the whole lexicon, or several for parts of it that fit."""
    try:
        return [Automaton(words, stems, max_states)] if words or stems else []
    except TooLarge:
        if len(words) + len(stems) < 2:  # one very long term
            return [Automaton(words, stems, 1 << 30)]
        w, s = (len(words) // 2, len(stems) // 2) if min(len(words), len(stems)) > 1 else (len(words), 0) if words and stems else (len(words) // 2, len(stems) // 2)
        parts = [(words[:w], stems[:s]), (words[w:], stems[s:])]
        return [a for part in parts for a in automata(*part, max_states)]


class Automaton:
    """One deterministic table for the trie of all terms and their Levenshtein automata.

    A state is the set of (trie node, edits so far) reachable, and whether a misspelled stem was met; letters
    outside the lexicon share a column. ``value`` gives for each state 0 none, 1 misspelled, 2 exact. Stems that
    match exactly accept for good; whole words only at their end.
    """

    def __init__(self, words: list[str], stems: list[str], max_states: int = 60_000) -> None:
        children: list[dict[str, int]] = [{}]
        word: dict[int, int] = {}  # node -> edits that a word which ends here may have
        stem: dict[int, int] = {}
        for terms, ends, edits in ((words, word, edits_for), (stems, stem, stem_edits_for)):
            for term in terms:
                at = 0
                for c in term:
                    if c not in children[at]:
                        children[at][c] = len(children)
                        children.append({})
                    at = children[at][c]
                ends[at] = edits(term)
        # Most edits that any term at or below a node allows. A child has a larger number than its parent.
        allow = [max(word.get(n, -1), stem.get(n, -1)) for n in range(len(children))]
        for n in range(len(children) - 1, -1, -1):
            allow[n] = max([allow[n], *(allow[kid] for kid in children[n].values())])
        self.alphabet = sorted({c for kids in children for c in kids})
        col = {c: i + 1 for i, c in enumerate(self.alphabet)}

        def closure(items: dict[int, int]) -> dict[int, int]:
            # Deletions: a term's letter that the word lacks.
            todo = list(items.items())
            while todo:
                node, e = todo.pop()
                for kid in children[node].values():
                    if e + 1 <= allow[kid] and e + 1 < items.get(kid, 99):
                        items[kid] = e + 1
                        todo.append((kid, e + 1))
            return items

        dead, exact, near = 0, 2, 3  # rows for nothing, an exact stem, a misspelled stem and nothing else
        width = len(col) + 1
        rows: list[list[int]] = [[dead] * width, [dead] * width, [exact] * width, [near] * width]
        values = [0, 0, 2, 1]
        start = closure({0: 0})
        index, queue = {(frozenset(start.items()), False): 1}, [(start, False)]
        while queue:
            items, met = queue.pop()
            me = index[frozenset(items.items()), met]
            values[me] = max([int(met), *(2 if e == 0 else 1 for n, e in items.items() if e <= word.get(n, -1))])
            for k in range(width):
                letter = self.alphabet[k - 1] if k else None
                nxt: dict[int, int] = {}
                for node, e in items.items():
                    for c, kid in children[node].items():
                        cost = e + (c != letter)
                        if cost <= allow[kid]:
                            nxt[kid] = min(nxt.get(kid, 99), cost)
                    if e + 1 <= allow[node]:  # a letter too many
                        nxt[node] = min(nxt.get(node, 99), e + 1)
                nxt = closure(nxt)
                if any(e == 0 and n in stem for n, e in nxt.items()):
                    rows[me][k] = exact
                    continue
                seen = met or any(e <= stem.get(n, -1) for n, e in nxt.items())
                if not nxt:
                    rows[me][k] = near if seen else dead
                    continue
                name = (frozenset(nxt.items()), seen)
                if name not in index:
                    if len(rows) >= max_states:
                        raise TooLarge(len(words) + len(stems))
                    index[name] = len(rows)
                    rows.append([dead] * width)
                    values.append(0)
                    queue.append((nxt, seen))
                rows[me][k] = index[name]
        self.next = np.array(rows, np.int32)
        self.value = np.array(values, np.int8)
        top = max([0x250, *(ord(c) + 1 for c in self.alphabet)])
        self.column = np.zeros(top + 1, np.int32)  # code point -> column; the last place is for all beyond
        for c, k in col.items():
            self.column[ord(c)] = k

    def run(self, columns: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Value of each word, following all words of a slice letter by letter."""
        out = np.zeros(starts.size, np.int8)
        live = np.arange(starts.size)
        state = np.ones(starts.size, np.int32)
        at = starts.copy()
        while live.size:
            state = self.next[state, columns[at]]
            at = at + 1
            done = at >= ends[live]
            out[live[done]] = self.value[state[done]]
            keep = ~done & (state > 0)
            live, state, at = live[keep], state[keep], at[keep]
        return out


def word_values(lexicon: list[Automaton], w: Words) -> np.ndarray:
    """Value of each word of a slice: the best over all tables."""
    out = np.zeros(w.starts.size, np.int8)
    code, first = code_points(w.data)
    lead = np.zeros(w.data.size, bool)
    lead[first] = True
    number = np.concatenate(([0], np.cumsum(lead)))  # the character that each byte starts
    starts, ends = number[w.starts], number[w.ends]
    for auto in lexicon:
        out = np.maximum(out, auto.run(auto.column[np.minimum(code, auto.column.size - 1)], starts, ends))
    return out


def _quote_depth(data: np.ndarray) -> np.ndarray:
    """True at bytes that are quotation marks or parts of them."""
    q = data == 0x22
    c2 = np.flatnonzero(data[:-1] == 0xC2)
    c2 = c2[(data[c2 + 1] == 0xAB) | (data[c2 + 1] == 0xBB)]
    q[c2] = True
    e2 = np.flatnonzero(data[:-2] == 0xE2)
    e2 = e2[(data[e2 + 1] == 0x80) & (data[e2 + 2] >= 0x98) & (data[e2 + 2] <= 0x9F)]
    q[e2] = True
    return q


def extractor(lexicon: list[Automaton], plain: frozenset[int], window: int = 8, blur: bool = False):
    """Function of a string array to a (rows, FEATURES) matrix.

    ``plain``: hashes of words that look like misspellings and are none; ``blur``: take exact hits as misspelled.
    """
    reporting = np.sort(np.unique(_hash_words(REPORTING)))
    second = np.sort(np.unique(_hash_words(SECOND_PERSON)))
    known = np.array(sorted(plain), np.uint64)

    def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not table.size:
            return np.zeros(h.size, bool)
        return table[np.minimum(np.searchsorted(table, h), table.size - 1)] == h

    def features(texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for a, b in slices(texts, SLICE_BYTES):
            w = byte_words(pc.utf8_lower(texts.slice(a, b - a)))
            if not w.starts.size or not lexicon:
                continue
            value = word_values(lexicon, w)
            hits = np.flatnonzero(value)
            if not hits.size:
                continue
            # The windows' words alone need hashes.
            hashes = range_hashes_of(w, hits)
            fine = (value[hits] == 2) | ~among(hashes, known)
            hits, hashes = hits[fine], hashes[fine]
            if not hits.size:
                continue
            marks = np.concatenate(([0], np.cumsum(_quote_depth(w.data))))
            row = w.row[hits]
            lo = np.maximum(hits - window, w.first[row])
            hi = np.minimum(hits + window, w.first[row + 1] - 1)
            open_before = marks[w.starts[hits]] - marks[w.starts[lo]]
            close_after = marks[w.ends[hi]] - marks[w.ends[hits]]
            near = np.unique((hits[:, None] + np.arange(-window, window + 1)[None, :]).clip(0, w.starts.size - 1))
            nh = range_hashes_of(w, near)
            said = np.zeros(w.starts.size + 1, np.int64)
            said[near[among(nh, reporting)]] = 1
            said = np.concatenate(([0], np.cumsum(said)))
            you = np.zeros(w.starts.size + 1, np.int64)
            you[near[among(nh, second)]] = 1
            you = np.concatenate(([0], np.cumsum(you)))
            quoted = ((open_before > 0) & (close_after > 0)) * 0.6 + (said[hits] - said[lo] > 0) * 0.3
            abuse = np.clip(1 - quoted + 0.2 * (you[hi + 1] - you[lo] > 0), 0.1, 1.2)
            exact = (value[hits] == 2) & (not blur)
            n = np.maximum(w.first[1:] - w.first[:-1], 1)[: b - a]
            sums = [np.bincount(row, x, b - a) for x in (abuse * exact, abuse * ~exact, quoted, exact * 1.0)]
            best = np.zeros(b - a)
            np.maximum.at(best, row, np.where(exact, abuse, 0.5 * abuse))
            block = out[a:b]
            block[:, 0] = np.log1p(sums[0])
            block[:, 1] = np.log1p(sums[1])
            block[:, 2] = np.log1p(sums[2])
            block[:, 3] = sums[0] > 0
            block[:, 4] = sums[1] > 0
            block[:, 5] = best
            block[:, 6] = np.log1p(100 * sums[0] / n)
            block[:, 7] = np.log1p(100 * sums[1] / n)
        return out

    return features


def range_hashes_of(w, which: np.ndarray) -> np.ndarray:
    """Hashes of some words only (each from its own bytes)."""
    parts = [w.data[s:e] for s, e in zip(w.starts[which].tolist(), w.ends[which].tolist())]
    if not parts:
        return np.zeros(0, np.uint64)
    lens = np.array([p.size for p in parts])
    ends = np.cumsum(lens)
    return range_hashes_abs(np.concatenate(parts), ends - lens, ends)


def range_hashes_abs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(data, starts, ends)


def _hash_words(words: list[str]) -> np.ndarray:
    data = "".join(words).encode()
    lens = np.array([len(x.encode()) for x in words], np.int64)
    ends = np.cumsum(lens)
    return range_hashes(np.frombuffer(data, np.uint8), ends - lens, ends)


# --------------------------------------------------------------------------- learning


def _g(k: float, n: float, p: float) -> float:
    """Signed G statistic of k label-1 rows among n at base rate p."""
    if n == 0 or k / n <= p:
        return 0.0
    q = k / n
    g = k * math.log(q / p) + ((n - k) * math.log((1 - q) / (1 - p)) if k < n else 0.0)
    return 2 * g


def learn_lexicon(train: DataFrame, label_col: str, max_terms: int, min_g: float) -> tuple[list[str], list[str]]:
    """(words, stems) that mark label 1, the strongest first; counting is distributed, the result is bounded."""
    low = F.lower("__t")
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1)))
    base = train.select(F.col(label_col).cast("int").alias("y"), words.alias("w"))
    # Near copies mostly share their least word hash; one of them counts.
    base = base.filter(F.size("w") > 0).withColumn("k", F.array_min(F.transform("w", lambda x: F.xxhash64(x))))
    base = base.groupBy("k", "y").agg(F.min_by("w", F.size("w")).alias("w"))
    totals = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return [], []
    p = pos / (pos + neg)
    word = base.select("y", F.explode("w").alias("word"))
    kinds = F.array(
        F.struct(F.lit(0).alias("n"), F.col("word").alias("term")),
        *(F.when(F.length("word") > n, F.struct(F.lit(n).alias("n"), F.substring("word", 1, n).alias("term"))) for n in range(4, 8)),
    )
    terms = word.select("y", "word", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("t"))
    counts = terms.groupBy("t.n", "t.term").agg(
        F.count_if(F.col("y") == 1).alias("k"), F.count(F.lit(1)).alias("all"), F.min("word").alias("lo"), F.max("word").alias("hi")
    )
    # Words of label-1 rows by their G statistic against the base rate; a stem must stand for more than one word.
    good = counts.filter((F.col("k") >= 4) & (F.col("k") >= 0.8 * F.col("all")) & ((F.col("n") == 0) | (F.col("lo") != F.col("hi"))))
    k, n = F.col("k").cast("double"), F.col("all").cast("double")
    rest = F.when(k < n, (n - k) * F.log((1 - k / n) / (1 - p))).otherwise(F.lit(0.0))
    good = good.withColumn("g", F.round(2 * (k * F.log(k / n / p) + rest), 6)).filter(F.col("g") >= min_g)
    words_, stems = [], []
    # Of several terms that stand for the same words the strongest is used, so some more are looked at.
    for r in good.orderBy(F.desc("g"), "n", "term").limit(20 * max_terms).collect():
        n, term = r["n"], r["term"]
        if len(words_) + len(stems) >= max_terms:
            break
        if any(term.startswith(s) for s in stems):
            continue
        if n == 0:
            words_.append(term)
        elif not any(w.startswith(term) for w in words_):
            stems.append(term)
    return words_, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (bias last) of a logistic regression, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2 * len(x))
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Lexicon, plain words and weights; ``score`` maps a string array to numbers from 0 to 1."""

    def __init__(self, lexicon: list[Automaton], plain: frozenset[int], w: np.ndarray) -> None:
        self.lexicon, self.plain, self.w = lexicon, plain, w

    def scorer(self):
        extract = extractor(self.lexicon, self.plain)

        def score(texts: pa.Array) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(extract(texts) @ self.w[:-1] + self.w[-1], -30, 30)))

        return score


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 4000,
    max_terms: int = 400,
    min_g: float = 20.0,
    seeds: tuple[str, ...] = tuple(SEED_TERMS),
) -> Model:
    """``labels`` holds training rows only."""
    text_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    picked = bounded_sample(known, id_col, label_col, per_class)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__t"))
    # The sample is bounded by per_class, so its ids go to the texts, not the other way round.
    rows = rows.join(F.broadcast(picked), id_col).filter("__t is not null")
    rows = rows.select("__t", F.col(label_col).cast("int").alias("y"), F.pmod(F.xxhash64("__t"), F.lit(2)).cast("int").alias("half")).persist()
    try:
        both = {r[0] for r in rows.select("y").distinct().collect()}
        if both != {0, 1}:
            none = np.zeros(FEATURES + 1)
            none[-1] = -8.0
            return Model([], frozenset(), none)
        words, stems = learn_lexicon(rows, "y", max_terms, min_g)
        words += [t for t in seeds if t not in words and not any(t.startswith(s) for s in stems)]
        lexicon = automata(words, stems)

        def lookalikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for half in (0, 1):
                    texts = string_array(batch.column(0).filter(pc.equal(batch.column(1), half)))
                    for a, b in slices(texts):
                        w = byte_words(pc.utf8_lower(texts.slice(a, b - a)))
                        if w.starts.size:
                            h = np.unique(range_hashes_of(w, np.flatnonzero(word_values(lexicon, w) == 1))).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(h.size, half, np.int32))], names=["h", "half"])

        # Words of the bounded sample that look like a term.
        plain = rows.filter("y = 0").select("__t", "half").mapInArrow(lookalikes, "h long, half int").distinct().collect()
        halves = [frozenset(int(np.int64(r["h"]).view(np.uint64)) for r in plain if r["half"] == k) for k in (0, 1)]
        measures = [[extractor(lexicon, halves[1 - k], blur=blur) for blur in (False, True)] for k in (0, 1)]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for half in (0, 1):
                    part = batch.filter(pc.equal(batch.column(2), half))
                    texts, y = string_array(part.column(0)), part.column(1)
                    yield pa.RecordBatch.from_arrays([y, pa.array(list(measures[half][0](texts)), pa.list_(pa.float64()))], names=["y", "x"])
                    bad = part.filter(pc.equal(y, 1))
                    x = measures[half][1](string_array(bad.column(0)))
                    x = x[x.any(axis=1)]  # a row without a hit has nothing to misspell
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

        seen = rows.select("__t", "y", "half").mapInArrow(measure, "y int, x array<double>").toArrow()
        y = seen.column("y").to_numpy().astype(float)
        x = np.array(seen.column("x").to_pylist())
        order = np.lexsort((*x.T[::-1], y))  # rows come in the order of tasks
        return Model(lexicon, halves[0] | halves[1], fit_logistic(x[order], y[order]))
    finally:
        rows.unpersist()


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, **options
) -> DataFrame:
    """(id, score, predicted) for each row; ``labels`` (id, label) are the rows to learn from, ``options`` those of train."""
    id_type = docs.schema[id_col].dataType.simpleString()
    model = train(docs, labels, id_col, text_col, label_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            p = score(string_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__t")).mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")


def filter_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, **options
) -> DataFrame:
    """docs without the rows that score ``threshold`` or more; all columns stay, nothing is shuffled."""
    model = train(docs, labels, id_col, text_col, label_col, **options)

    def reject(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.scorer()
        for texts in batches:
            yield pa.array(score(string_array(texts)))

    score = F.arrow_udf(reject, "double")
    return docs.filter(score(F.col(text_col).cast("string")) < threshold)


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows that may be learned from: crc32(id as text) mod 3 is not 1."""
    return labels.filter(split_of(F.col(id_col), 3) != 1)
