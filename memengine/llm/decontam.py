"""Operator 4: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are lower-cased words (letters and digits). A document leaks an item if some stretch of
its words lies within word edit distance ``floor(max_edit * n)`` of the item's n words (0.2: similarity
0.8 or more).

1. Candidate places. An item of n words within distance d of a stretch shares n - 1 - 2 d of its word
   pairs with it at least (q-gram lemma), so only places with that many known pairs inside n words can
   start a leak. This drops no true pair.
2. Item-sized windows around these places are embedded by the CGK random walk, which maps edit distance
   to Hamming distance: step j writes the word under the cursor and moves on if hash(j, word) has its top
   bit set. Each repeat has a walk and a sample of ``bits`` steps of its own; equal samples make a
   candidate. The number of repeats is set for each class of sizes by simulated edits on its own items to
   reach ``recall``; where that needs more than ``MOST`` repeats an error tells so.
3. Candidates are verified by exact edit distance against the best aligned stretch.

An item of 512 words or more is searched by parts of 256 words at least: of a stretch within distance of the
whole item, one part at least is within distance of its own stretch. The whole item is verified around it.

The items are broadcast in slices of ``slice_mb`` at most; a larger benchmark takes several passes.

Defined results: items of fewer than ``min_words`` words (five, the least shingle) name nothing and take no
part; nor do items without an id or text; null and empty texts leak nothing; a pair of ids is reported once,
with its least distance (ties: first place); an empty benchmark or table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import byte_words, mix, range_hashes, slices, string_array, text_batches

_K = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    arr = pc.utf8_lower(pa.array(texts, pa.string()))
    w = byte_words(arr)
    h = range_hashes(w.data, w.starts, w.ends)
    return [h[w.first[i] : w.first[i + 1]] for i in range(len(texts))]


def pair_hashes(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h[:-1] * _K + h[1:])


@dataclass(frozen=True, eq=False)
class Part:
    """What is searched: an item, or a part of a long one."""

    ident: object
    number: int  # of the item in its slice
    at: int  # place of the part in the item
    words: np.ndarray
    whole: np.ndarray


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """(least distance between the item and any stretch of the text, end of the stretch); exact."""
    prev = np.zeros(text.size + 1, np.int64)
    ramp = np.arange(text.size + 1)
    for i in range(item.size):
        cur = np.empty_like(prev)
        cur[0] = i + 1
        cur[1:] = np.minimum(prev[:-1] + (text != item[i]), prev[1:] + 1)
        cur = np.minimum.accumulate(cur - ramp) + ramp
        if cur.min() > most:
            return most + 1, 0
        prev = cur
    end = int(prev.argmin())
    return int(prev[end]), end


#: Most repeats of the search.
MOST = 2048


class Walks:
    """``repeats`` CGK walks over windows of one size, each with its sample of steps."""

    def __init__(self, n: int, repeats: int, bits: int, seed: int) -> None:
        # The cursor is near 0.8 n after 1.6 n steps, so it hardly ever passes the end.
        self.n, self.steps = n, max(bits, int(1.6 * n))
        salts, picks = [], []
        for block in range(-(-repeats // 256)):  # the first repeats are the same, however many follow
            salts.append(np.random.Generator(np.random.PCG64([seed, n, block])).integers(0, 1 << 63, (256, self.steps), dtype=np.uint64))
            order = np.tile(np.arange(self.steps), (256, 1))
            picks.append(np.random.Generator(np.random.PCG64([seed, n, block, 1])).permuted(order, axis=1)[:, :bits])
        self.salt = np.vstack(salts)[:repeats]
        self.picked = np.zeros((repeats, self.steps), bool)
        self.picked[np.arange(repeats)[:, None], np.vstack(picks)[:repeats]] = True

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, repeats) keys of a (windows, n) matrix of word hashes."""
        count, repeats = windows.shape[0], self.salt.shape[0]
        padded = np.concatenate((windows, np.zeros((count, 1), np.uint64)), axis=1)
        at = np.zeros((count, repeats), np.int64)
        key = np.broadcast_to(np.arange(repeats, dtype=np.uint64), (count, repeats)).copy()
        rows = np.arange(count)[:, None]
        with np.errstate(over="ignore"):
            for j in range(self.steps):
                word = padded[rows, at]
                use = self.picked[:, j]
                if use.any():
                    key[:, use] = mix(key[:, use] * _K + word[:, use] + np.uint64(j + 1))
                move = ((word ^ self.salt[:, j]) * _K) >> np.uint64(63)
                at = np.minimum(at + move.astype(np.int64), self.n)
        return key


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The item with random word edits, and random words behind it up to its size."""
    other = item.copy()
    for _ in range(edits):
        kind, p = rng.integers(3), rng.integers(max(other.size, 1))
        new = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        if kind == 0 and other.size:
            other[p] = new[0]
        elif kind == 1 and other.size:
            other = np.delete(other, p)
        else:
            other = np.insert(other, p, new)
    return np.resize(np.concatenate((other, rng.integers(0, 1 << 63, item.size, dtype=np.uint64))), item.size)


def repeats_for(items: list[np.ndarray], max_edit: float, bits: int, recall: float, seed: int, trials: int = 128) -> int:
    """Repeats (a power of two, 16 or more) that reach the recall on items edited as much as allowed."""
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    some = items[:: max(1, len(items) // trials)][:trials]
    pairs = [np.stack((x, _edited(x, int(max_edit * x.size), rng))) for x in some * -(-trials // len(some))]
    repeats, found = 16, np.zeros(len(pairs), bool)
    while True:
        made: dict[int, Walks] = {}
        for k in np.flatnonzero(~found).tolist():
            n = pairs[k].shape[1]
            walks = made.setdefault(n, Walks(n, repeats, bits, seed)) if n not in made else made[n]
            key = walks.keys(pairs[k])
            found[k] = bool((key[0] == key[1]).any())
        if found.mean() >= recall:
            return repeats
        if repeats >= MOST:
            raise ValueError(f"{repeats} repeats find {found.mean():.3f} of edited items of up to {max(p.shape[1] for p in pairs)} words, not {recall}")
        repeats *= 2


def _search(parts: list[Part], max_edit: float, bits: int, recall: float, seed: int):
    items = [(p.ident, p.words) for p in parts]
    # Classes of sizes within a factor of two have repeats of their own.
    by_class: dict[int, list[np.ndarray]] = defaultdict(list)
    for _, h in items:
        by_class[h.size.bit_length()].append(h)
    repeats_of = {c: repeats_for(hs, max_edit, bits, recall, seed) for c, hs in by_class.items()}
    sets = [np.unique(pair_hashes(h)) for _, h in items]
    known, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(items)), [x.size for x in sets])[np.argsort(inverse, kind="stable")]
    first_owner = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=known.size))))
    flags = np.zeros(1 << 22, bool)
    flags[(known >> np.uint64(42)).astype(np.int64)] = True
    size = np.array([h.size for _, h in items])
    edits = (max_edit * size).astype(np.int64)
    need = np.maximum(1, size - 1 - 2 * edits)
    classes = {}
    for n in np.unique(size).tolist():
        walks = Walks(n, repeats_of[int(n).bit_length()], bits, seed)
        members = np.flatnonzero(size == n)
        keys = walks.keys(np.stack([items[k][1] for k in members]))
        flat, who = np.unique(np.stack((keys.ravel(), np.repeat(members, keys.shape[1]).astype(np.uint64)), axis=1), axis=0).T
        names, first = np.unique(flat, return_index=True)
        classes[n] = (int(max_edit * n), walks, names, np.append(first, flat.size), who.astype(np.int64))
    # Coarse bins of sizes: the widest window with the least need of a bin.
    bins: list[tuple[int, int]] = []
    for n in sorted(classes):
        if bins and n <= 1.3 * low:
            bins[-1] = (n, min(bins[-1][1], int(need[size == n].min())))
        else:
            low = n
            bins.append((n, int(need[size == n].min())))

    def places_of(w, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place): places that can be the first shared pair of a leak of the item."""
        pairs = pair_hashes(h)
        maybe = np.flatnonzero(flags[(pairs >> np.uint64(42)).astype(np.int64)])
        maybe = maybe[w.row[maybe] == w.row[maybe + 1]]
        which = np.minimum(np.searchsorted(known, pairs[maybe]), known.size - 1)
        fine = known[which] == pairs[maybe]
        maybe, which = maybe[fine], which[fine]
        count = np.zeros(h.size + 1, np.int64)
        count[maybe + 1] = 1
        count = np.cumsum(count)
        live = np.zeros(h.size + 1, np.int64)
        for wide, least in bins:
            stop = np.minimum(maybe + wide - 1, h.size)
            ok = count[stop] - count[maybe] >= least
            np.add.at(live, maybe[ok], 1)
            np.add.at(live, stop[ok], -1)
        keep = np.cumsum(live)[maybe] > 0
        maybe, which = maybe[keep], which[keep]
        # The same test with each item's own pairs.
        reps = first_owner[which + 1] - first_owner[which]
        at = np.repeat(first_owner[which] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        item, place = owner[at], np.repeat(maybe, reps)
        span = h.size + int(size.max()) + 1
        code = item * span + place
        order = np.argsort(code)
        code, item, place = code[order], item[order], place[order]
        inside = np.searchsorted(code, code + size[item] - 1) - np.arange(code.size)
        ok = inside >= need[item]
        return item[ok], place[ok]

    def find(texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, words of the item) of all leaks in an array of texts."""
        out: list[tuple[int, int, int, int, int]] = []
        for a, b in slices(texts):
            w = byte_words(pc.utf8_lower(texts.slice(a, b - a)))
            if w.starts.size < 2:
                continue
            h = range_hashes(w.data, w.starts, w.ends)
            item, place = places_of(w, h)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for n in np.unique(size[item]).tolist():
                d, walks, names, first, who = classes[n]
                firsts = np.unique(place[size[item] == n])
                # The stretch may start before its first shared pair, by what edits can hide.
                grid = firsts[:, None] - np.arange(2 * d + 2)[None, :]
                starts = np.unique(grid[grid >= w.first[w.row[firsts]][:, None]])
                wide = np.concatenate((h, np.zeros(n, np.uint64)))
                near: dict[tuple[int, int], list[int]] = defaultdict(list)
                for c in range(0, starts.size, 4096):
                    s = starts[c : c + 4096]
                    keys = walks.keys(wide[s[:, None] + np.arange(n)[None, :]])
                    slot = np.minimum(np.searchsorted(names, keys), names.size - 1)
                    hit_w, hit_r = np.nonzero(names[slot] == keys)
                    for i, t in zip(hit_w.tolist(), slot[hit_w, hit_r].tolist()):
                        for k in who[first[t] : first[t + 1]].tolist():
                            near[int(w.row[s[i]]), k].append(int(s[i]))
                for (row, k), at in near.items():
                    lo, hi = int(w.first[row]), int(w.first[row + 1])
                    at = sorted(set(at))
                    groups = [[at[0], at[0]]]
                    for x in at[1:]:  # neighbouring windows are verified together
                        if x - groups[-1][1] <= n:
                            groups[-1][1] = x
                        else:
                            groups.append([x, x])
                    for g0, g1 in groups:
                        x0, x1 = max(lo, g0 - d), min(hi, g1 + n + d)
                        dist, end = edit_distance(items[k][1], h[x0:x1], d)
                        part = parts[k]
                        if dist <= d and part.whole is not part.words:
                            # A part was found: the whole item around it.
                            most = int(max_edit * part.whole.size)
                            start = x0 + end - n - part.at
                            x0, x1 = max(lo, start - 2 * most - d), min(hi, start + part.whole.size + 2 * most + d)
                            dist, end = edit_distance(part.whole, h[x0:x1], most)
                            dist = dist if dist <= most else 1 << 40
                        elif dist > d:
                            continue
                        found = (dist, x0 + end - lo, part.whole.size)
                        if dist < 1 << 40 and found < best.get((row, part.number), (1 << 40, 0, 0)):
                            best[row, part.number] = found
            out += [(a + row, number, dist, max(0, end - size), size) for (row, number), (dist, end, size) in best.items()]
        return out

    return find


def _rows(find, names: list[object], id_col: str):
    """mapInArrow form of ``find``: (id, item_id, edit_distance, first_word, item_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = find(string_array(batch.column(1)))
            if out:
                rows, ks, ds, ss, ns = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array([names[k] for k in ks]),
                        pa.array(ds, pa.int32()),
                        pa.array(ss, pa.int64()),
                        pa.array(ns, pa.int32()),
                    ],
                    names=[id_col, "item_id", "edit_distance", "first_word", "item_words"],
                )

    return run


def _parts(h: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(place, words) of an item: itself, or of a long one its parts of 256 to 511 words."""
    cuts = list(range(0, max(1, h.size - 255), 256)) if h.size >= 512 else [0]
    return [(a, h if len(cuts) == 1 else h[a:b]) for a, b in zip(cuts, [*cuts[1:], h.size])]


def _passes(benchmark: DataFrame, min_words: int, slice_mb: int) -> Iterator[tuple[list[Part], list[object]]]:
    """Parts of items, and the ids of the items by number, in slices of about ``slice_mb`` of text."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(total) // (slice_mb << 20)))
    for k in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        hashes = word_hashes([r["text"] for r in rows])
        parts = [Part(r["item_id"], number, at, piece, h) for number, (r, h) in enumerate(zip(rows, hashes)) if h.size >= min_words for at, piece in _parts(h)]
        if parts:
            yield parts, [r["item_id"] for r in rows]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edit: float = 0.2,
    min_words: int = 5,
    recall: float = 0.98,
    bits: int = 2,
    seed: int = 11,
    slice_mb: int = 32,
) -> DataFrame:
    """(id, item_id, edit_distance, first_word, item_words): a row for each leaked item of each document."""
    text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"{id_col} {id_type}, item_id {item_type}, edit_distance int, first_word long, item_words int"
    narrow = docs.select(id_col, F.col(text_col).cast("string").alias("__t"))
    out = None
    for parts, names in _passes(benchmark, min_words, slice_mb):
        got = narrow.mapInArrow(_rows(_search(parts, max_edit, bits, recall, seed), names, id_col), schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    # Rows of a repeated document or item id become one.
    least = F.min(F.struct("edit_distance", "first_word", "item_words")).alias("best")
    return out.groupBy(id_col, "item_id").agg(least).select(id_col, "item_id", "best.*")


def drop_leaking(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    max_edit: float = 0.2,
    min_words: int = 5,
    recall: float = 0.98,
    bits: int = 2,
    seed: int = 11,
    slice_mb: int = 32,
) -> DataFrame:
    """docs without those that leak an item: the same search as a filter, so that no text is shuffled."""
    text_batches(docs.sparkSession)

    def clean(find):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                keep = np.ones(len(texts), bool)
                keep[[row for row, *_ in find(string_array(texts))]] = False
                yield pa.array(keep)

        return F.arrow_udf(run, "boolean")

    for parts, _ in _passes(benchmark, min_words, slice_mb):
        docs = docs.filter(clean(_search(parts, max_edit, bits, recall, seed))(F.col(text_col).cast("string")))
    return docs
