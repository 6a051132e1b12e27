"""Operator 2: SentencePiece BPE encoding and decoding with seeded merge dropout.

Encoding. A text gets one space in front, spaces become U+2581, and its units (a run of U+2581 with what
follows up to the next, line breaks apart) are merged on their own: no piece of the vocabulary crosses
them, which is checked when the model is read. Candidate merges wait in an agenda, best score first, ties
to the left. With dropout, each candidate that comes up is skipped with probability ``rate``; a later merge
beside it can bring it up anew. Each occurrence of a unit has draws of its own, a hash of the seed, the
document's id and the unit's place in the text, whatever the unit's length. What is remembered is only what
follows from a unit and the steps at which it was skipped. Without dropout the ids are those of the model's
own library.

Decoding is exact for any text: characters without a piece, and U+2581 itself, are written as bytes.

Defined results: null and empty texts have no ids and decode to empty text; ids that name no piece, or
control pieces, decode to nothing; bytes that are no UTF-8 decode to U+FFFD; repeated rows get a row
each; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat, takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import slices, string_array, text_batches

SPACE = "▁"
_UNITS = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
_RAW = ""  # stands for a literal U+2581 while units are split; itself written as bytes
_MASK = (1 << 64) - 1
_GOLD = 0x9E3779B97F4A7C15
WIDE = 32  # longer units are merged one by one
_NEVER = (1 << 31) - 1
_STEPS = 128  # more than the candidates that come up in WIDE characters: WIDE - 1 and two for each merge


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_int(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


@cache
def _tails(rate: float) -> np.ndarray:
    """Chances, in 2^-32, that at least 1, 2, ... candidates pass before the next is skipped; ascending."""
    out, left = [], 1.0
    while len(out) < 1 << 16 and int((left := left * (1 - rate)) * (1 << 32)) > 0:
        out.append(int(left * (1 << 32)))
    return np.array(out[::-1], np.uint64)


def _gaps(keys: np.ndarray, nth: int, rate: float) -> np.ndarray:
    """For each key, how many candidates pass between its skip before the ``nth`` and that one."""
    tails = _tails(rate)
    u = _mix(keys + np.uint64(((nth + 1) * _GOLD) & _MASK)) >> np.uint64(32)
    return tails.size - np.searchsorted(tails, u, side="right")


def _skips(key: int, rate: float) -> Iterator[int]:
    """Steps at which a candidate is skipped, ascending: _gaps of one key, summed up."""
    if not rate:
        return
    tails = _tails(rate).tolist()
    at = nth = 0
    while True:
        gap = len(tails) - bisect_right(tails, _mix_int((key + (nth + 1) * _GOLD) & _MASK) >> 32)
        at, nth = at + gap, nth + 1
        if gap < 1 << 16:  # else no skip within the table; the draws have no memory
            yield at
            at += 1


def _places(doc_key: int, count: int) -> np.ndarray:
    """Keys of the first ``count`` units of a document."""
    return _mix(np.uint64(doc_key) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _doc_key(ident: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(ident).encode("utf-8", "surrogatepass"), seed)


class _Pairs:
    """Pairs of symbols that make a piece, in an open hash table: place in the order of scores, and the piece."""

    def __init__(self, base: int, keys: np.ndarray, merged: np.ndarray, rank: np.ndarray) -> None:
        bits = int(8 * keys.size).bit_length()
        self.base, self.shift, self.mask = base, np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank, self.merged = np.full(1 << bits, _NEVER, np.int32), np.zeros(1 << bits, np.int32)
        left, at = np.arange(keys.size), self._slot(keys)
        while left.size:
            here, first = np.unique(at, return_index=True)
            first = first[self.keys[here] < 0]
            put = left[first]
            self.keys[at[first]], self.rank[at[first]], self.merged[at[first]] = keys[put], rank[put], merged[put]
            rest = np.delete(np.arange(left.size), first)
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_GOLD)) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of scores (or _NEVER) and piece of each pair."""
        keys = (left.astype(np.int64) * self.base + right).ravel()
        at = self._slot(keys)
        found = self.keys[at]
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while rest.size:
            at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at[rest]]
            rest = rest[(found != keys[rest]) & (found >= 0)]
        return self.rank[at].reshape(left.shape), self.merged[at].reshape(left.shape)


class Model:
    """Pieces, scores and byte pieces of a model file; small enough to travel with the task."""

    def __init__(self, blob: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        size = sp.get_piece_size()
        self._tables = None
        self.score: dict[str, float] = {}
        self.ident: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE) or ("\n" in piece and len(piece) > 1):
                    raise ValueError(f"a piece crosses units: {piece!r}")
                self.score[piece], self.ident[piece] = sp.get_score(i), i
                self.raw.append(piece.replace(SPACE, " ").encode())

    def unit_ids(self, unit: str, rate: float, key: int) -> list[int]:
        """Ids of one unit; ``key`` names the seed, the document and the place."""
        return self._walk(unit, _skips(key & _MASK, rate))

    def _walk(self, unit: str, skips: Iterator[int]) -> list[int]:
        """Ids of one unit whose candidates are skipped at these steps."""
        symbols: list[str] = list(unit)
        n = len(symbols)
        score = self.score
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda: list[tuple[float, int, int, int]] = []
            for i in range(n - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None:
                    agenda.append((-s, i, 1, 2))  # score, left symbol, its length, length of both
            heapq.heapify(agenda)
            step, skip = -1, next(skips, -1)
            while agenda:
                _, i, a, both = heapq.heappop(agenda)
                j = after[i]
                if not symbols[i] or len(symbols[i]) != a or j >= n or a + len(symbols[j]) != both:
                    continue  # one side has grown meanwhile
                step += 1
                if step == skip:
                    skip = next(skips, -1)
                    continue
                symbols[i] += symbols[j]
                symbols[j] = ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    s = score.get(symbols[i] + symbols[k])
                    if s is not None:
                        heapq.heappush(agenda, (-s, i, both, both + len(symbols[k])))
                h = before[i]
                if h >= 0:
                    s = score.get(symbols[h] + symbols[i])
                    if s is not None:
                        heapq.heappush(agenda, (-s, h, len(symbols[h]), len(symbols[h]) + both))
        out: list[int] = []
        for piece in symbols:
            if not piece:
                continue
            ident = self.ident.get(piece)
            if ident is not None and piece != _RAW:
                out.append(ident)
            else:
                out.extend(self.byte_ids[b] for b in piece.replace(_RAW, SPACE).encode("utf-8", "replace"))
        return out

    def tables(self) -> tuple[np.ndarray, int, np.ndarray, "_Pairs"]:
        """Symbols of code points, the number that stands for none, ids of symbols, and the pairs that make a piece."""
        if self._tables is None:
            sym: dict[str, int] = {}
            for piece in self.score:
                sym.setdefault(piece, len(sym))
            for piece in self.score:
                for c in piece:
                    sym.setdefault(c, len(sym))
            none = len(sym)
            order = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
            rows = [
                (sym[piece[:k]] * (none + 1) + sym[piece[k:]], sym[piece], order[score])
                for piece, score in self.score.items()
                for k in range(1, len(piece))
                if piece[:k] in sym and piece[k:] in sym
            ]
            ident = np.array([*(self.ident.get(x, -1) for x in sym), -1], np.int32)
            code = np.full(0x110000, none, np.int32)  # code point -> symbol
            for x, k in sym.items():
                if len(x) == 1:
                    code[ord(x)] = k
            self._tables = code, none, ident, _Pairs(none + 1, *(np.array(x, np.int64) for x in zip(*rows)))
        return self._tables

    def _many(self, units: list[str], rate: float, key: int) -> list[bytes]:
        """unit_ids of many units under one key."""
        skips = list(takewhile(lambda x: x < 3 * max(map(len, units)), _skips(key & _MASK, rate)))
        flat, count, _ = self._merge(units, np.tile(np.array(skips, np.int64), (len(units), 1)))
        return [x.tobytes() for x in np.split(flat, np.cumsum(count)[:-1])]

    def _merge(self, units: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of like length at once, each step taking every unit's best candidate.

        ``skips``: for each unit, the steps at which the candidate is skipped. Ids in one array, their
        number for each unit, and the number of candidates that came up.
        """
        code, none, ident, pairs = self.tables()
        n = len(units)
        lens = np.fromiter(map(len, units), np.int64, n)
        wide = int(lens.max()) + 1  # a unit's places, and one that stays empty
        inside = np.arange(wide)[None, :] < lens[:, None]
        grid = np.full((n, wide), none, np.int32)
        grid[inside] = code[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        best, made = np.full((n, wide), _NEVER, np.int32), np.zeros((n, wide), np.int32)  # candidates by their left place, and what they make
        best[:, :-1], made[:, :-1] = pairs.look(grid[:, :-1], grid[:, 1:])
        s, r, m = grid.ravel(), best.ravel(), made.ravel()
        # Places in a row of all; before a unit's first comes the empty one of the unit before.
        after, before = np.arange(1, n * wide + 1), np.arange(-1, n * wide - 1)
        live, steps = np.arange(n), np.zeros(n, np.int64)
        while live.size:
            i = live * wide + best[live].argmin(axis=1)
            has = r[i] < _NEVER
            live, i = live[has], i[has]
            if skips.shape[1]:
                skip = (skips[live] == steps[live, None]).any(axis=1)
                r[i[skip]] = _NEVER
                i = i[~skip]
            steps[live] += 1
            j = after[i]
            k = after[j]
            s[i] = m[i]
            s[j], r[j] = -1, _NEVER  # grown into its left
            after[i], before[k] = k, i
            h = before[i]
            r[i], m[i] = pairs.look(s[i], s[k])
            r[h], m[h] = pairs.look(s[h], s[i])
        inside &= grid >= 0
        count = inside.sum(axis=1)
        ids = ident[grid]  # -1 counts from the end, where none is
        odd = np.flatnonzero(((ids < 0) & inside).any(axis=1))
        if not odd.size:
            return ids[inside], count, steps
        rows = [ids[k, x] for k, x in enumerate(inside)]
        for k in odd.tolist():
            rows[k] = np.array(self._walk(units[k], iter(skips[k].tolist())), np.int32)
            count[k] = rows[k].size
        return np.concatenate(rows), count, steps

    def encoder(self, rate: float, seed: int, cache_size: int = 600_000) -> Callable[[list[str], list[object]], list[np.ndarray]]:
        """Function of texts and their ids to token ids; outcomes are remembered up to about ``cache_size``."""
        known = _Outcomes(self, rate)

        def encode(texts: list[str], idents: list[object]) -> list[np.ndarray]:
            if known.size > cache_size:
                known.clear()
            cut = [[] if not t or _RAW in t or SPACE in t else _UNITS.findall(SPACE + t.replace(" ", SPACE)) for t in texts]
            places = [_places(_doc_key(i, seed), len(units)) for i, units in zip(idents, cut)]
            flat, count = known.ids_of(list(chain.from_iterable(cut)), np.concatenate([np.zeros(0, np.uint64), *places]))
            ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *map(len, cut)])]
            out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for k, (t, units) in enumerate(zip(texts, cut)):
                if t and not units:
                    out[k] = self._encode_odd(t, _doc_key(idents[k], seed), rate)
            return out

        return encode

    def _encode_odd(self, text: str, doc_key: int, rate: float) -> np.ndarray:
        """Texts that hold U+2581 or the stand-in: those characters are written as bytes."""
        parts = re.split(f"([{SPACE}{_RAW}])", text)
        cut = [[] if k % 2 else _UNITS.findall((SPACE if k == 0 else "") + part.replace(" ", SPACE)) for k, part in enumerate(parts)]
        places = iter(_places(doc_key, sum(map(len, cut))).tolist())
        out: list[int] = []
        for k, (part, units) in enumerate(zip(parts, cut)):
            if k % 2:
                out += [self.byte_ids[b] for b in part.encode()]
            for unit in units:
                out += self.unit_ids(unit, rate, next(places))
        return np.array(out, np.int32)

    def decoder(self) -> Callable[[np.ndarray], str]:
        raw = np.empty(len(self.raw) + 1, object)
        raw[:-1] = self.raw
        raw[-1] = b""

        def decode(ids: np.ndarray) -> str:
            ids = np.where((ids >= 0) & (ids < len(raw) - 1), ids, len(raw) - 1)
            blob = b"".join(raw[ids].tolist())
            return (blob[1:] if blob[:1] == b" " else blob).decode("utf-8", "replace")

        return decode


class _Outcomes:
    """Ids of units by the steps that were skipped, as a tree: a node's child has one more step skipped."""

    def __init__(self, model: Model, rate: float) -> None:
        self.model, self.rate = model, rate
        self.clear()

    def clear(self) -> None:
        self.size = self.used = 0
        self.roots: dict[str, int] = {}
        self.edges, self.kids = np.zeros(0, np.int64), np.zeros(0, np.int32)  # node * _STEPS + step, ascending, and the child
        self.units: list[str] = []
        self.up, self.skip, self.steps, self.start, self.count = (np.zeros(1024, np.int32) for _ in range(5))
        self.ids = np.zeros(4096, np.int32)

    def _store(self, units: list[str], up: np.ndarray, skip: np.ndarray, flat: np.ndarray, count: np.ndarray, steps: np.ndarray) -> np.ndarray:
        a, b = self.size, self.size + len(units)
        for name, values in (("up", up), ("skip", skip), ("steps", steps), ("start", self.used + np.cumsum(count) - count), ("count", count)):
            had = getattr(self, name)
            if had.size < b:
                had = np.concatenate([had, np.zeros(b, np.int32)])
                setattr(self, name, had)
            had[a:b] = values
        if self.ids.size < self.used + flat.size:
            self.ids = np.concatenate([self.ids, np.zeros(self.used + flat.size, np.int32)])
        self.ids[self.used : self.used + flat.size] = flat
        self.units += units
        self.size, self.used = b, self.used + flat.size
        return np.arange(a, b)

    def _grow(self, units: list[str], up: np.ndarray, skip: np.ndarray, depth: int) -> np.ndarray:
        """New nodes of units at a depth: skipped are ``skip`` and the steps of the nodes above."""
        path, node = np.zeros((len(units), depth), np.int64), up
        for d in range(depth - 1, -1, -1):
            path[:, d] = skip if d == depth - 1 else self.skip[node]
            node = node if d == depth - 1 else self.up[node]
        width = np.fromiter(map(len, units), np.int64, len(units))
        out = np.zeros(len(units), np.int64)
        group = np.searchsorted([5, 7, 10, 14], width)
        for k in np.unique(group):
            these = np.flatnonzero(group == k)
            for c in range(0, these.size, 8192):
                some = these[c : c + 8192]
                named = [units[j] for j in some.tolist()]
                out[some] = self._store(named, up[some], skip[some], *self.model._merge(named, path[some]))
        return out

    def ids_of(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all occurrences of units in one array, and their number for each."""
        node = np.fromiter(map(self.roots.get, units, repeat(-1)), np.int64, len(units))
        lost = np.flatnonzero(node < 0)
        if lost.size:
            named = list(map(units.__getitem__, lost.tolist()))
            new = [u for u in dict.fromkeys(named) if len(u) <= WIDE]
            none = np.full(len(new), -1)
            self.roots.update(zip(new, self._grow(new, none, none, 0).tolist()))
            node[lost] = np.fromiter(map(self.roots.get, named, repeat(-1)), np.int64, lost.size)
            for k in np.flatnonzero(node < 0).tolist():  # long: each occurrence on its own
                ids = np.array(self.model.unit_ids(units[k], self.rate, int(keys[k])), np.int32)
                none = np.full(1, -1)
                node[k] = self._store([units[k]], none, none, ids, np.array([ids.size]), np.zeros(1, np.int64))[0]
        live, at, depth = np.arange(len(units)), np.zeros(len(units), np.int64), 0
        while live.size and self.rate:
            step = at + _gaps(keys[live], depth, self.rate)
            here = node[live]
            more = step < self.steps[here]
            live, step, here = live[more], step[more], here[more]
            depth += 1
            if not live.size:
                break
            edge = here * _STEPS + step
            slot = np.minimum(np.searchsorted(self.edges, edge), max(0, self.edges.size - 1))
            child = np.where(self.edges[slot] == edge, self.kids[slot], -1).astype(np.int64) if self.edges.size else np.full(edge.size, -1)
            lost = np.flatnonzero(child < 0)
            if lost.size:
                new, which = np.unique(edge[lost], return_inverse=True)
                up, skip = new // _STEPS, new % _STEPS
                made = self._grow([self.units[k] for k in up.tolist()], up, skip, depth)
                at_edge = np.searchsorted(self.edges, new)
                self.edges, self.kids = np.insert(self.edges, at_edge, new), np.insert(self.kids, at_edge, made.astype(np.int32))
                child[lost] = made[which]
            node[live], at = child, step + 1
        count = self.count[node].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if ends.size else 0
        return self.ids[np.repeat(self.start[node] - (ends - count), count) + np.arange(total)], count


def load_model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(
    docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None
) -> DataFrame:
    """docs with ``token_ids`` array<int> in place of a column of that name, if any.

    decoded_col: name of one more column, the text that the ids decode to; made by the same worker, so that a
    round trip needs no second one.
    """
    text_batches(docs.sparkSession)
    model = load_model(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    keep = [c for c in docs.columns if c not in ("token_ids", decoded_col)]
    more = [decoded_col] if decoded_col else []
    at_id, at_text = keep.index(id_col), keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = shared.value.encoder(rate, seed), shared.value.decoder()
        for batch in batches:
            texts = string_array(batch.column(at_text))
            for a, b in slices(texts, 2 << 20):
                part = batch.slice(a, b - a)
                ids = enc(texts.slice(a, b - a).to_pylist(), part.column(at_id).to_pylist())
                told = [pa.array([dec(x) for x in ids], pa.string())] if more else []
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids), *told], names=[*keep, "token_ids", *more])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep).mapInArrow(run, ", ".join([fields, "token_ids array<int>", *(f"`{c}` string" for c in more)]))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([x.size for x in ids], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def decode(encoded: DataFrame, model_path: str, out_col: str = "decoded") -> DataFrame:
    """encoded with the text of ``token_ids`` in ``out_col``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))
    keep = [c for c in encoded.columns if c != out_col]
    at = keep.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = shared.value.decoder()
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                col = part.column(at)
                off = col.offsets.to_numpy()
                flat = col.values.to_numpy()
                texts = [dec(flat[x:y]) for x, y in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*keep, out_col])

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep).mapInArrow(run, f"{fields}, `{out_col}` string")


def ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(ids, "<i4").tobytes()).hexdigest()


def round_trip(
    docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, tokens_sha256, text_sha256, lossless) of the encoded and decoded documents."""
    both = encode(docs.select(id_col, text_col), model_path, rate, seed, id_col, text_col, "decoded")
    digest = F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256)
    return both.select(
        id_col,
        F.size("token_ids").cast("long").alias("n_tokens"),
        digest.alias("tokens_sha256"),
        F.sha2("decoded", 256).alias("text_sha256"),
        (F.col("decoded") == F.coalesce(text_col, F.lit(""))).alias("lossless"),
    )
