"""Operator 6: SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint. A-Z of the whole text are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are
``shingle`` words joined by one space, repeats included (fewer words: the whole sequence; no word,
also null text: fingerprint 0). Bit b is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Search. Bits are grouped into m partitions, correlated bits together. A pair at distance t or less has,
in at least one partition i, distance at most t_i, if the t_i (each -1 or more) sum to t - m + 1. The
allocation comes from dynamic programming on candidate counts estimated from a bounded sample; m is
chosen by the same estimate. Each distinct fingerprint is filed under its value in each partition and
probes the values within t_i.

Hot buckets. Exact copies are one fingerprint before the search. A bucket is cut into blocks of
``block`` fingerprints, and each pair of blocks is one unit of work, verified by XOR and popcount; it
emits a spanning forest of its links, not all pairs. So memory is bounded for buckets of any size, and
no link between components is lost.

Defined results: null text is empty text; repeated doc_ids share a row each; an empty table gives no
rows; extra columns do not matter, as only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import cut, hot_bound, salted, string_array, text_batches
from memengine.llm.components import connected_components

BITS = 64
_CHUNK = 1 << 16


def fingerprint_text(text: bytes | None, shingle: int = 4) -> int:
    """Fingerprint of one text (UTF-8) as an unsigned 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    n = len(words) - k + 1
    ones = np.zeros(BITS, np.int64)
    digest, s_all, e_all = xxhash.xxh64_intdigest, starts[:n], starts[k - 1 :] + lengths[k - 1 :]
    for at in range(0, n, _CHUNK):
        s, e = s_all[at : at + _CHUNK].tolist(), e_all[at : at + _CHUNK].tolist()
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(s, e)), np.uint64, len(s))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = 0
    for b in np.flatnonzero(2 * ones > n):
        value |= 1 << int(b)
    return value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, fp long): the fingerprint's 64 bits as a signed long."""
    text_batches(docs.sparkSession)
    names = [id_col, *carry]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = string_array(b.column(len(names))).cast(pa.binary())
            fp = np.fromiter((fingerprint_text(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*names, "fp"])

    return docs.select(*names, F.col(text_col).cast("string").alias("__t")).mapInArrow(run, f"{fields}, fp long")


# --------------------------------------------------------------------------- plan of the search


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64/m bits; each grows by the bit most correlated with its members."""
    if bits.shape[0] < 8:
        return [list(range(i, BITS, m)) for i in range(m)]
    x = bits.astype(np.float64)
    x -= x.mean(axis=0)
    sd = x.std(axis=0)
    x /= np.where(sd > 0, sd, 1)
    corr = np.abs(x.T @ x) / len(x)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, groups))) // (m - i)
        seed = max(left, key=lambda b: (corr[b][left].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b][group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    """How many values lie within ``radius`` of a value of ``width`` bits."""
    total, term = 0, 1
    for r in range(radius + 1):
        total += term
        term = term * (width - r) // (r + 1)
    return total


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and the least cost; costs[i][t + 1]. Infinite cost where none have it."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(row) - 1):
                if s + t <= total + len(costs) and (s + t not in nxt or c + row[t + 1] < nxt[s + t][0]):
                    nxt[s + t] = (c + row[t + 1], [*ts, t])
        best = nxt
    return best.get(total, (float("inf"), []))


def search_plan(sample: np.ndarray, n: int, distance: int, pair_cost: float = 4.0) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] with the least estimated number of probes and candidate pairs among n fingerprints.

    Candidates at threshold t are estimated by the larger of the sample's share of pairs within t and what
    independent bits with the sample's frequencies would give.
    """
    bits = bit_matrix(sample)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, 7):
        groups, costs = group_bits(bits, m), []
        for g in groups:
            row, b = [0.0], bits[:, g].astype(np.int16)
            p = b.mean(axis=0) if len(b) else np.full(len(g), 0.5)
            differ = 2 * p * (1 - p)
            poly = np.array([1.0])
            for d in differ:
                poly = np.convolve(poly, [1 - d, d])
            some = b[:512]
            far = (some[:, None, :] != some[None, :, :]).sum(axis=2)[np.triu_indices(len(some), 1)] if len(some) > 1 else np.array([99])
            for t in range(min(distance, 3) + 1):
                share = max(float(poly[: t + 1].sum()), float((far <= t).mean()) if (far <= t).sum() >= 3 else 0.0)
                row.append(n * ball(len(g), t) + pair_cost * share * n * n / 2)
            costs.append(row)
        total = distance - m + 1
        if total < -m:
            continue
        cost, ts = allocate(costs, total)
        if cost < float("inf") and (best is None or cost < best[0]):
            best = (cost, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    if best is None:
        raise ValueError("a distance of this size has no search plan")
    return best[1]


# --------------------------------------------------------------------------- links


def _file(plan: list[tuple[list[int], int]]):
    """mapInArrow: fp -> rows (part, val, fp, home); home rows are filed, others are probes."""

    def values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
        v = np.zeros(fps.size, np.uint64)
        for k, b in enumerate(bits):
            v |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
        return v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps_all = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps_all), 4096):
                fps = fps_all[at : at + 4096].view(np.uint64)
                for part, (bits, t) in enumerate(plan):
                    own = values(fps, bits)
                    for r in range(t + 1):
                        flips = [sum(1 << k for k in c) for c in combinations(range(len(bits)), r)]
                        for f0 in range(0, len(flips), 64):
                            f = np.array(flips[f0 : f0 + 64], np.uint64)
                            v = (own[:, None] ^ f[None, :]).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(v.size, part, np.int32)),
                                    pa.array(v.view(np.int64)),
                                    pa.array(np.repeat(fps, f.size).view(np.int64)),
                                    pa.array(np.full(v.size, r == 0)),
                                ],
                                names=["part", "val", "fp", "home"],
                            )

    return run


def _forest(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a x b within the distance, thinned to a spanning forest of the block pair."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    for at in range(0, a.size, 256):
        rows = a[at : at + 256]
        near = np.bitwise_count(rows[:, None] ^ b[None, :]) <= distance
        i, j = np.nonzero(near)
        if same:
            keep = rows[i] < b[j]
            i, j = i[keep], j[keep]
        for x, y in zip(rows[i].tolist(), b[j].tolist()):
            if x == y:
                continue
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
    if out:
        e = np.array(out, np.uint64)
        yield e[:, 0], e[:, 1]


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], distance: int, block: int = 4096) -> DataFrame:
    """(src, dst) longs: a set of links with the same components as all pairs within the distance."""
    entries = distinct.select("fp").mapInArrow(_file(plan), "part int, val long, fp long, home boolean")
    # Buckets of over ``block`` entries are cut; all others are one unit of work.
    hot = entries.groupBy("part", "val").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    hot = cut(hot.select("part", "val", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    total = hot.agg(F.sum("n")).first()[0] or 0
    many, one, keys = salted(entries, hot, ["part", "val"], F.col("n") >= hot_bound(total), "fp")
    full = many.join(one.drop("n"), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    full = full.withColumn("slot", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    # Each entry goes to its row of block pairs: (slot, k) for k >= slot and (k, slot) for k < slot.
    spread = full.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", "val", F.least("slot", "k").alias("p"), F.greatest("slot", "k").alias("q"), "slot", "home", "fp"
    )
    unit = spread.groupBy("part", "val", "p", "q").agg(
        F.collect_list(F.struct("slot", "home", "fp")).alias("members"), F.bool_or("home").alias("filed")
    )
    unit = unit.filter("filed and size(members) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = b.column(0).to_numpy(), b.column(1).to_numpy()
            members = b.column(2)
            flat = members.flatten()
            slot_, home, fp = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            off = np.frombuffer(members.buffers()[1], np.int32, len(members) + 1 + members.offset)[members.offset :]
            off = off - off[0]
            fp = fp.astype(np.int64).view(np.uint64)
            src, dst = [], []
            for r in range(len(b)):
                lo, hi = off[r], off[r + 1]
                s, h, f = slot_[lo:hi], home[lo:hi].astype(bool), fp[lo:hi]
                if p[r] == q[r]:
                    if h.any():
                        own = np.unique(f[h])
                        for e in _forest(own, own, distance, True):
                            src.append(e[0])
                            dst.append(e[1])
                        if not h.all():
                            for e in _forest(np.unique(f[~h]), own, distance, False):
                                src.append(e[0])
                                dst.append(e[1])
                else:
                    left, right = s == p[r], s == q[r]
                    for one, two in ((left & h, right), (left & ~h, right & h)):
                        if one.any() and two.any():
                            for e in _forest(np.unique(f[one]), np.unique(f[two]), distance, False):
                                src.append(e[0])
                                dst.append(e[1])
            if src:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(src).view(np.int64)), pa.array(np.concatenate(dst).view(np.int64))], names=["src", "dst"]
                )

    return unit.select("p", "q", "members").mapInArrow(run, "src long, dst long").distinct()


def classes(fp: DataFrame, id_col: str, distance: int, sample: int) -> DataFrame:
    """fp (id, fp; cut off from its lineage) with root, component_id and members (rows of the class).

    root is a fingerprint that names the class; component_id is the smallest id reachable over links.
    """
    distinct = cut(fp.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")))
    row = distinct.agg(F.count(F.lit(1)), F.sum("n")).first()
    n, rows = row[0], row[1] or 0
    seen = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(sample).collect()], np.int64).view(np.uint64)
    plan = search_plan(seen, n, distance)
    linked = cut(links(distinct, plan, distance))
    root = connected_components(linked, "src", "dst").withColumnRenamed("node", "fp")
    # Fingerprints without a link are classes of their own; the others learn what their root's class has.
    alone = distinct.join(root, "fp", "left_anti").select("fp", "n", F.col("fp").alias("root"), F.col("first_id").alias("component_id"), F.col("n").alias("members"))
    some = cut(distinct.join(root, "fp"))
    of_root = some.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("fps"))
    many, one, keys = salted(some.select("fp", "n", "root"), of_root, ["root"], F.col("fps") >= hot_bound(n), "fp")
    told = cut(alone.unionByName(many.join(one, keys).select("fp", "n", "root", "component_id", "members")))
    many, one, keys = salted(fp, told, ["fp"], F.col("n") >= hot_bound(rows), id_col)
    return many.join(one.drop("n"), keys).drop("__salt")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, sample: int = 4096
) -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id reachable over links."""
    # One fingerprint of all copies goes through the search; texts are read once.
    found = classes(cut(fingerprints(docs, id_col, text_col, shingle)), id_col, distance, sample)
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, sample: int = 4096
) -> DataFrame:
    """docs with one row of each class of near duplicates: that of the smallest id, then of the least row hash.

    A row is known by 128 bits of hash of all its columns, so rows that share an id, or have none, are judged
    each by its own text; a row without an id stays only where no row of its class has one. Of rows equal in
    every column one stays.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.array(*(c.isNull() for c in every))
    names = [F.xxhash64(F.lit(k), nulls, *every).alias(f"__k{k}") for k in (1, 2)]
    whole = docs.select(F.struct(*every).alias("__doc"), *names)
    short = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"), *names)
    found = classes(cut(fingerprints(short, "id", "t", shingle, ("__k1", "__k2"))), "id", distance, sample)
    found = cut(found.filter("members > 1").groupBy("root", "id", "__k1", "__k2").agg(F.count(F.lit(1)).alias("n")))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "__k1", "__k2", "n")).alias("x")).select("x.__k1", "x.__k2", "x.n")
    gone = found.join(kept, ["__k1", "__k2"], "left_anti").select("__k1", "__k2")
    several = kept.filter("n > 1").select("__k1", "__k2")
    single = whole.join(gone.unionByName(several), ["__k1", "__k2"], "left_anti")
    # Rows equal in every column, of which one stays; mostly none.
    equal = whole.join(several, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return single.unionByName(equal).select("__doc.*")
