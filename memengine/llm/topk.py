"""Operator 10: exact top-k search by inner product with a pivot-distance index.

Each component becomes floor(64 x). With M the largest norm, a vector v gets one more component
sqrt(M^2 - |v|^2), a query a zero: then |q - v|^2 = |q|^2 + M^2 - 2 <q, v>, so the largest inner products
are the nearest points, and distances obey the triangle inequality.

Index. ``pivots`` points come from a bounded sample (farthest-point order, some Lloyd steps). A task takes
its candidates in chunks; the vectors of a chunk are keyed by their nearest pivot and the distance to it,
sorted, and cut into annuli of ``ring`` vectors. So the index is built where the vectors lie: candidates are
not shuffled.

Search. Queries come in slices of ``slice_bytes`` at most, sent to all tasks; a larger set takes several passes.
A query's k-th best score so far (at first that in the sample) bounds its distance r. It expands the annuli of
a chunk in the order of their lower bounds and stops those of which the triangle inequality shows that they
lie beyond r: d(q, p) - hi > r or lo - d(q, p) > r. Expanded annuli are compared by matrix products. A task
hands on k rows a query. ``pruning`` tells how many vectors were compared and how many stopped.

Recall is 1: bounds only skip what can't enter the result; ties go to the smaller id and are never cut.
Products are exact at any size: in floats where all sums are below their precision, else in limbs of 20 bits,
else in whole numbers.

Defined results: vectors null or with null or non-finite components, or components that overflow when scaled,
take no part; nor do rows without an id; vectors of unlike length are compared on their common components;
vectors that repeat are candidates of their own; so are rows that repeat an id, but for a query of that id;
queries of one id are ranked together, and rows equal in id and vector ask once; fewer candidates than k: all;
scores beyond 64 bits are ranked by their true value and shown as the nearest 64-bit number; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import cut

_LIMB = 20


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<double>) of rows that take part; v is not scaled yet."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def matrix(col: pa.Array, dims: int, scale: int) -> np.ndarray:
    """(rows, dims) scaled whole numbers as doubles; short rows are filled up with zeros."""
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lens = np.diff(off)
    if lens.size and (lens == dims).all():
        return np.floor(flat[off[0] : off[-1]].reshape(-1, dims) * scale)
    out = np.zeros((lens.size, dims))
    for i, (a, n) in enumerate(zip(off[:-1], lens)):
        out[i, :n] = flat[a : a + n]
    return np.floor(out * scale)


@np.errstate(all="ignore")
def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-point order from the sample's mean: well spread, deterministic."""
    if not len(sample):
        return sample
    picked = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    p = sample[picked]
    for _ in range(4):  # a few Lloyd steps; pivots need not be data points
        near = _distances(sample, p).argmin(axis=1)
        p = np.stack([sample[near == k].mean(axis=0) if (near == k).any() else p[k] for k in range(len(p))])
    return p


@np.errstate(all="ignore")
def _distances(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * a @ p.T
    return np.sqrt(np.maximum(d, 0))


class Product:
    """Exact inner products of whole numbers up to ``widest``, with squared norms up to ``top``."""

    def __init__(self, top: float, widest: float, dims: int) -> None:
        # A sum of products is at most |q| |v| <= M^2 on the way, so it is exact below the precision.
        self.float = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else None
        limbed = top < 2.0**62 and dims < 1 << 12
        self.limbs = -(-int(widest).bit_length() // _LIMB) if limbed else 0
        self.scores = np.float64 if self.float is not None else np.int64 if limbed else object
        self.least = np.iinfo(np.int64).min if self.scores is np.int64 else -np.inf

    def prepare(self, m: np.ndarray) -> np.ndarray:
        """A matrix in the form that ``of`` takes."""
        if self.float is not None:
            return m.astype(self.float)
        if not self.limbs:
            return np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
        whole, top = m.astype(np.int64), self.limbs - 1
        parts = [whole >> (_LIMB * k) if k == top else (whole >> (_LIMB * k)) & ((1 << _LIMB) - 1) for k in range(self.limbs)]
        return np.stack(parts, axis=1).astype(np.float64)  # (rows, limbs, dims)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(rows of a, rows of b) scores: float64 below 2^53, else int64, else whole numbers of any size."""
        if self.float is not None:
            return (a @ b.T).astype(np.float64)
        if not self.limbs:
            return a @ b.T
        out = np.zeros((len(a), len(b)), np.int64)  # sums may wrap on the way; the whole fits
        for i in range(self.limbs):
            for j in range(self.limbs):
                out += (a[:, i] @ b[:, j].T).astype(np.int64) << (_LIMB * (i + j))
        return out


def _as_float(x: np.ndarray) -> np.ndarray:
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if abs(v) < 1 << 1000 else np.inf * (1 if v > 0 else -1) for v in x])


class Best:
    """The k best of each query so far: ids and scores in order, and the score below which nothing enters."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        n = len(floor)
        self.k, self.n, self.floor = k, n, floor
        self.ids, self.scores, self.count = np.zeros((n, k), np.int64), np.zeros((n, k), floor.dtype), np.zeros(n, np.int64)

    def take(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """More rows (query, id, score), of any number a query."""
        who = np.unique(q)
        here = np.arange(self.k)[None, :] < self.count[who][:, None]
        q = np.concatenate((np.repeat(who, self.count[who]), q))
        ids = np.concatenate((self.ids[who][here], ids))
        scores = np.concatenate((self.scores[who][here], scores))
        order = np.lexsort((ids, -scores, q)) if scores.dtype != object else np.array(sorted(range(q.size), key=lambda x: (q[x], -scores[x], ids[x])))
        q, ids, scores = q[order], ids[order], scores[order]
        at = np.searchsorted(q, who)
        place = np.arange(q.size) - np.repeat(at, np.diff(np.append(at, q.size)))
        keep = place < self.k
        q, ids, scores, place = q[keep], ids[keep], scores[keep], place[keep]
        self.ids[q, place], self.scores[q, place] = ids, scores
        self.count[who] = np.bincount(q, minlength=self.n)[who]
        full = who[self.count[who] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.scores[full, -1])


class Slice:
    """A slice of queries with what a task needs to search for them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, piv: np.ndarray, top: float, product: Product, floor: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            norm = (m**2).sum(axis=1)
        up = np.hstack([m, np.zeros((len(m), 1))])
        self.dist = _distances(up, piv)
        order = np.lexsort((ids, self.dist.argmin(axis=1)))  # queries of one pivot lie side by side
        self.ids, self.dist, self.floor = ids[order], self.dist[order], floor[order]
        self.norm, self.top, self.piv, self.product = norm[order], top, piv, product
        self.m = product.prepare(m[order])
        near = self.dist.argmin(axis=1)
        ends = np.flatnonzero(np.diff(np.append(near, -1))) + 1
        self.groups = [(a, min(a + 512, b)) for s, b in zip(np.concatenate(([0], ends[:-1])), ends) for a in range(s, b, 512)]
        self.slack = 1e-6 * (1 + np.sqrt(top))

    def reach(self, a: int, b: int, floor: np.ndarray) -> np.ndarray:
        """The largest distance at which a point can have a score of ``floor`` or more."""
        return np.sqrt(np.maximum(self.norm[a:b] + self.top - 2 * _as_float(floor), 0)) + self.slack


def search(batches: Iterator[pa.RecordBatch], asked: Slice, dims: int, scale: int, k: int, ring: int, chunk: int) -> Iterator[tuple[Best, np.ndarray, int]]:
    """(best of each query, vectors compared with each, vectors seen) of all batches of (id, v)."""
    best = Best(k, asked.floor.copy())
    compared, seen = np.zeros(len(asked.ids), np.int64), 0

    @np.errstate(all="ignore")
    def run(ids: np.ndarray, m: np.ndarray) -> None:
        up = np.hstack([m, np.sqrt(np.maximum(asked.top - (m**2).sum(axis=1), 0))[:, None]])
        d = _distances(up, asked.piv)
        near = d.argmin(axis=1)
        d = d[np.arange(len(m)), near]
        order = np.lexsort((ids, d, near))
        ids, near, d, vectors = ids[order], near[order], d[order], asked.product.prepare(m[order])
        bounds = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(near)) + 1)))
        cuts = [(x, min(x + ring, y)) for a, y in zip(bounds, np.append(bounds[1:], len(ids))) for x in range(a, y, ring)]
        pivot = near[[a for a, _ in cuts]]
        lo, hi = d[[a for a, _ in cuts]], d[[b - 1 for _, b in cuts]]
        for a, b in asked.groups:
            mine = asked.dist[a:b][:, pivot]
            least = np.maximum(np.maximum(mine - hi[None, :], lo[None, :] - mine), 0)
            for r in np.argsort(least.min(axis=0), kind="stable").tolist():
                # Not greater, so that bounds beyond the range of doubles stop nothing.
                go = np.flatnonzero(~(least[:, r] > asked.reach(a, b, best.floor[a:b]))) + a
                if not go.size:
                    continue
                x, y = cuts[r]
                compared[go] += y - x
                s = asked.product.of(asked.m[go], vectors[x:y])
                good = (s >= best.floor[go][:, None]) & (asked.ids[go][:, None] != ids[None, x:y])
                i, j = np.nonzero(good)
                if i.size:
                    best.take(go[i], ids[x + j], s[i, j])

    held_i: list[np.ndarray] = []
    held_m: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        for a in range(0, len(batch), chunk):
            part = batch.slice(a, chunk)
            held_i.append(part.column(0).to_numpy().astype(np.int64))
            held_m.append(matrix(part.column(1), dims, scale))
            rows += len(part)
            if rows >= chunk:
                run(np.concatenate(held_i), np.vstack(held_m))
                held_i, held_m, seen, rows = [], [], seen + rows, 0
    if rows:
        run(np.concatenate(held_i), np.vstack(held_m))
    yield best, compared, seen + rows


class Plan:
    """Bounds of a table, its pivots and a bounded sample: what all passes share."""

    def __init__(self, base: DataFrame, scale: int, pivots: int, sample: int) -> None:
        whole = F.transform("v", lambda c: F.abs(c * scale) + 1)  # floor moves a component by less than 1
        row = base.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(whole)), F.max(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x))).first()
        self.rows, self.dims, self.scale = row[0], int(row[1] or 0), scale
        if not self.rows:
            return
        self.top = float(row[3] or 0.0)
        self.product = Product(self.top, float(row[2] or 0.0), self.dims)
        seen = base.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
        self.ids = seen.column("id").to_numpy()
        self.some = matrix(seen.column("v").combine_chunks(), self.dims, scale)
        self.pivots = choose_pivots(np.hstack([self.some, np.sqrt(np.maximum(self.top - (self.some**2).sum(axis=1), 0))[:, None]]), pivots)
        self.prepared = self.product.prepare(self.some)

    def asked(self, seen: pa.Table, k: int) -> Slice:
        """A slice of queries (id, v); the k-th best score in the sample is the first bound of each."""
        ids = seen.column("id").to_numpy()
        m = matrix(seen.column("v").combine_chunks(), self.dims, self.scale)
        floor = np.full(len(ids), self.product.least, self.product.scores)
        for a in range(0, len(ids), 512):
            part = self.product.of(self.product.prepare(m[a : a + 512]), self.prepared)
            for i, row in enumerate(part):
                others = row[self.ids != ids[a + i]]
                if others.size >= k:
                    floor[a + i] = np.sort(others)[-k]
        return Slice(ids, m, self.pivots, self.top, self.product, floor)


def _passes(vectors: DataFrame, id_col: str, vec_col: str, k: int, query_mod: int, scale: int, pivots: int, sample: int, slice_bytes: int) -> Iterator[tuple[DataFrame, Slice, int]]:
    """(candidates, slice of queries, dims) of each pass."""
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vec_col, scale)
    plan = Plan(base, scale, pivots, sample)
    if not plan.rows:
        return
    # A table of fewer parts than there are cores is dealt out; beyond that vectors stay where they are.
    cores = spark.sparkContext.defaultParallelism
    dealt = base.repartition(cores, F.xxhash64("id", "v")) if base.rdd.getNumPartitions() < cores else base
    ask = base.filter(F.pmod("id", F.lit(query_mod)) == 0).dropDuplicates(["id", "v"])
    fit = max(1, slice_bytes // (8 * max(1, plan.dims)))
    count = ask.count()
    slices = max(1, -(-count // max(1, fit * 4 // 5)))
    for n in range(slices if count else 0):
        mine = ask if slices == 1 else ask.filter(F.pmod(F.xxhash64("id", "v"), F.lit(slices)) == n)
        seen = mine.orderBy("id").toArrow()
        if seen.num_rows:
            yield dealt, plan.asked(seen, k), plan.dims


OUT = "query_id long, rank int, vec_id long, score long"
_BIG = (1 << 63) - 1


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, key) -> the k best of each query id, in order; key sorts as the score."""
    rows = F.slice(F.sort_array(F.collect_list(F.struct("key", "vec_id", "score"))), 1, k)
    return found.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.posexplode("r").alias("pos", "x")).select("query_id", "pos", "x.key", "x.vec_id", "x.score")


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    query_mod: int = 20,
    scale: int = 64,
    pivots: int = 48,
    sample: int = 3000,
    ring: int = 1024,
    chunk: int = 32768,
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to smaller ids."""
    out = None
    for dealt, asked, dims in _passes(vectors, id_col, vec_col, k, query_mod, scale, pivots, sample, slice_bytes):
        shared = vectors.sparkSession.sparkContext.broadcast(asked)  # slice_bytes and what is derived from it

        def run(batches: Iterator[pa.RecordBatch], shared=shared, dims=dims) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for best, _, _ in search(batches, asked, dims, scale, k, ring, chunk):
                i, j = np.nonzero(np.arange(k)[None, :] < best.count[:, None])
                scores = best.scores[i, j]
                if scores.dtype == object:  # texts that sort as the true scores, which may pass 64 bits
                    key = [format((1 << 2200) - int(x), "0560x") for x in scores]
                    scores = np.array([max(-_BIG, min(_BIG, int(x))) for x in scores], np.int64)
                else:
                    scores = scores.astype(np.int64)
                    key = [""] * len(scores)
                for a in range(0, len(i), 1 << 16):
                    s = scores[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(asked.ids[i[a : a + (1 << 16)]]),
                            pa.array(best.ids[i, j][a : a + (1 << 16)]),
                            pa.array(s),
                            pa.array(key[a : a + (1 << 16)], pa.string()),
                            pa.array(-s),
                        ],
                        names=["query_id", "vec_id", "score", "far", "neg"],
                    )

        found = dealt.mapInArrow(run, "query_id long, vec_id long, score long, far string, neg long")
        found = _ranked(found.select("query_id", "vec_id", "score", F.struct("far", "neg").alias("key")), k)
        if out is None:
            out = found
            several = False
            continue
        # More passes: each ends in the shared folder, so that one slice at a time is held.
        if not several:
            out, several = cut(out), True
        out = out.unionByName(cut(found))
    if out is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    if several:
        out = _ranked(out, k)
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "vec_id", "score")


def pruning(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    query_mod: int = 20,
    scale: int = 64,
    pivots: int = 48,
    sample: int = 3000,
    ring: int = 1024,
    chunk: int = 32768,
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """(query_id, compared, stopped): vectors that a query was compared with, and those that its bounds stopped."""
    out = None
    for dealt, asked, dims in _passes(vectors, id_col, vec_col, k, query_mod, scale, pivots, sample, slice_bytes):
        shared = vectors.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, dims=dims) -> Iterator[pa.RecordBatch]:
            for _, compared, seen in search(batches, shared.value, dims, scale, k, ring, chunk):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids), pa.array(compared), pa.array(seen - compared)], names=["query_id", "compared", "stopped"])

        got = dealt.mapInArrow(run, "query_id long, compared long, stopped long").groupBy("query_id").agg(F.sum("compared").alias("compared"), F.sum("stopped").alias("stopped"))
        out = cut(got) if out is None else out.unionByName(cut(got))
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, compared long, stopped long")
    return out.groupBy("query_id").agg(F.sum("compared").alias("compared"), F.sum("stopped").alias("stopped"))
