"""Vector expressions, and blocked products for many queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memengine.functions.checkpoint import cut


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant, so that no join is needed for a single query."""
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity of unit vectors, clamped to [0, 1]; null for vectors of unlike length."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))
    return F.when(F.size(a) == F.size(b), clamped)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest_of_each(asked: DataFrame, rows: DataFrame, k: int | None, least: float, group: str | None = None, slice_bytes: int = 8 << 20) -> DataFrame:
    """(new_id, id, similarity, rank): for each row of asked (id, embedding) its k most similar of rows, itself apart.

    ``group``: column that both must share; k None: all of ``least`` or more, however many. Asked rows go to all
    tasks in slices of ``slice_bytes`` at most, a larger table in several passes; rows are not shuffled. Each batch
    is one matrix product a group, and a task hands on k rows a question. Similarities are ranked by 12 digits,
    ties to the smaller id. Vectors of unlike length never meet.
    """
    spark = asked.sparkSession
    if group:  # a question whose group has no row has no answer
        asked = asked.join(rows.select(group).distinct(), group, "left_semi")
    key = F.col(group).cast("string") if group else F.lit("")
    q = asked.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull() & key.isNotNull()).select("id", key.alias("g"), F.col("embedding").cast("array<double>").alias("v"))
    base = rows.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull() & key.isNotNull()).select("id", key.alias("g"), F.col("embedding").cast("array<double>").alias("v"))
    size = q.agg(F.sum(F.size("v").cast("long") * 8 + 64)).first()[0] or 0
    passes = max(1, -(-int(size) * 5 // (4 * slice_bytes)))
    schema, out = "new_id string, id string, similarity double", None
    for n in range(passes):
        part = (q if passes == 1 else q.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == n)).toArrow()
        shared = spark.sparkContext.broadcast(_blocks(part))  # slice_bytes at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            floor = {name: np.full(len(ids), least) for name, (ids, _) in shared.value.items()}
            for b in batches:
                for name, (ids, m) in _blocks(pa.Table.from_batches([b])).items():
                    if name not in shared.value:
                        continue
                    q_ids, qm = shared.value[name]
                    for a in range(0, len(ids), 2048):
                        sim = np.round(np.clip(m[a : a + 2048] @ qm.T, 0, 1), 12)
                        i, j = np.nonzero(sim >= floor[name][None, :])
                        fine = ids[a + i] != q_ids[j]
                        i, j = i[fine], j[fine]
                        held.append((q_ids[j], ids[a + i], sim[i, j]))
                        if k is not None and sim.shape[0] > k:  # the k-th best, or (itself among them) the next, bounds what follows
                            kth = np.partition(sim, sim.shape[0] - k - 1, axis=0)[sim.shape[0] - k - 1]
                            floor[name] = np.maximum(floor[name], kth)
                if sum(len(h[0]) for h in held) > 1 << 19:
                    held = [_best(held, k)]
                    if k is None:
                        yield from _triples(*held.pop())
            if held:
                yield from _triples(*_best(held, k))

        found = base.mapInArrow(run, schema)
        if passes > 1:
            found = cut(found if k is None else _top(found, k).drop("rank"))
        out = found if out is None else out.unionByName(found)
    if k is None:
        return out.withColumn("rank", F.lit(None).cast("int"))
    return _top(out, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("new_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(seen: pa.Table) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """(id, g, v) rows by group and length: ids and matrix."""
    out: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    col = seen.column("v").combine_chunks()
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)
    ids, groups, sizes = np.array(seen.column("id").to_pylist(), object), np.array(seen.column("g").to_pylist(), object), np.diff(off)
    names, by = np.unique(groups, return_inverse=True)
    order = np.lexsort((sizes, by))
    starts = np.flatnonzero((np.diff(by[order], prepend=-1) != 0) | (np.diff(sizes[order], prepend=-1) != 0))
    for at in np.split(order, starts[1:]) if order.size else []:
        g, n = names[by[at[0]]], int(sizes[at[0]])
        out[g, n] = (ids[at], np.nan_to_num(flat[off[at][:, None] + np.arange(n)[None, :]]) if n else np.zeros((at.size, 0)))
    return out


def _best(held: list[tuple[np.ndarray, ...]], k: int | None) -> tuple[np.ndarray, ...]:
    """The k best of each question among (question, id, similarity) arrays."""
    q, ids, s = (np.concatenate(x) for x in zip(*held))
    if k is None or not q.size:
        return q, ids, s
    by = np.unique(q, return_inverse=True)[1]
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -s, by))
    place = np.arange(order.size) - np.searchsorted(by[order], by[order])
    order = order[place < k]
    return q[order], ids[order], s[order]


def _triples(q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(q), 1 << 16):
        part = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(q[part].tolist(), pa.string()), pa.array(ids[part].tolist(), pa.string()), pa.array(s[part])], names=["new_id", "id", "similarity"])


def nearest(memories: DataFrame, queries: np.ndarray, names: Sequence[str], k: int, floor: float = 0.0) -> DataFrame:
    """(query, id, similarity): the k most similar rows for each of a bounded block of queries.

    Each batch is one matrix product; a task keeps k rows a query, so the shuffle carries k x tasks rows.
    Callers with more queries than fit a task call it block by block.
    """
    q = np.asarray(queries, np.float64)
    if q.nbytes > 64 << 20:
        raise ValueError("pass the queries in blocks of 64 MB at most")
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, str]]] = [[] for _ in names]
        for b in batches:
            ids = b.column(0).to_pylist()
            col = b.column(1)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if not ids or flat.size != len(ids) * q.shape[1]:
                continue
            sim = np.clip(flat.reshape(len(ids), -1) @ q.T, 0, 1)
            for j in range(len(names)):
                fine = np.flatnonzero(sim[:, j] >= floor)
                best[j] = sorted(best[j] + [(-float(sim[i, j]), ids[i]) for i in fine])[:k]
        rows = [(names[j], i, -s) for j, found in enumerate(best) for s, i in found]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2])], names=["query", "id", "similarity"])

    part = memories.filter(F.size("embedding") == q.shape[1]).select("id", "embedding").mapInArrow(run, "query string, id string, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
