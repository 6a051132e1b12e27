"""Operator 1: substring dedup by content-defined chunking with a gear rolling hash.

Chunks. The gear hash of the last 32 bytes is ``h = 2 h + G[byte]`` mod 2^32. A chunk ends where the
hash is the least of ``reach`` places to either side (and below all of those before it) and the next byte
starts a character; so chunks have over ``reach`` bytes, about twice that on average, and at most
``max_bytes`` by forced cuts. A cut depends on the 32 + 2 reach bytes around it alone, not on earlier cuts,
so after an insertion the cuts are the same again at once.

Dedup. A row is known by a hash of its id and text, so rows that share an id are apart. A chunk's 128-bit
digest is repeated if it occurs twice, in two rows or in one; its first occurrence keeps it and all others
lose it: that of the smallest id (null comes last), of rows that share an id that of the least hash, then the
least place in the text. A passage is a run of neighbouring repeated chunks of
``min_run_bytes`` or more; at 0 every repeated chunk counts. Per digest the shuffle carries its first row and
a count, combined before it, so a digest of any frequency costs a row a task; the join back hands a hot digest to as
many tasks as there are ``salts``.

Defined results: null and empty texts have no chunk and stay as they are; rows equal in id and text are one
row, and lose the same; rows with a null id are rows like others; texts of any length are chunked whole, in
pieces of bounded size; an empty table gives no rows; extra columns stay and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import buffers, cut, hot_bound, salted, slices, string_array, text_batches

REACH, MAX_BYTES, MIN_RUN_BYTES, SALTS, WINDOW = 24, 512, 80, 64, 32
#: One random 32-bit number for each byte value, from a fixed generator.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte, by doubling the window five times (32 bytes)."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        g = h.copy()
        g[k:] += h[:-k] << np.uint32(k)
        h = g
    return h


def cut_points(data: np.ndarray, off: np.ndarray, reach: int, max_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, in order, and the row of each.

    Rows are laid out with ``reach`` idle places between them, so that no row sees another's bytes.
    """
    top = np.uint32(0xFFFFFFFF)
    h = gear_hashes(data)
    starts_char = (data & 0xC0) != 0x80
    h[:-1][~starts_char[1:]] = top
    bounds = off.tolist()
    laid = np.full(data.size + len(bounds) * reach, top)
    for row, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if b - a >= WINDOW:  # the first places of a row have no full window
            laid[a + row * reach + WINDOW - 1 : b + row * reach] = h[a + WINDOW - 1 : b]
    before, after = np.empty_like(laid), laid.copy()  # least of the reach places before (without own), and from own on
    before[1:], before[0] = laid[:-1], top
    span = 1
    while span < reach:
        step = min(span, reach - span)
        before[step:] = np.minimum(before[step:], before[:-step])
        after[:-step] = np.minimum(after[:-step], after[step:])
        span += step
    at = np.flatnonzero((laid < before) & (laid == after))
    shift = np.searchsorted(off[1:] + np.arange(1, len(off)) * reach, at, side="right") * reach
    ends = np.union1d(at - shift + 1, off[1:][np.diff(off) > 0])
    starts = np.concatenate(([0], ends[:-1]))
    long = np.flatnonzero(ends - starts > max_bytes)
    if long.size:  # rare: forced cuts, moved back to a character's start
        extra: list[int] = []
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            while e - s > max_bytes:
                at = s + max_bytes
                while at > s and not starts_char[at]:
                    at -= 1
                s = at if at > s else s + max_bytes
                extra.append(s)
        ends = np.sort(np.concatenate((ends, np.array(extra, np.int64))))
    return ends, np.searchsorted(off, ends, side="left") - 1


def chunks(rows: DataFrame, reach: int, max_bytes: int) -> DataFrame:
    """(id, row, span, d1, d2): a row for each chunk of each text of ``rows`` (__id, __row, __t); span is place << 32 | length."""
    id_type = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = string_array(batch.column(2))
            for a, b in slices(texts):
                data, off = buffers(texts.slice(a, b - a))
                if not data.size:
                    continue
                e, rows = cut_points(data, off, reach, max_bytes)
                s = np.empty_like(e)
                s[1:] = e[:-1]
                s[0] = 0
                s = np.maximum(s, off[rows])
                view = memoryview(data)
                d = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(s.tolist(), e.tolist())]), np.int64).reshape(-1, 2)
                span = ((s - off[rows]) << 32) | (e - s)
                named = [c.take(pa.array(rows + a)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*named, pa.array(span), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["id", "row", "span", "d1", "d2"])

    return rows.mapInArrow(run, f"id {id_type}, row long, span long, d1 long, d2 long")


def _runs(min_run_bytes: int):
    """mapInArrow: (__row, spans of (span, d1, first)) of a row -> its passages, and what it loses of them."""

    def of(spans: list[dict]) -> tuple[list[list[int]], list[list[int]], int]:
        found: list[list] = []
        had: set[int] = set()
        for span, d1, first in sorted((x["span"], x["d1"], x["first"]) for x in spans):
            pos, n = span >> 32, span & 0xFFFFFFFF
            keep = first and d1 not in had
            had.add(d1)
            if found and found[-1][1] == pos:
                found[-1][1] = pos + n
                found[-1][2].append((pos, n, keep))
            else:
                found.append([pos, pos + n, [(pos, n, keep)]])
        found = [f for f in found if f[1] - f[0] >= min_run_bytes]
        cuts: list[list[int]] = []
        for _, _, parts in found:
            for pos, n, keep in parts:
                if keep:
                    continue
                if cuts and cuts[-1][1] == pos:
                    cuts[-1][1] = pos + n
                else:
                    cuts.append([pos, pos + n])
        return [f[:2] for f in found], cuts, sum(len(f[2]) for f in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cols = [], [[], [], [], [], []]
            for i in range(len(batch)):
                found, cuts, n = of(batch.column(1)[i].as_py())
                if found:
                    keep.append(i)
                    for c, v in zip(cols, ([f[0] for f in found], [f[1] for f in found], [c[0] for c in cuts], [c[1] for c in cuts], n)):
                        c.append(v)
            if keep:
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep)), *(pa.array(c, ints) for c in cols[:4]), pa.array(cols[4], pa.int32())],
                    names=["__row", "run_starts", "run_ends", "cut_starts", "cut_ends", "n_chunks"],
                )

    return run


def _row(id_col: str, text_col: str) -> Column:
    """Hash that knows a row; rows equal in id and text share it."""
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    return F.xxhash64(text, text.isNull(), ident, ident.isNull())


def _spans(docs: DataFrame, id_col: str, text_col: str, reach: int, max_bytes: int, min_run_bytes: int, salts: int) -> DataFrame:
    """(__row, run_starts, run_ends, cut_starts, cut_ends, n_chunks) of rows with a passage."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), _row(id_col, text_col).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__t"))
    every = chunks(rows, reach, max_bytes)
    # Rows equal in id and text have their chunks at the same place: that alone is no repeat.
    place = F.xxhash64("row", "span")
    shared = every.groupBy("d1", "d2").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"), F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n")
    )
    shared = cut(shared.filter("a <> b").select("d1", "d2", F.col("least.row").alias("first"), "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    dealt, kept, keys = salted(every.drop("id"), shared, ["d1", "d2"], F.col("n") >= hot_bound(total), "row", salts)
    found = dealt.join(kept.drop("n"), keys)
    spans = F.collect_set(F.struct("span", "d1", (F.col("row") == F.col("first")).alias("first"))).alias("spans")  # of one text
    found = found.groupBy(F.col("row").alias("__row")).agg(spans)
    return found.mapInArrow(_runs(min_run_bytes), "__row long, run_starts array<int>, run_ends array<int>, cut_starts array<int>, cut_ends array<int>, n_chunks int")


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = REACH,
    max_bytes: int = MAX_BYTES,
    min_run_bytes: int = MIN_RUN_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """A row for each row of docs with a repeated passage, in byte offsets of its UTF-8 text.

    run_starts/run_ends: passages that come elsewhere too; cut_starts/cut_ends: the parts of them that this
    row loses; n_chunks: chunks in the passages; removed_bytes: length of the parts.
    """
    out = _spans(docs, id_col, text_col, reach, max_bytes, min_run_bytes, salts)
    removed = F.aggregate(F.zip_with("cut_starts", "cut_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    ids = docs.select(F.col(f"`{id_col}`"), _row(id_col, text_col).alias("__row"))
    return ids.join(out, "__row").drop("__row").withColumn("removed_bytes", removed)


def _without(text: Column, starts: Column, ends: Column) -> Column:
    """The text without byte ranges, by substrings of its bytes."""
    raw = text.cast("binary")
    zero = F.array(F.lit(0))
    kept = F.zip_with(F.concat(zero, ends), F.concat(starts, F.array(F.octet_length(text))), lambda a, b: F.substring(raw, a + 1, b - a).cast("string"))
    return F.array_join(kept, "")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    changed_col: str | None = None,
    reach: int = REACH,
    max_bytes: int = MAX_BYTES,
    min_run_bytes: int = MIN_RUN_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """docs with repeated passages cut from the text; a text of which nothing is left becomes empty.

    changed_col: name of one more column, whether the row lost something.
    """
    spans = _spans(docs, id_col, text_col, reach, max_bytes, min_run_bytes, salts).filter(F.size("cut_starts") > 0)
    spans = spans.select(F.struct("__row", "cut_starts", "cut_ends").alias("__cut"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), _row(id_col, text_col).alias("__key"))
    joined = whole.join(spans, F.col("__key") == F.col("__cut.__row"), "left")
    text = F.col("__doc").getField(text_col)
    lost = F.col("__cut").isNotNull()
    shorter = F.when(lost, _without(text.cast("string"), F.col("__cut.cut_starts"), F.col("__cut.cut_ends"))).otherwise(text)
    out = [(shorter if c == text_col else F.col("__doc").getField(c)).alias(c) for c in docs.columns]
    return joined.select(*out, *([lost.alias(changed_col)] if changed_col else []))
