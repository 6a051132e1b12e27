"""Shared helpers of the training-data operators.

Text helpers work on the UTF-8 buffers of Arrow string arrays, so that hot loops are numpy
passes over bytes and not Python loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes (scratch arrays need about 40 times as much).
SLICE_BYTES = 1 << 19


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; only where it is unset (tests), a folder of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        import tempfile

        named = tempfile.mkdtemp(prefix="memengine-checkpoint-")
    sc.setCheckpointDir(named)


def text_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bound the Arrow batches of the session by rows (where that is not set lower already) and bytes.

    Texts run to hundreds of kilobytes; at the default of 10,000 rows a batch takes over 100 MB outside the
    heap in each task. The setting must still hold when the plan runs, so it stays.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_bound(total: int, most: int = 1000) -> int:
    """Rows that make a key hot among ``total``: at most ``most`` keys can have as many."""
    return max(most, -(-total // most))


def salted(many: DataFrame, one: DataFrame, keys: list[str], hot: Column, spread: str, salts: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt, and the keys to join them on, so that no task gets all rows of a hot key.

    ``one`` has a row for each key at most; ``hot`` picks those of its keys that ``hot_bound`` rows of ``many``
    have, so they are few enough to broadcast. Their rows in ``many`` are dealt by a hash of ``spread``.
    """
    named = one.filter(hot).select(*(F.col(k).alias(f"__hot_{k}") for k in keys))
    cond = F.col(keys[0]) == F.col(f"__hot_{keys[0]}")
    for k in keys[1:]:
        cond = cond & (F.col(k) == F.col(f"__hot_{k}"))
    drop, is_hot = [f"__hot_{k}" for k in keys], F.col(f"__hot_{keys[0]}").isNotNull()
    dealt = many.join(F.broadcast(named), cond, "left")
    dealt = dealt.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop(*drop)
    each = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = one.join(F.broadcast(named), cond, "left").withColumn("__salt", F.explode(each)).drop(*drop)
    return dealt, copied, [*keys, "__salt"]


def split_of(key: Column, buckets: int) -> Column:
    """crc32(key as text) mod buckets: names the rows that are held out; -1 for a null key, which is in no split."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(buckets), F.lit(-1).cast("long"))


def bounded_sample(df: DataFrame, key: str, cls: str, per_class: int, seed: int = 17) -> DataFrame:
    """At most about ``per_class`` rows of each class, picked by a hash of the key.

    Two passes of map-side work and one aggregate of a row per class; no sort, no shuffle of texts.
    The expected number of rows of a class is ``per_class`` at most, whatever the input's size.
    """
    counts = {r[0]: r[1] for r in df.groupBy(cls).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        if value is None:
            continue
        share = min(1.0, per_class / n)
        if share >= 1.0:
            keep = keep | (F.col(cls) == F.lit(value))
        else:
            u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30))
            keep = keep | ((F.col(cls) == F.lit(value)) & (u < F.lit(int(share * (1 << 30)))))
    return df.filter(keep)


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with at most ``limit`` bytes each (one row at least)."""
    if len(arr) == 0:
        return
    off = np.frombuffer(arr.buffers()[1], dtype=np.int32, count=len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    start = 0
    while start < len(arr):
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(arr))
        yield start, end
        start = end


def string_array(col: pa.Array) -> pa.Array:
    """The column as plain utf8 with 32-bit offsets, null as empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (starting at 0) of a utf8 array."""
    off = np.frombuffer(arr.buffers()[1], dtype=np.int32, count=len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """Words of a slice of rows: byte ranges, the row of each, the first word of each row."""

    data: np.ndarray
    row_off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray


def _word_mask(data: np.ndarray) -> np.ndarray:
    """True where a byte belongs to a word: ASCII letters and digits, and other letters.

    U+0080-U+00BF (C2 xx) and U+2000-U+20FF (E2 80-83 xx) are punctuation and spaces.
    """
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = True
    table[128:] = True
    mask = table[data]
    c2 = np.flatnonzero(data == 0xC2)
    if c2.size:
        mask[c2] = False
        mask[np.minimum(c2 + 1, data.size - 1)] = False
    e2 = np.flatnonzero(data == 0xE2)
    if e2.size:
        e2 = e2[(data[np.minimum(e2 + 1, data.size - 1)] >= 0x80) & (data[np.minimum(e2 + 1, data.size - 1)] <= 0x83)]
        for k in range(3):
            mask[np.minimum(e2 + k, data.size - 1)] = False
    return mask


def byte_words(arr: pa.Array) -> Words:
    """Split lower-cased rows into words without making a Python string of any."""
    data, off = buffers(arr)
    n_rows = len(arr)
    if data.size == 0:
        z = np.zeros(0, np.int64)
        return Words(data, off, z, z, z, np.zeros(n_rows + 1, np.int64))
    mask = _word_mask(data)
    edge = np.empty(data.size, bool)
    edge[0] = mask[0]
    edge[1:] = mask[1:] & ~mask[:-1]
    inner = off[1:-1]
    inner = inner[inner < data.size]
    edge[inner] = mask[inner]
    starts = np.flatnonzero(edge)
    stop = np.empty(data.size, bool)
    stop[-1] = mask[-1]
    stop[:-1] = mask[:-1] & ~mask[1:]
    last = inner[inner > 0] - 1
    stop[last] = mask[last]
    ends = np.flatnonzero(stop) + 1
    row = np.searchsorted(off, starts, side="right") - 1
    first = np.searchsorted(starts, off, side="left")
    return Words(data, off, starts, ends, row, first)


_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; those of a usual slice are kept."""
    kept = _POWERS.get(int(base))
    if kept is not None and kept.size >= n:
        return kept[:n]
    want, n = n, max(n, 2 * SLICE_BYTES) if n <= 2 * SLICE_BYTES else n
    out = _POWERS[int(base)] = _make_powers(base, n)
    if n > 2 * SLICE_BYTES:
        del _POWERS[int(base)]
    return out[:want]


def _make_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte range, by prefix sums (equal bytes, equal hash)."""
    if starts.size == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = data.size
        terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(_R, n)
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(terms, out=prefix[1:])
        inv = _powers(_R_INV, n)
        h = (prefix[ends] - prefix[starts]) * inv[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each starts."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[first].astype(np.int64)
    last = data.size - 1
    code = b.copy()
    many = np.flatnonzero(b >= 0xC0)
    if many.size:
        at, lead = first[many], b[many]
        c1 = data[np.minimum(at + 1, last)].astype(np.int64) & 0x3F
        c2 = data[np.minimum(at + 2, last)].astype(np.int64) & 0x3F
        c3 = data[np.minimum(at + 3, last)].astype(np.int64) & 0x3F
        two = ((lead & 0x1F) << 6) | c1
        three = ((lead & 0x0F) << 12) | (c1 << 6) | c2
        four = ((lead & 0x07) << 18) | (c1 << 12) | (c2 << 6) | c3
        code[many] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return code, first


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]
