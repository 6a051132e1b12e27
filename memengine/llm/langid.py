"""Operator 5: language identification by a blended-spectrum string kernel.

Kernel. A text is lower-cased, what is no letter becomes one space, and N(x) is the set of its n-grams of
1 to 4 characters, hashed to ``dims`` places. k(x, y) = |N(x) & N(y)| / sqrt(|N(x)| |N(y)|): presence, not
counts, summed over all lengths.

Model. Nystroem: at most ``landmarks`` training texts, spread over the languages, give the map
z(x) = K(x, L) K(L, L)^(-1/2); one ridge regression for each language against the rest is solved on at
most about ``sample_rows`` training texts, as many of each language. As k is linear in the presence vector, K(x, L) A = P(x) (P(L)' A)
up to norms, so a batch is scored by one matrix product with a (dims, languages) matrix.

Defined results: null texts and texts without a letter are ``und`` with score 0; so are all texts if no
language was learned; ties go to the first language by name; whole texts count, in pieces of bounded
size; repeated rows get a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import bounded_sample, buffers, code_points, letter_table, slices, split_of, string_array, text_batches

DIMS, ORDERS, ROWS = 1 << 15, 4, 256


def presence(texts: pa.Array, dims: int = DIMS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dims) bytes that are 1 where a hashed n-gram is present, and whether a row has a letter."""
    flags = np.zeros((len(texts), dims), np.uint8)
    has = np.zeros(len(texts), bool)
    letters = letter_table()
    for a, b in slices(texts):
        data, off = buffers(pc.utf8_lower(texts.slice(a, b - a)))
        if not data.size:
            continue
        code, first = code_points(data)
        row = np.searchsorted(off, first, side="right") - 1
        letter = letters[np.minimum(code, letters.size - 1)]
        code = np.where(letter, code, 32).astype(np.uint32)
        keep = letter.copy()
        keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
        keep[0] = True
        has[a:b] |= np.bincount(row[letter], minlength=b - a) > 0
        code, row = code[keep], row[keep]
        base = row.astype(np.int64) * dims
        view = flags[a:b].reshape(-1)
        h = np.zeros(code.size, np.uint32)
        for n in range(orders):
            if code.size <= n:
                break
            h = (h[: code.size - n] if n == 0 else h[:-1]) * np.uint32(0x01000193) + code[n:] * np.uint32(0x9E3779B1)
            place = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
            place = (place >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)
            inside = row[: code.size - n] == row[n:]
            view[(base[: code.size - n] + place)[inside]] = 1
    return flags, has


class KernelModel:
    """One-versus-rest kernel ridge regression on Nystroem landmarks, folded into one matrix."""

    def __init__(self, bits: np.ndarray, langs: np.ndarray, landmarks: int, ridge: float = 1e-3) -> None:
        """bits: packed presence rows; langs: their languages."""
        self.names = sorted(set(langs.tolist()))
        each = max(2, landmarks // max(1, len(self.names)))
        chosen = np.concatenate([np.flatnonzero(langs == x)[:each] for x in self.names])[:landmarks] if self.names else np.zeros(0, np.int64)

        def rows(which: np.ndarray) -> np.ndarray:
            p = np.unpackbits(bits[which], axis=1).astype(np.float32)
            return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

        mark = rows(chosen)
        k_mm = (mark @ mark.T).astype(np.float64)
        value, vector = np.linalg.eigh(k_mm)
        value = np.maximum(value, 1e-6)
        root = vector @ np.diag(value**-0.5) @ vector.T
        y = np.where(langs[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        z = np.vstack([(rows(np.arange(a, min(a + 512, len(bits)))) @ mark.T).astype(np.float64) for a in range(0, len(bits), 512)]) @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        beta = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ y)
        self.weights = (mark.T @ (root @ beta[:-1])).astype(np.float32)
        self.bias = beta[-1]

    def margins(self, flags: np.ndarray) -> np.ndarray:
        p = flags.astype(np.float32)
        norm = np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
        return (p @ self.weights) / norm + self.bias


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, landmarks: int, sample_rows: int) -> KernelModel | None:
    """``docs`` holds training rows only."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")
    )
    count = known.select("lang").distinct().count()
    if not count:
        return None
    picked = bounded_sample(known, "id", "lang", max(1, sample_rows // count))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                flags, has = presence(string_array(part.column(1)))
                packed = np.packbits(flags, axis=1)
                keep = np.flatnonzero(has)
                if keep.size:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(keep)), pa.array([packed[i].tobytes() for i in keep], pa.binary())], names=["lang", "bits"]
                    )

    seen = picked.orderBy(F.xxhash64("id")).select("lang", "t").mapInArrow(measure, "lang string, bits binary").toArrow()
    if not seen.num_rows:
        return None
    bits = np.frombuffer(b"".join(seen.column("bits").to_pylist()), np.uint8).reshape(seen.num_rows, -1)
    return KernelModel(bits, np.array(seen.column("lang").to_pylist()), landmarks)


def identify(
    docs: DataFrame,
    training: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    landmarks: int = 384,
    sample_rows: int = 6000,
) -> DataFrame:
    """(id, lang_pred, score) for each row of docs, learned from the rows of ``training``."""
    text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    model = train(training, id_col, text_col, lang_col, landmarks, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                flags, has = presence(string_array(part.column(1)))
                if model is None:
                    names, score = ["und"] * len(part), np.zeros(len(part))
                else:
                    m = 4 * model.margins(flags)
                    e = np.exp(m - m.max(axis=1, keepdims=True))
                    best = m.argmax(axis=1)
                    score = np.where(has, e[np.arange(len(part)), best] / e.sum(axis=1), 0.0)
                    names = [model.names[k] if ok else "und" for k, ok in zip(best.tolist(), has.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__t")).mapInArrow(run, f"{id_col} {id_type}, lang_pred string, score double")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: crc32(id as text) mod 4 is not 2."""
    return docs.filter(split_of(F.col(id_col), 4) != 2)
