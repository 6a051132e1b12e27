"""Operator 3: quality classifier by positive-unlabelled learning.

Features of a whole text: shares of kinds of characters, shares of upper-case, short, repeated and
neighbouring equal words, repeated lines, and lengths; each is cut at quantiles of the unlabelled sample,
so that the model is additive over steps.

Learning. Trusted positives are labelled rows of quality 1; unlabelled are rows without a label. The class
prior of the unlabelled is estimated from the two samples alone: the least ratio, over score thresholds,
of the unlabelled to the positive tail, with confidence terms (best-bin estimate). Then a linear model
minimises the non-negative unbiased risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  by Adam. Last, a
logistic map from margins to the chance of label 1 is fitted on labelled training rows of both kinds.
Samples are bounded: about ``per_class`` rows of each label, and ``unlabelled`` rows without one, picked by a
hash of the id from all of them; the unlabelled sample serves the fit alone (its prior and its risk).

Defined results: null and empty texts get the score of a text without characters; without positives or
unlabelled rows all scores are the share of label 1 among training labels (0.5 if there are none);
repeated rows get a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import bounded_sample, buffers, byte_words, cut, range_hashes, slices, split_of, string_array, text_batches
from memengine.llm.toxicity import fit_logistic

# Kinds of bytes: lower, upper, digit, space, line break, comma or stop, ! or ?, quotes and brackets, pipe,
# other symbols, non-ASCII, control.
_KINDS = 12


def _kinds() -> np.ndarray:
    k = np.full(256, 11, np.int64)
    k[97:123], k[65:91], k[48:58] = 0, 1, 2
    k[[32, 9]], k[[10, 13]] = 3, 4
    k[[ord(c) for c in ".,;:-"]] = 5
    k[[ord(c) for c in "!?"]] = 6
    k[[ord(c) for c in "\"'()[]{}"]] = 7
    k[ord("|")] = 8
    k[[ord(c) for c in "#$%&*+/<=>@\\^_`~"]] = 9
    k[128:] = 10
    return k


KINDS = _kinds()
NAMES = [f"kind{i}" for i in range(_KINDS)] + [
    "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "upper_words", "distinct", "log_excess", "adjacent", "pair_repeat",
    "log_lines", "line_bytes", "line_repeat", "symbols_per_word", "marks_per_word",
]


def features(texts: pa.Array) -> np.ndarray:
    """(rows, len(NAMES)) numbers."""
    out = np.zeros((len(texts), len(NAMES)))
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        data, off = buffers(part)
        n = b - a
        size = np.diff(off)
        if not data.size:
            continue
        byte_row = np.repeat(np.arange(n) * _KINDS, size)
        kinds = np.bincount(byte_row + KINDS[data], minlength=n * _KINDS).reshape(n, _KINDS)
        x = out[a:b]
        x[:, :_KINDS] = kinds / np.maximum(size, 1)[:, None]
        w = byte_words(part)
        words = np.diff(w.first)
        some = np.maximum(words, 1)
        length = w.ends - w.starts

        def per_row(mask: np.ndarray) -> np.ndarray:
            return np.bincount(w.row[mask], minlength=n) if mask.size else np.zeros(n)

        h = range_hashes(w.data, w.starts, w.ends)
        with np.errstate(over="ignore"):
            code = h ^ (w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            distinct = _distinct(code, w.row, n)
            same = (w.row[1:] == w.row[:-1]) if h.size else np.zeros(0, bool)
            pairs = (code[:-1] * np.uint64(3) + code[1:] * np.uint64(0xD6E8FEB86659FD93))[same] if h.size else code
            pair_row = w.row[1:][same] if h.size else w.row
        first_upper = (w.data[w.starts] >= 65) & (w.data[w.starts] < 91) if h.size else np.zeros(0, bool)
        last_upper = (w.data[w.ends - 1] >= 65) & (w.data[w.ends - 1] < 91) if h.size else np.zeros(0, bool)
        lines = np.flatnonzero(data == 10)
        line_start = np.unique(np.concatenate((off[:-1][size > 0], lines + 1)))
        line_start = line_start[line_start < data.size]
        line_end = np.minimum(np.concatenate((line_start[1:], [data.size])), data.size)
        line_row = np.searchsorted(off, line_start, side="right") - 1
        line_end = np.minimum(line_end, off[line_row + 1])
        line_end = line_end - (data[line_end - 1] == 10)  # the break itself is no part of a line
        n_lines = np.bincount(line_row, minlength=n)
        with np.errstate(over="ignore"):
            line_code = range_hashes(data, line_start, line_end) ^ (line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        c = _KINDS
        x[:, c] = np.log1p(size)
        x[:, c + 1] = np.log1p(words)
        x[:, c + 2] = np.bincount(w.row, length, n) / some
        x[:, c + 3] = per_row(length <= 3) / some
        x[:, c + 4] = per_row(length > 20) / some
        x[:, c + 5] = per_row(first_upper & last_upper & (length > 1)) / some
        x[:, c + 6] = distinct / some
        x[:, c + 7] = np.log1p(words) - np.log1p(distinct)
        x[:, c + 8] = (np.bincount(pair_row[h[:-1][same] == h[1:][same]], minlength=n) if h.size else np.zeros(n)) / some
        n_pairs = np.bincount(pair_row, minlength=n) if h.size else np.zeros(n)
        x[:, c + 9] = (n_pairs - _distinct(pairs, pair_row, n)) / np.maximum(n_pairs, 1) if h.size else 0
        x[:, c + 10] = np.log1p(n_lines)
        x[:, c + 11] = np.log1p(size / np.maximum(n_lines, 1))
        x[:, c + 12] = (n_lines - _distinct(line_code, line_row, n)) / np.maximum(n_lines, 1)
        x[:, c + 13] = np.log1p((kinds[:, 8] + kinds[:, 9]) / some)
        x[:, c + 14] = np.log1p(kinds[:, 6] / some)
    return out


def _distinct(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct codes in each row (codes already hold their row)."""
    if not code.size:
        return np.zeros(n)
    order = np.argsort(code)
    s = code[order]
    new = np.empty(s.size, bool)
    new[0] = True
    new[1:] = s[1:] != s[:-1]
    return np.bincount(row[order[new]], minlength=n).astype(float)


class Steps:
    """Features as steps at quantiles of a sample."""

    def __init__(self, x: np.ndarray, steps: int = 12) -> None:
        q = np.concatenate((np.linspace(0, 1, steps + 1)[1:-1], [0.01, 0.02, 0.98, 0.99]))
        self.cuts = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        self.mean, self.sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        parts = [np.clip((x - self.mean) / self.sd, -4, 4)]
        parts += [(x[:, j : j + 1] > c[None, :]).astype(np.float64) for j, c in enumerate(self.cuts)]
        return np.hstack(parts)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives among the unlabelled from held-out scores."""
    cuts = np.unique(np.quantile(np.concatenate((pos, unl)), np.linspace(0, 1, 201)))
    p = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    u = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    fine = p > 0.2
    best = int(np.argmin(np.where(fine, (u + slack) / np.maximum(p, 1e-9), np.inf)))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, l2: float = 1e-4) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative PU risk with the logistic loss."""
    ap, au = (np.hstack([x, np.ones((len(x), 1))]) for x in (xp, xu))
    w = np.zeros(ap.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    best, best_w = np.inf, w
    for t in range(1, steps + 1):
        gp, gu = ap @ w, au @ w
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        up = np.logaddexp(0, -gp).mean()
        down = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        risk = prior * up + max(0.0, down) + l2 * w[:-1] @ w[:-1]
        if risk < best:
            best, best_w = risk, w.copy()
        g_up = -ap.T @ (1 - sp) / len(ap) * prior
        g_down = au.T @ su / len(au) - prior * ap.T @ sp / len(ap)
        g = g_up + g_down if down >= 0 else -g_down
        g[:-1] += 2 * l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return best_w


class Model:
    """Steps, weights and the map from margins to scores; or one score for all."""

    def __init__(self, constant: float, steps: Steps | None = None, w: np.ndarray | None = None, line: tuple[float, float] = (1.0, 0.0), prior: float = 0.5) -> None:
        self.constant, self.steps, self.w, self.line, self.prior = constant, steps, w, line, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), self.constant)
        g = self.steps(x) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(self.line[0] * g + self.line[1], -30, 30)))


def learn(x: np.ndarray, label: np.ndarray) -> Model:
    """label: 1, 0, or -1 for unlabelled."""
    known = label >= 0
    constant = float(label[known].mean()) if known.any() else 0.5
    pos, unl = x[label == 1], x[label == -1]
    if len(pos) < 10 or len(unl) < 10:
        return Model(constant)
    steps = Steps(unl)
    zp, zu = steps(pos), steps(unl)
    # Two folds give held-out scores of both samples for the prior.
    fold_p, fold_u = np.arange(len(zp)) % 2, np.arange(len(zu)) % 2
    sp, su = np.zeros(len(zp)), np.zeros(len(zu))
    for k in (0, 1):
        a = np.vstack([zp[fold_p != k], zu[fold_u != k]])
        y = np.concatenate([np.ones((fold_p != k).sum()), np.zeros((fold_u != k).sum())])
        w = fit_logistic(a, y, l2=1e-3, steps=15)
        sp[fold_p == k] = zp[fold_p == k] @ w[:-1]
        su[fold_u == k] = zu[fold_u == k] @ w[:-1]
    prior = estimate_prior(sp, su)
    w = fit_nnpu(zp, zu, prior, l2=1e-4 + 0.5 / len(zu))
    line = (1.0, 0.0)
    if (label == 0).sum() >= 5:
        g = steps(x[known]) @ w[:-1] + w[-1]
        n1, n0 = (label == 1).sum(), (label == 0).sum()
        # Platt's targets keep the slope finite where the classes part completely.
        y = np.where(label[known] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        scale = max(float(g.std()), 1e-9)
        fit = fit_logistic(g[:, None] / scale, y, l2=1e-4)
        if fit[0] > 0:
            line = (float(fit[0]) / scale, float(fit[1]))
    return Model(constant, steps, w, line, prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, unlabelled: int) -> Model:
    """``labels`` and ``docs`` hold training rows only."""
    text_batches(docs.sparkSession)
    known = labels.filter(f"{label_col} in (0, 1)").groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    marked = docs.select(id_col).join(known, id_col, "left").select(id_col, F.coalesce("y", F.lit(-1)).alias("y")).groupBy(id_col).agg(F.max("y").alias("y"))
    marked = cut(marked)  # ids and labels, read several times below
    # Unlabelled rows are plenty; thin them by their own bound.
    picked = bounded_sample(marked.filter("y >= 0"), id_col, "y", per_class).unionByName(bounded_sample(marked.filter("y < 0"), id_col, "y", unlabelled))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__t")).join(F.broadcast(picked), id_col).select("__t", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(string_array(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["y", "x"])

    seen = rows.mapInArrow(measure, "y int, x array<float>").toArrow()
    if not seen.num_rows:
        return Model(0.5)
    x = seen.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(seen.num_rows, -1)
    y = seen.column("y").to_numpy()
    # Rows come in the order of tasks; a fixed order makes the folds and the fit repeatable.
    order = np.lexsort((*x.T[::-1], y))
    return learn(x[order].astype(np.float64), y[order])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    training: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 4000,
    unlabelled: int = 8000,
    threshold: float = 0.7,
) -> DataFrame:
    """(id, score, predicted) for each row of docs; labels and training are the rows to learn from."""
    id_type = docs.schema[id_col].dataType.simpleString()
    model = train(training, labels, id_col, text_col, label_col, per_class, unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features(string_array(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"]
            )

    return docs.select(id_col, F.col(text_col).cast("string").alias("__t")).mapInArrow(run, f"{id_col} {id_type}, score double, predicted int")


def training_rows(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: crc32(id as text) mod 4 is not 2."""
    return rows.filter(split_of(F.col(id_col), 4) != 2)
