"""A deterministic embedder for use where no model is at hand: hashed words, signed, unit length."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\w+")


def embed_text(text: str | None, dims: int = 64) -> np.ndarray:
    v = np.zeros(dims, np.float32)
    for w in _WORD.findall((text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _embed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: embed_text(t).tolist())


def hashed_vector(text: Column) -> Column:
    return _embed(text)
