"""Vectors as bytes of half-precision numbers, little-endian: half the room of float32, for stores that keep whole vectors.

Rounding is to the nearest, ties to even; too large becomes infinite, too small a subnormal number or zero. A null
vector, or one that holds a null, is null; bytes of an odd number are null; an empty vector is no bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def encoded(values: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return values.astype("<f2").tobytes()


def decoded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f2").astype(np.float32)


@pandas_udf(BinaryType())
def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else encoded(np.asarray(v, np.float32)))


@pandas_udf(ArrayType(FloatType()))
def _decode(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None or len(b) % 2 else decoded(b))


def encode(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return _encode(F.when(~F.exists(v, lambda x: x.isNull()), v.cast("array<float>")))


def decode(raw: str | Column) -> Column:
    return _decode(F.col(raw) if isinstance(raw, str) else raw)
