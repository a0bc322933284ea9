"""Vector expressions, evaluated in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """The vector at unit length, in float; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a)


def clamped_score(similarity: Column, penalty: Column) -> Column:
    """A similarity between 0 and 1, times the penalty."""
    return F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)) * penalty


@F.pandas_udf(BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], dtype="<f4"))
