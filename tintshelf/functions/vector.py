"""Vector functions (Column -> Column) on array<float|double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def scale(v: Column, factor: Column) -> Column:
    return F.transform(as_double(v), lambda x: x * factor)


def l2_normalize(v: Column) -> Column:
    """v / (|v| + 1e-8)."""
    n = norm(v) + EPS
    return F.transform(as_double(v), lambda x: x / n)


def hybrid_embedding(clip: Column, shape: Column, color: Column, stripe: Column, weights) -> Column:
    """Unit vector of the weighted, individually normalised parts (weights: 4 numbers or Columns)."""
    parts = [
        scale(l2_normalize(v), w if isinstance(w, Column) else F.lit(float(w)))
        for v, w in zip((clip, shape, color, stripe), weights)
    ]
    return l2_normalize(F.concat(*parts))


def quantize_int8(v: Column) -> Column:
    """INFERRED. struct<codes array<tinyint>, step>: symmetric per-vector scale, ties to even."""
    top = F.array_max(F.transform(as_double(v), F.abs))
    step = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    codes = F.transform(as_double(v), lambda x: F.rint(x / step).cast("tinyint"))
    return F.struct(codes.alias("codes"), step.alias("step"))


def dequantize_int8(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c.cast("double") * q["step"])
