"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    length = F.greatest(norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    """0 when one of the vectors vanishes."""
    na, nb = norm(a), norm(b)
    return F.when((na < EPS) | (nb < EPS), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def quantize(a: Column) -> Column:
    """struct<codes array<tinyint>, scale>: largest magnitude maps to 127, truncated toward 0."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top == 0, 1.0).otherwise(top)
    codes = F.transform(a, lambda x: (x.cast("double") / scale * 127).cast("int").cast("tinyint"))
    return F.struct(codes.alias("codes"), scale.alias("scale"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda v: v.cast("double") / 127.0 * q["scale"])


def storage_bytes(
    count: Column, dimension: int = 768, value_bytes: int = 4, row_bytes: int = 512, overhead: float = 1.25
) -> Column:
    """Expected bytes of a vector table with its metadata."""
    return F.floor(count * dimension * value_bytes * overhead) + count * row_bytes
