"""Vector arithmetic as Column expressions, in doubles; vectors count as unit vectors where a distance is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot: norms are taken to be 1."""
    return F.lit(1.0) - dot(a, b)


def clamped_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def true_cosine(a: Column, b: Column) -> Column:
    """The dot product over both norms; 0 where one is 0."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def l2_normalize(a: Column, least: float = 1e-8) -> Column:
    """The vector over its norm; unchanged where the norm is at most `least`."""
    n = norm(a)
    return F.when(n > least, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def int8_scale(a: Column) -> Column:
    """The largest magnitude over 127; 1 for a zero vector."""
    most = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(most > 0, most / 127.0).otherwise(F.lit(1.0))


def int8_codes(a: Column, scale: Column) -> Column:
    """Each component over the scale, rounded half away from zero and held within +-127."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int"))))


def int8_distance(codes: Column, scale: Column, query_codes: Column, query_scale: Column) -> Column:
    return F.lit(1.0) - dot(codes, query_codes) * scale * query_scale
