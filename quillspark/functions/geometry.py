"""Plane vectors as struct(x, y) and closed intervals as struct(lo, hi), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y) -> Column: return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
def vec_add(a, b): return vec(a.x + b.x, a.y + b.y)
def vec_sub(a, b): return vec(a.x - b.x, a.y - b.y)
def dot(a, b): return a.x * b.x + a.y * b.y
def magnitude(a): return F.sqrt(dot(a, a))
def complex_product(a, b): return vec(a.x * b.x - a.y * b.y, a.x * b.y + a.y * b.x)


def complex_quotient(a, b):
    """a / b as complex numbers; null where b is zero."""
    n = F.nullif(dot(b, b), F.lit(0.0))
    return vec((a.x * b.x + a.y * b.y) / n, (a.y * b.x - a.x * b.y) / n)


def interval(lo, hi) -> Column: return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
def interval_add(a, b): return interval(a.lo + b.lo, a.hi + b.hi)
def interval_sub(a, b): return interval(a.lo - b.hi, a.hi - b.lo)


def interval_mul(a, b):
    ends = [a.lo * b.lo, a.lo * b.hi, a.hi * b.lo, a.hi * b.hi]
    return interval(F.least(*ends), F.greatest(*ends))


def interval_square(a):
    ends = (a.lo * a.lo, a.hi * a.hi)
    return interval(F.when((a.lo <= 0) & (a.hi >= 0), 0.0).otherwise(F.least(*ends)), F.greatest(*ends))


def certainly_less(a, b): return a.hi < b.lo
def possibly_less(a, b): return a.lo < b.hi
