"""Array algebra on ARRAY columns. All are JVM-side expressions; positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x)


# Element-wise forms: the second operand is a number or an array of equal length.
def _binary(a, b, f) -> Column:
    if isinstance(b, Column):
        return F.zip_with(a, b, f)
    return F.transform(a, lambda x: f(x, F.lit(b)))


def add(a, b): return _binary(a, b, lambda x, y: x + y)
def sub(a, b): return _binary(a, b, lambda x, y: x - y)
def rsub(number, a): return F.transform(a, lambda x: F.lit(number) - x)
def mul(a, b): return _binary(a, b, lambda x, y: x * y)
def div(a, b): return _binary(a, b, lambda x, y: x / y)
def rdiv(number, a): return F.transform(a, lambda x: F.lit(number) / x)
def power(a, b): return _binary(a, b, lambda x, y: F.pow(x, y))
def largest(a, b): return _binary(a, b, lambda x, y: F.greatest(x, y))
def smallest(a, b): return _binary(a, b, lambda x, y: F.least(x, y))
def neg(a): return F.transform(a, lambda x: -x)
def absolute(a): return F.transform(a, lambda x: F.abs(x))
def log(a): return F.transform(a, lambda x: F.log(x))
def exp(a): return F.transform(a, lambda x: F.exp(x))
def sin(a): return F.transform(a, lambda x: F.sin(x))
def cos(a): return F.transform(a, lambda x: F.cos(x))
def greater(a, limit, yes=1, no=0): return F.transform(a, lambda x: F.when(x > limit, yes).otherwise(no))
def less(a, limit, yes=1, no=0): return F.transform(a, lambda x: F.when(x < limit, yes).otherwise(no))
def ifelse(condition, a, b): return F.transform(condition, lambda c, i: F.when(c != 0, F.get(a, i)).otherwise(F.get(b, i)))
def blend(weight, a, b): return F.transform(weight, lambda c, i: c * F.get(a, i) + (1 - c) * F.get(b, i))
def clip(a, lo, hi): return F.transform(a, lambda x: F.least(F.greatest(x, _c(lo)), _c(hi)))
def linear(a, m, b, lo, hi): return clip(F.transform(a, lambda x: x * m + b), lo, hi)
def gamma(a, c, g, lo, hi): return clip(F.transform(a, lambda x: F.pow(x, F.lit(g)) * c), lo, hi)


def expand_range(a, lo, hi) -> Column:
    """Rescaled so that the extremes become lo and hi; a constant array becomes lo."""
    least, most = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: F.when(most == least, F.lit(lo).cast("double")).otherwise((x - least) * (hi - lo) / (most - least) + lo))


def contains_only(a, values): return F.forall(a, lambda x: x.isin(*values))
def has_nan(a): return F.exists(a, lambda x: F.isnan(x.cast("double")))
def norm1(a): return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
def norm2(a): return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
def _over(a, norm): return F.element_at(F.transform(F.array(norm), lambda n: F.transform(a, lambda x: x / n)), 1)  # the norm is computed once
def normalize1(a): return _over(a, norm1(a))
def normalize2(a): return _over(a, norm2(a))
def first_index_of(a, value): return (F.array_position(a, value) - 1).cast("int")
def remove_value(a, value): return F.array_remove(a, value)
def remove_element(a, at): return F.filter(a, lambda x, i: i != at)
def insert_at(a, at, value): return F.array_insert(a, at + 1, _c(value))
def reverse(a): return F.reverse(a)
def iota(n): return F.sequence(F.lit(0), _c(n) - 1)
def unit_vector(n, at): return F.transform(iota(n), lambda i: F.when(i == at, 1).otherwise(0))
def bounded_at(a, at, default): return F.coalesce(F.when(F.lit(at) >= 0, F.get(a, F.lit(at))), _c(default))
def clamped_at(a, at): return F.get(a, F.greatest(F.lit(0), F.least(_c(at), F.size(a) - 1)))
def pick(a, indexes): return F.transform(indexes, lambda i: F.get(a, i))
def permute(a, order): return pick(a, order)


def shuffled(a, seed: int) -> Column:
    """A repeatable permutation: elements in the order of a hash of their place."""
    keyed = F.transform(a, lambda x, i: F.struct(F.xxhash64(i, F.lit(seed)).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def argsort(a) -> Column:
    """Places in ascending order of value, ties by place."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def ranks(a): return argsort(argsort(a))
def n_smallest(a, n): return F.slice(argsort(a), 1, n)


def n_largest(a, n) -> Column:
    """Places of the n largest values, ties by place."""
    keyed = F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["i"]), 1, n)


def sparsify(a, n) -> Column:
    """Values of magnitude below the n-th largest become 0."""
    limit = F.get(F.reverse(F.array_sort(F.transform(a, lambda x: F.abs(x)))), F.lit(n - 1))
    return F.transform(a, lambda x: F.when(F.abs(x) >= limit, x).otherwise(0))


def argmax(a): return first_index_of(a, F.array_max(a))
def argmin(a): return first_index_of(a, F.array_min(a))
def product(a): return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)
def dist2squared(a, b): return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
def dist2(a, b): return F.sqrt(dist2squared(a, b))
def fractile(a, f): return F.get(F.array_sort(a), F.least(F.floor(F.size(a) * f).cast("int"), F.size(a) - 1))
def upper_median(a): return fractile(a, 0.5)


def middle_median(a) -> Column:
    """The mean of the two middle values where their number is even."""
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def uniq(a): return F.array_sort(F.array_distinct(a))
def binsearch(a, value): return F.size(F.filter(a, lambda x: x <= value)) - 1
def is_sorted(a): return a == F.array_sort(a)
def quantize(a): return F.transform(a, lambda x: F.round(x.cast("double") * 100).cast("int"))
def popcount(a, limit): return F.size(F.filter(a, lambda x: x > limit))
def hamming(a, b, limit): return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > limit) != (y > limit)), lambda d: d))
def matmul_row(row, columns): return F.transform(columns, lambda c: F.aggregate(F.zip_with(row, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def entropy(p) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x < 1e-8, 0.0).otherwise(-x * F.log(x)))


def perplexity(p): return F.exp(entropy(p))
