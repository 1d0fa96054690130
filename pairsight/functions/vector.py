"""Column expressions over arrays of numbers; all sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def zipped(a: Column, b: Column, f) -> Column:
    return total(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def canberra(a: Column, b: Column) -> Column:
    """Mean of |x - y| / (|x| + |y|), 0 where both are 0."""
    return zipped(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)) / F.size(a)


def chi_square(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)) / 2


def l1(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: F.abs(x - y))


def relative_l1(a: Column, b: Column) -> Column:
    """Sum of |x - y| / (1 + x + y)."""
    return zipped(a, b, lambda x, y: F.abs(x - y) / (1 + x + y))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sign_bits(a: Column, words: int) -> Column:
    """Bits of 32 signs a word: bit i is set where the i-th value is above 0."""
    one = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get(a, i + 32 * w) > 0, F.expr("1L")).otherwise(F.lit(0).cast("long")) * F.pow(F.lit(2.0), i.cast("double")).cast("long"))
    return F.array(*[one(w) for w in range(words)])


def quantised(a: Column) -> Column:
    """Eight-bit weights: each value as a whole number of the largest magnitude / 127."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127
    return F.transform(a, lambda x: F.when(scale > 0, F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / scale)))).otherwise(0.0) * scale)
