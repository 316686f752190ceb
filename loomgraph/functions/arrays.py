"""Array, map and vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_run(small: Column, big: Column) -> Column:
    """Whether ``small`` stands in ``big`` as consecutive elements."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(big) - F.size(small) + 1, F.lit(1)))
    return (F.size(small) <= F.size(big)) & F.exists(starts, lambda i: F.slice(big, i, F.size(small)) == small)


def increasing(a: Column) -> Column:
    """Whether every element is greater than the one before."""
    return (F.size(a) < 2) | F.forall(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.try_element_at(a, i) < F.try_element_at(a, i + 1))


def compress(a: Column, mask: Column) -> Column:
    """Elements whose mask is true."""
    return F.transform(F.filter(F.arrays_zip(a.alias("v"), mask.alias("m")), lambda x: x["m"]), lambda x: x["v"])


def padded(a: Column, size: int, fill: object) -> Column:
    """The first ``size`` elements, filled up to that size."""
    kept = F.slice(a, 1, size)
    return F.concat(kept, F.array_repeat(F.lit(fill), F.lit(size) - F.size(kept)))


def distinct_in_order(a: Column) -> Column:
    return F.array_distinct(a)


def softmax(a: Column) -> Column:
    """exp of each element over the sum, shifted by the largest."""
    e = F.get(F.transform(F.array(F.array_max(a)), lambda m: F.transform(a, lambda x: F.exp(x - m))), 0)
    return F.get(F.transform(F.array(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda s, y: s + y).alias("n"))), lambda v: F.transform(v["e"], lambda x: x / v["n"])), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector at length one; the length stands in an array so that it is worked out once, not for each element."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / n)), 0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def mean_vector(vectors: Column, size: int) -> Column:
    """Element-wise mean of an array of vectors."""
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))
