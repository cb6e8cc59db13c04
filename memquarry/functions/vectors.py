"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def sign_buckets(v: Column, dims: int, groups: int = 8, buckets: int = 64) -> Column:
    """A bucket per group of dimensions: its signs as bits, modulo the number of buckets."""
    width = dims // groups

    def bucket(g: int) -> Column:
        bits = F.transform(F.slice(v, g * width + 1, width), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i)).otherwise(0.0))
        return F.pmod(F.aggregate(bits, F.lit(0.0), lambda s, x: s + x).cast("long"), F.lit(buckets))

    return F.array(*[bucket(g) for g in range(groups)])
