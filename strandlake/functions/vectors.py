"""Vector expressions on array columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.params import POOL_WIDTH


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """The vector at length 1; one of length 0 gives null."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pool(v: Column, width: int = POOL_WIDTH) -> Column:
    """Mean of each ``width`` consecutive dimensions; an incomplete last block is dropped."""
    blocks = F.floor(F.size(v) / width).cast("int")
    return F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: total(F.slice(v, i * width + 1, F.lit(width))) / width))


def dimension_sums(v: Column, dim: int) -> list[Column]:
    """Aggregates that add up vectors per dimension, with partial sums before the shuffle."""
    return [F.sum(F.element_at(v, i + 1)).alias(f"_s{i}") for i in range(dim)]
