"""Array expressions over embeddings and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronogrid.constants import SOURCES


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero when either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def squared_error_mean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x) / F.size(a)


def hash_vector(text: Column, n: int) -> Column:
    """``n`` values in [-1, 1]: 16-bit big-endian words of the SHA-256, wrapping."""
    digest = F.sha2(text, 256)

    def word(i: int) -> Column:
        return F.conv(F.substring(digest, 4 * (i % 16) + 1, 4), 16, 10).cast("double")

    return F.array(*[word(i) / F.lit(65535.0) * F.lit(2.0) - F.lit(1.0) for i in range(n)])


def one_hot_source(source: Column) -> Column:
    return F.array(*[F.when(source == name, F.lit(1.0)).otherwise(F.lit(0.0)) for name in SOURCES])
