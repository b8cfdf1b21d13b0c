"""Bit vectors, packed hashes and the threshold rule, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signs(vector: str | Column) -> Column:
    """Positive components as true bits."""
    return F.transform(vector, lambda x: x > 0)


def to_vector(bits: str | Column) -> Column:
    """True as 1, false as -1."""
    return F.transform(bits, lambda b: F.when(b, 1).otherwise(-1))


def pack(bits: str | Column) -> Column:
    """Up to 64 bits as one BIGINT; the first bit is the lowest."""
    powers = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    col = F.col(bits) if isinstance(bits, str) else bits
    return F.aggregate(F.zip_with(col, F.slice(powers, 1, F.size(col)), lambda b, p: F.when(b, p).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def hamming(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def score(width: int, distance: Column) -> Column:
    """Dot product of the +1/-1 vectors."""
    return (F.lit(width) - 2 * distance).cast("int")


def radius(degree: int) -> int:
    """Largest Hamming distance that a degree of similarity admits: the score
    must exceed width - degree - 1 strictly."""
    return degree // 2


def hex_id(binary: str | Column) -> Column:
    return F.lower(F.hex(binary))


def prefix_length(size: str | Column) -> Column:
    """Ten per cent of a size, rounded up, in whole numbers."""
    col = F.col(size) if isinstance(size, str) else size
    return F.floor((col + 9) / 10).cast("int")
