"""Integer codes and their lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """Signed 16-bit number to unsigned: 0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return F.shiftleft(v.cast("int"), 1).bitwiseXOR(F.shiftright(v.cast("int"), 31)).cast("long")


def unzigzag(u: Column) -> Column:
    return F.shiftright(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("long"))))


def varint_size(u: Column) -> Column:
    """Bytes of an unsigned 16-bit number at seven bits a byte."""
    return F.when(u < 128, 1).when(u < 16384, 2).otherwise(3).cast("long")


def rice_k(total: Column, count: Column) -> Column:
    """Rice parameter by the floored mean: floor(log2), 0 for a mean under 1 or nothing, 15 at most."""
    mean = F.when(count > 0, F.floor(total / count)).otherwise(0)
    # a number's binary digits are exact, a logarithm need not be
    return F.when(mean < 1, 0).otherwise(F.least(F.length(F.bin(mean)) - 1, F.lit(15))).cast("long")


def rice_length(u: Column, k: Column, most: int = 31) -> Column:
    """Bits of an unsigned number: unary quotient (up to most ones) and its stop, then k bits."""
    return (F.least(F.floor(u / F.pow(F.lit(2), k)).cast("long"), F.lit(most)) + 1 + k).cast("long")


def exp_golomb_length(u: Column) -> Column:
    return (2 * F.length(F.bin(u + 1)) - 1).cast("long")


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(F.greatest(a, b), c), F.least(a, b))


def binary_entropy(p: Column) -> Column:
    q = 1.0 - p
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + q * F.log2(q)))
