"""Sample conversions: colour, packing, limited-range video."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quant import clamp


def _half(x: Column, lossless: bool) -> Column:
    return F.floor(x / 2).cast("double") if lossless else x / 2


def ycocg_forward(r: Column, g: Column, b: Column, lossless: bool) -> tuple[Column, Column, Column]:
    """Luma and the two colour differences; halves are floored if lossless."""
    co = r - b
    t = b + _half(co, lossless)
    cg = g - t
    return t + _half(cg, lossless), co, cg


def ycocg_inverse(y: Column, co: Column, cg: Column, lossless: bool) -> tuple[Column, Column, Column]:
    t = y - _half(cg, lossless)
    b = t - _half(co, lossless)
    return b + co, cg + t, b


def to_byte(v: Column, peak: int = 255) -> Column:
    """Rounded half up and clamped sample."""
    return F.floor(clamp(v + 0.5, 0.0, float(peak))).cast("long")


def pack(samples: list[Column], bits: int) -> Column:
    """Samples side by side in one number, the first in the lowest bits (four of 8 bits, two of 16)."""
    peak, out = (1 << bits) - 1, F.lit(0).cast("long")
    for i, s in enumerate(samples):
        out = out.bitwiseOR(F.shiftleft(to_byte(s, peak), bits * i))
    return out


def unpack(word: Column, bits: int, count: int) -> list[Column]:
    return [F.shiftrightunsigned(word, bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(count)]


def pack_i16(a: Column, b: Column) -> Column:
    """Two clamped signed 16-bit numbers in 32 bits, the first low."""
    low, high = (clamp(x, -32768.0, 32767.0).cast("long").bitwiseAND(F.lit(0xFFFF)) for x in (a, b))
    return low.bitwiseOR(F.shiftleft(high, 16))


def unpack_i16(word: Column) -> tuple[Column, Column]:
    sign = lambda x: F.when(x >= 32768, x - 65536).otherwise(x)
    return sign(word.bitwiseAND(F.lit(0xFFFF))), sign(F.shiftrightunsigned(word, 16).bitwiseAND(F.lit(0xFFFF)))


def bt601_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Limited-range video samples (16 to 235, 16 to 240) to full-range colour, clamped."""
    l, u, v = 1.164 * (y - 16.0), cb - 128.0, cr - 128.0
    parts = (l + 1.596 * v, l - 0.392 * u - 0.813 * v, l + 2.017 * u)
    return tuple(clamp(x, 0.0, 255.0) for x in parts)


def rgb_to_bt601(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Full-range luma and colour differences around 128."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, 128.0 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128.0 + 0.5 * r - 0.418688 * g - 0.081312 * b


def deinterleave(a: Column) -> Column:
    """Struct of the three planes p0, p1, p2 whose samples an array holds in turn."""
    plane = lambda k: F.filter(a, lambda _, i: i % 3 == k)
    return F.struct(*(plane(k).alias(f"p{k}") for k in range(3)))


def interleave(a: Column, b: Column, c: Column) -> Column:
    """One array of the samples of three planes in turn."""
    return F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda z: F.array(z["a"], z["b"], z["c"])))
