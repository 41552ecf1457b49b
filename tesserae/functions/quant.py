"""Quantisation, weights and step rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: nested expressions would be computed again wherever a lambda names them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def quantize(v: Column, step: Number, dead_zone: Number = 0.0, weight: Number = 1.0) -> Column:
    """Dead-zone index of a coefficient: 0 under dead_zone steps, else the magnitude in steps rounded half up, with its sign."""
    e = _c(step) * _c(weight)
    return F.when(F.abs(v) < _c(dead_zone) * e, F.lit(0)).otherwise(F.signum(v) * F.floor(F.abs(v) / e + 0.5)).cast("long")


def dequantize(q: Column, step: Number, weight: Number = 1.0) -> Column:
    return q.cast("double") * _c(step) * _c(weight)


def dct_frequency_weight(row: Column, col: Column, strength: Number) -> Column:
    """Weight of an 8x8 frequency: grows with its squared distance from the mean."""
    return 1.0 + _c(strength) * (row * row + col * col) / 98.0


def adaptive_weight(variance: Column, strength: Number) -> Column:
    """Raw spatial weight of a block: smooth blocks above 1, busy ones below, within 0.5 and 2."""
    raw = 1.0 + 0.15 * _c(strength) * (8.0 - F.log2(1.0 + variance))
    return clamp(raw, 0.5, 2.0)


def energy_multiplier(energy: Column, most: Number) -> Column:
    """Step multiplier of a temporal high band by its mean magnitude: most up to 0.5, 1.2 from 10, in between linear in the logarithm."""
    low, high, least = 0.5, 10.0, 1.2
    share = (F.ln(energy) - F.ln(F.lit(low))) / (F.ln(F.lit(high)) - F.ln(F.lit(low)))
    return F.when(energy <= low, _c(most)).when(energy >= high, F.lit(least)).otherwise(_c(most) + share * (least - _c(most)))


def cfl_quantize(alpha: Column) -> Column:
    """Prediction factor in [-2, 2] as a 15-bit number."""
    a = clamp(alpha, -2.0, 2.0) * 8192
    return (F.signum(a) * F.floor(F.abs(a) + 0.5)).cast("long")


def cfl_dequantize(q: Column) -> Column:
    return q.cast("double") / 8192


def cfl_quantize_u8(alpha: Column) -> Column:
    """The older form of a byte: [-2, 2] onto 0 to 255."""
    return F.floor((clamp(alpha, -2.0, 2.0) + 2.0) / 4.0 * 255.0 + 0.5).cast("long")


def cfl_dequantize_u8(q: Column) -> Column:
    return q.cast("double") / 255.0 * 4.0 - 2.0


def clamp(v: Column, low: Number, high: Number) -> Column:
    return F.least(F.greatest(v, _c(low)), _c(high))


def psnr(mse: Column, peak: Number = 255.0) -> Column:
    """Infinity below 1e-10."""
    return F.when(mse < 1e-10, F.lit(float("inf"))).otherwise(10.0 * F.log10(_c(peak) * _c(peak) / mse))


def step_for_rate(target_bpp: Column, c: Number, alpha: Number, low: float = 0.5, high: float = 128.0) -> Column:
    """The step at which bpp = c * step^-alpha gives the target; 4 where the model says nothing."""
    c, alpha = _c(c), _c(alpha)
    raw = F.when((target_bpp > 0) & (c > 0) & (alpha > 0), F.pow(c / target_bpp, 1.0 / alpha)).otherwise(F.lit(4.0))
    return clamp(raw, low, high)


def vbv_adjustment(fill_ratio: Column, mode: Column) -> Column:
    """Factor on the step by buffer fill: cbr beyond 0.2 and 0.8 by up to one half, vbr beyond 0.1 and 0.9 by up to 0.3."""
    out = F.lit(1.0)
    for name, edge, force in (("cbr", 0.2, 0.5), ("vbr", 0.1, 0.3)):
        over, under = (fill_ratio - (1 - edge)) / edge, (edge - fill_ratio) / edge
        f = F.when(fill_ratio > 1 - edge, 1.0 / (1.0 + over * force)).when(fill_ratio < edge, 1.0 + under * force).otherwise(1.0)
        out = F.when(mode == name, f).otherwise(out)
    return out


def all_zero(most: Column, step: Number, dead_zone: Number) -> Column:
    """Whether nothing of a band of this largest magnitude leaves the dead zone, so that it needs no code."""
    return most < _c(dead_zone) * _c(step)
