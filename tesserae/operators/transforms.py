"""Block transforms on arrays: cosine, Walsh-Hadamard, Haar; as Spark expressions and, for whole tiles, as numpy kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.quant import dequantize, let, quantize
from . import lifting


def dct_matrix(n: int) -> list[list[float]]:
    """Orthonormal cosine basis: row k holds frequency k."""
    return [[(math.sqrt(1 / n) if k == 0 else math.sqrt(2 / n)) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def hadamard_matrix() -> list[list[float]]:
    """Order four, scaled by one half: its own inverse."""
    return [[0.5 * (-1) ** bin(i & j).count("1") for j in range(4)] for i in range(4)]


def separable(a: Column, basis: list[list[float]], n: int) -> Column:
    """basis * block * basis' of an array of n*n samples, as two passes of dot products with literal rows."""
    bank = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in basis))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def one_pass(block: Column) -> Column:
        """Transforms rows and transposes, so that two passes do both directions."""
        lines = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.slice(block, r * n + 1, F.lit(n)))
        return let(lines, lambda held: F.flatten(F.transform(bank, lambda b: F.transform(held, lambda line: dot(line, b)))))

    return let(a, lambda block: let(one_pass(block), one_pass))


def dct(a: Column, n: int = 8) -> Column:
    return separable(a, dct_matrix(n), n)


def idct(a: Column, n: int = 8) -> Column:
    return separable(a, [list(c) for c in zip(*dct_matrix(n), strict=True)], n)


def dct_quantized(a: Column, step: float, dead_zone: float, n: int = 8) -> Column:
    """Struct of a block's indices and its reconstruction (back) from them, in one projection."""
    both = lambda q: F.struct(q.alias("indices"), idct(F.transform(q, lambda x: dequantize(x, step)), n).alias("back"))
    return let(dct(a, n), lambda c: let(F.transform(c, lambda x: quantize(x, step, dead_zone)), both))


def hadamard4(a: Column) -> Column:
    return separable(a, hadamard_matrix(), 4)


def haar_matrix(n: int, levels: int = 1) -> np.ndarray:
    """Orthonormal Haar steps over n samples, low half first, repeated on the low half."""
    m = np.eye(n)
    for level in range(levels):
        size, step = n >> level, np.eye(n)
        step[:size, :size] = 0
        for i in range(size // 2):
            step[i, 2 * i] = step[i, 2 * i + 1] = step[size // 2 + i, 2 * i] = math.sqrt(0.5)
            step[size // 2 + i, 2 * i + 1] = -math.sqrt(0.5)
        m = step @ m
    return m


def block_transform(name: str, a: Column, inverse: bool = False) -> Column:
    """dct8, dct16, hadamard4, haar16 or haar16x2 by name. Two Haar levels transform both directions level by level."""
    sizes = {"dct8": 8, "dct16": 16, "hadamard4": 4, "haar16": 16, "haar16x2": 16}
    n = sizes[name]
    if name.startswith("dct"):
        return idct(a, n) if inverse else dct(a, n)
    if name == "hadamard4":
        return hadamard4(a)
    one = haar_matrix(16)
    two = haar_matrix(8)
    inner = np.eye(16)
    inner[:8, :8] = two
    steps = [one] if name == "haar16" else [one, _corner(inner)]
    if inverse:
        steps = [s.T for s in reversed(steps)]
    if name == "haar16":
        return separable(a, steps[0].tolist(), 16)

    def step(m: np.ndarray) -> Callable[[Column], Column]:
        return lambda v: _low_quarter(v, m) if m.shape == (8, 8) else separable(v, m.tolist(), 16)

    return let(step(steps[0])(a), step(steps[1]))


def _corner(m: np.ndarray) -> np.ndarray:
    return m[:8, :8]


def _low_quarter(a: Column, basis: np.ndarray) -> Column:
    """Transforms the 8x8 low corner of a 16x16 array and leaves the rest."""
    low = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(a, r * 16 + 1, F.lit(8))))
    place = lambda i: F.floor(i / 16).cast("int") * 8 + i % 16
    merged = lambda done: F.transform(a, lambda v, i: F.when((i % 16 < 8) & (i < 128), F.get(done, place(i))).otherwise(v))
    return let(separable(low, basis.tolist(), 8), merged)


# ---- whole tiles


def _lift53(x: np.ndarray) -> np.ndarray:
    even, odd = x[..., 0::2], x[..., 1::2]
    right = np.concatenate([even[..., 1:], even[..., -1:]], axis=-1)
    high = odd - np.floor((even + right) / 2)
    left = np.concatenate([high[..., :1], high[..., :-1]], axis=-1)
    return np.concatenate([even + np.floor((left + high + 2) / 4), high], axis=-1)


def _unlift53(x: np.ndarray) -> np.ndarray:
    half = x.shape[-1] // 2
    low, high = x[..., :half], x[..., half:]
    left = np.concatenate([high[..., :1], high[..., :-1]], axis=-1)
    even = low - np.floor((left + high + 2) / 4)
    right = np.concatenate([even[..., 1:], even[..., -1:]], axis=-1)
    return np.stack([even, high + np.floor((even + right) / 2)], axis=-1).reshape(x.shape)


def _lift97(x: np.ndarray) -> np.ndarray:
    low, high = x[..., 0::2].copy(), x[..., 1::2].copy()
    for up, down in ((lifting.ALPHA, lifting.BETA), (lifting.GAMMA, lifting.DELTA)):
        high += up * (low + np.concatenate([low[..., 1:], low[..., -1:]], axis=-1))
        low += down * (np.concatenate([high[..., :1], high[..., :-1]], axis=-1) + high)
    return np.concatenate([low * lifting.SCALE, high / lifting.SCALE], axis=-1)


def _unlift97(x: np.ndarray) -> np.ndarray:
    half = x.shape[-1] // 2
    low, high = x[..., :half] / lifting.SCALE, x[..., half:] * lifting.SCALE
    for up, down in ((lifting.GAMMA, lifting.DELTA), (lifting.ALPHA, lifting.BETA)):
        low = low - down * (np.concatenate([high[..., :1], high[..., :-1]], axis=-1) + high)
        high = high - up * (low + np.concatenate([low[..., 1:], low[..., -1:]], axis=-1))
    return np.stack([low, high], axis=-1).reshape(x.shape)


_LINES = {"5/3": (_lift53, _unlift53), "9/7": (_lift97, _unlift97)}


def wavelet(tiles: np.ndarray, levels: int, kind: str = "9/7") -> np.ndarray:
    """Wavelet of square tiles (..., n, n): rows, then columns, then again on the low corner."""
    out, n, step = tiles.astype(np.float64).copy(), tiles.shape[-1], _LINES[kind][0]
    for _ in range(levels):
        low = step(out[..., :n, :n])
        out[..., :n, :n] = step(low.swapaxes(-1, -2)).swapaxes(-1, -2)
        n //= 2
    return out


def unwavelet(tiles: np.ndarray, levels: int, kind: str = "9/7") -> np.ndarray:
    out, step = tiles.astype(np.float64).copy(), _LINES[kind][1]
    for level in range(levels - 1, -1, -1):
        n = tiles.shape[-1] >> level
        low = step(out[..., :n, :n].swapaxes(-1, -2)).swapaxes(-1, -2)
        out[..., :n, :n] = step(low)
    return out
