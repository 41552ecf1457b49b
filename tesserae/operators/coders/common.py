"""Bands of a tile, and bit strings."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=32)
def band_map(size: int, levels: int) -> np.ndarray:
    """Band group of every place of a tile: 0 low, 1 deepest detail, then edges and corner of each finer level."""
    out = np.zeros((size, size), np.int64)
    for level in range(levels - 1, -1, -1):
        region, half, depth = size >> level, (size >> level) // 2, levels - 1 - level
        edge = out[:region, :region]
        place = np.indices((region, region)) >= half
        edge[place.any(axis=0)] = max(1, 2 * depth)
        edge[place.all(axis=0)] = 1 if depth == 0 else 2 * depth + 1
    return out.ravel()


def rice_parameter(values: np.ndarray) -> int:
    """floor(log2(floor(mean))), 0 for none, 15 at most."""
    mean = int(values.sum()) // len(values) if len(values) else 0
    return min(15, mean.bit_length() - 1) if mean else 0


def joined(parts: list[str]) -> bytes:
    """Strings of binary digits as bytes, the last filled up with zeros."""
    bits = "".join(parts)
    if not bits:
        return b""
    n = -(-len(bits) // 8)
    return int(bits.ljust(8 * n, "0"), 2).to_bytes(n, "big")


def spread(data: bytes) -> str:
    """The binary digits of bytes."""
    return bin(int.from_bytes(b"\1" + data, "big"))[3:]


def rice_code(value: int, k: int) -> str:
    return "1" * (value >> k) + "0" + (format(value & ((1 << k) - 1), f"0{k}b") if k else "")


def read_rice(bits: str, at: int, k: int) -> tuple[int, int]:
    """Value and the place behind it."""
    stop = bits.index("0", at)
    q, at = stop - at, stop + 1
    return (q << k) | (int(bits[at : at + k], 2) if k else 0), at + k


def varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
