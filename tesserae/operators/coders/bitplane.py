"""Bit planes of blocks of 32 by 32: number of planes, then each plane from the highest (one bit if it is empty, else a bit for
each index), then the signs of the nonzero ones.

Layout (fixed values): count, size, blocks as 32-bit; offsets of the blocks; length of the data; data.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 32


def _block(q: np.ndarray) -> bytes:
    m = np.abs(q)
    planes = int(m.max(initial=0)).bit_length()
    if not planes:
        return b"\0"
    bits = []
    for p in range(planes - 1, -1, -1):
        plane = (m >> p) & 1
        bits += [np.zeros(1, np.int64), plane] if plane.any() else [np.ones(1, np.int64)]
    bits.append((q[m > 0] < 0).astype(np.int64))
    return bytes([planes]) + np.packbits(np.concatenate(bits).astype(np.uint8)).tobytes()


def encode(indices: np.ndarray, size: int, levels: int = 0) -> bytes:
    side = size // BLOCK
    blocks = np.asarray(indices, np.int64).reshape(side, BLOCK, side, BLOCK).swapaxes(1, 2).reshape(side * side, -1)
    parts = [_block(b) for b in blocks]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]) if parts else []
    data = b"".join(parts)
    return struct.pack("<III", size * size, size, len(parts)) + np.array(offsets, "<u4").tobytes() + struct.pack("<I", len(data)) + data


def decode(data: bytes) -> np.ndarray:
    _, size, n = struct.unpack_from("<III", data)
    offsets = np.frombuffer(data, "<u4", n, 12).tolist()
    at = 16 + 4 * n
    body, side = data[at : at + struct.unpack_from("<I", data, at - 4)[0]], size // BLOCK
    out = np.zeros((n, BLOCK * BLOCK), np.int64)
    for i, (a, z) in enumerate(zip(offsets, [*offsets[1:], len(body)], strict=True)):
        if z <= a:
            continue  # an empty block stands for zeros
        bits, p = np.unpackbits(np.frombuffer(body[a + 1 : z], np.uint8)), 0
        for plane in range(body[a] - 1, -1, -1):
            if bits[p]:
                p += 1
                continue
            out[i] |= bits[p + 1 : p + 1 + BLOCK * BLOCK].astype(np.int64) << plane
            p += 1 + BLOCK * BLOCK
        used = np.nonzero(out[i])[0]
        out[i, used[bits[p : p + len(used)] == 1]] *= -1
    return out.reshape(side, side, BLOCK, BLOCK).swapaxes(1, 2).ravel()
