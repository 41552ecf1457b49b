"""Adaptive Golomb-Rice tiles of 256 interleaved streams.

A stream takes every 256th index. Its tokens are 0 and a zero run, or 1, sign and magnitude less one. The magnitude's parameter
follows a running mean for each band; a run's depends on whether the magnitude before it was large. Odd streams start
their means from those that their even neighbours ended with, so evens go first. Bands without a nonzero index are left out.

Layout (fixed values): count, size, levels, groups as 32-bit; a flag byte (1 varint lengths, 2 all left out, 4 start parameters);
parameters of magnitudes, of runs after large and other magnitudes, bitmap of left-out bands; 1024 start parameters; lengths; streams.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import band_map, joined, read_rice, read_varint, rice_code, rice_parameter, spread, varint

STREAMS = 256
_COMPACT, _ALL_OUT, _STARTS = 1, 2, 4


def _log2(mean: int) -> int:
    return min(15, mean.bit_length() - 1) if mean > 0 else 0


def _runs(q: np.ndarray, bands: np.ndarray, groups: int) -> tuple[list[int], list[int]]:
    """Rice parameters of zero runs by the band where they begin: after large magnitudes, and after others."""
    large: list[list[int]] = [[] for _ in range(groups)]
    other: list[list[int]] = [[] for _ in range(groups)]
    for s in range(STREAMS):
        own, at = q[s::STREAMS], bands[s::STREAMS]
        places = np.nonzero(own)[0]
        ends = np.concatenate([places, [len(own)]])
        begins = np.concatenate([[0], places + 1])
        big = np.concatenate([[False], np.abs(own[places]) >= 2])
        for a, z, b in zip(begins, ends, big, strict=True):
            if z > a:
                (large if b else other)[at[a]].append(int(z - a) - 1)
    return tuple([rice_parameter(np.array(v, np.int64)) for v in x] for x in (large, other))


def _stream(q: list[int], bands: list[int], starts: list[int], k_large: list[int], k_other: list[int]) -> tuple[bytes, list[int]]:
    """Bytes of one stream of kept indices, and the means it ends with."""
    means, out, large, i, n = [(1 << k) << 4 for k in starts], [], False, 0, len(q)
    while i < n:
        g, v = bands[i], q[i]
        if v == 0:
            j = i + 1
            while j < n and q[j] == 0:
                j += 1
            out.append("0" + rice_code(j - i - 1, k_large[g] if large else k_other[g]))
            i, large = j, False
        else:
            m = abs(v) - 1
            out.append(("11" if v < 0 else "10") + rice_code(m, _log2(means[g] >> 4)))
            means[g] += (m << 1) - (means[g] >> 3)
            i, large = i + 1, m >= 1
    return joined(out), means


def encode(indices: np.ndarray, size: int, levels: int) -> bytes:
    q = np.asarray(indices, np.int64)
    groups = max(1, 2 * levels)
    q = q[: len(q) // STREAMS * STREAMS]
    bands = band_map(size, levels)[: len(q)]
    k = [rice_parameter(np.abs(q[(bands == g) & (q != 0)]) - 1) for g in range(groups)]
    k_large, k_other = _runs(q, bands, groups)
    out_of = [not q[bands == g].any() for g in range(groups)]
    bitmap = sum(1 << g for g in range(groups) if out_of[g])
    head = struct.pack("<IIII", len(indices), size, levels, groups)
    if all(out_of):
        return head + bytes([_ALL_OUT | _COMPACT, bitmap])
    kept = ~np.array(out_of)[bands]
    streams, starts = [b""] * STREAMS, bytearray(8 * STREAMS // 2)
    for s in (*range(0, STREAMS, 2), *range(1, STREAMS, 2)):
        use = kept[s::STREAMS]
        begin = k if s % 2 == 0 else list(starts[8 * (s // 2) : 8 * (s // 2) + groups])
        streams[s], means = _stream(q[s::STREAMS][use].tolist(), bands[s::STREAMS][use].tolist(), begin, k_large, k_other)
        if s % 2 == 0:
            for g in range(groups):
                starts[4 * s + g] = min(15, -(-(k[g] + _log2(means[g] >> 4)) // 2))
    body = bytes([_COMPACT | _STARTS, *k, *k_large, *k_other, bitmap]) + bytes(starts)
    return head + body + b"".join(varint(len(x)) for x in streams) + b"".join(streams)


def decode(data: bytes) -> np.ndarray:
    count, size, levels, groups = struct.unpack_from("<IIII", data)
    flags, at = data[16], 17
    out = np.zeros(count, np.int64)
    if flags & _ALL_OUT:
        return out
    k, k_large, k_other = (list(data[at + i * groups : at + (i + 1) * groups]) for i in range(3))
    at += 3 * groups
    bitmap, at = data[at], at + 1
    starts = b""
    if flags & _STARTS:
        starts, at = data[at : at + 1024], at + 1024
    lens = []
    for _ in range(STREAMS):
        n, at = read_varint(data, at)
        lens.append(n)
    bands = band_map(size, levels)[: count // STREAMS * STREAMS]
    kept = ((bitmap >> bands) & 1) == 0
    for s, n in enumerate(lens):
        places = np.nonzero(kept[s::STREAMS])[0]
        own = bands[s::STREAMS][places].tolist()
        begin = k if s % 2 == 0 or not starts else starts[8 * (s // 2) : 8 * (s // 2) + groups]
        means, bits, p, i, large = [(1 << x) << 4 for x in begin], spread(data[at : at + n]), 0, 0, False
        at += n
        while i < len(own):
            g = own[i]
            if bits[p] == "0":
                run, p = read_rice(bits, p + 1, k_large[g] if large else k_other[g])
                i, large = i + run + 1, False
            else:
                m, end = read_rice(bits, p + 2, _log2(means[g] >> 4))
                out[s + STREAMS * places[i]] = -(m + 1) if bits[p + 1] == "1" else m + 1
                means[g] += (m << 1) - (means[g] >> 3)
                p, i, large = end, i + 1, m >= 1
    return out
