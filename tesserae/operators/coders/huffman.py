"""Canonical Huffman tiles of 256 interleaved streams: a code for each band's magnitudes, Rice codes for zero runs.

64 symbols a band; the last escapes to an exponential Golomb code. Codes have at most eight bits.

Layout (fixed values): count, size, levels, groups as 32-bit; for each band the number of code lengths up to the last used one and
these; run parameters; 256 lengths as 16-bit; streams.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from .common import band_map, joined, read_rice, rice_code, rice_parameter, spread

STREAMS, SYMBOLS, LONGEST = 256, 64, 8
ESCAPE = SYMBOLS - 1


def code_lengths(freq: list[int]) -> list[int]:
    """Length of each symbol's code, 0 for those that don't occur; lengths over LONGEST are shared out among shorter ones."""
    heap = [(f, s) for s, f in enumerate(freq) if f > 0]
    if len(heap) <= 1:
        return [int(f > 0) for f in freq]
    heapq.heapify(heap)
    parent: dict[int, int] = {}
    node = len(freq)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (a + b, node))
        node += 1
    out = []
    for s, f in enumerate(freq):
        depth, x = 0, s
        while f > 0 and x in parent:
            x, depth = parent[x], depth + 1
        out.append(depth)
    return _limited(out)


def _limited(lengths: list[int]) -> list[int]:
    excess = sum(n - LONGEST for n in lengths if n > LONGEST)
    if not excess:
        return lengths
    counts = [0] * (LONGEST + 1)
    for n in lengths:
        if n:
            counts[min(n, LONGEST)] += 1
    # a code of j bits becomes two of j + 1 until the codes fit
    while sum(c << (LONGEST - n) for n, c in enumerate(counts) if n) > 1 << LONGEST:
        j = max(n for n in range(1, LONGEST) if counts[n])
        counts[j] -= 1
        counts[j + 1] += 2
        counts[LONGEST] -= 1
    order = sorted((n, s) for s, n in enumerate(lengths) if n)
    sizes = [n for n, c in enumerate(counts) for _ in range(c)]
    out = [0] * len(lengths)
    for (_, s), n in zip(order, sizes, strict=True):
        out[s] = n
    return out


def codes(lengths: list[int]) -> list[str]:
    """Canonical codes as binary digits: in order of length, then symbol."""
    out, code, before = [""] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code = (code + 1 if before else 0) << (n - before) if before else 0
        out[s], before = format(code, f"0{n}b"), n
    return out


def exp_golomb(value: int) -> str:
    bits = format(value + 1, "b")
    return "0" * (len(bits) - 1) + bits


def encode(indices: np.ndarray, size: int, levels: int) -> bytes:
    q = np.asarray(indices, np.int64)
    groups = max(1, 2 * levels)
    own = q[: len(q) // STREAMS * STREAMS]
    bands = band_map(size, levels)[: len(own)]
    lengths, words = [], []
    for g in range(groups):
        m = np.minimum(np.abs(own[(bands == g) & (own != 0)]) - 1, ESCAPE)
        lengths.append(code_lengths(np.bincount(m, minlength=SYMBOLS).tolist()))
        words.append(codes(lengths[-1]))
    runs: list[list[int]] = [[] for _ in range(groups)]
    for s in range(STREAMS):
        at = np.nonzero(own[s::STREAMS])[0]
        where = bands[s::STREAMS]
        for a, z in zip(np.concatenate([[0], at + 1]), np.concatenate([at, [len(where)]]), strict=True):
            if z > a:
                runs[where[a]].append(int(z - a) - 1)
    k = [rice_parameter(np.array(r, np.int64)) for r in runs]
    streams = []
    for s in range(STREAMS):
        values, where, out, i = own[s::STREAMS].tolist(), bands[s::STREAMS].tolist(), [], 0
        while i < len(values):
            g, v = where[i], values[i]
            if v == 0:
                j = i + 1
                while j < len(values) and values[j] == 0 and j - i < 32 << k[g]:
                    j += 1
                out.append("0" + rice_code(j - i - 1, k[g]))
                i = j
                continue
            m = abs(v) - 1
            out.append(("11" if v < 0 else "10") + words[g][min(m, ESCAPE)] + (exp_golomb(m - ESCAPE) if m >= ESCAPE else ""))
            i += 1
        streams.append(joined(out))
    head = struct.pack("<IIII", len(q), size, levels, groups)
    for x in lengths:
        used = max((i + 1 for i, n in enumerate(x) if n), default=0)
        head += bytes([used, *x[:used]])
    return head + bytes(k) + struct.pack(f"<{STREAMS}H", *map(len, streams)) + b"".join(streams)


def decode(data: bytes) -> np.ndarray:
    count, size, levels, groups = struct.unpack_from("<IIII", data)
    at, books = 16, []
    for _ in range(groups):
        used = data[at]
        books.append({w: s for s, w in enumerate(codes(list(data[at + 1 : at + 1 + used]))) if w})
        at += 1 + used
    k, at = data[at : at + groups], at + groups
    lens = struct.unpack_from(f"<{STREAMS}H", data, at)
    at += 2 * STREAMS
    out = np.zeros(count, np.int64)
    bands = band_map(size, levels)[: count // STREAMS * STREAMS]
    for s, n in enumerate(lens):
        where, bits, p, i = bands[s::STREAMS].tolist(), spread(data[at : at + n]), 0, 0
        at += n
        while i < len(where):
            g = where[i]
            if bits[p] == "0":
                run, p = read_rice(bits, p + 1, k[g])
                i += run + 1
                continue
            negative, p, end = bits[p + 1] == "1", p + 2, p + 3
            while bits[p:end] not in books[g]:
                end += 1
            m = books[g][bits[p:end]]
            p = end
            if m == ESCAPE:
                zeros = bits.index("1", p) - p
                m += int(bits[p + zeros : p + 2 * zeros + 1], 2) - 1
                p += 2 * zeros + 1
            out[s + STREAMS * i] = -(m + 1) if negative else m + 1
            i += 1
    return out
