"""Range coding with asymmetric numeral systems: 12-bit frequencies, byte renormalisation, 32 interleaved streams.

Three forms: one table for the whole tile; one with zero runs as symbols, where that is smaller; one table for each band, where
sparse detail bands have zero runs. Symbols are coded backwards, so that decoding runs forwards.

Layout (fixed values): little-endian 32-bit fields, 16-bit frequencies; streams' lengths, then states, then tables, then bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from .common import band_map

PRECISION, LOW, STREAMS, MOST_RUN = 12, 1 << 23, 32, 256
TOTAL = 1 << PRECISION


def normalize(counts: np.ndarray, total: int = TOTAL) -> np.ndarray:
    """Frequencies that sum to total, at least one for each symbol that occurs; differences go to the most frequent first."""
    counts = np.asarray(counts, np.int64)
    used = np.nonzero(counts)[0]
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        freq[:1] = total
        return freq
    freq[used] = np.maximum(1, counts[used] * total // counts.sum())
    gap, share = total - int(freq.sum()), max(1, total // len(used))
    for s in used[np.argsort(-counts[used], kind="stable")]:
        if gap > 0:
            change = min(gap, share)
        else:
            change = -min(-gap, int(freq[s]) - 1)
        freq[s] += change
        gap -= change
        if not gap:
            break
    if gap > 0:
        freq[used[np.argsort(-counts[used], kind="stable")][0]] += gap
    return freq


class Table:
    """Frequencies of the symbols from least on."""

    def __init__(self, least: int, freq: np.ndarray, run_base: int = 0):
        self.least, self.run_base = least, run_base
        self.freq = [int(x) for x in freq]
        self.cum = [0, *np.cumsum(freq).tolist()]
        self.of_slot = np.repeat(np.arange(len(freq)), freq).tolist() if sum(self.freq) == TOTAL else []

    @classmethod
    def of(cls, symbols: list[int], run_base: int = 0) -> Table:
        if not symbols:
            return cls(0, np.array([TOTAL]))
        least = min(symbols)
        return cls(least, normalize(np.bincount(np.array(symbols) - least)), run_base)


def put(symbols: list[int], tables: list[Table] | Table) -> tuple[int, bytes]:
    """State and bytes of one stream; tables: one, or one for each symbol."""
    state, out = LOW, bytearray()
    of = tables if isinstance(tables, list) else [tables] * len(symbols)
    for v, t in zip(reversed(symbols), reversed(of), strict=True):
        s = v - t.least
        f = t.freq[s]
        top = ((LOW >> PRECISION) << 8) * f
        while state >= top:
            out.append(state & 0xFF)
            state >>= 8
        state = ((state // f) << PRECISION) + state % f + t.cum[s]
    return state, bytes(reversed(out))


def get(state: int, data: bytes, count: int, table_at: Callable[[int], Table], step: Callable[[int, Table], int]) -> list[int]:
    """Symbols of one stream until step(symbol, table) has advanced the place by count."""
    out, at, place = [], 0, 0
    while place < count:
        t = table_at(place)
        slot = state & (TOTAL - 1)
        s = t.of_slot[slot]
        state = t.freq[s] * (state >> PRECISION) + slot - t.cum[s]
        while state < LOW and at < len(data):
            state = (state << 8) | data[at]
            at += 1
        v = s + t.least
        out.append(v)
        place += step(v, t)
    return out


def with_runs(values: list[int], base: int) -> list[int]:
    """Zeros become base and their number less one, in runs of at most MOST_RUN."""
    out, run = [], 0
    for v in [*values, None]:
        if v == 0 and run < MOST_RUN:
            run += 1
            continue
        if run:
            out.append(base + run - 1)
            run = 0
        if v == 0:
            run = 1
        elif v is not None:
            out.append(v)
    return out


def without_runs(symbols: list[int], base: int) -> list[int]:
    return [x for s in symbols for x in ([0] * (s - base + 1) if s >= base else [s])]


def encode_single(indices: np.ndarray) -> bytes:
    """One stream with one table."""
    q = [int(x) for x in indices]
    if not q:
        return struct.pack("<iIII", 0, 0, 0, 0)
    t = Table.of(q)
    state, data = put(q, t)
    data = struct.pack("<I", state) + data
    return struct.pack("<iIII", t.least, len(t.freq), len(q), len(data)) + struct.pack(f"<{len(t.freq)}H", *t.freq) + data


def decode_single(data: bytes) -> np.ndarray:
    least, n, count, size = struct.unpack_from("<iIII", data)
    if not count:
        return np.zeros(0, np.int64)
    t = Table(least, np.array(struct.unpack_from(f"<{n}H", data, 16)))
    own = data[16 + 2 * n : 16 + 2 * n + size]
    return np.array(get(struct.unpack_from("<I", own)[0], own[4:], count, lambda _: t, lambda v, t: 1), np.int64)


def _shared(q: np.ndarray, runs: bool) -> bytes:
    base = int(np.abs(q).max(initial=0)) + 1 if runs else 0
    streams = [q[s::STREAMS].tolist() for s in range(STREAMS)]
    if runs:
        streams = [with_runs(x, base) for x in streams]
    t = Table.of([v for x in streams for v in x])
    coded = [put(x, t) if x else (LOW, b"") for x in streams]
    head = struct.pack("<iIIi", t.least, len(t.freq), len(q), base) + struct.pack(f"<{STREAMS}I", *(len(d) for _, d in coded)) + struct.pack(f"<{STREAMS}I", *(s for s, _ in coded))
    return head + struct.pack(f"<{len(t.freq)}H", *t.freq) + b"".join(d for _, d in coded)


def encode_shared(indices: np.ndarray, size: int = 0, levels: int = 0) -> bytes:
    """The smaller of plain symbols and zero runs; runs are tried where three fifths are zero."""
    q = np.asarray(indices, np.int64)
    plain = _shared(q, False)
    if len(q) and (q == 0).mean() >= 0.6:
        return min(plain, _shared(q, True), key=len)
    return plain


def decode_shared(data: bytes) -> np.ndarray:
    least, n, count, base = struct.unpack_from("<iIIi", data)
    lens, states = struct.unpack_from(f"<{STREAMS}I", data, 16), struct.unpack_from(f"<{STREAMS}I", data, 16 + 4 * STREAMS)
    at = 16 + 8 * STREAMS
    t = Table(least, np.array(struct.unpack_from(f"<{n}H", data, at)), base)
    at += 2 * n
    out = np.zeros(count, np.int64)
    for s in range(min(STREAMS, count)):
        own = out[s::STREAMS]
        width = (lambda v, t: v - base + 1 if v >= base else 1) if base else (lambda v, t: 1)
        got = get(states[s], data[at : at + lens[s]], len(own), lambda _: t, width)
        own[:] = without_runs(got, base) if base else got
        at += lens[s]
    return out


def _band_bases(q: np.ndarray, bands: np.ndarray, groups: int) -> list[int]:
    """Where zero runs begin in a band's alphabet: in detail bands that are sparse and have sixteen symbols at least; 0 for no runs."""
    out = [0] * groups
    for g in range(1, groups):
        own = q[bands == g]
        most = int(np.abs(own).max(initial=0))
        if len(own) and (own == 0).mean() >= 0.6 and 2 * most + 1 >= 16:
            out[g] = most + 1
    return out


def _contexts(q: np.ndarray, size: int, levels: int) -> np.ndarray:
    """Table of every place: the bands of finer levels have one for a zero and one for a nonzero index above."""
    bands = band_map(size, levels)[: len(q)]
    plane = q.reshape(-1, size)
    above = np.zeros_like(plane)
    above[1:] = plane[:-1] != 0
    first = np.zeros(len(plane), bool)
    first[[0] + [size >> (level + 1) for level in range(levels) if size >> (level + 1) < len(plane)]] = True
    above[first] = 0  # no index above belongs to the same band there
    return np.where(bands <= 1, bands, 2 + 2 * (bands - 2) + above.ravel())


def _encode_tables(q: np.ndarray, size: int, levels: int, bands: np.ndarray, of: np.ndarray, groups: int, runs: bool) -> bytes:
    bases = _band_bases(q, bands, groups) if runs else [0] * groups
    streams: list[tuple[list[int], list[int]]] = []
    for s in range(STREAMS):
        values, where = q[s::STREAMS].tolist(), of[s::STREAMS].tolist()
        symbols, tables, i = [], [], 0
        while i < len(values):
            g, j = where[i], i + 1
            if bases[g] and values[i] == 0:
                while j < len(values) and values[j] == 0 and where[j] == g and j - i < MOST_RUN:
                    j += 1
                symbols.append(bases[g] + j - i - 1)
            else:
                symbols.append(values[i])
            tables.append(g)
            i = j
        streams.append((symbols, tables))
    by: list[list[int]] = [[] for _ in range(groups)]
    for symbols, tables in streams:
        for v, g in zip(symbols, tables, strict=True):
            by[g].append(v)
    made = [Table.of(x, b) for x, b in zip(by, bases, strict=True)]
    coded = [put(v, [made[g] for g in t]) if v else (LOW, b"") for v, t in streams]
    out = struct.pack("<IIII", len(q), size, levels, groups)
    for t in made:
        out += struct.pack("<iIi", t.least, len(t.freq), t.run_base) + struct.pack(f"<{len(t.freq)}H", *t.freq)
    return out + struct.pack(f"<{STREAMS}I", *(len(d) for _, d in coded)) + struct.pack(f"<{STREAMS}I", *(s for s, _ in coded)) + b"".join(d for _, d in coded)


def _read_tables(data: bytes) -> tuple[int, int, int, list[Table], int]:
    count, size, levels, groups = struct.unpack_from("<IIII", data)
    at, made = 16, []
    for _ in range(groups):
        least, n, base = struct.unpack_from("<iIi", data, at)
        made.append(Table(least, np.array(struct.unpack_from(f"<{n}H", data, at + 12)), base))
        at += 12 + 2 * n
    return count, size, levels, made, at


def encode_bands(indices: np.ndarray, size: int, levels: int) -> bytes:
    """One table for each band of the tile."""
    q = np.asarray(indices, np.int64)
    bands = band_map(size, levels)[: len(q)]
    return _encode_tables(q, size, levels, bands, bands, max(1, 2 * levels), True)


def decode_bands(data: bytes) -> np.ndarray:
    count, size, levels, made, at = _read_tables(data)
    lens, states = struct.unpack_from(f"<{STREAMS}I", data, at), struct.unpack_from(f"<{STREAMS}I", data, at + 4 * STREAMS)
    at += 8 * STREAMS
    out, bands = np.zeros(count, np.int64), band_map(size, levels)[:count]
    for s in range(min(STREAMS, count)):
        own, where = out[s::STREAMS], bands[s::STREAMS].tolist()
        place = 0

        def width(v: int, t: Table) -> int:
            return v - t.run_base + 1 if t.run_base and v >= t.run_base else 1

        got = get(states[s], data[at : at + lens[s]], len(own), lambda p, w=where: made[w[p]], width)
        for v in got:
            t = made[where[place]]
            n = width(v, t)
            if not (t.run_base and v >= t.run_base):
                own[place] = v
            place += n
        at += lens[s]
    return out


def encode_context(indices: np.ndarray, size: int, levels: int) -> bytes:
    """One table for each band and, in finer bands, for each state of the index above."""
    q = np.asarray(indices, np.int64)
    bands = band_map(size, levels)[: len(q)]
    groups = 2 + 2 * max(0, 2 * levels - 2)
    return _encode_tables(q, size, levels, bands, _contexts(q, size, levels), groups, False)


def decode_context(data: bytes) -> np.ndarray:
    """Streams go in step, as the table of an index depends on the one above it, in the row decoded before."""
    count, size, levels, made, at = _read_tables(data)
    lens, states = list(struct.unpack_from(f"<{STREAMS}I", data, at)), list(struct.unpack_from(f"<{STREAMS}I", data, at + 4 * STREAMS))
    at += 8 * STREAMS
    begins = [at + sum(lens[:s]) for s in range(STREAMS)]
    ends = [b + n for b, n in zip(begins, lens, strict=True)]
    out, bands = [0] * count, band_map(size, levels)[:count].tolist()
    first = {0} | {size >> (level + 1) for level in range(levels)}
    for i in range(count):
        s, g, y = i % STREAMS, bands[i], i // size
        if g > 1:
            g = 2 + 2 * (g - 2) + (1 if y not in first and out[i - size] else 0)
        t, state = made[g], states[s]
        slot = state & (TOTAL - 1)
        k = t.of_slot[slot]
        state = t.freq[k] * (state >> PRECISION) + slot - t.cum[k]
        while state < LOW and begins[s] < ends[s]:
            state = (state << 8) | data[begins[s]]
            begins[s] += 1
        states[s] = state
        out[i] = k + t.least
    return np.array(out, np.int64)
