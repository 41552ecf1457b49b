"""Frame and sequence containers: bytes, index tables and seeks.

A frame is a header, optional side information, a tile index (size and CRC-32 each) and tiles. A sequence file is a header, an index
and frames; the temporal form's index names role, level and group. Indexes are small DataFrames, so a seek is a filter on
them and one range of bytes. All numbers are little-endian; magics, sizes and codes are the formats' fixed values.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import ceil_div
from .coders import CODERS
from .coders.common import read_varint, varint
from .ordered import offsets

FRAME, SEQUENCE, TEMPORAL = b"GP15", b"GNV1", b"GNV2"
#: Older frames that are read, oldest first: what each has beyond the one before is told in read_frame.
OLDER = (b"GPC8", b"GPC9", b"GP10", b"GP11", b"GP12", b"GP13", b"GP14", FRAME)
SEQUENCE_HEADER, SEQUENCE_ENTRY, TEMPORAL_HEADER, TEMPORAL_ENTRY = 28, 21, 34, 22
KINDS = ("I", "P", "B")
CHROMA = ("444", "422", "420")
TRANSFORMS = ("none", "haar", "5/3")
INDEX_SCHEMA = "frame long, offset long, size long, kind string, pts long"
TEMPORAL_SCHEMA = "entry long, offset long, size long, role string, level long, gop long, pos long, pts long"
ROLES = ("low", "high", "tail")
_WAVELETS = ("5/3", "9/7")


@dataclass
class Frame:
    width: int
    height: int
    bit_depth: int = 8
    tile: int = 256
    step: float = 4.0
    dead_zone: float = 0.0
    levels: int = 3
    wavelet: str = "9/7"
    block_dct: bool = False
    per_band: bool = False
    chroma: str = "444"
    weights: list[float] = field(default_factory=list)  # low band, then three for each level
    chroma_weight: float = 1.0
    alphas: list[int] | None = None
    aq: bool = False
    aq_strength: float = 0.0
    weight_map: list[float] | None = None
    intra_modes: list[int] | None = None
    kind: str = "I"
    block: int = 16
    vectors: list[tuple[int, int]] | None = None
    back_vectors: list[tuple[int, int]] | None = None
    modes: list[int] | None = None
    refs: tuple[int, int] = (0, 1)
    coder: str = "rice"
    tiles: list[bytes] = field(default_factory=list)

    @property
    def padded_width(self) -> int:
        return ceil_div(self.width, self.tile) * self.tile


def zigzag(v: int) -> int:
    return ((v << 1) ^ (v >> 15)) & 0xFFFF


def unzigzag(u: int) -> int:
    return (u >> 1) ^ -(u & 1)


def _predicted(done: list[tuple[int, int]], i: int, across: int) -> tuple[int, int]:
    """Median of the left, upper and upper right vector; zero where there is none, the upper for a missing upper right."""
    x, y = i % across, i // across
    left = done[i - 1] if x else (0, 0)
    up = done[i - across] if y else (0, 0)
    right = done[i - across + 1] if y and x + 1 < across else up
    return tuple(sorted(v)[1] for v in zip(left, up, right, strict=True))


def write_vectors(vectors: list[tuple[int, int]], across: int) -> bytes:
    """A bit for each zero vector, then the others' differences from their prediction."""
    zeros = np.packbits([v == (0, 0) for v in vectors], bitorder="little").tobytes() if vectors else b""
    out = bytearray(zeros)
    for i, v in enumerate(vectors):
        if v != (0, 0):
            for a, p in zip(v, _predicted(vectors, i, across), strict=True):
                out += varint(zigzag(a - p))
    return bytes(out)


def read_vectors(data: bytes, at: int, count: int, across: int) -> tuple[list[tuple[int, int]], int]:
    n = ceil_div(count, 8)
    zeros, at = np.unpackbits(np.frombuffer(data, np.uint8, n, at), bitorder="little"), at + n
    out: list[tuple[int, int]] = []
    for i in range(count):
        if zeros[i]:
            out.append((0, 0))
            continue
        v = []
        for p in _predicted(out, i, across):
            u, at = read_varint(data, at)
            v.append(p + unzigzag(u))
        out.append(tuple(v))
    return out, at


def pack_modes(modes: list[int]) -> bytes:
    """Four modes of two bits a byte, the first lowest."""
    return bytes(sum((m & 3) << (2 * j) for j, m in enumerate(modes[i : i + 4])) for i in range(0, len(modes), 4))


def unpack_modes(data: bytes, count: int) -> list[int]:
    return [(data[i // 4] >> (2 * (i % 4))) & 3 for i in range(count)]


def write_frame(f: Frame) -> bytes:
    w = f.weights or [1.0] * (1 + 3 * f.levels)
    out = bytearray(FRAME + struct.pack("<IIIIffI", f.width, f.height, f.bit_depth, f.tile, f.step, f.dead_zone, f.levels))
    out += bytes([_WAVELETS.index(f.wavelet), f.block_dct, f.per_band, CHROMA.index(f.chroma)])
    out += struct.pack(f"<fI{len(w) - 1}ff", w[0], (len(w) - 1) // 3, *w[1:], f.chroma_weight)
    out.append(f.alphas is not None)
    if f.alphas is not None:
        out += struct.pack(f"<II{len(f.alphas)}h", 1 + 3 * f.levels, ceil_div(f.width, f.tile) * ceil_div(f.height, f.tile), *f.alphas)
    m = f.weight_map or []
    out += struct.pack(f"<IfI{len(m)}f", f.aq, f.aq_strength, len(m), *m)
    out.append(f.intra_modes is not None)
    if f.intra_modes is not None:
        packed = pack_modes(f.intra_modes)
        out += struct.pack("<II", len(f.intra_modes), len(packed)) + packed
    out.append(KINDS.index(f.kind))
    if f.vectors is not None:
        out += struct.pack("<HI", f.block, len(f.vectors)) + write_vectors(f.vectors, f.padded_width // f.block)
        if f.kind == "B":
            back, modes = f.back_vectors or [], f.modes or []
            out += struct.pack("<I", len(back)) + (write_vectors(back, f.padded_width // 16) if back else b"")
            out += struct.pack("<I", len(modes)) + bytes(modes) + bytes(f.refs)
    out += struct.pack("<II", CODERS[f.coder][0], len(f.tiles))
    for t in f.tiles:
        out += struct.pack("<II", len(t), zlib.crc32(t))
    return bytes(out) + b"".join(f.tiles)


def read_frame(data: bytes) -> tuple[Frame, list[bool]]:
    """The frame, and for each tile whether it has its checksum (layouts without checksums: true).

    From the second layout on frames have the flag of band tables, from the third kinds and vectors, from the fourth intra modes,
    backward vectors and the tile index, from the fifth coded vectors, from the sixth chroma, from the seventh reference indices. Rice
    tiles of layouts before the last have other parameters and are an error.
    """
    if data[:4] not in OLDER:
        raise ValueError(f"not a frame: {data[:4]!r}")
    age, at = OLDER.index(data[:4]), 4

    def take(form: str) -> tuple:
        nonlocal at
        got = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return got

    width, height, depth, tile, step, dead, levels = take("IIIIffI")
    wavelet, dct = take("BB")
    bands = take("B")[0] if age >= 1 else 0
    chroma = take("B")[0] if age >= 5 else 0
    low, n = take("fI")
    weights = [low, *take(f"{3 * n}f")]
    (chroma_weight,) = take("f")
    alphas = None
    if take("B")[0]:
        per, tiles = take("II")
        alphas = list(take(f"{2 * per * tiles}h"))
    aq, strength, n = take("IfI")
    weight_map = list(take(f"{n}f")) if n else None
    intra = None
    if age >= 3 and take("B")[0]:
        count, n = take("II")
        intra, at = unpack_modes(data[at : at + n], count), at + n
    kind = KINDS[take("B")[0]] if age >= 2 else "I"
    f = Frame(width, height, depth, tile, step, dead, levels, _WAVELETS[wavelet], bool(dct), bool(bands), CHROMA[chroma], weights, chroma_weight, alphas, bool(aq), strength, weight_map, intra, kind)
    def moves(count: int, across: int) -> list[tuple[int, int]]:
        nonlocal at
        if age >= 4:
            got, at = read_vectors(data, at, count, across)
            return got
        flat = take(f"{2 * count}h")
        return list(zip(flat[0::2], flat[1::2], strict=True))

    if kind != "I":
        f.block, n = take("HI")
        f.vectors = moves(n, f.padded_width // f.block)
        if kind == "B" and age >= 3:
            (n,) = take("I")
            f.back_vectors = moves(n, f.padded_width // 16) if n else None
            (n,) = take("I")
            f.modes = list(take(f"{n}B")) if n else None
            f.refs = take("BB") if age >= 6 else (0, 1)
    code, n = take("II")
    f.coder = next(k for k, v in CODERS.items() if v[0] == code)
    if f.coder == "rice" and age < len(OLDER) - 1:
        raise ValueError("Rice tiles of this layout are not read")
    if age < 3:  # tiles follow each other without an index, and tell their own length
        for _ in range(n):
            size = tile_length(f.coder, data, at)
            f.tiles.append(data[at : at + size])
            at += size
        return f, [True] * n
    index, valid = [take("II") for _ in range(n)], []
    for size, crc in index:
        f.tiles.append(data[at : at + size])
        valid.append(zlib.crc32(f.tiles[-1]) == crc)
        at += size
    return f, valid


def tile_length(coder: str, data: bytes, at: int) -> int:
    """Bytes of the tile that begins at a place, from its own fields."""
    begin = at
    if coder == "rans":
        _, n, _, _ = struct.unpack_from("<iIIi", data, at)
        return 16 + 256 + 2 * n + sum(struct.unpack_from("<32I", data, at + 16))
    if coder == "bitplane":
        n = struct.unpack_from("<III", data, at)[2]
        return 16 + 4 * n + struct.unpack_from("<I", data, at + 12 + 4 * n)[0]
    groups = struct.unpack_from("<IIII", data, at)[3]
    at += 16
    for _ in range(groups):
        at += 12 + 2 * struct.unpack_from("<iIi", data, at)[1] if coder == "rans_bands" else 1 + data[at]
    if coder == "rans_bands":
        return at - begin + 256 + sum(struct.unpack_from("<32I", data, at))
    return at - begin + groups + 512 + sum(struct.unpack_from("<256H", data, at + groups))


# ---- sequences


def write_sequence(frames: list[tuple[bytes, str]], width: int, height: int, rate: tuple[int, int]) -> bytes:
    """A file of (frame bytes, kind) in display order."""
    at = SEQUENCE_HEADER + SEQUENCE_ENTRY * len(frames)
    out = bytearray(SEQUENCE + struct.pack("<IIIIII", 1, width, height, len(frames), *rate))
    for i, (blob, kind) in enumerate(frames):
        out += struct.pack("<QIBQ", at, len(blob), KINDS.index(kind), i)
        at += len(blob)
    return bytes(out) + b"".join(b for b, _ in frames)


def sequence_index(data: bytes) -> tuple[dict, list[tuple]]:
    """Header fields and rows of INDEX_SCHEMA."""
    if data[:4] != SEQUENCE or len(data) < SEQUENCE_HEADER:
        raise ValueError("not a sequence file")
    version, width, height, n, num, den = struct.unpack_from("<IIIIII", data, 4)
    rows = [struct.unpack_from("<QIBQ", data, SEQUENCE_HEADER + SEQUENCE_ENTRY * i) for i in range(n)]
    return {"version": version, "width": width, "height": height, "frames": n, "fps_num": num, "fps_den": den}, [(i, o, s, KINDS[k], p) for i, (o, s, k, p) in enumerate(rows)]


def write_temporal(groups: list[dict], tail: list[tuple[int, bytes]], width: int, height: int, frames: int, rate: tuple[int, int], transform: str, size: int, factor: float) -> bytes:
    """A file of groups {gop, low, highs: levels from the finest} and tail frames (pts, bytes): each group's low frame, then its highs
    from the deepest level, after all groups the tail."""
    entries: list[tuple] = []
    for g in groups:
        pos, base = 0, g["gop"] * size
        entries.append((g["low"], 0, 0, g["gop"], pos, base))
        for level in range(len(g["highs"]) - 1, -1, -1):
            for blob in g["highs"][level]:
                pos += 1
                entries.append((blob, 1, level, g["gop"], pos, base + pos))
    entries += [(blob, 2, 0, pts // size, pts % size, pts) for pts, blob in tail]
    out = bytearray(TEMPORAL + struct.pack("<IIIIIIBBf", 1, width, height, frames, *rate, TRANSFORMS.index(transform), size, factor))
    at = TEMPORAL_HEADER + TEMPORAL_ENTRY * len(entries)
    for blob, role, level, gop, pos, pts in entries:
        out += struct.pack("<QIBBHHI", at, len(blob), role, level, gop, pos, pts)
        at += len(blob)
    return bytes(out) + b"".join(e[0] for e in entries)


def temporal_index(data: bytes) -> tuple[dict, list[tuple]]:
    """Header fields and rows of TEMPORAL_SCHEMA."""
    if data[:4] != TEMPORAL or len(data) < TEMPORAL_HEADER:
        raise ValueError("not a temporal sequence file")
    version, width, height, frames, num, den, transform, size, factor = struct.unpack_from("<IIIIIIBBf", data, 4)
    first = None
    rows, at = [], TEMPORAL_HEADER
    while first is None or at < first:
        o, n, role, level, gop, pos, pts = struct.unpack_from("<QIBBHHI", data, at)
        first = o if first is None else first
        rows.append((len(rows), o, n, ROLES[role], level, gop, pos, pts))
        at += TEMPORAL_ENTRY
    head = {"version": version, "width": width, "height": height, "frames": frames, "fps_num": num, "fps_den": den, "transform": TRANSFORMS[transform], "gop_size": size, "factor": factor}
    return head, rows


def index_frame(spark: SparkSession, data: bytes) -> DataFrame:
    """The index of a file as a DataFrame, by its magic."""
    if data[:4] == TEMPORAL:
        return spark.createDataFrame(temporal_index(data)[1], TEMPORAL_SCHEMA)
    return spark.createDataFrame(sequence_index(data)[1], INDEX_SCHEMA)


def read_blob(payload: Column, offset: Column, size: Column) -> Column:
    """The bytes of one entry."""
    return F.substring(payload, offset + 1, size)


def seek_keyframe(index: DataFrame, pts: int) -> int:
    """Frame of the last key frame at or before pts; 0 if there is none."""
    row = index.where((F.col("kind") == "I") & (F.col("pts") <= pts)).agg(F.max_by("frame", "pts").alias("f")).first()
    return row.f or 0


def group_entries(index: DataFrame, gop: int) -> DataFrame:
    """Entries of one group, the low frame first, then from the deepest level."""
    return index.where((F.col("gop") == gop) & (F.col("role") != "tail")).orderBy(F.col("role").desc(), F.col("level").desc(), "pos")


def groups_of(index: DataFrame) -> DataFrame:
    return index.where(F.col("role") != "tail").select("gop").distinct().orderBy("gop")


def tail_of(index: DataFrame) -> DataFrame:
    return index.where(F.col("role") == "tail").orderBy("pts")


def index_of_blobs(blobs: DataFrame, order: str = "pts", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pts, kind, size, offset): the index of a sequence file of blobs (keys, pts, kind, blob) for each of keys, without gathering them."""
    sized = blobs.select(*keys, order, "kind", F.octet_length("blob").cast("long").alias("size"))
    return offsets(sized, order, "size", SEQUENCE_HEADER, SEQUENCE_ENTRY, keys)
