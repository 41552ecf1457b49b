"""PNG images of 8 and 16 bits a sample, with the standard library's zlib.

Ten-bit samples are kept in the upper bits of 16-bit ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def read(data: bytes) -> np.ndarray:
    """Samples (height, width, 3) of an image that is not interlaced; grey is repeated, alpha left out."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG image")
    at, body, palette, head = 8, b"", b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + chunk) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = chunk
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    width, height, depth, color, _, _, interlaced = head
    if depth not in (8, 16) or interlaced:
        raise ValueError("only 8 and 16 bits without interlacing are read")
    unit = _CHANNELS[color] * depth // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * unit)
    raw = _unfiltered(lines[:, 0], lines[:, 1:], unit)
    out = raw.view(">u2").astype(np.uint16) if depth == 16 else raw
    out = out.reshape(height, width, _CHANNELS[color])
    if color == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[out[..., 0]]
    return np.repeat(out[..., :1], 3, axis=2) if color in (0, 4) else out[..., :3]


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, unit: int) -> np.ndarray:
    height, n = lines.shape
    out = np.zeros((height + 1, n + unit), np.int64)  # a line and a pixel of zeros before the image
    for y in range(height):
        up, kind = out[y], kinds[y]
        own = out[y + 1]
        own[unit:] = lines[y]
        if kind == 2:
            own[unit:] = (own[unit:] + up[unit:]) & 255
        elif kind == 1:
            for c in range(unit):
                own[unit + c :: unit] = np.cumsum(own[unit + c :: unit]) & 255
        elif kind in (3, 4):
            for i in range(unit, n + unit):
                a, b, c = own[i - unit], up[i], up[i - unit]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[i] = (own[i] + guess) & 255
    return np.ascontiguousarray(out[1:, unit:].astype(np.uint8))


def write(rgb: np.ndarray, bit_depth: int = 8) -> bytes:
    """Image bytes of samples (height, width, 3), rounded and clamped."""
    height, width = rgb.shape[:2]
    peak = (1 << bit_depth) - 1
    v = np.clip(np.floor(np.asarray(rgb, np.float64) + 0.5), 0, peak).astype(np.uint32)
    raw = v.astype(np.uint8) if bit_depth == 8 else (v << (16 - bit_depth)).astype(">u2")
    lines = b"".join(b"\0" + line.tobytes() for line in raw)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8 if bit_depth == 8 else 16, 2, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def images(spark: SparkSession, path: str, bit_depth: int = 8, pattern: str = r"(\d+)\.[A-Za-z]+$") -> DataFrame:
    """(seq_id, frame_idx, width, height, rgb) of the images that a path or glob names; frame_idx is the number in the file's name."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    number = F.regexp_extract("path", pattern, 1)
    files = files.select(F.when(number != "", number.cast("long")).otherwise(0).alias("frame_idx"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [read(b) >> (16 - bit_depth) if bit_depth > 8 else read(b) for b in pdf["content"]]
            yield pd.DataFrame({"seq_id": 0, "frame_idx": pdf["frame_idx"], "width": [g.shape[1] for g in got], "height": [g.shape[0] for g in got], "rgb": [g.ravel().astype(float).tolist() for g in got]})

    return files.mapInPandas(run, "seq_id long, frame_idx long, width int, height int, rgb array<double>")
