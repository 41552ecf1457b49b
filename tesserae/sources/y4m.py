"""Raw video files (YUV4MPEG2): a Spark data source that reads frames by range, and a writer.

A header line gives size, rate and chroma; each frame is a line and three planes. Frames have equal sizes (their lines carry no
parameters), so a partition is a range of frames and a range of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_input

MAGIC, LINE = b"YUV4MPEG2", b"FRAME\n"
SCHEMA = "seq_id long, frame_idx long, width int, height int, rgb array<double>"


@dataclass
class Header:
    width: int
    height: int
    fps_num: int = 30
    fps_den: int = 1
    full_chroma: bool = False
    size: int = 0

    @property
    def chroma_size(self) -> tuple[int, int]:
        return (self.height, self.width) if self.full_chroma else (-(-self.height // 2), -(-self.width // 2))

    @property
    def frame_bytes(self) -> int:
        h, w = self.chroma_size
        return len(LINE) + self.width * self.height + 2 * h * w


def header(first: bytes) -> Header:
    """The header of a file from its first bytes; 30 frames a second and quarter chroma unless it says otherwise."""
    line, _, _ = first.partition(b"\n")
    if not line.startswith(MAGIC):
        raise ValueError("not a YUV4MPEG2 file")
    out = Header(0, 0, size=len(line) + 1)
    for token in line.rstrip(b"\r").decode("ascii").split()[1:]:
        kind, rest = token[0], token[1:]
        if kind == "W":
            out.width = int(rest)
        elif kind == "H":
            out.height = int(rest)
        elif kind == "F" and ":" in rest:
            out.fps_num, out.fps_den = map(int, rest.split(":", 1))
        elif kind == "C":
            out.full_chroma = rest.lstrip("abcdefghijklmnopqrstuvwxyz").startswith("444")
    if not out.width or not out.height:
        raise ValueError("the header has no size")
    return out


def frame_rgb(h: Header, data: bytes) -> np.ndarray:
    """Full-range samples (height, width, 3) of one frame's planes, which are limited-range."""
    n, (ch, cw) = h.width * h.height, h.chroma_size
    raw = np.frombuffer(data, np.uint8).astype(np.float64)
    y = raw[:n].reshape(h.height, h.width)
    cb, cr = raw[n : n + ch * cw].reshape(ch, cw), raw[n + ch * cw :].reshape(ch, cw)
    if not h.full_chroma:
        cb, cr = (p.repeat(2, axis=0).repeat(2, axis=1)[: h.height, : h.width] for p in (cb, cr))
    y, cb, cr = 1.164 * (y - 16), cb - 128, cr - 128
    return np.clip(np.stack([y + 1.596 * cr, y - 0.392 * cb - 0.813 * cr, y + 2.017 * cb], axis=-1), 0, 255)


def write(frames: Iterator[np.ndarray], width: int, height: int, rate: tuple[int, int] = (30, 1)) -> Iterator[bytes]:
    """The bytes of a file with quarter chroma: full-range luma, and colour of the upper left sample of each two by two."""
    yield f"YUV4MPEG2 W{width} H{height} F{rate[0]}:{rate[1]} Ip A0:0 C420\n".encode()
    for rgb in frames:
        r, g, b = (np.asarray(rgb, np.float64)[..., i] for i in range(3))
        planes = (0.299 * r + 0.587 * g + 0.114 * b, (-0.168736 * r - 0.331264 * g + 0.5 * b + 128)[::2, ::2], (0.5 * r - 0.418688 * g - 0.081312 * b + 128)[::2, ::2])
        yield LINE + b"".join(np.clip(p, 0, 255).astype(np.uint8).tobytes() for p in planes)


@dataclass
class Frames(InputPartition):
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_task = int(options.get("framesPerTask", "16"))

    def _header(self) -> tuple[Header, int]:
        with open_input(self.path) as f:
            h = header(f.read_at(min(4096, f.size()), 0))
            return h, (f.size() - h.size) // h.frame_bytes

    def partitions(self) -> list[Frames]:
        _, n = self._header()
        return [Frames(a, min(n, a + self.per_task)) for a in range(0, n, self.per_task)] or [Frames(0, 0)]

    def read(self, partition: Frames) -> Iterator[tuple]:
        h, _ = self._header()
        with open_input(self.path) as f:
            for i in range(partition.first, partition.last):
                data = f.read_at(h.frame_bytes, h.size + i * h.frame_bytes)
                if data[: len(LINE)] != LINE:
                    raise ValueError(f"frame {i} does not begin where it should")
                yield (0, i, h.width, h.height, frame_rgb(h, data[len(LINE) :]).ravel().tolist())


class Y4m(DataSource):
    """spark.read.format("y4m").load(path), after spark.dataSource.register(Y4m). Option framesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def window(frames: list, at: int, size: int) -> list:
    """size frames from at on; past the end the last is repeated."""
    return [frames[min(i, len(frames) - 1)] for i in range(at, at + size)]
