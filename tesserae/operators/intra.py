"""Prediction of 8x8 blocks from their neighbours within a tile.

Modes: 0 mean of the neighbours there are, 1 the left column, 2 the upper row, 3 along the diagonal from the upper row and the sample behind
it, if that lies in the tile; a missing neighbour counts as 128. The encoder predicts from original samples, the decoder from reconstructed ones, block by
block, so that errors stay within a tile of TILE samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK, TILE, MISSING = 8, 32, 128.0


def _guesses(plane: np.ndarray, x: int, y: int, tile: int) -> np.ndarray:
    """The four predictions (mode, row, column) of the block at (x, y)."""
    has_left, has_up = x % tile > 0, y % tile > 0
    left = plane[y : y + BLOCK, x - 1] if has_left else np.full(BLOCK, MISSING)
    up = plane[y - 1, x : x + BLOCK] if has_up else np.full(BLOCK, MISSING)
    known = np.concatenate([left] * has_left + [up] * has_up) if has_left or has_up else np.array([MISSING])
    inside = (x + BLOCK) % tile and x + BLOCK < plane.shape[1]
    corner = MISSING if not has_up else plane[y - 1, x + BLOCK] if inside else up[-1]
    behind = np.concatenate([up[1:], np.full(BLOCK + 1, corner)])
    place = np.arange(BLOCK)
    return np.stack([np.full((BLOCK, BLOCK), known.mean()), np.repeat(left[:, None], BLOCK, 1), np.repeat(up[None], BLOCK, 0), behind[place[:, None] + place[None]]])


def _corners(shape: tuple[int, int], tile: int) -> Iterator[tuple[int, int]]:
    """Blocks tile by tile, row by row."""
    for ty in range(0, shape[0], tile):
        for tx in range(0, shape[1], tile):
            for y in range(ty, min(ty + tile, shape[0]), BLOCK):
                for x in range(tx, min(tx + tile, shape[1]), BLOCK):
                    yield x, y


def predict(plane: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Residual and modes (a number a block) of a plane of whole blocks."""
    residual, modes = np.empty_like(plane, dtype=float), np.zeros((plane.shape[0] // BLOCK, plane.shape[1] // BLOCK), np.int64)
    for x, y in _corners(plane.shape, tile):
        own, guesses = plane[y : y + BLOCK, x : x + BLOCK], _guesses(plane, x, y, tile)
        m = int(np.abs(own - guesses).sum(axis=(1, 2)).argmin())
        modes[y // BLOCK, x // BLOCK] = m
        residual[y : y + BLOCK, x : x + BLOCK] = own - guesses[m]
    return residual, modes


def reconstruct(residual: np.ndarray, modes: np.ndarray, tile: int = TILE) -> np.ndarray:
    """The plane of a residual: each block waits for those that it is predicted from."""
    out = np.zeros_like(residual, dtype=float)
    for x, y in _corners(residual.shape, tile):
        at = slice(y, y + BLOCK), slice(x, x + BLOCK)
        out[at] = residual[at] + _guesses(out, x, y, tile)[modes[y // BLOCK, x // BLOCK]]
    return out


def predicted(tiles: DataFrame, size: int) -> DataFrame:
    """Adds residual and modes to rows with data array<double>, tiles of size samples."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema.fields)
    at = tiles.columns.index("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [predict(np.array(d, float).reshape(size, size)) for d in b.column(at).to_pylist()]
            new = [pa.array([r.ravel() for r, _ in got], pa.list_(pa.float64())), pa.array([m.ravel() for _, m in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "residual", "modes"])

    return tiles.mapInArrow(run, f"{fields}, residual array<double>, modes array<long>")
