"""Frames to coded frames and back, and coded sequences: the composites of transforms, quantiser, prediction and coders.

Frames are rows (seq_id, frame_idx, width, height, rgb array<double>). Independent frames are one row in, one row out; predicted
ones depend on the frames before them, so a group of pictures is one grouped call and groups spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import quality_preset
from ..functions.geometry import ceil_div
from .coders import CODERS
from .coders.common import band_map
from .containers import CHROMA, Frame, read_frame, write_frame
from .transforms import dct_matrix, unwavelet, wavelet

_SHIFTS = dict(zip(CHROMA, ((0, 0), (1, 0), (1, 1)), strict=True))


def settings(q: int, width: int, height: int, tile: int = 256, **more) -> Frame:
    """An empty frame with the settings of a quality."""
    p = quality_preset(q)
    base = Frame(width, height, tile=tile, step=p["step"], dead_zone=p["dead_zone"], levels=p["levels"], wavelet=p["wavelet"], per_band=True, chroma_weight=p["chroma_weight"])
    base.aq, base.aq_strength = p["aq"] and p["wavelet"] == "9/7", p["aq_strength"]
    base.alphas = [] if p["cfl"] and more.get("chroma", "444") == "444" else None
    return replace(base, **more)


def color(rgb: np.ndarray, lossless: bool) -> list[np.ndarray]:
    half = (lambda x: np.floor(x / 2)) if lossless else (lambda x: x / 2)
    r, g, b = (rgb[..., i] for i in range(3))
    co = r - b
    t = b + half(co)
    cg = g - t
    return [t + half(cg), co, cg]


def uncolor(planes: list[np.ndarray], lossless: bool) -> np.ndarray:
    half = (lambda x: np.floor(x / 2)) if lossless else (lambda x: x / 2)
    y, co, cg = planes
    t = y - half(cg)
    b = t - half(co)
    return np.stack([b + co, cg + t, b], axis=-1)


def padded(p: np.ndarray, tile: int) -> np.ndarray:
    h, w = p.shape
    return np.pad(p, ((0, -h % tile), (0, -w % tile)), mode="edge")


def cut(p: np.ndarray, tile: int) -> np.ndarray:
    """Tiles (n, tile, tile) of a padded plane, row by row."""
    h, w = p.shape
    return p.reshape(h // tile, tile, w // tile, tile).swapaxes(1, 2).reshape(-1, tile, tile)


def sewn(tiles: np.ndarray, width: int) -> np.ndarray:
    n, tile = tiles.shape[0], tiles.shape[1]
    across = width // tile
    return tiles.reshape(n // across, across, tile, tile).swapaxes(1, 2).reshape(-1, width)


def _steps(f: Frame, chroma: bool) -> np.ndarray:
    """Step of every place of a tile."""
    w = f.weights or [1.0] * (1 + 3 * f.levels)
    if f.block_dct:
        r = np.arange(8)
        weight = 1 + 7.0 * (r[:, None] ** 2 + r[None] ** 2) / 98
        out = np.tile(weight, (f.tile // 8, f.tile // 8))
    else:
        out = np.full((f.tile, f.tile), w[0])
        for level in range(f.levels - 1, -1, -1):
            n, half = f.tile >> level, (f.tile >> level) // 2
            out[half:n, :half], out[:half, half:n], out[half:n, half:n] = w[1 + 3 * level : 4 + 3 * level]
    return f.step * out * (f.chroma_weight if chroma else 1.0)


def _forward(tiles: np.ndarray, f: Frame) -> np.ndarray:
    if not f.block_dct:
        return wavelet(tiles, f.levels, f.wavelet)
    d, n = np.array(dct_matrix(8)), f.tile // 8
    b = tiles.reshape(-1, n, 8, n, 8).swapaxes(2, 3)
    return (d @ b @ d.T).swapaxes(2, 3).reshape(tiles.shape)


def _inverse(tiles: np.ndarray, f: Frame) -> np.ndarray:
    if not f.block_dct:
        return unwavelet(tiles, f.levels, f.wavelet)
    d, n = np.array(dct_matrix(8)), f.tile // 8
    b = tiles.reshape(-1, n, 8, n, 8).swapaxes(2, 3)
    return (d.T @ b @ d).swapaxes(2, 3).reshape(tiles.shape)


def _spatial(coefficients: np.ndarray, f: Frame, block: int = 4) -> np.ndarray:
    """Weight of every low-band block of every tile, normalised and smoothed within the tile."""
    n = f.tile >> f.levels
    side = max(1, n // block)
    low = coefficients[:, : side * (n // side), : side * (n // side)].reshape(len(coefficients), side, n // side, side, n // side)
    w = np.clip(1 + 0.15 * f.aq_strength * (8 - np.log2(1 + low.var(axis=(2, 4)))), 0.5, 2)
    w = np.clip(w * np.exp(-np.log(w).mean()), 0.5, 2)
    if side >= 3:
        total, count = np.zeros_like(w), np.zeros_like(w)
        wide = np.pad(w, ((0, 0), (1, 1), (1, 1)))
        ones = np.pad(np.ones_like(w), ((0, 0), (1, 1), (1, 1)))
        for i in range(3):
            for j in range(3):
                total += wide[:, i : i + side, j : j + side]
                count += ones[:, i : i + side, j : j + side]
        w = total / count
        w *= np.exp(-np.log(w).mean())
    return w


def _everywhere(weights: np.ndarray, f: Frame) -> np.ndarray:
    """Block weights at every coefficient's place: each band shrinks to the low band."""
    side = weights.shape[1]
    out = np.ones((len(weights), f.tile, f.tile))
    for level in range(f.levels + 1):
        n = f.tile >> level
        half = n // 2 if level < f.levels else n
        at = np.arange(half) * side // half
        band = weights[:, at][:, :, at]
        if level == f.levels:
            out[:, :n, :n] = band
        else:
            out[:, half:n, :half] = out[:, :half, half:n] = out[:, half:n, half:n] = band
    return out


def _index(c: np.ndarray, step: np.ndarray, dead: float) -> np.ndarray:
    m = np.abs(c)
    return np.where(m < dead * step, 0, np.sign(c) * np.floor(m / step + 0.5)).astype(np.int64)


def _alphas(luma: np.ndarray, chroma: np.ndarray, f: Frame) -> np.ndarray:
    """Code of the factor of luma in chroma for every tile and subband."""
    bands = _subbands(f.tile, f.levels)
    out = np.zeros((len(luma), 1 + 3 * f.levels), np.int64)
    for b in range(out.shape[1]):
        y, c = luma[:, bands == b], chroma[:, bands == b]
        yy = (y * y).sum(axis=1)
        a = np.where(yy > 1e-10, (y * c).sum(axis=1) / np.maximum(yy, 1e-10), 0.0)
        out[:, b] = np.floor(np.clip(a, -2, 2) * 8192 + 0.5)
    return out


def _subbands(tile: int, levels: int) -> np.ndarray:
    out = np.zeros((tile, tile), np.int64)
    for level in range(levels):
        n, half = tile >> level, (tile >> level) // 2
        out[half:n, :half], out[:half, half:n], out[half:n, half:n] = 1 + 3 * level, 2 + 3 * level, 3 + 3 * level
    return out


def encode_planes(planes: list[np.ndarray], f: Frame) -> Frame:
    """Codes three planes (residuals, or colour planes of a frame) with the frame's settings."""
    f = replace(f, tiles=[])
    sx, sy = _SHIFTS[f.chroma]
    luma, alphas = None, []
    for i, p in enumerate(planes):
        if i and (sx or sy):
            p = np.pad(p, ((0, p.shape[0] % (1 << sy)), (0, p.shape[1] % (1 << sx))), mode="edge")
            p = p.reshape(p.shape[0] >> sy, 1 << sy, p.shape[1] >> sx, 1 << sx).mean(axis=(1, 3))
        c = _forward(cut(padded(p, f.tile), f.tile), f)
        step = _steps(f, i > 0)[None]
        if i == 0 and f.aq and not f.block_dct:
            weights = _spatial(c, f).astype(np.float32)
            f.weight_map = weights.ravel().tolist()
            step = step * _everywhere(weights.astype(float), f)
        if i and f.alphas is not None:
            a = _alphas(luma, c, f)
            alphas += a.ravel().tolist()
            c = c - a[:, _subbands(f.tile, f.levels)] / 8192 * luma
        q = _index(c, step, f.dead_zone)
        if i == 0:
            luma = q * step
        f.tiles += [CODERS[f.coder][1](t.ravel(), f.tile, f.levels) for t in q]
    if f.alphas is not None:
        f.alphas = alphas
    return f


def decode_planes(f: Frame, valid: list[bool] | None = None) -> list[np.ndarray]:
    """The planes of a coded frame; damaged tiles count as zeros."""
    sx, sy = _SHIFTS[f.chroma]
    out, at, luma = [], 0, None
    bands = _subbands(f.tile, f.levels)
    for i in range(3):
        w, h = (ceil_div(f.width, 1 << sx), ceil_div(f.height, 1 << sy)) if i else (f.width, f.height)
        pw, ph = ceil_div(w, f.tile) * f.tile, ceil_div(h, f.tile) * f.tile
        n = pw * ph // f.tile**2
        zero = np.zeros(f.tile**2, np.int64)
        q = np.stack([CODERS[f.coder][2](t) if valid is None or valid[at + j] else zero for j, t in enumerate(f.tiles[at : at + n])]).reshape(-1, f.tile, f.tile)
        step = _steps(f, i > 0)[None]
        if i == 0 and f.weight_map:
            side = int(round((len(f.weight_map) / n) ** 0.5))
            step = step * _everywhere(np.array(f.weight_map, np.float32).astype(float).reshape(n, side, side), f)
        c = q * step
        if i == 0:
            luma = c
        elif f.alphas is not None:
            a = np.array(f.alphas[(i - 1) * n * (1 + 3 * f.levels) : i * n * (1 + 3 * f.levels)]).reshape(n, -1)
            c = c + a[:, bands] / 8192 * luma
        at += n
        p = sewn(_inverse(c, f), pw)[:h, :w]
        if i and (sx or sy):
            p = p.repeat(1 << sy, axis=0).repeat(1 << sx, axis=1)[: f.height, : f.width]
        out.append(p)
    return out


def lossless(f: Frame) -> bool:
    return f.step <= 1 and f.dead_zone == 0 and f.wavelet == "5/3" and not f.block_dct


def encode_frame(rgb: np.ndarray, f: Frame) -> bytes:
    return write_frame(encode_planes(color(rgb, lossless(f)), f))


def decode_frame(data: bytes) -> np.ndarray:
    f, valid = read_frame(data)
    return np.clip(uncolor(decode_planes(f, valid), lossless(f)), 0, (1 << f.bit_depth) - 1)


def psnr(a: np.ndarray, b: np.ndarray, peak: float = 255.0) -> float:
    mse = float(((a - b) ** 2).mean())
    return float("inf") if mse < 1e-10 else 10 * np.log10(peak * peak / mse)


def encode(frames: DataFrame, q: int, tile: int = 256, **more) -> DataFrame:
    """(seq_id, frame_idx, blob, bytes, bpp, psnr): every frame coded on its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                rgb = np.asarray(r.rgb, np.float64).reshape(r.height, r.width, 3)
                blob = encode_frame(rgb, settings(q, r.width, r.height, tile, **more))
                rows.append((r.seq_id, r.frame_idx, blob, len(blob), 8 * len(blob) / (r.width * r.height), psnr(rgb, np.rint(decode_frame(blob)))))
            yield pd.DataFrame(rows, columns=["seq_id", "frame_idx", "blob", "bytes", "bpp", "psnr"])

    return frames.mapInPandas(run, "seq_id long, frame_idx long, blob binary, bytes long, bpp double, psnr double")


def decode(coded: DataFrame) -> DataFrame:
    """(seq_id, frame_idx, width, height, rgb) of coded frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [decode_frame(b) for b in pdf["blob"]]
            yield pd.DataFrame({"seq_id": pdf["seq_id"], "frame_idx": pdf["frame_idx"], "width": [g.shape[1] for g in got], "height": [g.shape[0] for g in got], "rgb": [g.ravel().tolist() for g in got]})

    return coded.mapInPandas(run, "seq_id long, frame_idx long, width int, height int, rgb array<double>")


# ---- predicted frames


def search(cur: np.ndarray, ref: np.ndarray, block: int, reach: int = 4, bias: float = 0.0) -> np.ndarray:
    """Best whole-sample move of every block by summed differences: vectors in quarter samples (rows, columns, 2)."""
    h, w = cur.shape
    wide = np.pad(ref, reach, mode="edge")
    best, out = None, np.zeros((h // block, w // block, 2), np.int64)
    for dx, dy in sorted(((x, y) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1)), key=lambda m: (abs(m[0]) + abs(m[1]), m[1], m[0])):
        d = np.abs(cur - wide[reach + dy : reach + dy + h, reach + dx : reach + dx + w])
        sad = d[: h // block * block, : w // block * block].reshape(h // block, block, w // block, block).sum(axis=(1, 3))
        if best is None:
            best = sad - bias
            continue
        better = sad < best
        best = np.where(better, sad, best)
        out[better] = (4 * dx, 4 * dy)
    return out


def compensate(ref: np.ndarray, vectors: np.ndarray, block: int) -> np.ndarray:
    """Bilinear prediction by vectors in quarter samples, clamped to the plane."""
    h, w = ref.shape
    y, x = np.mgrid[:h, :w]
    v = vectors[np.minimum(y // block, vectors.shape[0] - 1), np.minimum(x // block, vectors.shape[1] - 1)]
    fx, fy = x + v[..., 0] / 4, y + v[..., 1] / 4
    x0, y0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
    ax, ay = fx - x0, fy - y0
    at = lambda i, j: ref[np.clip(y0 + j, 0, h - 1), np.clip(x0 + i, 0, w - 1)]
    return at(0, 0) * (1 - ax) * (1 - ay) + at(1, 0) * ax * (1 - ay) + at(0, 1) * (1 - ax) * ay + at(1, 1) * ax * ay


def _residual_settings(f: Frame) -> Frame:
    """Predicted frames have even weights and a doubled dead zone, and neither colour prediction nor spatial weights."""
    return replace(f, weights=[], chroma_weight=1.0, dead_zone=2 * f.dead_zone, alphas=None, aq=False, weight_map=None)


def _predicted(planes: list[np.ndarray], ref: list[np.ndarray], f: Frame, block: int = 8) -> tuple[Frame, list[np.ndarray]]:
    """A frame predicted from another one's reconstruction, and its own reconstruction."""
    v = search(padded(planes[0], f.tile), padded(ref[0], f.tile), block, bias=2.0 * block * block / 8)
    guess = [compensate(p, v, block) for p in ref]
    g = replace(_residual_settings(f), kind="P", block=block, vectors=[tuple(int(a) for a in m) for m in v.reshape(-1, 2)])
    coded = encode_planes([p - q for p, q in zip(planes, guess, strict=True)], g)
    return coded, [p + q for p, q in zip(decode_planes(coded), guess, strict=True)]


def _from(f: Frame, valid: list[bool], ref: list[np.ndarray]) -> list[np.ndarray]:
    """Reconstruction of a predicted frame; its damaged tiles have no residual."""
    v = np.array(f.vectors).reshape(-1, f.padded_width // f.block, 2)
    return [p + compensate(r, v, f.block) for p, r in zip(decode_planes(f, valid), ref, strict=True)]


def _shown(planes: list[np.ndarray], f: Frame) -> np.ndarray:
    return np.clip(uncolor(planes, False), 0, (1 << f.bit_depth) - 1)


def encode_group(frames: list[np.ndarray], f: Frame) -> list[bytes]:
    """An independent frame and predicted ones, each from the reconstruction of the one before."""
    out, ref = [], None
    for rgb in frames:
        planes = color(rgb, False)
        if ref is None:
            coded = encode_planes(planes, f)
            ref = decode_planes(coded)
        else:
            coded, ref = _predicted(planes, ref, f)
        out.append(write_frame(coded))
    return out


def decode_group(blobs: list[bytes]) -> list[np.ndarray]:
    out, ref = [], None
    for data in blobs:
        f, valid = read_frame(data)
        ref = _from(f, valid, ref) if f.kind == "P" else decode_planes(f, valid)
        out.append(_shown(ref, f))
    return out


#: Display offsets of seven frames between two anchors in coding order, and their references: 0 and 8 are the anchors (fixed values).
PYRAMID = ((4, 0, 8), (2, 0, 4), (6, 4, 8), (1, 0, 2), (3, 2, 4), (5, 4, 6), (7, 6, 8))
#: Factor on the step by layer, and the most that it gives.
LEAF_STEP, MOST_STEP = 1.5, 64.0


def _mixed(fwd: np.ndarray, bwd: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Prediction of a plane by block mode: 0 forward, 1 backward, 2 their mean."""
    y, x = np.mgrid[: fwd.shape[0], : fwd.shape[1]]
    m = modes[np.minimum(y // block, modes.shape[0] - 1), np.minimum(x // block, modes.shape[1] - 1)]
    return np.choose(m, [fwd, bwd, (fwd + bwd) / 2])


def _between(planes: list[np.ndarray], fwd: list[np.ndarray], bwd: list[np.ndarray], f: Frame, refs: tuple[int, int], block: int = 16) -> tuple[Frame, list[np.ndarray]]:
    """A frame predicted from both sides, and its reconstruction."""
    luma = padded(planes[0], f.tile)
    va, vb = (search(luma, padded(r[0], f.tile), block, bias=2.0 * block * block / 8) for r in (fwd, bwd))
    a, b = compensate(padded(fwd[0], f.tile), va, block), compensate(padded(bwd[0], f.tile), vb, block)
    h, w = luma.shape[0] // block, luma.shape[1] // block
    cost = lambda p: np.abs(luma - p)[: h * block, : w * block].reshape(h, block, w, block).sum(axis=(1, 3))
    modes = np.stack([cost(a), cost(b), cost((a + b) / 2)]).argmin(axis=0)
    guess = [_mixed(compensate(p, va, block), compensate(q, vb, block), modes, block) for p, q in zip(fwd, bwd, strict=True)]
    moves = [[tuple(int(x) for x in m) for m in v.reshape(-1, 2)] for v in (va, vb)]
    g = replace(_residual_settings(f), kind="B", block=block, vectors=moves[0], back_vectors=moves[1], modes=modes.ravel().tolist(), refs=refs)
    coded = encode_planes([p - q for p, q in zip(planes, guess, strict=True)], g)
    return coded, [p + q for p, q in zip(decode_planes(coded), guess, strict=True)]


#: Frames from one anchor to the next where there are frames between them.
REACH = 8


def encode_pyramid(frames: list[np.ndarray], f: Frame) -> list[bytes]:
    """Frames in display order: the first on its own, every eighth after it predicted from the one eight before, the seven between from coarse
    to fine. What is left over is predicted one from another. References are counted from the anchor before."""
    planes = [color(x, False) for x in frames]
    first = encode_planes(planes[0], f)
    out, done = {0: write_frame(first)}, {0: decode_planes(first)}
    n = len(frames) - 1
    for anchor in range(0, n // REACH * REACH, REACH):
        coded, done[anchor + REACH] = _predicted(planes[anchor + REACH], done[anchor], f)
        out[anchor + REACH] = write_frame(coded)
        for at, a, b in PYRAMID:
            step = min(MOST_STEP, f.step * (LEAF_STEP if at % 2 else 1.0))
            coded, done[anchor + at] = _between(planes[anchor + at], done[anchor + a], done[anchor + b], replace(f, step=step), (a, b))
            out[anchor + at] = write_frame(coded)
    for i in range(n // REACH * REACH + 1, n + 1):
        coded, done[i] = _predicted(planes[i], done[i - 1], f)
        out[i] = write_frame(coded)
    return [out[i] for i in range(n + 1)]


def decode_pyramid(blobs: list[bytes]) -> list[np.ndarray]:
    """Frames of encode_pyramid in display order; damaged tiles have no residual."""
    coded = [read_frame(b) for b in blobs]
    done = {0: decode_planes(*coded[0])}
    anchor = 0
    while anchor + 1 < len(coded):
        if coded[anchor + 1][0].kind != "B":
            done[anchor + 1] = _from(*coded[anchor + 1], done[anchor])
            anchor += 1
            continue
        done[anchor + REACH] = _from(*coded[anchor + REACH], done[anchor])
        for at, _, _ in PYRAMID:
            f, valid = coded[anchor + at]
            across = f.padded_width // f.block
            va, vb = (np.array(v).reshape(-1, across, 2) for v in (f.vectors, f.back_vectors))
            modes = np.array(f.modes).reshape(-1, across)
            a, b = (done[anchor + r] for r in f.refs)
            guess = [_mixed(compensate(p, va, f.block), compensate(q, vb, f.block), modes, f.block) for p, q in zip(a, b, strict=True)]
            done[anchor + at] = [p + q for p, q in zip(decode_planes(f, valid), guess, strict=True)]
        anchor += REACH
    return [_shown(done[i], coded[0][0]) for i in range(len(coded))]


def encode_sequences(frames: DataFrame, q: int, interval: int = 8, tile: int = 256) -> DataFrame:
    """(seq_id, frame_idx, kind, blob, bytes, psnr): groups of interval frames, an independent one and predicted ones; where there are nine
    or more, seven of every eight are predicted from both sides.

    A group is one task's work, in order; groups of all sequences are spread over tasks.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        w, h = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        rgb = [np.asarray(x, np.float64).reshape(h, w, 3) for x in pdf["rgb"]]
        f = replace(settings(q, w, h, tile), wavelet="9/7")
        blobs = encode_pyramid(rgb, f)
        back = decode_pyramid(blobs)
        rows = [(key[0], i, read_frame(b)[0].kind, b, len(b), psnr(x, np.rint(y))) for i, b, x, y in zip(pdf["frame_idx"], blobs, rgb, back, strict=True)]
        return pd.DataFrame(rows, columns=["seq_id", "frame_idx", "kind", "blob", "bytes", "psnr"])

    g = frames.withColumn("gop", F.floor(F.col("frame_idx") / interval).cast("long"))
    return g.groupBy("seq_id", "gop").applyInPandas(run, "seq_id long, frame_idx long, kind string, blob binary, bytes long, psnr double")


def decode_sequences(coded: DataFrame, interval: int = 8) -> DataFrame:
    """(seq_id, frame_idx, width, height, rgb) of encode_sequences' rows (seq_id, frame_idx, blob) of the same interval.

    A group that has lost its first frames has no reference and gives no frame."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        rows, blobs = [], list(pdf["blob"])
        if pdf["frame_idx"].iloc[0] % interval == 0 and pdf["frame_idx"].is_monotonic_increasing:
            rows = [(key[0], i, x.shape[1], x.shape[0], x.ravel().tolist()) for i, x in zip(pdf["frame_idx"], decode_pyramid(blobs), strict=True)]
        return pd.DataFrame(rows, columns=["seq_id", "frame_idx", "width", "height", "rgb"])

    g = coded.select("seq_id", "frame_idx", "blob", F.floor(F.col("frame_idx") / interval).cast("long").alias("gop"))
    return g.groupBy("seq_id", "gop").applyInPandas(run, "seq_id long, frame_idx long, width int, height int, rgb array<double>")


def encode_temporal(frames: DataFrame, q: int, size: int = 4, tile: int = 256, factor: float = 2.0) -> DataFrame:
    """(seq_id, gop, role, level, pos, blob): Haar bands over groups of size frames, highs with a larger step; frames left over are
    coded on their own with role tail. Groups are independent of each other."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        w, h = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        base = replace(settings(q, w, h, tile), wavelet="9/7")
        planes = [color(np.asarray(x, np.float64).reshape(h, w, 3), False) for x in pdf["rgb"]]
        rows = []
        if len(planes) < size:
            rows = [(*key, "tail", 0, int(i) % size, write_frame(encode_planes(p, base))) for i, p in zip(pdf["frame_idx"], planes, strict=True)]
        else:
            lows, level, pos, highs = planes, 0, 0, []
            while len(lows) > 1:
                pairs = list(zip(lows[0::2], lows[1::2], strict=True))
                highs.append([[b - a for a, b in zip(x, y, strict=True)] for x, y in pairs])
                lows = [[(a + b) / 2 for a, b in zip(x, y, strict=True)] for x, y in pairs]
            rows.append((*key, "low", 0, 0, write_frame(encode_planes(lows[0], base))))
            g = replace(_residual_settings(base), step=base.step * factor, dead_zone=base.dead_zone)
            for level in range(len(highs) - 1, -1, -1):
                for p in highs[level]:
                    pos += 1
                    rows.append((*key, "high", level, pos, write_frame(encode_planes(p, g))))
        return pd.DataFrame(rows, columns=["seq_id", "gop", "role", "level", "pos", "blob"])

    g = frames.withColumn("gop", F.floor(F.col("frame_idx") / size).cast("long"))
    return g.groupBy("seq_id", "gop").applyInPandas(run, "seq_id long, gop long, role string, level long, pos long, blob binary")


def decode_temporal(coded: DataFrame, size: int = 4) -> DataFrame:
    """(seq_id, frame_idx, width, height, rgb) of encode_temporal's rows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, gop = [], int(key[1])
        out = lambda p, i: (key[0], gop * size + i, p[0].shape[1], p[0].shape[0], np.clip(uncolor(p, False), 0, most).ravel().tolist())
        coded = {(r.role, r.level, r.pos): read_frame(r.blob) for r in pdf.itertuples()}
        got, most = {k: decode_planes(*x) for k, x in coded.items()}, max((1 << x[0].bit_depth) - 1 for x in coded.values())
        if any(k[0] == "tail" for k in got):
            rows = [out(p, k[2]) for k, p in sorted(got.items(), key=lambda x: x[0][2])]
        else:
            frames = [got["low", 0, 0]]
            levels = sorted({k[1] for k in got if k[0] == "high"}, reverse=True)
            for level in levels:
                highs = [p for k, p in sorted((k, p) for k, p in got.items() if k[0] == "high" and k[1] == level)]
                frames = [x for low, high in zip(frames, highs, strict=True) for x in ([a - b / 2 for a, b in zip(low, high, strict=True)], [a + b / 2 for a, b in zip(low, high, strict=True)])]
            rows = [out(p, i) for i, p in enumerate(frames)]
        return pd.DataFrame(rows, columns=["seq_id", "frame_idx", "width", "height", "rgb"])

    return coded.groupBy("seq_id", "gop").applyInPandas(run, "seq_id long, frame_idx long, width int, height int, rgb array<double>")


def tile_bytes(coded: DataFrame) -> DataFrame:
    """(seq_id, frame_idx, tile, size, valid): the tile index of every coded frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                f, valid = read_frame(r.blob)
                rows += [(r.seq_id, r.frame_idx, i, len(t), v) for i, (t, v) in enumerate(zip(f.tiles, valid, strict=True))]
            yield pd.DataFrame(rows, columns=["seq_id", "frame_idx", "tile", "size", "valid"])

    return coded.select("seq_id", "frame_idx", "blob").mapInPandas(run, "seq_id long, frame_idx long, tile long, size long, valid boolean")


__all__ = ["band_map", "decode", "decode_sequences", "decode_temporal", "encode", "encode_sequences", "encode_temporal", "settings", "tile_bytes"]
