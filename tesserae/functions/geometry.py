"""Tiles, subbands and blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHROMA = {"444": (0, 0), "422": (1, 0), "420": (1, 1)}


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def frame_geometry(width: int, height: int, tile: int = 256, chroma: str = "444") -> dict[str, int]:
    """Tiles and padded sizes of a frame and of its chroma planes."""
    sx, sy = CHROMA[chroma]
    tx, ty = ceil_div(width, tile), ceil_div(height, tile)
    cw, ch = ceil_div(width, 1 << sx), ceil_div(height, 1 << sy)
    ctx, cty = ceil_div(cw, tile), ceil_div(ch, tile)
    return {
        "tiles_x": tx, "tiles_y": ty, "padded_width": tx * tile, "padded_height": ty * tile, "chroma_width": cw, "chroma_height": ch,
        "chroma_tiles_x": ctx, "chroma_tiles_y": cty, "chroma_padded_width": ctx * tile, "chroma_padded_height": cty * tile, "tiles": tx * ty + 2 * ctx * cty,
    }


def num_subbands(levels: int) -> int:
    return 1 + 3 * levels


def subband_index(x: Column, y: Column, tile: int, levels: int) -> Column:
    """0 for the low band; 1 to 3 for the finest level's bottom left, top right and both, 4 to 6 for the next, and so on."""
    out, cases = F.lit(0), []
    for level in range(levels):
        half = (tile >> level) // 2
        first = 1 + 3 * level
        cases.append((half, first))
    for half, first in reversed(cases):
        out = F.when((x >= half) & (y >= half), first + 2).when(x >= half, first + 1).when(y >= half, first).otherwise(out)
    return out.cast("long")


def subband_group(x: Column, y: Column, tile: int, levels: int) -> Column:
    """Coarser bands of the entropy coders: 0 low, 1 deepest detail, then for each finer level its edges and its corner."""
    out = F.lit(0)
    for level in range(levels - 1, -1, -1):
        half, depth = (tile >> level) // 2, levels - 1 - level
        edges = 1 if depth == 0 else 2 * depth
        corner = 1 if depth == 0 else 2 * depth + 1
        out = F.when((x >= half) & (y >= half), corner).when((x >= half) | (y >= half), edges).otherwise(out)
    return out.cast("long")


def ll_block(x: Column, y: Column, tile: int, levels: int, block: int) -> tuple[Column, Column]:
    """Block of the low band that a coefficient's place corresponds to."""
    size = tile >> levels
    bx, by = F.lit(0), F.lit(0)
    whole = max(1, size // block)
    bx = F.floor(F.least(x, F.lit(size - 1)) / block)
    by = F.floor(F.least(y, F.lit(size - 1)) / block)
    for level in range(levels - 1, -1, -1):
        half = (tile >> level) // 2
        scale = half // size  # band samples for each low-band sample
        inside = lambda v, h=half, s=scale: F.floor(F.when(v >= h, v - h).otherwise(v) / s)
        here = (x >= half) | (y >= half)
        bx = F.when(here, F.floor(inside(x) / block)).otherwise(bx)
        by = F.when(here, F.floor(inside(y) / block)).otherwise(by)
    return F.least(bx, F.lit(whole - 1)).cast("long"), F.least(by, F.lit(whole - 1)).cast("long")


def mv_scale(v: Column, shift: int) -> Column:
    """Motion vector at a coarser scale: an arithmetic shift, which floors."""
    return F.shiftright(v.cast("int"), shift)
