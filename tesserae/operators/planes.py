"""Planes as long rows (keys, x, y, value): padding, tiles, resampling, filters, gathers.

Neighbourhoods are found by moving rows to the places that need them and aggregating, so each is one shuffle by place and
grows in proportion; nothing joins a plane with itself by inequality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pad(df: DataFrame, width: int, height: int, tile: int, value: str = "v") -> DataFrame:
    """Repeats the last column and row out to whole tiles: each edge row yields its copies."""
    w, h = -(-width // tile) * tile, -(-height // tile) * tile
    reach = lambda c, last, to: F.when(F.col(c) == last, F.sequence(F.lit(last).cast("long"), F.lit(to - 1).cast("long"))).otherwise(F.array(F.col(c).cast("long")))
    rest = [c for c in df.columns if c not in ("x", "y")]
    df = df.select(*rest, F.explode(reach("x", width - 1, w)).alias("x"), "y")
    return df.select(*rest, "x", F.explode(reach("y", height - 1, h)).alias("y"))


def crop(df: DataFrame, width: int, height: int) -> DataFrame:
    return df.where((F.col("x") < width) & (F.col("y") < height))


def tile_place(df: DataFrame, tile: int, tiles_x: int) -> DataFrame:
    """Adds tile_idx and lx, ly, the place within the tile."""
    tx, ty = F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)
    return df.withColumns({"tile_idx": (ty * tiles_x + tx).cast("long"), "lx": F.col("x") % tile, "ly": F.col("y") % tile})


def to_tiles(df: DataFrame, keys: list[str], tile: int, value: str = "v") -> DataFrame:
    """(keys, tile_idx, data): one array a tile, row by row."""
    at = F.col("ly") * tile + F.col("lx")
    return df.groupBy(*keys, "tile_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("p"), F.col(value).alias("v")))), lambda s: s["v"]).alias("data"))


def from_tiles(df: DataFrame, keys: list[str], tile: int, tiles_x: int) -> DataFrame:
    """Tiles back to (keys, x, y, v)."""
    out = df.select(*keys, "tile_idx", F.posexplode("data").alias("p", "v"))
    x = (F.col("tile_idx") % tiles_x) * tile + F.col("p") % tile
    y = F.floor(F.col("tile_idx") / tiles_x) * tile + F.floor(F.col("p") / tile)
    return out.select(*keys, x.cast("long").alias("x"), y.cast("long").alias("y"), "v")


def downsample(df: DataFrame, keys: list[str], fx: int, fy: int, value: str = "v") -> DataFrame:
    """Means of boxes of fx by fy."""
    x, y = F.floor(F.col("x") / fx).cast("long").alias("x"), F.floor(F.col("y") / fy).cast("long").alias("y")
    return df.groupBy(*keys, x, y).agg(F.avg(value).alias(value))


def upsample(df: DataFrame, fx: int, fy: int) -> DataFrame:
    """Each sample fills a box of fx by fy."""
    rest = [c for c in df.columns if c not in ("x", "y")]
    box = F.array(*(F.struct((F.col("x") * fx + i).alias("x"), (F.col("y") * fy + j).alias("y")) for j in range(fy) for i in range(fx)))
    return df.select(*rest, F.inline(box))


def spread_vectors(df: DataFrame, by: int = 4) -> DataFrame:
    """Vectors of a coarse grid for the finer one: each fills by x by blocks, and is by times as long."""
    return upsample(df.withColumns({"dx": F.col("dx") * by, "dy": F.col("dy") * by}), by, by)


def coarser_vectors(df: DataFrame) -> DataFrame:
    """The top left vector of each two by two blocks."""
    return df.where("x % 2 = 0 and y % 2 = 0").withColumns({"x": F.floor(F.col("x") / 2).cast("long"), "y": F.floor(F.col("y") / 2).cast("long")})


_RING = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)]


def _around(df: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """Every row at its own place and the eight around it; places that are none of the plane's are dropped later."""
    to = F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), F.lit(i == 0 and j == 0).alias("_own")) for i, j in _RING))
    return df.select(*keys, *value, F.inline(to))


def box3(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Mean of the up to nine samples around each place."""
    g = _around(df, keys, [value]).groupBy(*keys, "x", "y").agg(F.avg(value).alias(value), F.max("_own").alias("_own"))
    return g.where("_own").drop("_own")


def median3_vectors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Component-wise median of the nine vectors around each inner block; edge blocks keep theirs."""
    g = _around(df, keys, ["dx", "dy"]).groupBy(*keys, "x", "y").agg(
        F.sort_array(F.collect_list("dx")).alias("a"), F.sort_array(F.collect_list("dy")).alias("b"), F.max(F.when(F.col("_own"), F.struct("dx", "dy"))).alias("own")
    )
    mid = lambda c, own: F.when(F.size(c) == 9, F.get(c, F.lit(4))).otherwise(F.col(f"own.{own}"))
    return g.where("own is not null").select(*keys, "x", "y", mid("a", "dx").alias("dx"), mid("b", "dy").alias("dy"))


def deblock(df: DataFrame, keys: list[str], tile: int, step: float, value: str = "v") -> DataFrame:
    """Smooths the two samples on either side of tile edges, along rows, then along columns; strong edges (over two steps) stay."""
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*keys, across).orderBy(along)
        v = F.col(value)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        at = F.col(along) % tile
        right, left = (at == 0) & (F.col(along) > 0), (at == tile - 1) & after.isNotNull()
        flat_r, flat_l = F.abs(before - v) <= 2 * step, F.abs(v - after) <= 2 * step
        smooth_r = (before + 2 * v + F.coalesce(after, v)) / 4
        smooth_l = (F.coalesce(before, v) + 2 * v + after) / 4
        df = df.withColumn(value, F.when(right & flat_r, smooth_r).when(left & flat_l, smooth_l).otherwise(v))
    return df


def motion_compensate(reference: DataFrame, vectors: DataFrame, keys: list[str], width: int, height: int, block: int, value: str = "v") -> DataFrame:
    """(keys, x, y, p): prediction of every sample from the reference by its block's vector in quarter samples.

    Samples are bilinear between the four around the place, clamped to the plane. The block's vectors join its samples, each
    sample asks for its four neighbours, and those join the reference by place.
    """
    grid = F.explode(F.sequence(F.lit(0), F.lit(block * block - 1)))
    at = vectors.select(*keys, "dx", "dy", F.col("x").alias("bx"), F.col("y").alias("by"), grid.alias("i"))
    at = at.withColumns({"x": F.col("bx") * block + F.col("i") % block, "y": F.col("by") * block + F.floor(F.col("i") / block)}).where((F.col("x") < width) & (F.col("y") < height))
    fx, fy = F.col("x") + F.col("dx") / 4.0, F.col("y") + F.col("dy") / 4.0
    hold = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("long")
    corners = []
    for j in (0, 1):
        for i in (0, 1):
            wx = fx - F.floor(fx) if i else 1 - (fx - F.floor(fx))
            wy = fy - F.floor(fy) if j else 1 - (fy - F.floor(fy))
            corners.append(F.struct(hold(F.floor(fx) + i, width).alias("rx"), hold(F.floor(fy) + j, height).alias("ry"), (wx * wy).alias("w")))
    asked = at.select(*keys, "x", "y", F.inline(F.array(*corners))).where("w > 0")
    ref = reference.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("x").alias("rx2"), F.col("y").alias("ry2"), F.col(value).alias("r"))
    same = (F.col("rx") == F.col("rx2")) & (F.col("ry") == F.col("ry2"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return asked.join(ref, same).groupBy(*keys, "x", "y").agg(F.sum(F.col("w") * F.col("r")).alias("p"))


def bidirectional(forward: Column, backward: Column, mode: Column) -> Column:
    """Prediction by block mode: 0 forward, 1 backward, 2 their mean."""
    return F.when(mode == 0, forward).when(mode == 1, backward).otherwise((forward + backward) / 2)


def reference_picks(frames: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Joins each frame's forward and backward reference by their index in the pool; a missing index means 0 and 1."""
    side = lambda s: pool.select(*(F.col(k).alias(f"_{s}{k}") for k in keys), F.col("slot").alias(f"_{s}slot"), F.col("v").alias(f"{s}_v"))
    out = frames
    for s, default in (("fwd", 0), ("bwd", 1)):
        on = F.coalesce(F.col(f"{s}_ref"), F.lit(default)) == F.col(f"_{s}slot")
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{s}{k}"))
        out = out.join(side(s), on, "left").drop(f"_{s}slot", *(f"_{s}{k}" for k in keys))
    return out
