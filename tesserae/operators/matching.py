"""Block matching: bounded candidate sets, sums of absolute differences, smallest cost with an explicit tie key.

Candidates are exploded beside each sample (a stated, bounded set of moves), equi-joined with the reference by place and summed by
block and move, so partial sums are made before the shuffle and there is no join by inequality. Ties go to the smaller
(cost, |dx| + |dy|, dy, dx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d)


def tie_key(cost: Column, dx: Column, dy: Column) -> Column:
    return F.struct(cost.alias("cost"), (F.abs(dx) + F.abs(dy)).alias("far"), dy.alias("ky"), dx.alias("kx"))


def moves(reach: int, step: int = 1) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-reach, reach + 1, step) for dx in range(-reach, reach + 1, step)]


def block_match(current: DataFrame, reference: DataFrame, keys: list[str], block: int, offsets: list[tuple[int, int]], start: DataFrame | None = None, zero_bias: float = 0.0, sample: int = 1) -> DataFrame:
    """(keys, bx, by, dx, dy, sad): the best move of each block of the current plane into the reference.

    start: (keys, bx, by, dx, dy), around which offsets lie (two-stage searches); zero_bias is taken off the cost of the zero
    move; sample takes every so-maniest sample both ways. Moves that leave the reference at any sample are out.
    """
    cur = current.select(*keys, F.floor(F.col("x") / block).cast("long").alias("bx"), F.floor(F.col("y") / block).cast("long").alias("by"), "x", "y", "v")
    if sample > 1:
        cur = cur.where(f"x % {sample} = 0 and y % {sample} = 0")
    if start is not None:
        cur = cur.join(start.select(*keys, "bx", "by", F.col("dx").alias("sx"), F.col("dy").alias("sy")), [*keys, "bx", "by"])
    else:
        cur = cur.withColumns({"sx": F.lit(0), "sy": F.lit(0)})
    each = F.inline(F.array(*(F.struct((F.col("sx") + i).cast("long").alias("dx"), (F.col("sy") + j).cast("long").alias("dy")) for i, j in offsets)))
    asked = cur.select(*keys, "bx", "by", "x", "y", "v", each).withColumns({"rx": F.col("x") + F.col("dx"), "ry": F.col("y") + F.col("dy")})
    ref = reference.select(*keys, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("v").alias("r"))
    met = asked.join(ref, [*keys, "rx", "ry"], "left")
    costs = met.groupBy(*keys, "bx", "by", "dx", "dy").agg(F.sum(F.abs(F.col("v") - F.col("r"))).alias("sad"), F.count_if(F.col("r").isNull()).alias("out"))
    cost = F.col("sad") - F.when((F.col("dx") == 0) & (F.col("dy") == 0), zero_bias).otherwise(0.0)
    best = F.min_by(F.struct("dx", "dy", "sad"), tie_key(cost, F.col("dx"), F.col("dy"))).alias("best")
    return costs.where("out = 0").groupBy(*keys, "bx", "by").agg(best).select(*keys, "bx", "by", "best.*")


def two_stage(current: DataFrame, reference: DataFrame, keys: list[str], block: int, coarse: int = 32, stride: int = 4, fine: int = 4) -> DataFrame:
    """Coarse search on sampled blocks, then a fine one around its result, with a bias to the zero move."""
    first = block_match(current, reference, keys, block, moves(coarse, stride), sample=4)
    return block_match(current, reference, keys, block, moves(fine), start=first, zero_bias=2.0 * block * block / 8)


def bidir_choice(forward: Column, backward: Column, mean: Column) -> tuple[Column, Column]:
    """Mode (0 forward, 1 backward, 2 both) and cost of the cheapest prediction; ties keep the earlier."""
    best = F.least(F.struct(forward.alias("c"), F.lit(0).alias("m")), F.struct(backward.alias("c"), F.lit(1).alias("m")), F.struct(mean.alias("c"), F.lit(2).alias("m")))
    return best["m"].cast("long"), best["c"]


def split_choice(whole: Column, halves_h: Column, halves_v: Column, quarters: Column, lam: Column) -> tuple[Column, Column]:
    """Partition (0 whole, 1 and 2 halves, 3 quarters) and cost of a block: splits pay for their vectors, ties keep the earlier."""
    costs = (whole, halves_h + 4 * lam, halves_v + 4 * lam, quarters + F.greatest(lam, whole / 4))
    best = F.least(*(F.struct(c.alias("c"), F.lit(i).alias("m")) for i, c in enumerate(costs)))
    return best["m"].cast("long"), best["c"]


#: Block sizes of the diagnostic and their vector cost in units of lambda (fixed values).
SIZES = (("8x8", 8.0), ("8x16", 4.0), ("16x8", 4.0), ("16x16", 2.0), ("32x32", 2.0))


def size_choice(costs: list[Column], lam: float) -> Column:
    """Name of the cheapest of the five block sizes by summed differences and vector cost."""
    best = F.least(*(F.struct((c + lam * w).alias("c"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, ((n, w), c) in enumerate(zip(SIZES, costs, strict=True))))
    return best["n"]


def intra_modes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bx, by, mode, sad): best of mean, left column, upper row and diagonal prediction of 8x8 blocks from original neighbours.

    blocks: (keys, bx, by, a), arrays of 64. A missing neighbour counts as 128, the mean is of those there are; ties keep the lower
    mode. The neighbours come by equi-joins with the left, upper and upper right block.
    """
    left = blocks.select(*keys, (F.col("bx") + 1).alias("bx"), "by", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.get("a", r * 8 + 7)).alias("left"))
    above = blocks.select(*keys, "bx", (F.col("by") + 1).alias("by"), F.slice("a", 57, 8).alias("above"))
    corner = blocks.select(*keys, (F.col("bx") - 1).alias("bx"), (F.col("by") + 1).alias("by"), F.get("a", F.lit(56)).alias("corner"))
    df = blocks
    for side in (left, above, corner):
        df = df.join(side, [*keys, "bx", "by"], "left")
    none = F.array_repeat(F.lit(128.0), 8)
    empty = F.array().cast("array<double>")
    known = F.concat(F.coalesce("left", empty), F.coalesce("above", empty))
    total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
    behind = F.coalesce("corner", F.get("above", F.lit(7)), F.lit(128.0))
    df = df.withColumns({"mean": F.when(F.size(known) > 0, total / F.size(known)).otherwise(128.0), "left": F.coalesce("left", none), "above": F.coalesce("above", none), "corner": behind})
    place = F.sequence(F.lit(0), F.lit(63))
    row, col = (lambda i: F.floor(i / 8).cast("int")), (lambda i: (i % 8).cast("int"))
    along = lambda i: row(i) + col(i) + 1
    predictions = [
        F.transform(place, lambda i: F.col("mean")),
        F.transform(place, lambda i: F.get("left", row(i))),
        F.transform(place, lambda i: F.get("above", col(i))),
        F.transform(place, lambda i: F.when(along(i) < 8, F.get("above", along(i))).otherwise(F.col("corner"))),
    ]
    best = F.least(*(F.struct(sad(F.col("a"), p).alias("sad"), F.lit(m).cast("long").alias("mode")) for m, p in enumerate(predictions)))
    return df.select(*keys, "bx", "by", best.alias("b")).select(*keys, "bx", "by", "b.mode", "b.sad")
