"""Ordered sequences: scenes, groups of pictures, decode order, seek, offsets, runs, stability.

All take rows with key columns and pos, the place in the key's sequence; each is a window over the keys, so one sequence is
one task's sorted run, and sequences spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scene_segments(df: DataFrame, keys: list[str], threshold: float, value: str = "value") -> DataFrame:
    """Adds segment: the number of cuts (steps of more than threshold) so far."""
    w = Window.partitionBy(*keys).orderBy("pos")
    cut = F.abs(F.col(value) - F.lag(value).over(w)) > threshold
    return df.withColumn("cut", F.coalesce(cut, F.lit(False))).withColumn("segment", F.sum(F.col("cut").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: B frames of one group, which a P frame ends (fixed value).
B_FRAMES = 7


def assign_kinds(df: DataFrame, keys: list[str], interval: int) -> DataFrame:
    """Adds since (frames since the last key frame) and kind.

    Key frames (I) are those whose pos is a multiple of interval, and every segment's first. The frames up to the next one are cut
    into groups of B_FRAMES B frames and a P frame; what is left over is P. Intervals that hold no whole group have no B frames.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    first = F.col("segment") != F.lag("segment").over(w)
    key = F.coalesce(first, F.lit(True)) | (F.col("pos") % max(interval, 1) == 0)
    df = df.withColumn("_run", F.sum(key.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run")
    df = df.withColumns({"since": F.col("pos") - F.min("pos").over(run), "_left": F.count("*").over(run) - 1})
    group = B_FRAMES + 1
    whole = F.floor(F.col("_left") / group) * group
    inner = (F.col("since") <= whole) & (F.col("since") % group != 0) if interval > group else F.lit(False)
    return df.withColumn("kind", F.when(F.col("since") == 0, "I").when(inner, "B").otherwise("P")).drop("_run", "_left")


#: Display offset to coding rank of seven frames between anchors: the middle, then the quarters, then the rest (fixed values).
PYRAMID = (4, 2, 5, 1, 6, 3, 7)


def decode_order(df: DataFrame, keys: list[str], pyramid: bool) -> DataFrame:
    """Adds decode_pos: an anchor comes before the B frames that lead to it; seven of them go from coarse to fine if pyramid."""
    w = Window.partitionBy(*keys).orderBy("pos")
    b = F.col("kind") == "B"
    ahead = F.min(F.when(~b, F.col("pos"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"_b": b, "_next": ahead, "_isle": F.sum((~b).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    run = Window.partitionBy(*keys, "_isle", "_b")
    df = df.withColumns({"_first": F.min("pos").over(run), "_run": F.count("*").over(run)})
    at = F.col("pos") - F.col("_first") + 1
    coarse = F.element_at(F.array(*map(F.lit, PYRAMID)), F.least(at, F.lit(7)).cast("int"))
    rank = F.when(~F.col("_b"), 0).when(F.lit(pyramid) & (F.col("_run") == 7), coarse).otherwise(at)
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("_b"), F.coalesce("_next", F.lit(1 << 60))).otherwise(F.col("pos")), F.col("_b").cast("int"), rank)
    return df.withColumn("decode_pos", (F.row_number().over(order) - 1).cast("long")).drop("_b", "_next", "_isle", "_first", "_run")


def seek_keyframe(df: DataFrame, keys: list[str], is_key: Column) -> DataFrame:
    """Adds key_pos: the last key frame at or before each frame; 0 if there is none."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("key_pos", F.coalesce(F.max(F.when(is_key, F.col("pos"))).over(w), F.lit(0).cast("long")))


def seek_group(pts: Column, size: int, groups: Column) -> Column:
    """Group of a seek target, no further than the last."""
    return F.greatest(F.least(F.floor(pts / size), groups - 1), F.lit(0)).cast("long")


def temporal_groups(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Adds gop, role (group, or tail for frames left over) and seek_gop."""
    n = F.floor(F.count("*").over(Window.partitionBy(*keys)) / size)
    gop = F.floor(F.col("pos") / size).cast("long")
    return df.withColumns({"gop": gop, "role": F.when(gop < n, "group").otherwise("tail"), "seek_gop": seek_group(F.col("pos"), size, n)})


def cut_groups(df: DataFrame, keys: list[str], size: int, threshold: float, value: str = "value") -> DataFrame:
    """(keys, gop, cut, iframes) of whole groups: cut if neighbours within the group differ by more than threshold."""
    g = df.withColumn("gop", F.floor(F.col("pos") / size).cast("long"))
    w = Window.partitionBy(*keys, "gop").orderBy("pos")
    g = g.withColumn("d", F.abs(F.col(value) - F.lag(value).over(w)))
    out = g.groupBy(*keys, "gop").agg(F.coalesce(F.max(F.col("d") > threshold), F.lit(False)).alias("cut"), F.count("*").alias("c")).where(F.col("c") == size)
    return out.select(*keys, "gop", "cut", F.when(F.col("cut"), F.lit(size)).otherwise(1).cast("long").alias("iframes"))


def offsets(df: DataFrame, order: str, size: str, header: int, entry: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds offset: where each blob begins in a file of a header, an index entry for each blob and the blobs in order; a file for each of keys.

    Range partitions are summed first, and a window over that small table gives each partition's start, so that the
    running sum within a partition is all that a task does.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id())
    sums = parted.groupBy(*keys, "_part").agg(F.sum(size).alias("_sum"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    own = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.lit(header) + F.lit(entry) * F.col("_all") + F.col("_before")
    out = parted.join(F.broadcast(starts), [*keys, "_part"])
    return out.withColumn("offset", (first + F.coalesce(F.sum(size).over(own), F.lit(0))).cast("long")).drop("_part", "_before", "_all")


def runs(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys, first, run): islands of rows whose flag holds."""
    w = Window.partitionBy(*keys, flag).orderBy("pos")
    isle = F.col("pos") - F.row_number().over(w)
    return df.withColumn("_isle", isle).where(flag).groupBy(*keys, "_isle").agg(F.min("pos").alias("first"), F.count("*").alias("run")).drop("_isle")


def stability(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, extremes and spread of each sequence, its worst drop from one frame to the next and the spread of steps."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("pos"))
    return df.withColumn("_d", d).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("spread"),
        F.greatest(F.coalesce(F.max(-F.col("_d")), F.lit(0.0)), F.lit(0.0)).alias("worst_drop"), F.coalesce(F.stddev_pop("_d"), F.lit(0.0)).alias("delta_spread"),
    )


def duration(frames: Column, fps_num: Column, fps_den: Column) -> Column:
    return F.when(fps_num == 0, 0.0).otherwise(frames * fps_den / fps_num)


def frame_rate(fps_num: Column, fps_den: Column) -> Column:
    return F.when(fps_den == 0, 0.0).otherwise(fps_num / fps_den)
