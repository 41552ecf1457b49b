"""Rate-distortion tables as CSV: columns are found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the benchmark table (fixed values).
BENCHMARK = (
    "name", "input", "width", "height", "tile_size", "qstep", "dead_zone", "psnr_db", "psnr_r", "psnr_g", "psnr_b", "ssim", "bpp", "compressed_bytes", "encode_ms", "decode_ms", "encode_fps",
    "decode_fps",
)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def points(spark: SparkSession, path: str) -> DataFrame:
    """(psnr, bpp) of a table, lossless rows with infinite psnr included; empty if a column is missing."""
    t = _table(spark, path)
    if not {"psnr", "bpp"} <= set(t.columns):
        return spark.createDataFrame([], "psnr double, bpp double")
    number = lambda c: F.when(F.lower(c) == "inf", float("inf")).otherwise(F.col(c).try_cast("double"))
    return t.select(number("psnr").alias("psnr"), number("bpp").alias("bpp")).where("psnr is not null and bpp is not null")


def curve(spark: SparkSession, path: str) -> DataFrame:
    """The same in order of psnr; a missing column is an error."""
    missing = {"psnr", "bpp"} - set(_table(spark, path).columns)
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    return points(spark, path).orderBy("psnr")


def write_benchmark(df: DataFrame, path: str) -> None:
    """Writes the benchmark table; columns that df lacks are empty."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in BENCHMARK)).write.csv(path, header=True, mode="overwrite")


def write_sequence(frames: DataFrame, path: str) -> None:
    """Writes (frame_idx, frame_type, psnr, ssim, bpp, encoded_bytes) and a row of their summary."""
    columns = ("frame_idx", "frame_type", "psnr", "ssim", "bpp", "encoded_bytes")
    rows = frames.select(F.col("frame_idx").cast("string"), "frame_type", F.round("psnr", 4).alias("psnr"), F.round("ssim", 6).alias("ssim"), F.round("bpp", 4).alias("bpp"), "encoded_bytes")
    total = frames.agg(F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"), F.avg("bpp").alias("bpp"), F.sum("encoded_bytes").alias("encoded_bytes"))
    total = total.select(F.lit("summary").alias("frame_idx"), F.lit("").alias("frame_type"), *(F.round(c, 4).alias(c) for c in ("psnr", "ssim", "bpp")), "encoded_bytes")
    rows.select(*columns).unionByName(total.select(*columns)).write.csv(path, header=True, mode="overwrite")


def union_codecs(*tables: DataFrame) -> DataFrame:
    """One table of several codecs' points; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def pooled_score(json: DataFrame, column: str = "value", metric: str = "vmaf") -> DataFrame:
    """(mean, min, max) of an external tool's pooled JSON result."""
    return json.select(*(F.get_json_object(column, f"$.pooled_metrics.{metric}.{k}").cast("double").alias(k) for k in ("mean", "min", "max")))
