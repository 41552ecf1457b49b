"""Tile coding over DataFrames: one row a tile in, one row a tile out, no shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coders import CODERS, zero_tile


def _apply(df: DataFrame, make, adds: str, uses: list[str]) -> DataFrame:
    """Adds the columns of adds to every row, computed by make(values of uses) -> tuple."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at, names = [df.columns.index(u) for u in uses], [x.split()[0] for x in adds.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in adds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [make(*v) for v in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return df.mapInArrow(run, f"{fields}, {adds}")


def encode(tiles: DataFrame, coder: str, size: int, levels: int) -> DataFrame:
    """Adds blob, size and crc to rows with data array<int>; a null tile counts as zeros."""

    def make(data):
        blob = CODERS[coder][1](np.zeros(size * size, np.int64) if data is None else np.array(data, np.int64), size, levels)
        return blob, len(blob), zlib.crc32(blob)

    return _apply(tiles, make, "blob binary, size long, crc long", ["data"])


def decode(tiles: DataFrame, coder: str) -> DataFrame:
    """Adds data array<int> to rows with blob."""
    return _apply(tiles, lambda blob: (CODERS[coder][2](blob).astype(np.int32),), "data array<int>", ["blob"])


def checked(tiles: DataFrame) -> DataFrame:
    """Adds valid: whether a blob has the checksum that its index gives."""
    return tiles.withColumn("valid", F.crc32("blob") == F.col("crc"))


def damaged(tiles: DataFrame) -> DataFrame:
    """Rows whose blob has not the checksum of its index."""
    return checked(tiles).where("not valid").drop("valid")


def substituted(tiles: DataFrame, coder: str, size: int, levels: int) -> DataFrame:
    """Damaged blobs replaced by tiles of zeros, which are joined as a literal."""
    zero = zero_tile(coder, size, levels)
    bad = F.crc32("blob") != F.col("crc")
    return tiles.withColumns({"blob": F.when(bad, F.lit(zero)).otherwise(F.col("blob")), "crc": F.when(bad, F.lit(zlib.crc32(zero))).otherwise(F.col("crc"))})


def round_trip(tiles: DataFrame, coder: str, size: int, levels: int) -> DataFrame:
    """Adds bytes and exact: the blob's length, and whether it decodes to its tile."""

    def make(data):
        q = np.array(data, np.int64)
        blob = CODERS[coder][1](q, size, levels)
        return len(blob), bool((CODERS[coder][2](blob) == q).all())

    return _apply(tiles, make, "bytes long, exact boolean", ["data"])


def skip_by_energy(tiles: DataFrame, threshold: float) -> DataFrame:
    """Tiles whose mean magnitude is under the threshold become zeros; 0 skips none."""
    mean = F.aggregate("data", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("data")
    return tiles.withColumn("data", F.when(mean < threshold, F.transform("data", lambda x: x * 0)).otherwise(F.col("data")))


def skip_by_motion(current: DataFrame, references: list[DataFrame], keys: list[str], step: float) -> DataFrame:
    """(keys, tile_idx, skip): whether a tile hardly differs from its reference, or from the mean of two, without motion."""
    joined = current.select(*keys, "tile_idx", "data")
    for i, r in enumerate(references):
        joined = joined.join(r.select(*keys, "tile_idx", F.col("data").alias(f"_r{i}")), [*keys, "tile_idx"])
    ref = F.col("_r0") if len(references) == 1 else F.zip_with("_r0", "_r1", lambda a, b: (a + b) / 2)
    mad = F.aggregate(F.zip_with("data", ref, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("data")
    return joined.select(*keys, "tile_idx", (mad < step / 2).alias("skip"))


def zero_by_map(tiles: DataFrame, skips: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles that the map names become zeros."""
    j = tiles.join(skips, [*keys, "tile_idx"], "left")
    return j.withColumn("data", F.when(F.coalesce("skip", F.lit(False)), F.transform("data", lambda x: x * 0)).otherwise(F.col("data"))).drop("skip")


def zero_by_sad(blocks: DataFrame, reference: Column, threshold: float) -> DataFrame:
    """Adds sad, the summed differences of data from the reference's samples, and makes data zeros where they are under the threshold."""
    gap = F.aggregate(F.zip_with("data", reference, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    out = blocks.withColumn("sad", gap)
    return out.withColumn("data", F.when(F.col("sad") < threshold, F.transform("data", lambda x: x * 0)).otherwise(F.col("data")))
