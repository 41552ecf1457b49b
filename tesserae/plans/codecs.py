"""Queries that run coders and codecs over blocks taken as frames; bytes have no SQL, so tests hold them against identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quant
from ..operators import codec, containers, intra, matching, sweeps, tiles
from ..operators.coders import CODERS, huffman
from ..session import table
from ..streaming import rate
from .registry import query, series

_SIDE = 32


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, frame_idx, width, height, rgb): sixteen blocks of one label side by side are a frame; the last block of a label is repeated to fill its last frame."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").select("label", (F.row_number().over(w) - 1).alias("n"), "embedding")
    at = F.floor(F.col("n") / 16).cast("long")
    g = e.groupBy(F.col("label").cast("long").alias("seq_id"), at.alias("frame_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "embedding"))), lambda s: s["embedding"]).alias("e"))

    def pixel(i):
        y, x = F.floor(i / _SIDE).cast("int"), (i % _SIDE).cast("int")
        block = F.get("e", F.least(F.floor(y / 8).cast("int") * 4 + F.floor(x / 8).cast("int"), F.size("e") - 1))
        v = F.round(F.get(block, (y % 8) * 8 + x % 8).cast("double") * 100)
        return F.array(v + 128, F.floor(v / 2) + 128, F.lit(128.0))

    rgb = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_SIDE * _SIDE - 1)), pixel))
    side = F.lit(_SIDE)
    return g.select("seq_id", "frame_idx", side.alias("width"), side.alias("height"), rgb.alias("rgb"))


def _index_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.select("seq_id", "frame_idx", F.transform(_luma(), lambda v: quant.quantize(v - 128, 6.0, 0.75).cast("int")).alias("data"))


def _luma():
    """Every third sample; held, as the samples would be computed anew for each place otherwise."""
    place = F.sequence(F.lit(0), F.lit(_SIDE * _SIDE - 1))
    return quant.let(F.col("rgb"), lambda rgb: F.transform(place, lambda i: F.get(rgb, i * 3)))


@query()
def coder_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every tile under every coder, and whether it comes back."""
    t = _index_tiles(spark, sf_dir)
    parts = [tiles.round_trip(t, name, _SIDE, 2).select("seq_id", "frame_idx", F.lit(name).alias("coder"), "bytes", "exact") for name in CODERS]
    return reduce(DataFrame.unionByName, parts)


@query()
def damaged_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth tile is damaged on purpose, found by its checksum and replaced by zeros."""
    t = tiles.encode(_index_tiles(spark, sf_dir), "rans_bands", _SIDE, 2)
    hurt = F.when(F.col("frame_idx") % 5 == 0, F.concat(F.col("blob"), F.lit(b"\0"))).otherwise(F.col("blob"))
    t = tiles.checked(t.withColumn("blob", hurt))
    fixed = tiles.decode(tiles.substituted(t, "rans_bands", _SIDE, 2).drop("data"), "rans_bands")
    return fixed.select("seq_id", "frame_idx", "valid", F.forall("data", lambda x: x == 0).alias("zero"))


@query()
def codec_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and quality of every frame coded on its own at quality 75."""
    return codec.encode(frames(spark, sf_dir), 75, _SIDE).select("seq_id", "frame_idx", "bytes", F.round("bpp", 6).alias("bpp"), F.round("psnr", 4).alias("psnr"))


@query()
def codec_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of an independent and predicted frames at quality 75."""
    return codec.encode_sequences(frames(spark, sf_dir), 75, interval=4, tile=_SIDE).select("seq_id", "frame_idx", "kind", "bytes", F.round("psnr", 4).alias("psnr"))


@query()
def codec_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the temporal bands of groups of two frames."""
    t = codec.encode_temporal(frames(spark, sf_dir), 75, size=2, tile=_SIDE)
    return t.groupBy("seq_id", "role").agg(F.count("*").alias("n"), F.sum(F.octet_length("blob")).alias("bytes"))


@query()
def container_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a sequence file of every label's frames."""
    coded = codec.encode(frames(spark, sf_dir), 75, _SIDE)
    return containers.index_of_blobs(coded.select("seq_id", F.col("frame_idx").alias("pts"), F.lit("I").alias("kind"), "blob"), keys=("seq_id",))


@query()
def rate_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step and buffer of each user's series under rate control, as a fold over the sequence."""
    s = series(spark, sf_dir).select(F.col("user_id").alias("seq_id"), "pos", (F.col("value") / 10 + 0.1).alias("complexity"))
    return rate.controlled_batch(s, bitrate=3e6, fps=30.0, pixels=100_000).select("seq_id", "pos", F.round("step", 6).alias("step"), F.round("fill", 3).alias("fill"))


@query()
def huffman_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every magnitude by event type."""
    m = table(spark, sf_dir, "events").select("event_type", F.least(F.floor(F.col("value") / 4), F.lit(63)).cast("int").alias("m"))
    counts = m.groupBy("event_type", "m").agg(F.count("*").alias("n"))

    def run(key, pdf):
        import pandas as pd

        freq = [0] * 64
        for a, n in zip(pdf["m"], pdf["n"], strict=True):
            freq[a] = int(n)
        lengths = huffman.code_lengths(freq)
        return pd.DataFrame([(key[0], s, freq[s], n) for s, n in enumerate(lengths) if n], columns=["event_type", "m", "n", "bits"])

    return counts.groupBy("event_type").applyInPandas(run, "event_type string, m int, n long, bits int")


@query()
def codec_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label's frames in groups of nine, coded from both sides; the last group of a label may have fewer."""
    return codec.encode_sequences(frames(spark, sf_dir), 75, interval=9, tile=_SIDE).select("seq_id", "frame_idx", "kind", "bytes", F.round("psnr", 4).alias("psnr"))


@query()
def block_match_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move of each 8x8 block of every frame into the label's frame before, by a coarse and a fine search."""
    luma = frames(spark, sf_dir).select("seq_id", "frame_idx", F.posexplode(_luma()).alias("p", "v"))
    planes = luma.select("seq_id", "frame_idx", (F.col("p") % _SIDE).cast("long").alias("x"), F.floor(F.col("p") / _SIDE).alias("y"), "v")
    before = planes.withColumn("frame_idx", F.col("frame_idx") + 1)
    return matching.two_stage(planes.where("frame_idx > 0"), before, ["seq_id", "frame_idx"], 8, coarse=24)


@query()
def sweep_wavelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and quality of both wavelets at three steps."""
    s = sweeps.run(frames(spark, sf_dir), "wavelet", _SIDE)
    return s.select("settings", "frames", F.round("bpp", 6).alias("bpp"), F.round("psnr", 4).alias("psnr"))


@query()
def intra_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean magnitude of every tile before and after prediction from its neighbours."""
    p = intra.predicted(frames(spark, sf_dir).select("seq_id", "frame_idx", _luma().alias("data")), _SIDE)
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(c), 6)
    return p.select("seq_id", "frame_idx", mean("data").alias("before"), mean("residual").alias("after"), F.array_size(F.array_distinct("modes")).alias("modes"))
