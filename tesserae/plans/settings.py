"""Queries on rate steps, buffers, durations, parsers, padding and packed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config, quant, samples
from ..operators import ordered, planes
from ..session import table
from .registry import SAMPLES, query, r6
from .registry import samples as sample_rows


@query("SELECT p_partkey, round(least(greatest(pow(2.6 / (p_size / 10.0), 1 / 1.2), 0.5), 128), 6) AS step FROM part")
def rate_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step that the initial rate model gives for a target."""
    step = quant.step_for_rate(F.col("p_size") / 10.0, 2.6, 1.2)
    return table(spark, sf_dir, "part").select("p_partkey", r6(step, "step"))


@query("""SELECT p_partkey, round(CASE WHEN fill > 1 - e THEN 1 / (1 + (fill - (1 - e)) / e * w) WHEN fill < e THEN 1 + (e - fill) / e * w ELSE 1 END, 6) AS factor FROM
(SELECT p_partkey, (p_partkey % 101) / CAST(100 AS DOUBLE) AS fill, CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 0.1 END::DOUBLE AS e, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0.3 END::DOUBLE AS w FROM part)""")
def buffer_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor on the step by buffer fill, in both modes."""
    mode = F.when(F.col("p_partkey") % 2 == 0, "cbr").otherwise("vbr")
    return table(spark, sf_dir, "part").select("p_partkey", r6(quant.vbv_adjustment(F.col("p_partkey") % 101 / 100.0, mode), "factor"))


@query("""SELECT p_partkey, round(CASE WHEN num = 0 THEN 0 ELSE p_size * den / CAST(num AS DOUBLE) END, 6) AS seconds, round(CASE WHEN den = 0 THEN 0 ELSE num / CAST(den AS DOUBLE) END, 6) AS fps
FROM (SELECT p_partkey, p_size, p_partkey % 4 * 10 AS num, p_partkey % 3 AS den FROM part)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    num, den = F.col("p_partkey") % 4 * 10, F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", r6(ordered.duration(F.col("p_size"), num, den), "seconds"), r6(ordered.frame_rate(num, den), "fps"))


_WORDS = ("CBR", "vbr", "Haar", "53", "9/7", "yuv4:2:0", "444", "none", "x", "97", "LeGall53")
_LIST = ", ".join(f"'{w}'" for w in _WORDS)


@query(f"""SELECT s, CASE WHEN l IN ('cbr', 'vbr') THEN l END AS rate, CASE WHEN l IN ('none', 'haar', 'auto') THEN l WHEN l IN ('53', 'legall53', '5/3') THEN '5/3' END AS temporal,
CASE WHEN l IN ('53', '5/3', 'legall53', 'legall') THEN '5/3' WHEN l IN ('97', '9/7', 'cdf97', 'cdf') THEN '9/7' END AS wavelet,
CASE WHEN replace(replace(l, 'yuv', ''), ':', '') IN ('444', '422', '420') THEN replace(replace(l, 'yuv', ''), ':', '') END AS chroma FROM (SELECT s, lower(s) AS l FROM (SELECT unnest([{_LIST}]) AS s))""")
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, _WORDS))).alias("s"))
    return words.select("s", config.rate_mode(s).alias("rate"), config.temporal_kind(s).alias("temporal"), config.wavelet_kind(s).alias("wavelet"), config.chroma_kind(s).alias("chroma"))


@query(f"""SELECT vec_id, tile_idx, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM
(SELECT s.vec_id, CAST(py // 5 * 2 + px // 5 AS BIGINT) AS tile_idx, s.v FROM {SAMPLES} s, (SELECT unnest(range(10)) AS px), (SELECT unnest(range(10)) AS py) WHERE least(px, 7) = s.x AND least(py, 7) = s.y) GROUP BY 1, 2""")
def padded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes padded to whole tiles by their last samples, and cut into tiles."""
    wide = planes.pad(sample_rows(spark, sf_dir).select("vec_id", "x", "y", "v"), 8, 8, 5)
    return planes.tile_place(wide, 5, 2).groupBy("vec_id", "tile_idx").agg(F.count("*").alias("n"), r6(F.sum("v"), "total"))


@query("""SELECT l_orderkey, l_linenumber, (CAST(least(greatest(a, -32768), 32767) AS BIGINT) & 65535) | ((CAST(least(greatest(b, -32768), 32767) AS BIGINT) & 65535) << 16) AS word
FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) - 30000 AS a, -floor(l_quantity) AS b FROM lineitem)""")
def pack_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = samples.pack_i16(F.floor("l_extendedprice") - 30000, -F.floor("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", word.alias("word"))
