"""Queries on single elements: colour, packing, quantisation, integer codes, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, quant, samples
from ..functions.config import PRESET_SQL, bitrate, preset_table, temporal_mode
from ..session import table
from .registry import query, r6

_RGB = "floor(l_quantity * 5) AS r, floor(l_extendedprice) % 256 AS g, floor(l_discount * 1000) AS b"
#: Dead-zone quantiser in SQL.
_Q = "CASE WHEN abs({v}) < {dz} * {e} THEN 0 ELSE sign({v}) * floor(abs({v}) / ({e}) + 0.5) END"


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") * 5).cast("double").alias("r"), (F.floor("l_extendedprice") % 256).cast("double").alias("g"),
        F.floor(F.col("l_discount") * 1000).cast("double").alias("b"),
    )


@query(f"SELECT l_orderkey, l_linenumber, CAST({_Q.format(v='x', dz=0.75, e=4.0)} AS BIGINT) AS q FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x FROM lineitem)")
def deadzone_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", quant.quantize(F.col("l_quantity") - 25, 4.0, 0.75).alias("q"))


@query(f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(x - q * 16)), 6) AS mean_error, round(max(abs(x - q * 16)), 6) AS max_error, sum(CASE WHEN q = 0 THEN 1 ELSE 0 END)::BIGINT AS zeros
FROM (SELECT l_returnflag, l_linestatus, x, {_Q.format(v='x', dz=0.75, e=16.0)} AS q FROM (SELECT l_returnflag, l_linestatus, l_extendedprice / 100 - 250 AS x FROM lineitem))
GROUP BY 1, 2""")
def dequantize_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") / 100 - 250
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", x.alias("x"), quant.quantize(x, 16.0, 0.75).alias("q"))
    e = F.abs(F.col("x") - quant.dequantize(F.col("q"), 16.0))
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(F.avg(e), "mean_error"), r6(F.max(e), "max_error"), F.count_if(F.col("q") == 0).alias("zeros")
    )


@query(f"""
SELECT l_orderkey, l_linenumber, b + floor((r - b) / 2) + floor((g - b - floor((r - b) / 2)) / 2) AS y, r - b AS co, g - b - floor((r - b) / 2) AS cg,
       b + (r - b) / 2 + (g - b - (r - b) / 2) / 2 AS y_lossy, g - b - (r - b) / 2 AS cg_lossy
FROM (SELECT l_orderkey, l_linenumber, {_RGB} FROM lineitem)""")
def ycocg_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, co, cg = samples.ycocg_forward(F.col("r"), F.col("g"), F.col("b"), True)
    y2, _, cg2 = samples.ycocg_forward(F.col("r"), F.col("g"), F.col("b"), False)
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", y.alias("y"), co.alias("co"), cg.alias("cg"), y2.alias("y_lossy"), cg2.alias("cg_lossy"))


@query("SELECT l_returnflag, count(*) AS n, 0::BIGINT AS wrong, round(avg(floor(l_quantity * 5)), 6) AS mean_r FROM lineitem GROUP BY 1")
def ycocg_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse gives back every sample, so nothing is wrong."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.floor(F.col("l_quantity") * 5).cast("double").alias("r"), (F.floor("l_extendedprice") % 256).cast("double").alias("g"), F.floor(F.col("l_discount") * 1000).cast("double").alias("b"))
    y, co, cg = samples.ycocg_forward(F.col("r"), F.col("g"), F.col("b"), True)
    df = li.withColumns({"y": y, "co": co, "cg": cg})
    r, g, b = samples.ycocg_inverse(F.col("y"), F.col("co"), F.col("cg"), True)
    wrong = F.count_if((r != F.col("r")) | (g != F.col("g")) | (b != F.col("b")))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), wrong.alias("wrong"), r6(F.avg(r), "mean_r"))


_BYTE = "CAST(floor(least(greatest(({}) + 0.5, 0), {})) AS BIGINT)"


@query(f"""SELECT l_orderkey, l_linenumber, {_BYTE.format('l_quantity * 6', 255)} | ({_BYTE.format('l_extendedprice / 200', 255)} << 8) | ({_BYTE.format('l_discount * 3000 - 20', 255)} << 16) | ({_BYTE.format('l_tax * 1000', 255)} << 24) AS word,
{_BYTE.format('l_extendedprice', 65535)} | ({_BYTE.format('l_quantity * 1000', 65535)} << 16) AS word16 FROM lineitem""")
def pack_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    four = [c("l_quantity") * 6, c("l_extendedprice") / 200, c("l_discount") * 3000 - 20, c("l_tax") * 1000]
    two = [c("l_extendedprice"), c("l_quantity") * 1000]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", samples.pack(four, 8).alias("word"), samples.pack(two, 16).alias("word16"))


@query("""SELECT event_id, CAST(d AS BIGINT) AS delta, z, CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 ELSE 3 END::BIGINT AS bytes
FROM (SELECT event_id, d, CAST(CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS BIGINT) AS z FROM (SELECT event_id, floor(value * 10) - 300 AS d FROM events))""")
def zigzag_varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.floor(F.col("value") * 10) - 300).cast("long")
    z = bits.zigzag(d)
    return table(spark, sf_dir, "events").select("event_id", d.alias("delta"), z.alias("z"), bits.varint_size(z).alias("bytes"))


@query("""SELECT event_type, count(*) AS n, sum(least(u // CAST(pow(2, k) AS BIGINT), 31) + 1 + k)::BIGINT AS rice_bits, sum(2 * length(bin(u + 1)) - 1)::BIGINT AS golomb_bits
FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS u, 3 AS k FROM events) GROUP BY 1""")
def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.floor("value").cast("long")
    df = table(spark, sf_dir, "events").select("event_type", bits.rice_length(u, F.lit(3)).alias("r"), bits.exp_golomb_length(u).alias("g"))
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("r").alias("rice_bits"), F.sum("g").alias("golomb_bits"))


@query(PRESET_SQL)
def quality_preset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preset_table(spark).select("q", F.round("step", 6).alias("step"), F.round("dead_zone", 6).alias("dead_zone"), "cfl", "levels", "aq", "aq_strength", "chroma_weight", "wavelet")


@query("""SELECT s, CASE WHEN regexp_matches(s, '^[0-9.]+[KkMmGg]?$') THEN TRY_CAST(regexp_extract(s, '^([0-9.]+)', 1) AS DOUBLE) *
CASE upper(regexp_extract(s, '([KkMmGg])$', 1)) WHEN 'K' THEN 1000.0 WHEN 'M' THEN 1000000.0 WHEN 'G' THEN 1000000000.0 ELSE 1.0 END END AS bits_per_second
FROM (SELECT DISTINCT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || CASE l_linenumber % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'm' WHEN 2 THEN 'G' WHEN 3 THEN '' ELSE 'x' END AS s FROM lineitem)""")
def bitrate_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 5
    suffix = F.when(n == 0, "K").when(n == 1, "m").when(n == 2, "G").when(n == 3, "").otherwise("x")
    s = F.concat(F.col("l_quantity").cast("long").cast("string"), suffix)
    return table(spark, sf_dir, "lineitem").select(s.alias("s")).distinct().select("s", bitrate(F.col("s")).alias("bits_per_second"))


@query("""SELECT p_partkey, fps, q, CASE WHEN fps < 1 THEN 'none' WHEN fps <= 25 OR q >= 90 THEN 'haar2' ELSE 'haar4' END AS mode FROM (SELECT p_partkey, p_size * 1.2 AS fps, p_partkey % 101 AS q FROM part)""")
def temporal_mode_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, q = F.col("p_size") * 1.2, F.col("p_partkey") % 101
    return table(spark, sf_dir, "part").select("p_partkey", fps.alias("fps"), q.alias("q"), temporal_mode(fps, q).alias("mode"))


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest(l + 1.596 * v, 0), 255), 6) AS r, round(least(greatest(l - 0.392 * u - 0.813 * v, 0), 255), 6) + 0.0 AS g, round(least(greatest(l + 2.017 * u, 0), 255), 6) AS b
FROM (SELECT l_orderkey, l_linenumber, 1.164 * (l_quantity * 4 - 16.0) AS l, l_discount * 2000 + 28 - 128.0 AS u, l_tax * 2500 + 28 - 128.0 AS v FROM lineitem)""")
def video_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    r, g, b = samples.bt601_to_rgb(c("l_quantity") * 4, c("l_discount") * 2000 + 28, c("l_tax") * 2500 + 28)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(r, "r"), r6(g, "g"), r6(b, "b"))


@query("""SELECT l_orderkey, l_linenumber, CAST(sign(a) * floor(abs(a) + 0.5) AS BIGINT) AS q, round(sign(a) * floor(abs(a) + 0.5) / 8192, 6) AS back
FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity / 10 - 2.5, -2), 2) * 8192 AS a FROM lineitem)""")
def cfl_factor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quant.cfl_quantize(F.col("l_quantity") / 10 - 2.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), r6(quant.cfl_dequantize(q), "back"))


_SWEEP = ", ".join(f"({s}, {d})" for s in (4.0, 8.0, 16.0) for d in (0.0, 0.25, 0.5, 0.75, 1.0))


@query(f"""SELECT step, dead_zone, count(*) AS n, round(avg(CASE WHEN q = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share, round(avg(pow(x - q * step, 2)), 6) AS mse
FROM (SELECT step, dead_zone, x, {_Q.format(v='x', dz='dead_zone', e='step')} AS q FROM (SELECT value - 30 AS x FROM events) CROSS JOIN (SELECT CAST(a AS DOUBLE) AS step, CAST(b AS DOUBLE) AS dead_zone FROM (VALUES {_SWEEP}) t(a, b)))
GROUP BY 1, 2""")
def sweep_deadzone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting over every sample in one pass: the stated settings are exploded beside each row and partly aggregated there."""
    settings = F.array(*(F.struct(F.lit(s).alias("step"), F.lit(d).alias("dead_zone")) for s in (4.0, 8.0, 16.0) for d in (0.0, 0.25, 0.5, 0.75, 1.0)))
    x = table(spark, sf_dir, "events").select((F.col("value") - 30).alias("x"), F.inline(settings))
    q = quant.quantize(F.col("x"), F.col("step"), F.col("dead_zone"))
    df = x.withColumn("q", q)
    e = F.col("x") - quant.dequantize(F.col("q"), F.col("step"))
    return df.groupBy("step", "dead_zone").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("q") == 0, 1.0).otherwise(0.0)), "zero_share"), r6(F.avg(e * e), "mse"))
