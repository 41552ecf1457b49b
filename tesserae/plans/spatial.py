"""Queries on blocks and planes: transforms, subbands, weights, prediction, matching, filters, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, quant
from ..operators import matching, planes, transforms
from .registry import SAMPLES, blocks, query, r6, samples

_DCT = "(" + " + ".join(f"CASE k WHEN {k} THEN (" + " + ".join(f"({c!r}) * s[{i + 1}]" for i, c in enumerate(row)) + ") ELSE 0 END" for k, row in enumerate(transforms.dct_matrix(8))) + ")"
_H = "(" + " + ".join(f"CASE k WHEN {k} THEN (" + " + ".join(f"({c!r}) * s[{i + 1}]" for i, c in enumerate(row)) + ") ELSE 0 END" for k, row in enumerate(transforms.hadamard_matrix())) + ")"


def _both_ways(base: str, n: int, kernel: str) -> str:
    """Separable transform of (vec_id, x, y, v) in SQL: along rows, then along columns."""
    ks = f"(SELECT unnest(range({n})) AS k)"
    return f"""(SELECT vec_id, k0 AS x, CAST(k AS BIGINT) AS y, {kernel} AS c FROM (SELECT vec_id, k0, list(v ORDER BY y) AS s FROM
 (SELECT vec_id, y, CAST(k AS BIGINT) AS k0, {kernel} AS v FROM (SELECT vec_id, y, list(v ORDER BY x) AS s FROM {base} GROUP BY 1, 2), {ks}) GROUP BY 1, 2), {ks})"""


_DCT8 = _both_ways(SAMPLES, 8, _DCT)


@query(f"SELECT vec_id, x, y, round(c, 6) + 0.0 AS c FROM {_DCT8}")
def dct8_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = blocks(spark, sf_dir).select("vec_id", F.posexplode(transforms.dct(F.col("a"))).alias("p", "c"))
    return a.select("vec_id", (F.col("p") % 8).cast("long").alias("x"), F.floor(F.col("p") / 8).alias("y"), r6(F.col("c"), "c"))


@query(f"SELECT vec_id, x, y, round(c, 6) + 0.0 AS c FROM {_both_ways(f'(SELECT * FROM {SAMPLES} WHERE x < 4 AND y < 4)', 4, _H)}")
def hadamard4_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("a", r * 8 + 1, F.lit(4))))
    a = blocks(spark, sf_dir).select("vec_id", F.posexplode(transforms.hadamard4(quarter)).alias("p", "c"))
    return a.select("vec_id", (F.col("p") % 4).cast("long").alias("x"), F.floor(F.col("p") / 4).alias("y"), r6(F.col("c"), "c"))


_FOURS = f"(SELECT vec_id * 4 + y // 4 * 2 + x // 4 AS vec_id, x % 4 AS x, y % 4 AS y, v FROM {SAMPLES})"


@query(f'SELECT vec_id // 4 AS vec_id, vec_id % 2 AS bx, vec_id % 4 // 2 AS "by", x, y, round(c, 6) + 0.0 AS c FROM {_both_ways(_FOURS, 4, _H)}')
def hadamard4_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four 4x4 blocks (bx, by) of every 8x8 block; hadamard4_block has the first alone."""
    four = lambda bx, by: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("a", (r + 4 * by) * 8 + 4 * bx + 1, F.lit(4))))
    each = F.inline(F.array(*(F.struct(F.lit(bx).cast("long").alias("bx"), F.lit(by).cast("long").alias("by"), four(bx, by).alias("f")) for by in (0, 1) for bx in (0, 1))))
    a = blocks(spark, sf_dir).select("vec_id", each).select("vec_id", "bx", "by", F.posexplode(transforms.hadamard4(F.col("f"))).alias("p", "c"))
    return a.select("vec_id", "bx", "by", (F.col("p") % 4).cast("long").alias("x"), F.floor(F.col("p") / 4).alias("y"), r6(F.col("c"), "c"))


_BAND = "CASE WHEN x >= 4 AND y >= 4 THEN 3 WHEN x >= 4 THEN 2 WHEN y >= 4 THEN 1 WHEN x >= 2 AND y >= 2 THEN 6 WHEN x >= 2 THEN 5 WHEN y >= 2 THEN 4 ELSE 0 END"
_GROUP = "CASE WHEN x >= 4 AND y >= 4 THEN 3 WHEN x >= 4 OR y >= 4 THEN 2 WHEN x >= 2 OR y >= 2 THEN 1 ELSE 0 END"


@query(f"SELECT label, CAST({_BAND} AS BIGINT) AS band, CAST({_GROUP} AS BIGINT) AS grp, count(*) AS n, round(sum(v * v), 6) AS energy, round(avg(abs(v)), 6) AS mean_abs FROM {SAMPLES} GROUP BY 1, 2, 3")
def subband_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    s = s.withColumns({"band": geometry.subband_index(x, y, 8, 2), "grp": geometry.subband_group(x, y, 8, 2)})
    return s.groupBy("label", "band", "grp").agg(F.count("*").alias("n"), r6(F.sum(F.col("v") * F.col("v")), "energy"), r6(F.avg(F.abs("v")), "mean_abs"))


_VAR = f'(SELECT vec_id, x // 2 AS bx, y // 2 AS "by", var_pop(v) AS variance FROM {SAMPLES} GROUP BY 1, 2, 3)'


@query(f'SELECT vec_id, bx, "by", round(variance, 6) AS variance FROM {_VAR}')
def ll_block_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variances(spark, sf_dir).select("vec_id", "bx", "by", r6(F.col("variance"), "variance"))


def _variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    at = [F.floor(F.col(c) / 2).cast("long").alias(f"b{c}") for c in ("x", "y")]
    return s.groupBy("vec_id", *at).agg(F.var_pop("v").alias("variance"))


@query(f"""
WITH w AS (SELECT vec_id, bx, "by", least(greatest(1 + 0.15 * 0.2 * (8 - log2(1 + variance)), 0.5), 2) AS w FROM {_VAR}),
g AS (SELECT vec_id, bx, "by", least(greatest(w * exp(-avg(ln(w)) OVER (PARTITION BY vec_id)), 0.5), 2) AS w FROM w),
b AS (SELECT a.vec_id, a.bx, a."by", avg(n.w) AS w FROM g a JOIN g n ON a.vec_id = n.vec_id AND abs(a.bx - n.bx) <= 1 AND abs(a."by" - n."by") <= 1 GROUP BY 1, 2, 3)
SELECT vec_id, bx, "by", round(w * exp(-avg(ln(w)) OVER (PARTITION BY vec_id)), 6) AS w FROM b""")
def aq_weight_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights from variances: raw, by the geometric mean, smoothed over neighbours, by the geometric mean again."""
    w = Window.partitionBy("vec_id")
    even = lambda c: F.col(c) * F.exp(-F.avg(F.ln(c)).over(w))
    v = _variances(spark, sf_dir).select("vec_id", F.col("bx").alias("x"), F.col("by").alias("y"), quant.adaptive_weight(F.col("variance"), 0.2).alias("w"))
    v = v.withColumn("w", quant.clamp(even("w"), 0.5, 2.0))
    out = planes.box3(v, ["vec_id"], "w").withColumn("w", even("w"))
    return out.select("vec_id", F.col("x").alias("bx"), F.col("y").alias("by"), r6(F.col("w"), "w"))


_LI = "(SELECT l_suppkey, l_linenumber, l_orderkey, l_quantity AS luma, l_discount * 100 + l_quantity / 5 AS chroma FROM lineitem)"
_ALPHA = f"(SELECT l_suppkey, CASE WHEN sum(luma * luma) <= 1e-10 THEN 0 ELSE sum(luma * chroma) / sum(luma * luma) END AS alpha FROM {_LI} GROUP BY 1)"


def _planes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_suppkey", "l_linenumber", "l_orderkey", F.col("l_quantity").alias("luma"), (F.col("l_discount") * 100 + F.col("l_quantity") / 5).alias("chroma"))


def _alphas(df: DataFrame) -> DataFrame:
    yy = F.sum(F.col("luma") * F.col("luma"))
    return df.groupBy("l_suppkey").agg(F.when(yy <= 1e-10, 0.0).otherwise(F.sum(F.col("luma") * F.col("chroma")) / yy).alias("alpha"))


@query(f"SELECT l_suppkey, round(alpha, 6) AS alpha, CAST(floor(least(greatest(alpha, -2), 2) * 8192 + 0.5) AS BIGINT) AS code FROM {_ALPHA}")
def cfl_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _alphas(_planes_of(spark, sf_dir))
    return a.select("l_suppkey", r6(F.col("alpha"), "alpha"), quant.cfl_quantize(F.col("alpha")).alias("code"))


@query(f"""SELECT l_linenumber, count(*) AS n, round(avg(abs(chroma)), 6) AS before, round(avg(abs(chroma - code / 8192.0 * luma)), 6) AS after FROM {_LI}
JOIN (SELECT l_suppkey, CAST(floor(least(greatest(alpha, -2), 2) * 8192 + 0.5) AS DOUBLE) AS code FROM {_ALPHA}) USING (l_suppkey) GROUP BY 1""")
def cfl_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _planes_of(spark, sf_dir)
    a = _alphas(df).select("l_suppkey", quant.cfl_dequantize(quant.cfl_quantize(F.col("alpha"))).alias("a"))
    rest = F.abs(F.col("chroma") - F.col("a") * F.col("luma"))
    return df.join(a, "l_suppkey").groupBy("l_linenumber").agg(F.count("*").alias("n"), r6(F.avg(F.abs("chroma")), "before"), r6(F.avg(rest), "after"))


_ENERGY = f"(SELECT vec_id, avg(abs(v)) AS energy FROM {SAMPLES} GROUP BY 1)"


@query(f"""SELECT vec_id, round(energy, 6) AS energy, round(CASE WHEN energy <= 0.5 THEN 2.0 WHEN energy >= 10 THEN 1.2 ELSE 2.0 + (ln(energy) - ln(0.5)) / (ln(10.0) - ln(0.5)) * (1.2 - 2.0) END, 6) AS multiplier, round(max(energy) OVER (), 6) AS most FROM {_ENERGY}""")
def tile_energy_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.aggregate("a", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("a")
    b = blocks(spark, sf_dir).select("vec_id", e.alias("energy"))
    most = b.agg(F.max("energy").alias("most"))
    return b.join(F.broadcast(most)).select("vec_id", r6(F.col("energy"), "energy"), r6(quant.energy_multiplier(F.col("energy"), 2.0), "multiplier"), r6(F.col("most"), "most"))


@query(f"SELECT label, count(*) AS n, sum(CASE WHEN e < 9.8 THEN 1 ELSE 0 END)::BIGINT AS skipped, round(sum(CASE WHEN e < 9.8 THEN 0 ELSE v END), 6) AS kept FROM (SELECT label, v, avg(abs(v)) OVER (PARTITION BY vec_id) AS e FROM {SAMPLES}) GROUP BY 1")
def tile_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of little energy become zero, as one expression on the block's array."""
    e = F.aggregate("a", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("a")
    b = blocks(spark, sf_dir).withColumn("skip", e < 9.8)
    total = F.when(F.col("skip"), 0.0).otherwise(F.aggregate("a", F.lit(0.0), lambda s, x: s + x))
    return b.groupBy("label").agg(F.sum(F.size("a").cast("long")).alias("n"), F.sum(F.when(F.col("skip"), F.size("a")).otherwise(0).cast("long")).alias("skipped"), r6(F.sum(total), "kept"))


_PICK = "(SELECT a.vec_id, b.vec_id AS ref, sum(abs(a.v - b.v)) AS sad FROM {s} a JOIN {s} b ON a.x = b.x AND a.y = b.y AND a.label = b.label AND a.vec_id <> b.vec_id AND b.vec_id % 20 = 0 GROUP BY 1, 2)"


@query(f"SELECT vec_id, min_by(ref, sad * 1e6 // 1 * 1e6 + ref) AS ref, round(min(sad), 6) AS sad FROM {_PICK.format(s=SAMPLES)} GROUP BY 1")
def block_match_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of a stated reference set (every twentieth block of the same label) for each block, by summed differences."""
    b = blocks(spark, sf_dir)
    ref = b.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("ref"), F.col("a").alias("r"))
    costs = b.join(ref, "label").where("vec_id <> ref").select("vec_id", "ref", matching.sad(F.col("a"), F.col("r")).alias("sad"))
    return costs.groupBy("vec_id").agg(F.min_by("ref", F.struct("sad", "ref")).alias("ref"), r6(F.min("sad"), "sad"))


_NEAREST = "(SELECT a.vec_id, b.vec_id AS ref, round(sum(abs(a.v - b.v)), 6) AS sad FROM {s} a JOIN {s} b ON a.x = b.x AND a.y = b.y AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 GROUP BY 1, 2)"


@query(f"SELECT vec_id, ref, sad FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sad, ref) AS r FROM {_NEAREST.format(s=SAMPLES)}) WHERE r = 1")
def block_match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of all other blocks for every twentieth block, by summed differences; block_match_argmin has every twentieth block as candidates."""
    b = blocks(spark, sf_dir)
    asked = b.where("vec_id % 20 = 0").select("vec_id", F.col("a").alias("q"))
    ref = b.select(F.col("vec_id").alias("ref"), "a")
    costs = ref.crossJoin(F.broadcast(asked)).where("vec_id <> ref").select("vec_id", "ref", F.round(matching.sad(F.col("q"), F.col("a")), 6).alias("sad"))
    return costs.groupBy("vec_id").agg(F.min(F.struct("sad", "ref")).alias("m")).select("vec_id", "m.ref", r6(F.col("m.sad"), "sad"))


_TRIPLE = f"""(SELECT vec_id, sum(abs(v - f)) AS fwd, sum(abs(v - b)) AS bwd, sum(abs(v - (f + b) / 2)) AS mean FROM
(SELECT vec_id, v, lag(v) OVER w AS f, lead(v) OVER w AS b FROM {SAMPLES} WINDOW w AS (PARTITION BY x, y ORDER BY vec_id)) WHERE f IS NOT NULL AND b IS NOT NULL GROUP BY 1)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block beside the one before and the one after it, by equi-joins on the id."""
    b = blocks(spark, sf_dir).select("vec_id", "a")
    before = b.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("f"))
    after = b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return b.join(before, "vec_id").join(after, "vec_id")


@query(f"SELECT vec_id, CASE WHEN fwd <= bwd AND fwd <= mean THEN 0 WHEN bwd <= mean THEN 1 ELSE 2 END::BIGINT AS mode, round(least(fwd, bwd, mean), 6) AS cost FROM {_TRIPLE}")
def bidir_mode_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _neighbours(spark, sf_dir)
    mean = F.zip_with("f", "b", lambda x, y: (x + y) / 2)
    t = t.select("vec_id", *(matching.sad(F.col("a"), c).alias(n) for n, c in (("fwd", F.col("f")), ("bwd", F.col("b")), ("mean", mean))))
    mode, cost = matching.bidir_choice(F.col("fwd"), F.col("bwd"), F.col("mean"))
    return t.select("vec_id", mode.alias("mode"), r6(cost, "cost"))


@query(f"""SELECT vec_id, CASE WHEN w <= h AND w <= u AND w <= q THEN 0 WHEN h <= u AND h <= q THEN 1 WHEN u <= q THEN 2 ELSE 3 END::BIGINT AS split, round(least(w, h, u, q), 6) AS cost FROM
(SELECT vec_id, least(f, b) AS w, least(f1, b1) + least(f2, b2) + 4 * 20.0 AS h, least(f3, b3) + least(f4, b4) + 4 * 20.0 AS u, least(f5, b5) + least(f6, b6) + least(f7, b7) + least(f8, b8) + greatest(20.0, least(f, b) / 4) AS q FROM
(SELECT vec_id, {', '.join(f"sum(CASE WHEN {c} THEN abs(v - {s}) ELSE 0 END) AS {s}{i or ''}" for s in 'fb' for i, c in enumerate(['true', 'y < 4', 'y >= 4', 'x < 4', 'x >= 4', 'x < 4 AND y < 4', 'x >= 4 AND y < 4', 'x < 4 AND y >= 4', 'x >= 4 AND y >= 4']))}
FROM (SELECT vec_id, x, y, v, lag(v) OVER w AS f, lead(v) OVER w AS b FROM {SAMPLES} WINDOW w AS (PARTITION BY x, y ORDER BY vec_id)) WHERE f IS NOT NULL AND b IS NOT NULL GROUP BY 1))""")
def split_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block, its halves or its quarters choose their reference on their own."""
    t = _neighbours(spark, sf_dir)
    d = lambda s: F.zip_with("a", s, lambda x, y: F.abs(x - y))
    t = t.select("vec_id", d("f").alias("f"), d("b").alias("b"))
    part = lambda c, keep: F.aggregate(F.transform(c, lambda x, i: F.when(keep(i % 8, F.floor(i / 8)), x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    best = lambda keep: F.least(part("f", keep), part("b", keep))
    left, up = (lambda x, y: x < 4), (lambda x, y: y < 4)
    no = lambda f: lambda x, y: ~f(x, y)
    both = lambda f, g: lambda x, y: f(x, y) & g(x, y)
    t = t.select(
        "vec_id", best(lambda x, y: x >= 0).alias("w"), (best(up) + best(no(up))).alias("h"), (best(left) + best(no(left))).alias("v"),
        sum((best(both(p, q)) for p in (left, no(left)) for q in (up, no(up))), F.lit(0.0)).alias("q"),
    )
    split, cost = matching.split_choice(F.col("w"), F.col("h"), F.col("v"), F.col("q"), F.lit(20.0))
    return t.select("vec_id", split.alias("split"), r6(cost, "cost"))


_STEPPED = f"(SELECT *, sign(v) * floor(abs(v) / 4 + 0.5) * 4 AS w FROM {SAMPLES})"


@query(f"SELECT label, count(*) AS n, round(max(abs(v - w)), 6) AS most, round(avg(abs(v - w)), 6) AS mean, sum(CASE WHEN abs(v - w) > 0.001 THEN 1 ELSE 0 END)::BIGINT AS beyond FROM {_STEPPED} GROUP BY 1")
def checkpoint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two versions of the same planes, joined by place."""
    a = samples(spark, sf_dir)
    b = a.select("vec_id", "x", "y", quant.dequantize(quant.quantize(F.col("v"), 4.0), 4.0).alias("w"))
    d = F.abs(F.col("v") - F.col("w"))
    return a.join(b, ["vec_id", "x", "y"]).groupBy("label").agg(F.count("*").alias("n"), r6(F.max(d), "most"), r6(F.avg(d), "mean"), F.count_if(d > 1e-3).alias("beyond"))


@query(f"""SELECT label, round(10 * log10(255.0 * 255 / avg(pow(v - w, 2)) ), 6) AS psnr, round(10 * log10(255.0 * 255 / avg(CASE WHEN edge THEN pow(v - w, 2) END)), 6) AS at_edges, round(10 * log10(255.0 * 255 / avg(CASE WHEN NOT edge THEN pow(v - w, 2) END)), 6) AS inside
FROM (SELECT *, x IN (0, 7) OR y IN (0, 7) AS edge FROM {_STEPPED}) GROUP BY 1""")
def boundary_vs_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    e = F.pow(F.col("v") - quant.dequantize(quant.quantize(F.col("v"), 4.0), 4.0), 2)
    edge = F.col("x").isin(0, 7) | F.col("y").isin(0, 7)
    s = s.select("label", e.alias("e"), edge.alias("edge"))
    part = lambda c: quant.psnr(F.avg(F.when(c, F.col("e"))))
    return s.groupBy("label").agg(r6(quant.psnr(F.avg("e")), "psnr"), r6(part(F.col("edge")), "at_edges"), r6(part(~F.col("edge")), "inside"))


@query(f"""SELECT label, round(((2 * ma * mb + 6.5025) * (2 * cab + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 6) AS ssim FROM
(SELECT label, avg(v) AS ma, avg(w) AS mb, var_pop(v) AS va, var_pop(w) AS vb, covar_pop(v, w) AS cab FROM {_STEPPED} GROUP BY 1)""")
def ssim_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quality import ssim

    s = samples(spark, sf_dir).withColumn("w", quant.dequantize(quant.quantize(F.col("v"), 4.0), 4.0))
    return ssim(s, ["label"], "v", "w").select("label", r6(F.col("ssim"), "ssim"))


@query(f"SELECT vec_id, x // 4 AS x, y // 4 AS y, round(avg(v), 6) + 0.0 AS v FROM {SAMPLES} GROUP BY 1, 2, 3")
def downscale4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.downsample(samples(spark, sf_dir), ["vec_id"], 4, 4).select("vec_id", "x", "y", r6(F.col("v"), "v"))


_HALF = f"(SELECT vec_id, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM {SAMPLES} GROUP BY 1, 2, 3)"


@query(f"SELECT s.vec_id, round(avg(abs(s.v - h.v)), 6) AS mean_error FROM {SAMPLES} s JOIN {_HALF} h ON s.vec_id = h.vec_id AND s.x // 2 = h.x AND s.y // 2 = h.y GROUP BY 1")
def chroma_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box means of two by two samples, spread out again, against the samples."""
    s = samples(spark, sf_dir).select("vec_id", "x", "y", "v")
    up = planes.upsample(planes.downsample(s, ["vec_id"], 2, 2), 2, 2).withColumnRenamed("v", "u")
    return s.join(up, ["vec_id", "x", "y"]).groupBy("vec_id").agg(r6(F.avg(F.abs(F.col("v") - F.col("u"))), "mean_error"))


@query(f"SELECT a.vec_id, a.x, a.y, round(avg(b.v), 6) + 0.0 AS v FROM {SAMPLES} a JOIN {SAMPLES} b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3")
def box_mean3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.box3(samples(spark, sf_dir), ["vec_id"]).select("vec_id", "x", "y", r6(F.col("v"), "v"))


def _deblock_sql(base: str, along: str, across: str) -> str:
    return f"""(SELECT vec_id, x, y, CASE WHEN {along} = 4 AND abs(p - v) <= 20 THEN (p + 2 * v + coalesce(n, v)) / 4 WHEN {along} = 3 AND abs(v - n) <= 20 THEN (coalesce(p, v) + 2 * v + n) / 4 ELSE v END AS v
FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM {base} WINDOW w AS (PARTITION BY vec_id, {across} ORDER BY {along})))"""


@query(f"SELECT vec_id, x, y, round(v, 6) + 0.0 AS v FROM {_deblock_sql(_deblock_sql(SAMPLES, 'x', 'y'), 'y', 'x')}")
def deblock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.deblock(samples(spark, sf_dir), ["vec_id"], 4, 10.0).select("vec_id", "x", "y", r6(F.col("v"), "v"))


_MV = "(SELECT vec_id, x, y, CAST(floor(v / 4) AS BIGINT) AS dx, CAST(floor(v / 5) AS BIGINT) AS dy FROM " + SAMPLES + ")"


@query(f"""SELECT vec_id, x, y, CASE WHEN c = 9 THEN mx ELSE dx END AS dx, CASE WHEN c = 9 THEN my ELSE dy END AS dy FROM
(SELECT a.vec_id, a.x, a.y, any_value(a.dx) AS dx, any_value(a.dy) AS dy, count(*) AS c, list_sort(list(b.dx))[5] AS mx, list_sort(list(b.dy))[5] AS my FROM {_MV} a JOIN {_MV} b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3)""")
def mv_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.median3_vectors(_vectors(spark, sf_dir), ["vec_id"])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("vec_id", "x", "y", F.floor(F.col("v") / 4).cast("long").alias("dx"), F.floor(F.col("v") / 5).cast("long").alias("dy"))


@query(f"SELECT count(*) AS n, sum(dx >> 2)::BIGINT AS sx, sum(dy >> 2)::BIGINT AS sy, sum(CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN dx ELSE 0 END)::BIGINT AS coarse_x, (sum(dx) * 64)::BIGINT AS spread_x FROM {_MV}")
def mv_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at a coarser scale (floored), on a coarser grid (top left) and spread onto a finer one (four times as long, sixteen copies)."""
    v = _vectors(spark, sf_dir)
    down = v.agg(F.count("*").alias("n"), F.sum(geometry.mv_scale(F.col("dx"), 2)).alias("sx"), F.sum(geometry.mv_scale(F.col("dy"), 2)).alias("sy"))
    coarse = planes.coarser_vectors(v).agg(F.sum("dx").alias("coarse_x"))
    spread = planes.spread_vectors(v).agg(F.sum("dx").alias("spread_x"))
    return down.join(F.broadcast(coarse)).join(F.broadcast(spread))


@query(f"""WITH s AS (SELECT * FROM {SAMPLES}), m AS (SELECT vec_id, x // 4 AS bx, y // 4 AS gy, CAST(floor(avg(v)) AS BIGINT) % 7 AS dx, CAST(floor(max(v)) AS BIGINT) % 5 AS dy FROM s GROUP BY 1, 2, 3),
a AS (SELECT s.vec_id, x, y, v, x + dx / 4.0 AS fx, y + dy / 4.0 AS fy FROM s JOIN m ON s.vec_id = m.vec_id AND x // 4 = bx AND y // 4 = gy),
c AS (SELECT vec_id, x, y, v, least(greatest(floor(fx) + i, 0), 7) AS rx, least(greatest(floor(fy) + j, 0), 7) AS ry, abs(1 - i - (fx - floor(fx))) * abs(1 - j - (fy - floor(fy))) AS w FROM a, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
p AS (SELECT c.vec_id, c.x, c.y, any_value(c.v) AS v, sum(w * r.v) AS p FROM c JOIN s r ON r.vec_id = c.vec_id - 1 AND r.x = rx AND r.y = ry WHERE w > 0 GROUP BY 1, 2, 3)
SELECT vec_id, round(sum(abs(v - p)), 6) AS residual FROM p GROUP BY 1""")
def motion_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual of each block sequence against the one before it, moved by vectors in quarter samples."""
    s = samples(spark, sf_dir).select("vec_id", "x", "y", "v")
    at = [F.floor(F.col(c) / 4).cast("long").alias(c) for c in ("x", "y")]
    vectors = s.groupBy("vec_id", *at).agg((F.floor(F.avg("v")) % 7).alias("dx"), (F.floor(F.max("v")) % 5).alias("dy"))
    before = s.withColumn("vec_id", F.col("vec_id") + 1)
    p = planes.motion_compensate(before, vectors, ["vec_id"], 8, 8, 4)
    return s.join(p, ["vec_id", "x", "y"]).groupBy("vec_id").agg(r6(F.sum(F.abs(F.col("v") - F.col("p"))), "residual"))


@query(f"""WITH b AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bx, list(v + 128 ORDER BY y, x) AS a FROM {SAMPLES} GROUP BY 1, 2),
n AS (SELECT b.*, p.a AS l FROM b LEFT JOIN b p ON p.label = b.label AND p.bx = b.bx - 1),
s AS (SELECT label, bx, a, CASE WHEN l IS NULL THEN list_transform(range(8), lambda r: 128.0) ELSE list_transform(range(8), lambda r: l[r * 8 + 8]) END AS e FROM n),
c AS (SELECT label, bx, list_sum([abs(a[i + 1] - list_sum(e) / 8) for i in range(64)]) AS c0, list_sum([abs(a[i + 1] - e[i // 8 + 1]) for i in range(64)]) AS c1, list_sum([abs(a[i + 1] - 128) for i in range(64)]) AS c2 FROM s)
SELECT label, bx, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END::BIGINT AS mode, round(least(c0, c1, c2), 6) AS sad FROM c""")
def intra_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prediction of each block from its left neighbour in a row of blocks; nothing stands above, which counts as 128."""
    w = Window.partitionBy("label").orderBy("vec_id")
    b = blocks(spark, sf_dir).select("label", (F.row_number().over(w) - 1).cast("long").alias("bx"), F.lit(0).cast("long").alias("by"), F.transform("a", lambda x: x + 128).alias("a"))
    return matching.intra_modes(b, ["label"]).select("label", "bx", "mode", r6(F.col("sad"), "sad"))
