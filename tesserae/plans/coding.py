"""Queries on symbol statistics, code costs, diagnostics and rate-distortion points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, geometry, quant
from ..operators import entropy, quality
from ..session import table
from .registry import SAMPLES, query, r6, samples
from .spatial import _MV, _vectors

_GRP = "CASE WHEN x >= 4 AND y >= 4 THEN 3 WHEN x >= 4 OR y >= 4 THEN 2 WHEN x >= 2 OR y >= 2 THEN 1 ELSE 0 END"
_Q = f"(SELECT vec_id, label, x, y, v, CAST({_GRP} AS BIGINT) AS grp, CAST(CASE WHEN abs(v) < 6 THEN 0 ELSE sign(v) * floor(abs(v) / 8 + 0.5) END AS BIGINT) AS q FROM {SAMPLES})"


def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.withColumns({"grp": geometry.subband_group(F.col("x"), F.col("y"), 8, 2), "q": quant.quantize(F.col("v"), 8.0, 0.75)})


_K = "CASE WHEN c = 0 OR t // c < 1 THEN 0 ELSE least(length(bin(CAST(t // c AS BIGINT))) - 1, 15) END::BIGINT"
_KS = f"(SELECT label, grp, c AS nonzero, {_K} AS k FROM (SELECT label, grp, coalesce(sum(abs(q) - 1) FILTER (WHERE q <> 0), 0) AS t, count(*) FILTER (WHERE q <> 0) AS c FROM {_Q} GROUP BY 1, 2))"


@query(f"SELECT label, grp, nonzero, k FROM {_KS}")
def optimal_rice_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.rice_parameters(_indices(spark, sf_dir), ["label", "grp"])


@query(f"SELECT label, grp, count(*) AS n, sum(CASE WHEN q = 0 THEN 1 ELSE 3 + k + (abs(q) - 1) // CAST(pow(2, k) AS BIGINT) END)::BIGINT AS bits FROM {_Q} JOIN {_KS} USING (label, grp) GROUP BY 1, 2")
def rice_bit_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of all indices of a group under its Rice parameter, from the histogram of indices."""
    hist = entropy.histogram(_indices(spark, sf_dir), ["label", "grp"], F.col("q"))
    nonzero = F.col("symbol") != 0
    w = Window.partitionBy("label", "grp")
    total, count = F.sum(F.when(nonzero, F.col("n") * (F.abs("symbol") - 1))).over(w), F.sum(F.when(nonzero, F.col("n"))).over(w)
    hist = hist.withColumn("k", bits.rice_k(F.coalesce(total, F.lit(0)), F.coalesce(count, F.lit(0))))
    length = F.when(nonzero, 2 + bits.rice_length(F.abs("symbol") - 1, F.col("k"), 1 << 30)).otherwise(1)
    return hist.groupBy("label", "grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * length).cast("long").alias("bits"))


@query(f"SELECT vec_id, sum(CASE WHEN z THEN 1 << CAST(grp AS INT) ELSE 0 END)::BIGINT AS bitmap FROM (SELECT vec_id, grp, bool_and(q = 0) AS z FROM {_Q} GROUP BY 1, 2) GROUP BY 1")
def skip_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.skip_bitmap(_indices(spark, sf_dir), ["vec_id"])


_HIST = f"(SELECT label, grp, q AS symbol, count(*) AS n FROM {_Q} GROUP BY 1, 2, 3)"


@query(f"SELECT * FROM {_HIST}")
def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.histogram(_indices(spark, sf_dir), ["label", "grp"], F.col("q"))


_NORM = f"""(SELECT label, grp, symbol, n, f + CASE WHEN r = 1 THEN 4096 - sum(f) OVER (PARTITION BY label, grp) ELSE 0 END::BIGINT AS freq FROM
(SELECT *, greatest(n * 4096 // sum(n) OVER (PARTITION BY label, grp), 1)::BIGINT AS f, row_number() OVER (PARTITION BY label, grp ORDER BY n DESC, symbol) AS r FROM {_HIST}))"""


@query(f"SELECT label, grp, symbol, n, freq::BIGINT AS freq FROM {_NORM}")
def histogram_normalize_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.normalize_largest(symbol_histogram(spark, sf_dir), ["label", "grp"])


@query(f"SELECT label, grp, symbol, freq::BIGINT AS freq, coalesce(sum(freq) OVER (PARTITION BY label, grp ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM {_NORM}")
def cumulative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.cumulative(histogram_normalize_largest(spark, sf_dir), ["label", "grp"]).drop("n")


@query(f"""WITH c AS (SELECT *, coalesce(sum(freq) OVER (PARTITION BY label, grp ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM {_NORM})
SELECT label, grp, slot, symbol FROM c JOIN (SELECT unnest(range(0, 4096, 64)) AS slot) ON slot >= cum AND slot < cum + freq""")
def symbol_of_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cum = cumulative_frequency(spark, sf_dir)
    slots = cum.select("label", "grp").distinct().select("label", "grp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4095), F.lit(64)), lambda x: x.cast("long"))).alias("slot"))
    return entropy.symbol_lookup(slots, cum, ["label", "grp"]).select("label", "grp", "slot", "symbol")


@query(f"""WITH c AS (SELECT *, coalesce(sum(freq) OVER (PARTITION BY label, grp ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM {_NORM})
SELECT label, grp, slot, symbol FROM c JOIN (SELECT unnest(range(0, 4096)) AS slot) ON slot >= cum AND slot < cum + freq""")
def symbol_of_every_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 4096 slots of each label and group; symbol_of_slot has every 64th."""
    cum = cumulative_frequency(spark, sf_dir)
    slots = cum.select("label", "grp").distinct().select("label", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4095).cast("long"))).alias("slot"))
    return entropy.symbol_lookup(slots, cum, ["label", "grp"]).select("label", "grp", "slot", "symbol")


_H2 = "CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) END"


@query(f"""SELECT grp, n, round({_H2.format(p='(s / n)')}, 6) AS flat, round(CASE WHEN n0 > 0 THEN n0 / n * {_H2.format(p='(s0 / n0)')} ELSE 0 END + CASE WHEN n1 > 0 THEN n1 / n * {_H2.format(p='(s1 / n1)')} ELSE 0 END, 6) AS given_above FROM
(SELECT grp, count(*) AS n, sum(sig) AS s, count(*) FILTER (WHERE ctx = 0) AS n0, count(*) FILTER (WHERE ctx = 1) AS n1, sum(sig) FILTER (WHERE ctx = 0) AS s0, sum(sig) FILTER (WHERE ctx = 1) AS s1 FROM
 (SELECT grp, CAST(q <> 0 AS INT) AS sig, coalesce(CAST(lag(q) OVER (PARTITION BY vec_id, grp, x ORDER BY y) <> 0 AS INT), 0) AS ctx FROM {_Q}) GROUP BY 1)""")
def significance_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = entropy.significance(_indices(spark, sf_dir), ["grp"])
    return s.select("grp", "n", r6(F.col("flat"), "flat"), r6(F.col("given_above"), "given_above"))


@query(f"SELECT label, count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT label, max(CASE WHEN x % 2 = 0 THEN abs(v) END) AS a, max(CASE WHEN x % 2 = 1 THEN abs(v) END) AS b FROM {SAMPLES} GROUP BY label, vec_id, y, x // 2) GROUP BY 1")
def pair_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.pair_correlation(samples(spark, sf_dir), ["label"]).select("label", "n", r6(F.col("r"), "r"))


@query(f"""WITH a AS (SELECT *, lag(dx) OVER (PARTITION BY vec_id, y ORDER BY x) AS lx, lag(dy) OVER (PARTITION BY vec_id, y ORDER BY x) AS ly, lag(dx) OVER (PARTITION BY vec_id, x ORDER BY y) AS ax, lag(dy) OVER (PARTITION BY vec_id, x ORDER BY y) AS ay FROM {_MV}),
b AS (SELECT *, CASE WHEN ax IS NOT NULL THEN coalesce(lead(ax) OVER w, ax) END AS rx, CASE WHEN ay IS NOT NULL THEN coalesce(lead(ay) OVER w, ay) END AS ry FROM a WINDOW w AS (PARTITION BY vec_id, y ORDER BY x))
SELECT vec_id, x, y, (dx - list_sort([coalesce(lx, 0), coalesce(ax, 0), coalesce(rx, 0)])[2])::BIGINT AS ddx, (dy - list_sort([coalesce(ly, 0), coalesce(ay, 0), coalesce(ry, 0)])[2])::BIGINT AS ddy FROM b""")
def median3_predictor_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = entropy.vector_predictors(_vectors(spark, sf_dir), ["vec_id"])
    return p.select("vec_id", "x", "y", (F.col("dx") - F.col("px")).alias("ddx"), (F.col("dy") - F.col("py")).alias("ddy"))


@query(f"""SELECT vec_id, count(*) AS n, count(*) FILTER (WHERE dx = 0 AND dy = 0) AS zeros, round(avg(m), 6) AS mean, list_sort(list(m))[count(*) // 2 + 1] AS median, max(m) AS most,
{', '.join(f"count(*) FILTER (WHERE m >= {a} AND m <= {b}) AS h{i}" for i, (a, b) in enumerate(((0, 0), (1, 2), (3, 4), (5, 8), (9, 16), (17, 99999999))))} FROM (SELECT *, greatest(abs(dx), abs(dy)) AS m FROM {_MV}) GROUP BY 1""")
def mv_stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = entropy.vector_stats(_vectors(spark, sf_dir), ["vec_id"])
    return s.withColumn("mean", F.round("mean", 6))


@query(f"SELECT label, count(*) AS n, round(avg(abs(v)), 6) AS mean_abs, round(stddev_pop(abs(v)), 6) AS spread, round(100 * avg(CASE WHEN abs(v) < 1 THEN 1.0 ELSE 0 END), 6) AS near_zero, round(avg(CASE WHEN q = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share FROM {_Q} GROUP BY 1")
def residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.abs("v")
    return _indices(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("n"), r6(F.avg(a), "mean_abs"), r6(F.stddev_pop(a), "spread"), r6(100 * F.avg(F.when(a < 1, 1.0).otherwise(0.0)), "near_zero"),
        r6(F.avg(F.when(F.col("q") == 0, 1.0).otherwise(0.0)), "zero_share"),
    )


@query("""SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS data_bytes, (count(*) * 8)::BIGINT AS index_bytes, sum(CASE WHEN n_chars < 128 THEN 1 WHEN n_chars < 16384 THEN 2 ELSE 3 END)::BIGINT AS side_bytes,
round(8.0 * (sum(strlen(text)) + count(*) * 8 + sum(CASE WHEN n_chars < 128 THEN 1 WHEN n_chars < 16384 THEN 2 ELSE 3 END)) / sum(n_chars), 6) AS bits_per_char FROM documents GROUP BY 1""")
def bit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "n_chars", F.octet_length("text").cast("long").alias("b"), bits.varint_size(F.col("n_chars")).alias("side"))
    g = d.groupBy("source").agg(F.count("*").alias("n"), F.sum("b").alias("data_bytes"), (F.count("*") * 8).alias("index_bytes"), F.sum("side").alias("side_bytes"), F.sum("n_chars").alias("chars"))
    return g.withColumn("bits_per_char", F.round(8.0 * (F.col("data_bytes") + F.col("index_bytes") + F.col("side_bytes")) / F.col("chars"), 6)).drop("chars")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(10 * log10(255.0 * 255 / avg(pow(x - floor(x / 8 + 0.5) * 8, 2))), 6) AS psnr FROM (SELECT l_returnflag, l_linestatus, l_extendedprice / 400 AS x FROM lineitem) GROUP BY 1, 2""")
def psnr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") / 400
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", x.alias("x"), quant.dequantize(quant.quantize(x, 8.0), 8.0).alias("w"))
    return quality.psnr_by(df, ["l_returnflag", "l_linestatus"], "x", "w").select("l_returnflag", "l_linestatus", "n", r6(F.col("psnr"), "psnr"))


_STEPS = "2.0, 4.0, 8.0, 16.0, 32.0"
_RD = f"""(SELECT event_type, step, avg(CASE WHEN q = 0 THEN 1 ELSE 2 * floor(log2(abs(q))) + 3 END) AS bpp, 10 * log10(255.0 * 255 / avg(pow(value - q * step, 2))) AS psnr FROM
(SELECT event_type, value, step, sign(value) * floor(abs(value) / step + 0.5) AS q FROM events, (SELECT unnest([{_STEPS}])::DOUBLE AS step)) GROUP BY 1, 2)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and quality of every event type at five steps."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.explode(F.array(*(F.lit(float(s)) for s in _STEPS.split(", ")))).alias("step"))
    e = e.withColumn("q", quant.quantize(F.col("value"), F.col("step")))
    cost = F.when(F.col("q") == 0, 1).otherwise(2 * (F.length(F.bin(F.abs("q"))) - 1) + 3)
    d = F.col("value") - quant.dequantize(F.col("q"), F.col("step"))
    return e.groupBy("event_type", "step").agg(F.avg(cost).alias("bpp"), quant.psnr(F.avg(d * d)).alias("psnr"))


@query(f"""WITH s AS (SELECT *, lead(bpp) OVER w AS b2, lead(psnr) OVER w AS p2 FROM {_RD} WINDOW w AS (PARTITION BY event_type ORDER BY bpp)),
t AS (SELECT event_type, bpp, psnr, b2, p2, greatest(bpp, 2.0) AS a, least(b2, 8.0) AS b FROM s WHERE b2 IS NOT NULL AND b2 > bpp)
SELECT event_type, round(sum(CASE WHEN b > a THEN (b - a) * ((psnr + (a - bpp) / (b2 - bpp) * (p2 - psnr)) + (psnr + (b - bpp) / (b2 - bpp) * (p2 - psnr))) / 2 ELSE 0 END), 6) AS area FROM t GROUP BY 1""")
def trapezoid_rd_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = quality.trapezoid_area(_points(spark, sf_dir), ["event_type"], "bpp", "psnr", F.lit(2.0), F.lit(8.0))
    return a.select("event_type", r6(F.col("area"), "area"))


@query()
def bd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rate and quality differences of every event type's curve against that of clicks."""
    return quality.bd_rates(_points(spark, sf_dir), "event_type", "click")


@query("""SELECT user_id, array_to_string(list_filter([CASE WHEN last_v / first_v > 0.7 THEN 'size_ratio' END, CASE WHEN zeros = 0 THEN 'no_zero_vectors' END, CASE WHEN errors = 0 THEN 'no_skips' END, CASE WHEN mean > 15 THEN 'residual' END,
CASE WHEN near < 50 THEN 'near_zero' END, CASE WHEN last_v / first_v > 0.9 THEN 'coefficients' END, CASE WHEN mean / 6 > 5 THEN 'magnitudes' END], lambda x: x IS NOT NULL), ',') AS findings
FROM (SELECT user_id, max_by(value, event_id) AS last_v, min_by(value, event_id) AS first_v, count(*) FILTER (WHERE value < 1) AS zeros, count(*) FILTER (WHERE event_type = 'error') AS errors, avg(value) AS mean, 100 * avg(CASE WHEN value < 20 THEN 1.0 ELSE 0 END) AS near FROM events WHERE value > 0 GROUP BY 1)""")
def diagnostic_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 0")
    g = e.groupBy("user_id").agg(
        F.max_by("value", "event_id").alias("last"), F.min_by("value", "event_id").alias("first"), F.count_if(F.col("value") < 1).alias("zeros"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.avg("value").alias("mean"), (100 * F.avg(F.when(F.col("value") < 20, 1.0).otherwise(0.0))).alias("near"),
    )
    c, ratio = F.col, F.col("last") / F.col("first")
    w = entropy.warnings(ratio, c("zeros"), c("errors"), c("mean"), c("near"), ratio, c("mean") / 6)
    return g.select("user_id", F.array_join(w, ",").alias("findings"))


@query("""SELECT event_type, max(value) FILTER (WHERE i = least(n * 10 // 100, n - 1)) AS p10, max(value) FILTER (WHERE i = least(n * 50 // 100, n - 1)) AS p50, max(value) FILTER (WHERE i = least(n * 90 // 100, n - 1)) AS p90
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def percentile_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.picks(table(spark, sf_dir, "events"), ["event_type"], "value")


@query()
def crc32_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum and size of every document as a blob."""
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"))
