"""Queries on ordered signals: temporal bands, wavelets, scenes, groups, order, seek, rate control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, quant
from ..operators import lifting, ordered, rate
from ..session import table
from .registry import SERIES, query, r6, series

_Q = "CASE WHEN abs(v) < 0.75 * {s} THEN 0 ELSE sign(v) * floor(abs(v) / {s} + 0.5) END"
_FOUR = f"(SELECT user_id, pos // 4 AS g, list(value ORDER BY pos) AS a FROM {SERIES} GROUP BY 1, 2 HAVING count(*) = 4)"
_BANDS = f"""(SELECT user_id, g, l0 + (l1 - l0) / 2 AS b0, l1 - l0 AS b1, h0 AS b2, h1 AS b3, a FROM
 (SELECT user_id, g, a, a[1] + (a[2] - a[1]) / 2 AS l0, a[2] - a[1] AS h0, a[3] + (a[4] - a[3]) / 2 AS l1, a[4] - a[3] AS h1 FROM {_FOUR}))"""


@query(f"""
WITH c AS (SELECT user_id, g, 0 AS band, 4.0 AS s, b0 AS v FROM {_BANDS} UNION ALL SELECT user_id, g, 1, 8.0, b1 FROM {_BANDS} UNION ALL SELECT user_id, g, 2, 16.0, b2 FROM {_BANDS} UNION ALL SELECT user_id, g, 2, 16.0, b3 FROM {_BANDS}),
q AS (SELECT band, CAST({_Q.format(s='s')} AS BIGINT) AS q FROM c),
k AS (SELECT band, CASE WHEN mean < 1 THEN 0 ELSE least(length(bin(CAST(mean AS BIGINT))) - 1, 15) END AS k FROM
     (SELECT band, coalesce(sum(abs(q) - 1) FILTER (WHERE q <> 0) // nullif(count(*) FILTER (WHERE q <> 0), 0), 0) AS mean FROM q GROUP BY band)),
w AS (SELECT avg(e) AS mse FROM (SELECT unnest([a[1] - f0, a[2] - f1, a[3] - f2, a[4] - f3]) ^ 2 AS e FROM
     (SELECT a, m0 - d2 / 2 AS f0, m0 - d2 / 2 + d2 AS f1, m1 - d3 / 2 AS f2, m1 - d3 / 2 + d3 AS f3 FROM
     (SELECT a, d0 - d1 / 2 AS m0, d0 - d1 / 2 + d1 AS m1, d2, d3 FROM
     (SELECT a, 4.0 * (SELECT {_Q.format(s='4.0')} FROM (SELECT b0 AS v)) AS d0, 8.0 * (SELECT {_Q.format(s='8.0')} FROM (SELECT b1 AS v)) AS d1,
             16.0 * (SELECT {_Q.format(s='16.0')} FROM (SELECT b2 AS v)) AS d2, 16.0 * (SELECT {_Q.format(s='16.0')} FROM (SELECT b3 AS v)) AS d3 FROM {_BANDS})))))
SELECT CAST(band AS BIGINT) AS band, count(*) AS samples, round(avg(CASE WHEN q = 0 THEN 1 ELSE 3 + ((abs(q) - 1) // CAST(pow(2, k) AS BIGINT)) + k END), 6) AS bits_per_sample,
       round((SELECT 10 * log10(255.0 * 255.0 / mse) FROM w), 6) AS psnr
FROM q JOIN k USING (band) GROUP BY band""")
def band_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a sample and quality that remain of each temporal band: Haar over groups of four, dead-zone quantiser, Rice code.

    One shuffle makes the groups; bands, error and their partial sums follow in the same stage, so only a row for each
    band and task moves on.
    """
    steps = (4.0, 8.0, 16.0, 16.0)
    g = lifting.in_groups(series(spark, sf_dir), ["user_id"], 4).withColumn("bands", lifting.haar_levels(F.col("a"), 4))
    q = F.array(*(quant.quantize(F.get("bands", F.lit(i)), s, 0.75) for i, s in enumerate(steps)))
    g = g.select("a", q.alias("q"))
    back = lifting.unhaar_levels(F.array(*(quant.dequantize(F.get("q", F.lit(i)), s) for i, s in enumerate(steps))), 4)
    error = F.aggregate(F.zip_with("a", back, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    bands = F.array(*(F.struct(F.lit(min(i, 2)).cast("long").alias("band"), F.get("q", F.lit(i)).alias("q"), (error if i == 0 else F.lit(0.0)).alias("e")) for i in range(4)))
    # the magnitudes' histogram is small: Rice lengths need the parameter, which needs the sum first
    hist = g.select(F.inline(bands)).groupBy("band", F.abs("q").alias("m")).agg(F.count("*").alias("n"), F.sum("e").alias("e"))
    every, band = Window.partitionBy(), Window.partitionBy("band")
    count = F.sum(F.when(F.col("m") > 0, F.col("n"))).over(band)
    total = F.sum(F.when(F.col("m") > 0, F.col("n") * (F.col("m") - 1))).over(band)
    hist = hist.withColumns({"k": bits.rice_k(F.coalesce(total, F.lit(0)), F.coalesce(count, F.lit(0)))})
    length = F.when(F.col("m") == 0, 1).otherwise(3 + F.floor((F.col("m") - 1) / F.pow(F.lit(2), F.col("k"))) + F.col("k"))
    sums = hist.groupBy("band").agg(F.sum("n").alias("samples"), F.sum(F.col("n") * length).alias("bits"), F.sum("e").alias("e"))
    mse = F.sum("e").over(every) / F.sum("samples").over(every)
    return sums.select("band", "samples", r6(F.col("bits") / F.col("samples"), "bits_per_sample"), r6(quant.psnr(mse), "psnr"))


@query(f"SELECT user_id, pos // 2 AS n, round(a[1] + (a[2] - a[1]) / 2, 6) AS low, round(a[2] - a[1], 6) + 0.0 AS high FROM (SELECT user_id, pos // 2 * 2 AS pos, list(value ORDER BY pos) AS a FROM {SERIES} GROUP BY 1, 2 HAVING count(*) = 2)")
def haar_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lifting.split_pairs(series(spark, sf_dir), ["user_id"])
    low, high = lifting.haar(F.col("even"), F.col("odd"))
    return pairs.select("user_id", "n", r6(low, "low"), r6(high, "high"))


@query(f"SELECT user_id, g, round(b0, 6) AS b0, round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2, round(b3, 6) + 0.0 AS b3 FROM {_BANDS}")
def haar_multilevel4(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lifting.in_groups(series(spark, sf_dir), ["user_id"], 4).withColumn("b", lifting.haar_levels(F.col("a"), 4))
    return g.select("user_id", "g", *(r6(F.get("b", F.lit(i)), f"b{i}") for i in range(4)))


@query(f"""SELECT user_id, g, round(d0, 6) + 0.0 AS d0, round(d1, 6) + 0.0 AS d1, round(a[1] + d0 / 2, 6) + 0.0 AS s0, round(a[3] + (d0 + d1) / 4, 6) + 0.0 AS s1
FROM (SELECT user_id, g, a, a[2] - (a[1] + a[3]) / 2 AS d0, a[4] - a[3] AS d1 FROM {_FOUR})""")
def temporal53(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lifting.in_groups(series(spark, sf_dir), ["user_id"], 4)
    bands = lifting.temporal53(*(F.get("a", F.lit(i)) for i in range(4)))
    return g.select("user_id", "g", *(r6(b, n) for b, n in zip(bands, ("d0", "d1", "s0", "s1"), strict=True)))


_PAIRS = f"(SELECT user_id, pos // 2 AS n, max(CASE WHEN pos % 2 = 0 THEN floor(value) END) AS even, max(CASE WHEN pos % 2 = 1 THEN floor(value) END) AS odd FROM {SERIES} GROUP BY 1, 2 HAVING count(*) = 2)"
_WIN = "(PARTITION BY user_id ORDER BY n)"


@query(f"""SELECT user_id, n, even + floor((coalesce(lag(high) OVER {_WIN}, high) + high + 2) / 4) AS low, high
FROM (SELECT *, odd - floor((even + coalesce(lead(even) OVER {_WIN}, even)) / 2) AS high FROM {_PAIRS})""")
def lifting53_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumn("value", F.floor("value").cast("double"))
    out = lifting.forward53(lifting.split_pairs(s, ["user_id"]), ["user_id"])
    return out.select("user_id", "n", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


@query(f"""WITH s1 AS (SELECT user_id, n, even AS l, odd + {lifting.ALPHA} * (even + coalesce(lead(even) OVER {_WIN}, even)) AS h FROM {_PAIRS}),
s2 AS (SELECT user_id, n, h, l + {lifting.BETA} * (coalesce(lag(h) OVER {_WIN}, h) + h) AS l FROM s1), s3 AS (SELECT user_id, n, l, h + {lifting.GAMMA} * (l + coalesce(lead(l) OVER {_WIN}, l)) AS h FROM s2),
s4 AS (SELECT user_id, n, h, l + {lifting.DELTA} * (coalesce(lag(h) OVER {_WIN}, h) + h) AS l FROM s3)
SELECT user_id, n, round(l * {lifting.SCALE}, 6) + 0.0 AS low, round(h * {lifting.INV_SCALE}, 6) + 0.0 AS high FROM s4""")
def lifting97_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumn("value", F.floor("value").cast("double"))
    out = lifting.forward97(lifting.split_pairs(s, ["user_id"]), ["user_id"])
    return out.select("user_id", "n", r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query(f"""SELECT user_id, CAST(segment AS BIGINT) AS segment, min(pos) AS first, count(*) AS n, round(avg(value), 6) AS mean FROM
(SELECT *, sum(CASE WHEN d > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS segment FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS d FROM {SERIES})) GROUP BY 1, 2""")
def scene_cut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ordered.scene_segments(series(spark, sf_dir), ["user_id"], threshold=50.0)
    return s.groupBy("user_id", "segment").agg(F.min("pos").alias("first"), F.count("*").alias("n"), r6(F.avg("value"), "mean"))


_CUTS = f"(SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) > 50, true) AS first FROM {SERIES})"


def _plan(interval: int) -> str:
    """Kinds by the number of the frame after its key frame: eight to a group, of which the last is P."""
    return f"""(SELECT user_id, pos, since, CASE WHEN since = 0 THEN 'I' WHEN {interval} >= 9 AND (since - 1) // 8 < (frames - 1) // 8 AND (since - 1) % 8 < 7 THEN 'B' ELSE 'P' END AS kind
FROM (SELECT k.user_id, k.pos, k.pos - k.key_pos AS since, count(*) OVER (PARTITION BY k.user_id, k.key_pos) AS frames FROM
(SELECT user_id, pos, max(CASE WHEN first OR pos % {interval} = 0 THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS key_pos FROM {_CUTS}) k))"""


def _kinds(interval: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = ordered.scene_segments(series(spark, sf_dir), ["user_id"], threshold=50.0)
        return ordered.assign_kinds(s, ["user_id"], interval=interval).select("user_id", "pos", "since", "kind")

    return run


@query(f"SELECT user_id, pos, since, kind FROM {_plan(9)}")
def gop_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(9)(spark, sf_dir)


@query(f"SELECT user_id, pos, since, kind FROM {_plan(10)}")
def gop_assignment_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of one group and a frame that is left over."""
    return _kinds(10)(spark, sf_dir)


@query(f"SELECT user_id, pos, since, kind FROM {_plan(17)}")
def gop_assignment_two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(17)(spark, sf_dir)


@query(f"SELECT user_id, pos, since, kind FROM {_plan(8)}")
def gop_assignment_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval that holds no whole group: no B frames."""
    return _kinds(8)(spark, sf_dir)


@query(f"""SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY anchor, late, rank) - 1 AS decode_pos FROM
(SELECT user_id, pos, CASE WHEN kind = 'B' THEN coalesce(next_anchor, 1000000000) ELSE pos END AS anchor, CASE WHEN kind = 'B' THEN 1 ELSE 0 END AS late,
 CASE WHEN kind <> 'B' THEN 0 WHEN run = 7 THEN [4, 2, 5, 1, 6, 3, 7][pos - first + 1] ELSE pos - first + 1 END AS rank FROM
 (SELECT *, min(CASE WHEN kind <> 'B' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_anchor,
  min(pos) OVER (PARTITION BY user_id, isle, kind = 'B') AS first, count(*) OVER (PARTITION BY user_id, isle, kind = 'B') AS run FROM
  (SELECT *, sum(CASE WHEN kind <> 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS isle FROM {_plan(9)})))""")
def decode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ordered.scene_segments(series(spark, sf_dir), ["user_id"], threshold=50.0)
    kinds = ordered.assign_kinds(s, ["user_id"], interval=9)
    return ordered.decode_order(kinds, ["user_id"], pyramid=True).select("user_id", "pos", "decode_pos")


@query(f"SELECT a.user_id, a.pos, coalesce(max(b.pos), 0) AS key_pos FROM {SERIES} a LEFT JOIN {SERIES} b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.pos <= a.pos GROUP BY 1, 2")
def seek_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of seek by a running maximum: one window, no range join."""
    s = series(spark, sf_dir)
    return ordered.seek_keyframe(s, ["user_id"], F.col("event_type") == "error").select("user_id", "pos", "key_pos")


@query("SELECT doc_id, 28 + 21 * count(*) OVER () + coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, strlen(text) AS size FROM documents")
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of blobs in a container: sizes by range partition first, then a sum within each; no single task sees all rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return ordered.offsets(d, "doc_id", "size", header=28, entry=21).select("doc_id", F.col("offset").alias("off"), "size")


@query(f"""SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(stddev_pop(value), 6) AS spread,
round(greatest(coalesce(max(-d), 0), 0), 6) + 0.0 AS worst_drop, round(coalesce(stddev_pop(d), 0), 6) AS delta_spread FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM {SERIES}) GROUP BY 1""")
def sequence_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ordered.stability(series(spark, sf_dir), ["user_id"])
    return m.select("user_id", "n", *(r6(F.col(c), c) for c in ("mean", "low", "high", "spread", "worst_drop", "delta_spread")))


@query(f"""WITH RECURSIVE s AS (SELECT user_id, pos, value FROM {SERIES}),
r AS (SELECT user_id, pos, least(greatest(600.0 + 60 - 1.5 * value, 0), 1200) AS fill FROM s WHERE pos = 0
UNION ALL SELECT s.user_id, s.pos, least(greatest(r.fill + 60 - 1.5 * s.value, 0), 1200) FROM r JOIN s ON s.user_id = r.user_id AND s.pos = r.pos + 1)
SELECT user_id, count(*) AS n, round(min(fill), 6) AS least_fill, round(max(fill), 6) AS most_fill, round(max_by(fill, pos), 6) AS last_fill, sum(CASE WHEN fill = 0 THEN 1 ELSE 0 END)::BIGINT AS empty FROM r GROUP BY 1""")
def vbv_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffer fill as an ordered fold over each user's samples."""
    f = rate.buffer_fold(series(spark, sf_dir), ["user_id"], F.col("value") * 1.5, budget=60.0, capacity=1200.0)
    x = F.explode("fills").alias("fill")
    last = F.element_at("fills", -1).alias("last")
    return f.select("user_id", last, x).groupBy("user_id").agg(F.count("*").alias("n"), r6(F.min("fill"), "least_fill"), r6(F.max("fill"), "most_fill"), r6(F.first("last"), "last_fill"), F.count_if(F.col("fill") == 0).alias("empty"))


@query(f"""SELECT user_id, pos, CAST(count(*) OVER w AS BIGINT) AS n, CASE WHEN -slope > 0.1 AND -slope < 5 THEN round(-slope, 6) END AS alpha FROM
(SELECT user_id, pos, regr_slope(ln(value + 1), ln(pos % 7 + 2)) OVER w2 AS slope FROM {SERIES} WINDOW w2 AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the logarithmic rate model over each user's last thirty samples."""
    s = series(spark, sf_dir).withColumns({"bpp": F.col("value") + 1, "step": F.col("pos") % 7 + 2})
    return rate.fit_window(s, ["user_id"]).select("user_id", "pos", "n", F.round("alpha", 6).alias("alpha"))


@query(f"SELECT user_id, least(pos // 4, greatest(count(*) OVER (PARTITION BY user_id) // 4 - 1, 0)) AS gop, pos, CASE WHEN pos // 4 < count(*) OVER (PARTITION BY user_id) // 4 THEN 'group' ELSE 'tail' END AS role FROM {SERIES}")
def temporal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four, the frames left over as a tail, and the group that a seek to each frame lands in."""
    return ordered.temporal_groups(series(spark, sf_dir), ["user_id"], 4).select("user_id", F.col("seek_gop").alias("gop"), "pos", "role")


@query(f"""SELECT user_id, g AS gop, bool_or(d > 38) AS cut, CASE WHEN bool_or(d > 38) THEN 4 ELSE 1 END::BIGINT AS iframes FROM
(SELECT user_id, pos // 4 AS g, abs(value - lag(value) OVER (PARTITION BY user_id, pos // 4 ORDER BY pos)) AS d, count(*) OVER (PARTITION BY user_id, pos // 4) AS c FROM {SERIES}) WHERE c = 4 GROUP BY 1, 2""")
def cut_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a cut inside fall back to four independent frames."""
    return ordered.cut_groups(series(spark, sf_dir), ["user_id"], 4, 38.0)


@query(f"""WITH r AS (SELECT user_id, event_type, pos - row_number() OVER (PARTITION BY user_id, value < 10 ORDER BY pos) AS isle, pos, value < 10 AS zero FROM {SERIES})
SELECT user_id, min(pos) AS first, CAST(count(*) AS BIGINT) AS run FROM r WHERE zero GROUP BY user_id, isle""")
def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of samples that quantise to zero, as islands of two row numbers."""
    s = series(spark, sf_dir).withColumn("zero", F.col("value") < 10)
    return ordered.runs(s, ["user_id"], "zero").select("user_id", "first", "run")


@query(f"""SELECT user_id, count(*) AS n, round(sum(pow(value - prev, 2)) / count(*), 6) AS mse, sum(CASE WHEN value = prev THEN 1 ELSE 0 END)::BIGINT AS same, round(avg(CASE WHEN abs(value - prev) < 3 THEN 1.0 ELSE 0 END), 6) AS within, round(avg(abs(value - prev)), 6) AS mad
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS prev FROM {SERIES}) WHERE prev IS NOT NULL GROUP BY 1""")
def temporal_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("pos")
    d = F.abs(F.col("value") - F.col("prev"))
    s = series(spark, sf_dir).withColumn("prev", F.lag("value").over(w)).where("prev is not null")
    return s.groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg(d * d), "mse"), F.count_if(F.col("value") == F.col("prev")).alias("same"), r6(F.avg(F.when(d < 3, 1.0).otherwise(0.0)), "within"), r6(F.avg(d), "mad"))
