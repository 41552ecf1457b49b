"""Settings: the quality scale, parsers, subband weights, sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quality anchors (fixed values): quality, step, dead zone, colour prediction.
ANCHORS = (
    (1, 64.0, 1.0, False),
    (10, 32.0, 0.75, False),
    (25, 16.0, 0.75, False),
    (50, 8.0, 0.75, True),
    (75, 4.0, 0.75, True),
    (85, 2.8, 0.5, True),
    (92, 2.05, 0.05, False),
    (99, 2.0, 0.0, False),
    (100, 1.0, 0.0, False),
)


def preset_table(spark: SparkSession) -> DataFrame:
    """Settings of every quality from 1 to 100: steps interpolated in the logarithm, dead zones linearly, switches from the nearer anchor."""
    q = F.col("q")
    spans = [(a, b) for a, b in zip(ANCHORS, ANCHORS[1:], strict=False)]
    pick = lambda f: F.coalesce(*(F.when((q >= a[0]) & (q < b[0]), f(a, b)) for a, b in spans), f(ANCHORS[-1], ANCHORS[-1]))
    t = lambda a, b: (q - a[0]) / float(max(1, b[0] - a[0]))
    step = pick(lambda a, b: F.exp(math.log(a[1]) + t(a, b) * (math.log(b[1]) - math.log(a[1]))))
    dead = pick(lambda a, b: a[2] + t(a, b) * (b[2] - a[2]))
    cfl = pick(lambda a, b: F.when(t(a, b) < 0.5, a[3]).otherwise(b[3]))
    chroma = F.when(q < 40, 1.5).when(q < 60, 1.3).when(q < 85, 1.2).otherwise(1.0)
    return spark.range(1, 101).select(F.col("id").alias("q")).select(
        "q", step.alias("step"), dead.alias("dead_zone"), cfl.alias("cfl"), F.when(q >= 50, 4).otherwise(3).cast("long").alias("levels"), (q <= 80).alias("aq"),
        F.when(q >= 70, 0.2).otherwise(0.15).alias("aq_strength"), chroma.alias("chroma_weight"), F.when(q == 100, "5/3").otherwise("9/7").alias("wavelet"),
    )


def quality_preset(q: int) -> dict:
    """The same for one quality, clamped to 1..100, as plain values."""
    q = min(100, max(1, q))
    a, b = next(((a, b) for a, b in zip(ANCHORS, ANCHORS[1:], strict=False) if a[0] <= q < b[0]), (ANCHORS[-1], ANCHORS[-1]))
    t = (q - a[0]) / max(1, b[0] - a[0])
    return {
        "step": math.exp(math.log(a[1]) + t * (math.log(b[1]) - math.log(a[1]))), "dead_zone": a[2] + t * (b[2] - a[2]), "cfl": (a if t < 0.5 else b)[3], "levels": 4 if q >= 50 else 3,
        "aq": q <= 80, "aq_strength": 0.2 if q >= 70 else 0.15, "chroma_weight": 1.5 if q < 40 else 1.3 if q < 60 else 1.2 if q < 85 else 1.0, "wavelet": "5/3" if q == 100 else "9/7",
    }


_VALUES = ", ".join(f"({q}, {s}, {d}, {str(c).lower()})" for q, s, d, c in ANCHORS)
PRESET_SQL = f"""
WITH a AS (SELECT *, lead(q) OVER (ORDER BY q) AS q2, lead(step) OVER (ORDER BY q) AS step2, lead(dz) OVER (ORDER BY q) AS dz2, lead(cfl) OVER (ORDER BY q) AS cfl2
           FROM (SELECT q, CAST(s AS DOUBLE) AS step, CAST(d AS DOUBLE) AS dz, c AS cfl FROM (VALUES {_VALUES}) v(q, s, d, c))),
j AS (SELECT CAST(r.q AS BIGINT) AS q, a.*, coalesce((r.q - a.q) / CAST(a.q2 - a.q AS DOUBLE), 0) AS t FROM (SELECT unnest(range(1, 101)) AS q) r JOIN a ON r.q >= a.q AND (r.q < a.q2 OR a.q2 IS NULL))
SELECT q, round(exp(ln(step) + t * (ln(coalesce(step2, step)) - ln(step))), 6) AS step, round(dz + t * (coalesce(dz2, dz) - dz), 6) AS dead_zone,
       CASE WHEN t < 0.5 THEN cfl ELSE cfl2 END AS cfl, CASE WHEN q >= 50 THEN 4 ELSE 3 END::BIGINT AS levels, q <= 80 AS aq, CASE WHEN q >= 70 THEN 0.2 ELSE 0.15 END::DOUBLE AS aq_strength,
       CASE WHEN q < 40 THEN 1.5 WHEN q < 60 THEN 1.3 WHEN q < 85 THEN 1.2 ELSE 1.0 END::DOUBLE AS chroma_weight, CASE WHEN q = 100 THEN '5/3' ELSE '9/7' END AS wavelet
FROM j"""


def is_lossless(step: float, dead_zone: float, wavelet: str, transform: str = "wavelet") -> bool:
    return step <= 1.0 and dead_zone == 0.0 and wavelet == "5/3" and transform == "wavelet"


def subband_weights(levels: int, kind: str = "uniform", coarse_first: bool = False, corner: float = 1.0) -> list[float]:
    """Step factors: low band, then left, right and corner of each level, finest first. Perceptual weights grow towards
    the coarse levels, or towards the fine ones if coarse_first."""
    if kind == "uniform":
        return [1.0] * (1 + 3 * levels)
    out = [1.0]
    for i in range(levels):
        rank = levels - 1 - i if coarse_first else i
        edge = 1.0 + 0.5 * rank
        last = i == 0 if coarse_first else i == levels - 1
        out += [edge, edge, (edge + (1.0 if last else 0.5)) * corner]
    return out


def packed_weights(weights: list[float], chroma: float = 1.0) -> list[float]:
    """Sixteen slots; levels that do not fit are left at 1."""
    whole = weights[: 1 + (15 // 3) * 3]
    return [w * chroma for w in whole + [1.0] * (16 - len(whole))]


def bitrate(s: Column) -> Column:
    """Bits a second from a number with an optional K, M or G; null for anything else."""
    factor = {"K": 1e3, "M": 1e6, "G": 1e9}
    unit = F.upper(F.regexp_extract(s, "([KkMmGg])$", 1))
    scale = F.lit(1.0)
    for u, f in factor.items():
        scale = F.when(unit == u, f).otherwise(scale)
    return F.when(s.rlike("^[0-9.]+[KkMmGg]?$"), F.expr("1.0d") * F.regexp_extract(s, "^([0-9.]+)", 1).try_cast("double") * scale)


def rate_mode(s: Column) -> Column:
    return F.when(F.lower(s).isin("cbr", "vbr"), F.lower(s))


def temporal_kind(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.isin("none", "haar", "auto"), low).when(low.isin("53", "legall53", "5/3"), "5/3")


def wavelet_kind(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.isin("53", "5/3", "legall53", "legall"), "5/3").when(low.isin("97", "9/7", "cdf97", "cdf"), "9/7")


def chroma_kind(s: Column) -> Column:
    plain = F.replace(F.replace(F.lower(s), F.lit("yuv"), F.lit("")), F.lit(":"), F.lit(""))
    return F.when(plain.isin("444", "422", "420"), plain)


def temporal_mode(fps: Column, q: Column) -> Column:
    """Automatic choice: none below one frame a second; two frames a group up to 25 or from quality 90, else four."""
    return F.when(fps < 1, "none").when((fps <= 25) | (q >= 90), "haar2").otherwise("haar4")


def csv_name(path: str, suffix: str) -> str:
    stem, dot, kind = path.rpartition(".")
    return f"{stem}{suffix}.{kind}" if dot else f"{path}{suffix}"


#: Capacity of one of a Rice tile's 256 streams: bits a sample at step 0 and their fall with the step, the margin, the least, and the most
#: of tiles up to 128 and of larger ones (fixed values).
_BITS, _FALL, _MARGIN, _LEAST, _MOST_SMALL, _MOST_LARGE = 15.0, 0.3, 3, 256, 1024, 4096


def rice_stream_bytes(tile: Column, step: Column) -> Column:
    """Bytes that a stream may take: the estimate with its margin, rounded up to a power of two, within bounds."""
    bits = _BITS / (1 + _FALL * F.least(F.greatest(step, F.lit(0.5)), F.lit(64.0)))
    need = F.greatest(F.floor(bits * tile * tile / 8 * _MARGIN / 256), F.lit(1))
    most = F.when(tile <= 128, _MOST_SMALL).otherwise(_MOST_LARGE)
    return F.greatest(F.lit(_LEAST), F.least(most, F.pow(F.lit(2.0), F.ceil(F.log2(need))))).cast("long")
