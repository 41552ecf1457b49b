"""Wavelets over ordered signals and over arrays.

Two forms. Window form: one row a sample, neighbours by lag and lead, for long signals that are keyed and ordered. Array
form: one row a signal or block, higher-order functions, no shuffle. Edges repeat: a missing right even sample is the last
one, a missing left detail the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quant import let

#: Lifting steps and scale of the 9/7 wavelet (fixed values).
ALPHA, BETA, GAMMA, DELTA, SCALE = -1.586134342, -0.052980118, 0.882911075, 0.443506852, 1.149604398
INV_SCALE = 0.869864452


def split_pairs(df: DataFrame, keys: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """(keys, n, even, odd): neighbouring samples side by side; an odd last sample is left out."""
    pair = F.floor(F.col(pos) / 2).cast("long")
    at = F.col(pos) % 2
    g = df.groupBy(*keys, pair.alias("n")).agg(F.max(F.when(at == 0, F.col(value))).alias("even"), F.max(F.when(at == 1, F.col(value))).alias("odd"))
    return g.where(F.col("odd").isNotNull())


def forward53(df: DataFrame, keys: list[str]) -> DataFrame:
    """One level of the integer 5/3 wavelet over (keys, n, even, odd): adds low and high."""
    w = Window.partitionBy(*keys).orderBy("n")
    right = F.coalesce(F.lead("even").over(w), F.col("even"))
    df = df.withColumn("high", F.col("odd") - F.floor((F.col("even") + right) / 2))
    left = F.coalesce(F.lag("high").over(w), F.col("high"))
    return df.withColumn("low", F.col("even") + F.floor((left + F.col("high") + 2) / 4))


def inverse53(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, low, high) back to even and odd."""
    w = Window.partitionBy(*keys).orderBy("n")
    left = F.coalesce(F.lag("high").over(w), F.col("high"))
    df = df.withColumn("even", F.col("low") - F.floor((left + F.col("high") + 2) / 4))
    right = F.coalesce(F.lead("even").over(w), F.col("even"))
    return df.withColumn("odd", F.col("high") + F.floor((F.col("even") + right) / 2))


def forward97(df: DataFrame, keys: list[str]) -> DataFrame:
    """One level of the 9/7 wavelet over (keys, n, even, odd): adds low and high."""
    w = Window.partitionBy(*keys).orderBy("n")
    df = df.withColumns({"low": F.col("even"), "high": F.col("odd")})
    for up, down in ((ALPHA, BETA), (GAMMA, DELTA)):
        df = df.withColumn("high", F.col("high") + up * (F.col("low") + F.coalesce(F.lead("low").over(w), F.col("low"))))
        df = df.withColumn("low", F.col("low") + down * (F.coalesce(F.lag("high").over(w), F.col("high")) + F.col("high")))
    return df.withColumns({"low": F.col("low") * SCALE, "high": F.col("high") * INV_SCALE})


def inverse97(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("n")
    df = df.withColumns({"even": F.col("low") * INV_SCALE, "odd": F.col("high") * SCALE})
    for up, down in ((GAMMA, DELTA), (ALPHA, BETA)):
        df = df.withColumn("even", F.col("even") - down * (F.coalesce(F.lag("odd").over(w), F.col("odd")) + F.col("odd")))
        df = df.withColumn("odd", F.col("odd") - up * (F.col("even") + F.coalesce(F.lead("even").over(w), F.col("even"))))
    return df


def haar(a: Column, b: Column) -> tuple[Column, Column]:
    """Low and high band of a pair: the high is the difference, the low the mean."""
    high = b - a
    return a + high / 2, high


def unhaar(low: Column, high: Column) -> tuple[Column, Column]:
    a = low - high / 2
    return a, a + high


def haar_levels(values: Column, size: int) -> Column:
    """Haar bands of an array of size = 2^n samples: the low one, then the highs from the deepest level to the finest."""
    if size == 1:
        return values
    half = size // 2

    def level(v: Column) -> Column:
        pairs = [haar(F.get(v, F.lit(2 * i)), F.get(v, F.lit(2 * i + 1))) for i in range(half)]
        return F.concat(haar_levels(F.array(*(x for x, _ in pairs)), half), F.array(*(h for _, h in pairs)))

    return let(values, level)


def unhaar_levels(bands: Column, size: int) -> Column:
    if size == 1:
        return bands
    half = size // 2

    def level(low: Column) -> Column:
        pairs = [unhaar(F.get(low, F.lit(i)), F.get(bands, F.lit(half + i))) for i in range(half)]
        return F.array(*(x for p in pairs for x in p))

    return let(unhaar_levels(F.slice(bands, 1, half), half), level)


def temporal53(f0: Column, f1: Column, f2: Column, f3: Column) -> tuple[Column, Column, Column, Column]:
    """5/3 over four samples without rounding: details d0, d1 and lows s0, s1."""
    d0, d1 = f1 - (f0 + f2) / 2, f3 - f2
    return d0, d1, f0 + d0 / 2, f2 + (d0 + d1) / 4


def untemporal53(d0: Column, d1: Column, s0: Column, s1: Column) -> tuple[Column, Column, Column, Column]:
    f0, f2 = s0 - d0 / 2, s1 - (d0 + d1) / 4
    return f0, d0 + (f0 + f2) / 2, f2, d1 + f2


def in_groups(df: DataFrame, keys: list[str], size: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """(keys, g, a): arrays of size consecutive samples; a shorter tail is left out."""
    g = F.floor(F.col(pos) / size).cast("long")
    out = df.groupBy(*keys, g.alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value]).alias("a"))
    return out.where(F.size("a") == size)
