"""Quality of a reconstruction: PSNR, SSIM, rate-distortion curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quant import psnr


def psnr_by(df: DataFrame, keys: list[str], a: str, b: str, peak: float = 255.0) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d * d).alias("mse")).withColumn("psnr", psnr(F.col("mse"), peak))


def ssim(df: DataFrame, keys: list[str], a: str, b: str, peak: float = 255.0) -> DataFrame:
    """(keys, ssim): one window over all samples, population moments."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    m = df.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab"))
    c = F.col
    top = (2 * c("ma") * c("mb") + c1) * (2 * c("cab") + c2)
    return m.select(*keys, (top / ((c("ma") * c("ma") + c("mb") * c("mb") + c1) * (c("va") + c("vb") + c2))).alias("ssim"))


def trapezoid_area(df: DataFrame, keys: list[str], x: str, y: str, low: Column, high: Column) -> DataFrame:
    """(keys, area): integral of the piecewise linear curve of (x, y) between low and high."""
    w = Window.partitionBy(*keys).orderBy(x)
    seg = df.withColumns({"x2": F.lead(x).over(w), "y2": F.lead(y).over(w), "lo": low, "hi": high}).where(f"x2 is not null and x2 > {x}")
    a, b = F.greatest(F.col(x), F.col("lo")), F.least(F.col("x2"), F.col("hi"))
    at = lambda p: F.col(y) + (p - F.col(x)) / (F.col("x2") - F.col(x)) * (F.col("y2") - F.col(y))
    return seg.groupBy(*keys).agg(F.sum(F.when(b > a, (b - a) * (at(a) + at(b)) / 2).otherwise(0.0)).alias("area"))


def _spline_integral(x: np.ndarray, y: np.ndarray, low: float, high: float) -> float:
    """Integral of the natural cubic spline through the points between low and high."""
    n, h = len(x) - 1, np.diff(x)
    a = np.zeros((n + 1, n + 1))
    rhs = np.zeros(n + 1)
    a[0, 0] = a[n, n] = 1.0
    for i in range(1, n):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, rhs)

    def upto(i: int, t: float) -> float:
        c1 = (y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6
        return y[i] * t + c1 * t * t / 2 + m[i] * t**3 / 6 + (m[i + 1] - m[i]) / h[i] * t**4 / 24

    total = 0.0
    for i in range(n):
        lo, hi = max(low, x[i]), min(high, x[i + 1])
        if hi > lo:
            total += upto(i, hi - x[i]) - upto(i, lo - x[i])
    return total


def _clean(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finite points in order of x, one for each x."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    keep = np.concatenate([[True], np.diff(x) > 1e-12]) if len(x) else np.zeros(0, bool)
    return x[keep], y[keep]


def bd_rate(bpp_a, psnr_a, bpp_b, psnr_b) -> float | None:
    """Average difference in rate of curve b against a at equal quality, in percent; None without four points each or overlap."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a = _clean(np.asarray(psnr_a, float), np.log(np.asarray(bpp_a, float)))
        b = _clean(np.asarray(psnr_b, float), np.log(np.asarray(bpp_b, float)))
    mean = _mean_gap(a, b)
    return None if mean is None else float((np.exp(mean) - 1) * 100)


def bd_psnr(bpp_a, psnr_a, bpp_b, psnr_b) -> float | None:
    """Average difference in quality of curve b against a at equal rate."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a = _clean(np.log(np.asarray(bpp_a, float)), np.asarray(psnr_a, float))
        b = _clean(np.log(np.asarray(bpp_b, float)), np.asarray(psnr_b, float))
    mean = _mean_gap(a, b)
    return None if mean is None else float(mean)


def _mean_gap(a: tuple, b: tuple) -> float | None:
    if min(len(a[0]), len(b[0])) < 4:
        return None
    low, high = max(a[0][0], b[0][0]), min(a[0][-1], b[0][-1])
    if high - low <= 1e-12:
        return None
    return (_spline_integral(*b, low, high) - _spline_integral(*a, low, high)) / (high - low)


def bd_rates(points: DataFrame, key: str, anchor: str) -> DataFrame:
    """(key, bd_rate, bd_psnr) of every curve of points (key, bpp, psnr) against the anchor's.

    A curve is a few points; the anchor's are broadcast within their array and each other curve is one group.
    """
    curve = F.collect_list(F.struct("bpp", "psnr")).alias("curve")
    curves = points.groupBy(key).agg(curve)
    base = curves.where(F.col(key) == anchor).select(F.col("curve").alias("base"))

    def run(batches):
        for pdf in batches:
            rows = []
            for k, c, b in zip(pdf[key], pdf["curve"], pdf["base"], strict=True):
                args = [[p["bpp"] for p in b], [p["psnr"] for p in b], [p["bpp"] for p in c], [p["psnr"] for p in c]]
                rows.append((k, bd_rate(*args), bd_psnr(*args)))
            yield pd.DataFrame(rows, columns=[key, "bd_rate", "bd_psnr"])

    kind = points.schema[key].dataType.simpleString()
    return curves.join(F.broadcast(base)).mapInPandas(run, f"{key} {kind}, bd_rate double, bd_psnr double")
