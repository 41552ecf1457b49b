"""Rate control: buffer, model fit, step choice; as folds over ordered sequences."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 30


def _exp(x: float) -> float:
    """e^x, infinite where it passes the largest double, as math.exp raises an error there."""
    try:
        return math.exp(x)
    except OverflowError:
        return math.inf


def _power(x: float, y: float) -> float:
    """x^y of a positive x, infinite where it passes the largest double."""
    try:
        return x**y
    except OverflowError:
        return math.inf


def buffer_fold(df: DataFrame, keys: list[str], bits: Column, budget: float, capacity: float) -> DataFrame:
    """(keys, fills): the buffer after each frame of a key, half full at first; a fold that Spark runs over the ordered array."""
    rows = df.select(*keys, F.struct("pos", bits.alias("bits")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))

    def step(acc: Column, s: Column) -> Column:
        fill = F.least(F.greatest(acc["at"] + budget - s["bits"], F.lit(0.0)), F.lit(capacity))
        return F.struct(fill.alias("at"), F.concat(acc["out"], F.array(fill)).alias("out"))

    zero = F.struct(F.lit(capacity / 2).alias("at"), F.array().cast("array<double>").alias("out"))
    return rows.select(*keys, F.aggregate("s", zero, step)["out"].alias("fills"))


def fit_window(df: DataFrame, keys: list[str], history: int = HISTORY) -> DataFrame:
    """Adds n and alpha: bpp = c * step^-alpha by least squares in logarithms over the last samples; null if it is no sensible model."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-(history - 1), 0)
    x, y = F.ln("step"), F.ln("bpp")
    slope = F.regr_slope(y, x).over(w)
    return df.withColumns({"n": F.count("*").over(w), "alpha": F.when((-slope > 0.1) & (-slope < 5), -slope)})


@dataclass
class Controller:
    """The controller's state for one sequence, for stateful streams and grouped folds."""

    bitrate: float
    fps: float
    pixels: int
    mode: str = "vbr"
    c: float = 2.6
    alpha: float = 1.2
    fill: float = -1.0
    history: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.capacity = self.bitrate * (1.0 if self.mode == "cbr" else 2.0)
        if self.fill < 0:
            self.fill = self.capacity / 2

    def step(self) -> float:
        """The step for the next frame: the model's, moved by the buffer."""
        target = self.bitrate / (self.fps * self.pixels)
        raw = _power(self.c / target, 1 / self.alpha) if target > 0 and self.c > 0 and self.alpha > 0 else 4.0
        edge, force = (0.2, 0.5) if self.mode == "cbr" else (0.1, 0.3)
        full = self.fill / self.capacity
        factor = 1 / (1 + (full - 1 + edge) / edge * force) if full > 1 - edge else 1 + (edge - full) / edge * force if full < edge else 1.0
        return min(max(min(max(raw, 0.5), 128.0) * factor, 0.5), 128.0)

    def update(self, step: float, bpp: float, frames: int = 1) -> None:
        """Takes in one sample, which stands for a frame or for a group of frames."""
        self.history = [*self.history, (step, bpp)][-HISTORY:]
        self._fit()
        self.fill = min(max(self.fill + frames * (self.bitrate / self.fps - bpp * self.pixels), 0.0), self.capacity)

    def _fit(self) -> None:
        good = [(s, b) for s, b in self.history if s > 0 and b > 0]
        if len(self.history) < 2:
            if good:
                self.c = good[-1][1] * _power(good[-1][0], self.alpha)
            return
        if len(good) < 2:
            return
        n, xs, ys = len(good), [math.log(s) for s, _ in good], [math.log(b) for _, b in good]
        det = n * sum(x * x for x in xs) - sum(xs) ** 2
        if abs(det) < 1e-12:
            self.c = sum(b for _, b in good) / n * _power(sum(s for s, _ in good) / n, self.alpha)
            return
        slope = (n * sum(x * y for x, y in zip(xs, ys, strict=True)) - sum(xs) * sum(ys)) / det
        c = _exp((sum(ys) - slope * sum(xs)) / n)
        if 0.1 < -slope < 5 and c > 0 and math.isfinite(c):
            self.alpha, self.c = -slope, c
