"""Settings crossed with frames, and timings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codec

#: Named sweeps: parameter and its values (fixed values).
SWEEPS = {
    "step": {"step": (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)},
    "dead_zone": {"step": (4.0, 8.0), "dead_zone": (0.0, 0.25, 0.5, 0.75, 1.0)},
    "levels": {"step": (4.0,), "levels": (1, 2, 3, 4)},
    "wavelet": {"step": (2.0, 4.0, 8.0), "wavelet": ("5/3", "9/7")},
    "colour": {"step": (4.0, 8.0, 16.0), "alphas": (None, [])},
    "coder": {"step": (4.0, 8.0), "coder": ("rice", "rans", "rans_bands", "huffman", "bitplane")},
    "transform": {"step": (4.0, 8.0), "block_dct": (False, True)},
}


def settings_of(sweep: dict) -> list[dict]:
    return [dict(zip(sweep, v, strict=True)) for v in product(*sweep.values())]


def run(frames: DataFrame, sweep: str | dict, tile: int = 256) -> DataFrame:
    """(settings as JSON, frames, bpp, psnr): every setting of a stated list over every frame; settings are spread over tasks, and partly
    averaged there."""
    chosen = [json.dumps(s, sort_keys=True) for s in settings_of(SWEEPS[sweep] if isinstance(sweep, str) else sweep)]

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                rgb = np.asarray(r.rgb, np.float64).reshape(r.height, r.width, 3)
                f = codec.settings(75, r.width, r.height, tile, **{"alphas": None, "aq": False, "dead_zone": 0.0, "levels": 3, **json.loads(r.settings)})
                blob = codec.encode_frame(rgb, f)
                mse = float(((rgb - np.rint(codec.decode_frame(blob))) ** 2).mean())
                rows.append((r.settings, 8 * len(blob) / (r.width * r.height), mse))
            yield pd.DataFrame(rows, columns=["settings", "bpp", "mse"])

    each = frames.withColumn("settings", F.explode(F.array(*map(F.lit, chosen)))).mapInPandas(coded, "settings string, bpp double, mse double")
    mse = F.avg("mse")
    return each.groupBy("settings").agg(F.count("*").alias("frames"), F.avg("bpp").alias("bpp"), F.when(mse < 1e-10, float("inf")).otherwise(10 * F.log10(255.0 * 255.0 / mse)).alias("psnr"))


def throughput(action: Callable[[], object], pixels: int, runs: int = 5) -> dict[str, float]:
    """Frames and megapixels a second of an action over one frame, after one run to warm up."""
    action()
    began = time.perf_counter()
    for _ in range(runs):
        action()
    each = (time.perf_counter() - began) / runs
    return {"ms": each * 1000, "fps": 1 / each, "mpix_per_s": pixels / each / 1e6}
