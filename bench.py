"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is run once to warm up and then RUNS times; its figure is the median of writing its whole result to a sink that
keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = (
    "band_cost", "deadzone_quantize", "dequantize_error", "ycocg_forward", "pack_u8", "haar_multilevel4", "lifting53_level", "lifting97_level", "scene_cut_segments", "decode_order",
    "frame_offsets", "vbv_fill", "dct8_block", "aq_weight_map", "cfl_residual", "block_match_argmin", "motion_residual", "rice_bit_length", "histogram_normalize_largest",
    "median3_predictor_delta", "psnr_by_group", "sweep_deadzone", "codec_frames", "coder_round_trip",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tesserae.plans.catalogue import QUERIES
    from tesserae.session import local_session

    spark = local_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    times: dict[str, float] = {}
    for name in names:
        own = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            own.append(time.perf_counter() - began)
        times[name] = round(statistics.median(own[1:]), 4)
    spark.stop()
    sf = re.search(r"sf([0-9.]+)$", sf_dir.rstrip("/"))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else sf_dir}))


if __name__ == "__main__":
    main()
