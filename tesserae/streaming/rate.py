"""The rate controller and scene segmentation over streams of frames, keyed by sequence."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rate import Controller


def _restored(text: str | None, bitrate: float, fps: float, pixels: int, mode: str) -> Controller:
    if text is None:
        return Controller(bitrate, fps, pixels, mode)
    return Controller(**json.loads(text))


def controlled(frames: DataFrame, bitrate: float, fps: float, pixels: int, mode: str = "vbr") -> DataFrame:
    """(seq_id, pos, step, fill) of a stream of (seq_id, pos, complexity): the step for each frame in order.

    A frame of complexity c at step s is taken to cost c / s bits a pixel, which updates the model and the buffer. The state
    of a sequence is the controller itself; frames of one micro-batch are taken in order of pos.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = _restored(state.get[0] if state.exists else None, bitrate, fps, pixels, mode)
        rows = []
        for r in pd.concat(list(batches)).sort_values("pos").itertuples():
            step = c.step()
            c.update(step, r.complexity / step)
            rows.append((key[0], int(r.pos), step, c.fill))
        state.update((json.dumps({k: v for k, v in asdict(c).items()}),))
        yield pd.DataFrame(rows, columns=["seq_id", "pos", "step", "fill"])

    return frames.groupBy("seq_id").applyInPandasWithState(run, "seq_id long, pos long, step double, fill double", "state string", "append", GroupStateTimeout.NoTimeout)


def controlled_batch(frames: DataFrame, bitrate: float, fps: float, pixels: int, mode: str = "vbr") -> DataFrame:
    """The same over a table: one fold for each sequence."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, rows = Controller(bitrate, fps, pixels, mode), []
        for r in pdf.sort_values("pos").itertuples():
            step = c.step()
            c.update(step, r.complexity / step)
            rows.append((key[0], int(r.pos), step, c.fill))
        return pd.DataFrame(rows, columns=["seq_id", "pos", "step", "fill"])

    return frames.groupBy("seq_id").applyInPandas(run, "seq_id long, pos long, step double, fill double")


def scene_cuts(frames: DataFrame, threshold: float = 50.0) -> DataFrame:
    """(seq_id, pos, cut, segment) of a stream of (seq_id, pos, value): a step of more than the threshold begins a segment."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, segment = state.get if state.exists else (None, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values("pos").itertuples():
            cut = before is not None and abs(r.value - before) > threshold
            segment += cut
            before = float(r.value)
            rows.append((key[0], int(r.pos), bool(cut), int(segment)))
        state.update((before, segment))
        yield pd.DataFrame(rows, columns=["seq_id", "pos", "cut", "segment"])

    return frames.groupBy("seq_id").applyInPandasWithState(run, "seq_id long, pos long, cut boolean, segment long", "before double, segment long", "append", GroupStateTimeout.NoTimeout)


def grouped_rates(frames: DataFrame, size: int) -> DataFrame:
    """(seq_id, gop, frames, bits): a running count of each group's bits, as a streaming aggregation."""
    gop = F.floor(F.col("pos") / size).cast("long").alias("gop")
    return frames.groupBy("seq_id", gop).agg(F.count("*").alias("frames"), F.sum("bits").alias("bits"))
