"""Streams of sections through the same ordered gates as batches: one state for each recording."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulseloom.functions import quality as qu
from pulseloom.operators.waveforms import FOLDED, folded_step


def stream_fold(rows: DataFrame, fs: float) -> DataFrame:
    """history_fold over a stream of quality_rows. Sections of a recording are to arrive in order of batches; within a batch they are put
    in order. The state of a recording is a few seconds of samples and some hundred peaks."""
    names = [f.split()[0] for f in FOLDED.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = qu.unpacked(state.get[0]) if state.exists else qu.start(), []
        for row in pd.concat(list(frames)).sort_values("wave_section").to_dict("records"):
            now, got = folded_step(now, row, fs)
            out.append(got)
        state.update((qu.packed(now),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("record_id").applyInPandasWithState(run, FOLDED, "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and means by event type in tumbling (or sliding) windows; rows later than ``late`` are left out in a stream."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    kept = events.withWatermark(time, late) if events.isStreaming else events
    return kept.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
