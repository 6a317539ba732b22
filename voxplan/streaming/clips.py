"""Clips from chunks in keyed state that goes away with its recorder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gathering(StatefulProcessor):
    """A recorder's chunks that are no whole clip yet, as a list of chunks, and the timer that lets them go."""

    def __init__(self, clip_samples: int, idle_ms: int):
        self.clip_samples, self.idle_ms = clip_samples, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "us long, seq long, first int, samples array<double>")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(ts.value // 1000, int(seq), 0, np.asarray(x, float)) for part in rows for ts, seq, x in zip(part["ts"], part["seq"], part["samples"]) if len(x)]
        new.sort(key=lambda c: c[:2])
        chunks = [(us, seq, first, np.asarray(x, float)) for us, seq, first, x in self.chunks.get()] + new if self.chunks.exists() else new
        have, out, i = sum(len(c[3]) for c in chunks), [], 0
        while have >= self.clip_samples:
            us, seq, first, _ = chunks[i]
            parts, left = [], self.clip_samples
            while left:
                at, s, f, x = chunks[i]
                parts.append(x[:left])
                if len(x) > left:
                    chunks[i] = (at, s, f + left, x[left:])
                else:
                    i += 1
                left -= len(parts[-1])
            have -= self.clip_samples
            out.append((key[0], us, seq, first, np.concatenate(parts)))
        self._keep(chunks[i:], max([c[0] for c in new], default=0) // 1000, timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out, columns=["recorder", "us", "seq", "first", "samples"])

    def _keep(self, chunks: list[tuple], last_ms: int, watermark: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        if chunks:
            at = max(last_ms, watermark) + self.idle_ms
            self.chunks.put([(us, seq, first, x.tolist()) for us, seq, first, x in chunks])
            self.handle.registerTimer(at)
            self.timer.update((at,))
        else:
            self.chunks.clear()
            self.timer.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.chunks.clear()
        self.timer.clear()
        return iter([])

    def close(self) -> None:
        pass


def assemble_clips_by_start(chunks: DataFrame, clip_samples: int = 32000, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(recorder, us, seq, first, samples): a clip for each clip_samples of a recorder's chunks (recorder, ts, seq, samples), in order of ts and seq within a batch.

    A clip is named by its first sample: its chunk's time in microseconds and seq, and its place in that chunk. So no number has to
    be kept for a recorder: state is there only while a clip is begun, and none is left when that is whole or the recorder has been idle so
    long. Chunks later than the watermark are dropped, chunks without samples have no effect. A recorder's chunks of one
    micro-batch are in memory at once; the source's limit of a batch bounds them. State is kept in RocksDB, which the
    session is set to use from now on.
    """
    spark = chunks.sparkSession
    if "RocksDB" not in spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, _ROCKS)
    gathering = Gathering(clip_samples, int(pd.Timedelta(idle).total_seconds() * 1000))
    keyed = chunks.withWatermark("ts", late).groupBy("recorder")
    return keyed.transformWithStateInPandas(gathering, "recorder long, us long, seq long, first int, samples array<double>", "append", "eventTime")
