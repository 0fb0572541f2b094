"""Threshold events of a stream: the runs that events.detect() finds, closed as their ends become certain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolith.functions.expressions import LEVELS

_ROWS = "t long, v double"
_RUN = "level string, onset long, last long, peak double, total double, n long"
#: Where a session that runs detect_stream() keeps its state; states with timers need it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Runs(StatefulProcessor):
    """Rows wait until the watermark has passed them, are taken in order of time, and open, go on with or close a run of each level. A timer wakes a key for rows that wait and for runs that nothing has gone on with."""

    def __init__(self, key: str, levels: dict[str, float], minutes: int, least: int, close_us: int):
        self.key, self.levels, self.minutes, self.least, self.close_us = key, levels, minutes, least, close_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROWS)
        self.runs = handle.getListState("runs", _RUN)

    def _advance(self, key, new: list[tuple], watermark_us: int) -> Iterator[pd.DataFrame]:
        rows = sorted([*((r[0], r[1]) for r in self.waiting.get()), *new], key=lambda r: r[0])
        ready = [r for r in rows if r[0] < watermark_us]
        later = rows[len(ready) :]
        runs = {r[0]: list(r) for r in self.runs.get()}
        closed = []
        for t, v in ready:
            for level, threshold in self.levels.items():
                on = v is not None and v >= threshold
                run = runs.get(level)
                if run and (not on or t - run[2] > self.close_us):
                    closed.append(runs.pop(level))
                    run = None
                if on and run:
                    run[2], run[3], run[4], run[5] = t, max(run[3], v), run[4] + v, run[5] + 1
                elif on:
                    runs[level] = [level, t, t, v, v, 1]
        for level in [level for level, run in runs.items() if run[2] + self.close_us < watermark_us and not later]:
            closed.append(runs.pop(level))
        self.waiting.put([(t, v) for t, v in later]) if later else self.waiting.clear()
        self.runs.put([tuple(r) for r in runs.values()]) if runs else self.runs.clear()
        wake = [t for t, _ in later[:1]] + [run[2] + self.close_us for run in runs.values()]
        if wake:
            self.handle.registerTimer(max(min(wake), watermark_us) // 1000 + 1)
        found = [r for r in closed if r[5] >= self.least]
        if found:
            at = lambda us: pd.to_datetime(list(us), unit="us", utc=True)
            yield pd.DataFrame({self.key: [key] * len(found), "level": [r[0] for r in found], "onset": at(r[1] for r in found), "end": at(r[2] for r in found), "peak_s4": [r[3] for r in found], "mean_s4": [r[4] / r[5] for r in found], "duration_min": [r[5] * self.minutes for r in found]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), None if v is None or v != v else float(v)) for part in rows for t, v in zip(part["event_us"], part["event_value"])]
        yield from self._advance(key[0], new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def detect_stream(df: DataFrame, value: str, time: str, key: str, minutes: int = 30, least_minutes: int = 30, thresholds: dict[str, float] | None = None, late: str = "1 hour", close_hours: float = 24.0) -> DataFrame:
    """key, level, onset, end, peak_s4, mean_s4, duration_min of the events of a stream, each given out once, in append mode.

    As events.detect(): a null ends a run, a missing step of time doesn't, and a run has at least max(1, least_minutes //
    minutes) rows. A run is closed by the row that ends it, or when the watermark (the latest time less `late`) is
    close_hours past its last row; a row that comes after such a silence begins a new run. Rows later than the watermark
    allows are dropped; rows without a time or key are left out. Open runs and waiting rows are state, so they last from
    batch to batch and through a restart. Event time needs a zone; times come out in UTC. The session needs PROVIDER.
    """
    levels = thresholds or {name: least for name, least, *_ in LEVELS}
    rows = df.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late).select(key, time, F.unix_micros(time).alias("event_us"), F.col(value).cast("double").alias("event_value"))
    kind = df.schema[key].dataType.simpleString()
    made = f"{key} {kind}, level string, onset timestamp, end timestamp, peak_s4 double, mean_s4 double, duration_min long"
    runs = _Runs(key, levels, minutes, max(1, least_minutes // minutes), int(close_hours * 3_600_000_000))
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=runs, outputStructType=made, outputMode="append", timeMode="eventtime")
