"""Streams in order of event time: event leaders and rolling quantiles over rows, for rows that come in any order within a stated lateness.

A key's rows wait in its state until the watermark has passed them, are then taken in order, and come out once. A timer in event time
wakes a key that nothing new comes for, so its last rows come out as soon as any key's rows move the watermark on. Rows without a
time have no place and are left out, as are rows that come later than stated. The state is what came within the lateness, and the
last leader or the last rows of the window.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _split(rows: list[tuple], watermark: int) -> tuple[list[tuple], list[tuple]]:
    """Rows (microseconds, ...) in order: those that the watermark (milliseconds) has passed, and those that wait."""
    rows = sorted(rows, key=lambda r: r[:2])
    n = bisect_left(rows, watermark * 1000 + 1, key=lambda r: r[0])
    return rows[:n], rows[n:]


def _wake(state: GroupState, waiting: list[tuple]) -> None:
    if waiting:
        state.setTimeoutTimestamp(-(-waiting[0][0] // 1000))


def leaders(stream: DataFrame, threshold: float, *, late: str = "1 minute", recording="recording", ts="ts") -> DataFrame:
    """(recording, leader): a peak leads an event if it comes more than `threshold` seconds after the last leader, by the peaks' times."""
    kind = stream.schema[recording].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        new = [] if state.hasTimedOut else [int(t) for part in parts for t in part["_us"]]
        due, rest = _split([(t, 0) for t in {*waiting, *new}], state.getCurrentWatermarkMs())
        found = []
        for t, _ in due:
            if last is None or t - last > threshold * 1_000_000:
                last = t
                found.append(t)
        state.update((last, [t for t, _ in rest]))
        _wake(state, rest)
        if found:
            yield pd.DataFrame({recording: [key[0]] * len(found), "us": found})

    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(recording, ts, F.unix_micros(ts).alias("_us"))
    out = rows.groupBy(recording).applyInPandasWithState(step, f"{recording} {kind}, us long", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(recording, F.timestamp_micros("us").alias("leader"))


def rolling_quantile(stream: DataFrame, window: int, *, quantile: float = 0.5, late: str = "1 minute", key="key", ts="ts", tie="tie", value="value") -> DataFrame:
    """key, ts, tie, value, baseline, detrended: as the batch operator's trailing window of rows, in order of time and `tie` (a long).

    The window is a list in order of time and the same values sorted: a row costs two searches and two moves in the sorted one, not
    a sort of the window. NULL values take a place in the window and no part in the quantile.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ties, values, before = state.get if state.exists else ([], [], [], [])
        rows = list(zip(times, ties, values, strict=True))
        if not state.hasTimedOut:
            for part in parts:
                rows += [(int(t), int(n), None if pd.isna(v) else float(v)) for t, n, v in zip(part["_us"], part[tie], part[value], strict=True)]
        due, rest = _split(rows, state.getCurrentWatermarkMs())
        last, ordered, base = deque(before), sorted(v for v in before if v is not None), []
        for _, _, v in due:
            last.append(v)
            if v is not None:
                insort(ordered, v)
            gone = last.popleft() if len(last) > window else None
            if gone is not None:
                ordered.pop(bisect_left(ordered, gone))
            at = quantile * (len(ordered) - 1)
            low = int(at)
            base.append(None if not ordered else ordered[low] + (at - low) * (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]))
        state.update(([r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest], list(last)))
        _wake(state, rest)
        if due:
            yield pd.DataFrame({key: [k[0]] * len(due), "us": [r[0] for r in due], tie: [r[1] for r in due], "value": pd.array([r[2] for r in due], "Float64"), "baseline": pd.array(base, "Float64")})

    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("_us"), F.col(tie).cast("long").alias(tie), F.col(value).cast("double").alias(value))
    out = rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, us long, {tie} long, value double, baseline double", "times array<long>, ties array<long>, vals array<double>, last array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select(key, F.timestamp_micros("us").alias("ts"), tie, "value", "baseline", (F.col("value") - F.col("baseline")).alias("detrended"))
