"""Peaks of traces: detection, realignment, widths, vetoes, amplitudes and intervals between them.

Detection is greedy in places, so it runs per trace in Arrow; all else is joins on (key, frame) and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.scalars import compensated_mean
from .traces import KEY, ORDER, VALUE, by, each_trace, with_double

_PEAK = "peak int, prominence double, left double, right double"


def detect(df: DataFrame, *, height=0.0, distance=150, prominence=4.01, width=None, flat=True, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """key, peak, prominence, left and right half-height limits of every peak. Missing samples count as 0. Flat tops count as peaks
    at their middle unless `flat` is off."""

    def find(at: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        found = kernels.find_peaks(np.nan_to_num(x.astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf), height=height, distance=distance, prominence=prominence, width=width, flat=flat)
        limits = {s: np.interp(found[s], np.arange(len(at)), at) for s in ("left", "right")}
        return {"peak": at[found["peak"]].astype(np.int32), "prominence": found["prominence"], **limits}

    return each_trace(df, find, _PEAK, order, value, key=key, order=order)


def candidates(df: DataFrame, *, height: float | None = None, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Rows that are local maxima; of a flat top its middle row, rounded down. Windows only."""
    w, v = by(key, order), F.col(value)
    out = df.withColumn("_new", F.coalesce((v != F.lag(v).over(w)).cast("int"), F.lit(1)))
    out = out.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(key, "_run")
    out = out.withColumns({"_a": F.min(order).over(run), "_b": F.max(order).over(run), "_prev": F.lag(v).over(w), "_next": F.lead(v).over(w)})
    out = out.withColumns({"_before": F.first("_prev").over(run.orderBy(order)), "_after": F.last("_next").over(run.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    top = (v > F.col("_before")) & (v > F.col("_after")) & (F.col(order) == F.expr("(_a + _b) div 2"))
    return out.where(top & (v >= height) if height is not None else top).select(*df.columns)


def _near(peaks: DataFrame, df: DataFrame, before, after, *, key=KEY, order=ORDER) -> DataFrame:
    """Each peak with the rows of its trace from `before` frames before to `after` after it, by an equi-join on frames."""
    rows = peaks.withColumn(order, F.explode(F.sequence(F.col("peak") - before, F.col("peak") + after)))
    return rows.join(df, [key, order])


def realign(peaks: DataFrame, df: DataFrame, window: int = 10, *, negative=False, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Moves each peak to the first largest (or smallest) sample within `window` frames: key, peak, aligned."""
    near = _near(peaks.select(key, "peak"), df.select(key, order, value), window, window, key=key, order=order)
    v = -F.col(value) if negative else F.col(value)
    return near.groupBy(key, "peak").agg(F.max_by(order, F.struct(v, -F.col(order))).alias("aligned"))


def nearest(peaks: DataFrame, df: DataFrame, window: int = 10, *, negative=False, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """As `realign`, without the last frame of the window."""
    near = _near(peaks.select(key, "peak"), df.select(key, order, value), window, window - 1, key=key, order=order)
    v = -F.col(value) if negative else F.col(value)
    return near.groupBy(key, "peak").agg(F.max_by(order, F.struct(v, -F.col(order))).alias("nearest"))


def half_widths(df: DataFrame, peaks: DataFrame, *, share=0.5, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """key, peak, prominence, left, right of given peaks, which are frames of their traces."""
    marks = peaks.select(key, F.col("peak").alias(order), F.lit(1).alias("_peak")).distinct()

    def measure(at: np.ndarray, x: np.ndarray, peak: np.ndarray) -> dict[str, np.ndarray]:
        x, p = np.nan_to_num(x.astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf), np.flatnonzero(peak == 1)
        prom = kernels.prominences(x, p)
        left, right = kernels.widths(x, p, prom, share)
        return {"peak": at[p].astype(np.int32), "prominence": prom, "left": left, "right": right}

    marked = df.select(key, order, value).join(marks, [key, order], "left")
    return each_trace(marked, measure, _PEAK, order, value, "_peak", key=key, order=order)


def correlation_veto(peaks: DataFrame, correlations: DataFrame, fps: float, threshold: float, *, key=KEY, order=ORDER, value="r") -> DataFrame:
    """Peaks whose largest local correlation in [p - 1.5 s, p + 1 s) reaches the threshold. Peaks at the ends stay; 0 turns it off."""
    if threshold == 0:
        return peaks
    before, after = int(1.5 * fps), int(fps)
    n = correlations.groupBy(key).agg(F.count("*").alias("_n"))
    best = _near(peaks.select(key, "peak"), correlations.select(key, order, value), before, after - 1, key=key, order=order).groupBy(key, "peak").agg(F.max(value).alias("_best"))
    out = peaks.join(n, key, "left").join(best, [key, "peak"], "left")
    inside = (F.col("peak") > 1.5 * fps) & (F.col("peak") < F.col("_n") - fps)
    return out.where(~F.coalesce(inside & (F.col("_best") < threshold), F.lit(False))).drop("_n", "_best")


def intervals_between(peaks: DataFrame, fps: float = 1.0, *, key=KEY) -> DataFrame:
    """Adds `isi`, the seconds since the key's previous peak (NULL for its first)."""
    return peaks.withColumn("isi", (F.col("peak") - F.lag("peak").over(by(key, "peak"))) / F.lit(fps))


def interval_stats(peaks: DataFrame, fps: float = 1.0, *, key=KEY) -> DataFrame:
    """key, n_peaks, mean_isi and cv (population deviation over mean)."""
    rows = intervals_between(peaks, fps, key=key)
    return rows.groupBy(key).agg(F.count("*").alias("n_peaks"), F.avg("isi").alias("mean_isi"), F.try_divide(F.stddev_pop("isi"), F.avg("isi")).alias("cv"))


def amplitudes(peaks: DataFrame, df: DataFrame, *, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Adds `amplitude`, the value at the peak."""
    at = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(value).alias("amplitude"))
    return peaks.join(at, (F.col(key) == F.col("_k")) & (F.col("peak") == F.col("_o")), "left").drop("_k", "_o")


def mean_around(peaks: DataFrame, df: DataFrame, window: int = 10, *, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """key, peak, mean of [peak - window, peak + window); NULL where that begins before the trace."""
    near = _near(peaks.select(key, "peak"), df.select(key, order, value), window, window - 1, key=key, order=order)
    mean = near.groupBy(key, "peak").agg(compensated_mean(F.sort_array(F.collect_list(F.col(value).cast("double")))).alias("mean"))
    return peaks.select(key, "peak").join(mean, [key, "peak"], "left").withColumn("mean", F.when(F.col("peak") >= window, F.col("mean")))


def max_around(peaks: DataFrame, other: DataFrame, fps: float, *, within_s: float = 3.0, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """key, peak, rate: the largest value of a second trace within some seconds of the peak, times the frame rate."""
    n = int(within_s * fps)
    near = _near(peaks.select(key, "peak"), other.select(key, order, value), n, n - 1, key=key, order=order)
    return peaks.select(key, "peak").join(near.groupBy(key, "peak").agg((F.max(value) * fps).alias("rate")), [key, "peak"], "left")


def match_template(df: DataFrame, query: list[float], k: int, *, apart: bool = False, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """key, start, distance: the k + 1 stretches of each trace nearest to the query, none of which starts inside one before it;
    with `apart` no two overlap."""
    kind, q = df.schema[key].dataType.simpleString(), np.asarray(query, float)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        profile = kernels.distance_profile(x, q) if len(x) >= len(q) else np.empty(0)
        starts = kernels.best_matches(profile, len(q), k, apart=apart)
        return pd.DataFrame({key: pdf[key].iloc[0], "start": pdf[order].to_numpy()[starts] if starts else [], "distance": profile[starts] if starts else []})

    return df.select(key, order, value).groupBy(key).applyInPandas(match, f"{key} {kind}, start int, distance double")


def highpass(df: DataFrame, *, fps=20.0, cutoff_hz=1 / 60, degree=3, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Adds `filtered`: zero-phase Butterworth high-pass of each run of present samples. Traces come one after another in batches, so a
    trace costs no call of Spark's, and memory is that of a trace and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held)
            x, starts = t[value].to_numpy().astype(float), np.flatnonzero(t["_at"].to_numpy() == 1)
            out = np.concatenate([kernels.highpass(part, fps, cutoff_hz, degree) for part in np.split(x, starts[1:])])
            yield from t.drop_columns("_at").append_column("filtered", pa.array(out, from_pandas=True)).combine_chunks().to_batches()

        for batch in batches:
            starts = np.flatnonzero(batch.column("_at").to_numpy() == 1)
            if len(starts) and (held or starts[-1]):
                if starts[-1]:
                    held.append(pa.Table.from_batches([batch.slice(0, starts[-1])]))
                yield from done()
                held = []
                batch = batch.slice(starts[-1])
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
        if held:
            yield from done()

    rows = df.withColumn("_at", F.row_number().over(by(key, order)))
    out = rows.mapInArrow(run, with_double(df, "filtered"))
    return out.withColumn("filtered", F.when(~F.isnan("filtered"), F.col("filtered")))


def noise(df: DataFrame, *, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """key, noise: amplitude of the upper half of the spectrum."""
    kind = df.schema[key].dataType.simpleString()

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "noise": [kernels.noise_amplitude(pdf.sort_values(order)[value].to_numpy(float))]})

    return df.select(key, order, value).groupBy(key).applyInPandas(measure, f"{key} {kind}, noise double")


def edit(peaks: DataFrame, log: DataFrame, *, key=KEY) -> DataFrame:
    """Peak lists after manual edits. peaks: (key, positions); log: (key, at, action add or remove, position), applied by `at`:
    the last action on a position decides."""
    last = log.groupBy(key, "position").agg(F.max_by("action", "at").alias("action"))
    lists = last.groupBy(key).agg(*[F.collect_list(F.when(F.col("action") == a, F.col("position"))).alias(f"_{a}") for a in ("add", "remove")])
    empty = F.array().cast("array<int>")
    out = peaks.join(lists, key, "left")
    kept = F.array_except(F.coalesce("positions", empty), F.coalesce("_remove", empty))
    return out.select(*[c for c in peaks.columns if c != "positions"], F.sort_array(F.array_union(kept, F.coalesce("_add", empty))).alias("positions"))
