"""Trace operators: baselines, detrending, gaps, robust scores, smoothing, extrema, stacking and joining of recordings.

A trace is the rows of one `key` in the order of `order`, a whole number from 0; `value` is a double, NULL where missing.
Everything is a window over one key, so a plan has one exchange on the key. Long rolling medians can run in Arrow
(`engine="arrow"`), where the cost of a row does not grow with the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

KEY, ORDER, VALUE = "cell", "frame", "f"


def by(key: str | list[str] = KEY, order: str | None = ORDER):
    w = W.partitionBy(*([key] if isinstance(key, str) else key))
    return w.orderBy(order) if order else w


def with_double(df: DataFrame, name: str) -> StructType:
    """The schema of df and one more column of doubles; any may be NULL."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + [StructField(name, DoubleType())])


def frames(df: DataFrame, key: str, *order: str, name: str = ORDER) -> DataFrame:
    """Adds the position of each row in its key, from 0."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def each_trace(df: DataFrame, work: Callable[..., dict[str, np.ndarray]], kinds: str, *columns: str, key: str = KEY, order: str = ORDER) -> DataFrame:
    """key and what work(*columns of a trace in its order, as NumPy arrays) returns. Traces come in order of their key in batches of
    samples, so a trace costs no call of Spark's, and memory is that of a trace and a batch."""
    names = [part.split()[0] for part in kinds.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(t: pa.Table, cuts: list[int]) -> list[pa.RecordBatch]:
            arrays = [t[c].to_numpy() for c in columns]
            found = [work(*[a[i:j] for a in arrays]) for i, j in zip(cuts, cuts[1:])]
            first = np.repeat(cuts[:-1], [len(f[names[0]]) for f in found])
            made = pa.table([t[key].take(pa.array(first)), *[pa.array(np.concatenate([f[n] for f in found])) for n in names]], [key, *names])
            return made.combine_chunks().to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            k = pa.concat_arrays([*(h[key].combine_chunks().slice(h.num_rows - 1) for h in held[-1:]), batch.column(key)])
            a, b = k.slice(1), k.slice(0, len(k) - 1)
            new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(new) + (0 if held else 1)
            if not len(cuts):
                held.append(t)
                continue
            whole = pa.concat_tables([*held, t.slice(0, cuts[-1])])
            before = sum(h.num_rows for h in held)
            yield from done(whole, [0, *(cuts + before).tolist()])
            held = [t.slice(cuts[-1])]
        if held:
            whole = pa.concat_tables(held)
            yield from done(whole, [0, whole.num_rows])

    rows = df.select(key, order, *[c for c in columns if c != order]).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, f"{key} {kind}, {kinds}")


# Baselines


def dff0(df: DataFrame, *, first: int = 0, last: int = 5, quantile: float | None = None, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """(f - f0) / f0; f0 is the mean of frames [first, last), or a quantile of the whole trace."""
    v = F.col(value)
    f0 = F.avg(F.when((F.col(order) >= first) & (F.col(order) < last), v)) if quantile is None else F.percentile(v, quantile)
    return df.withColumn("dff0", F.try_divide(v - f0.over(by(key, None)), f0.over(by(key, None))))


def dff0_first_half(df: DataFrame, *, quantile: float = 0.3, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """(f - f0) / f0 with f0 a quantile of the first half of the frames."""
    whole = by(key, None)
    out = df.withColumn("_n", F.count("*").over(whole))
    f0 = F.percentile(F.when(F.col(order) < F.expr("_n div 2"), F.col(value)), quantile).over(whole)
    return out.withColumn("_f0", f0).withColumn("dff0", F.try_divide(F.col(value) - F.col("_f0"), F.col("_f0"))).drop("_n", "_f0")


def _rolling_arrow(df: DataFrame, window: int, quantile: float, center: bool, least: int, key, order, value) -> DataFrame:
    # A struct comes as a dict, which has no order; the tuple of its values has.
    by_fields = (lambda c: c.map(lambda at: tuple(at.values()))) if isinstance(df.schema[order].dataType, StructType) else None

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, key=by_fields)
        x = pdf[value].astype(float)
        pdf["baseline"] = x.rolling(window, center=center, min_periods=max(1, least)).quantile(quantile)
        return pdf

    return df.groupBy(key).applyInPandas(roll, with_double(df, "baseline"))


#: Windows longer than this go to the Arrow form unless an engine is named: the cost of a row of the SQL form grows with the window.
LONG_WINDOW = 100


def rolling_quantile(df: DataFrame, window: int, *, quantile=0.5, center=False, min_periods=0, engine: str | None = None, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Adds `baseline`, the quantile of the window: trailing, or centred with the longer half before. engine: sql or arrow (the same
    result); by the window's length if none is named."""
    if (engine or ("arrow" if window > LONG_WINDOW else "sql")) == "arrow":
        return _rolling_arrow(df, window, quantile, center, min_periods, key, order, value)
    w = by(key, order).rowsBetween(-(window // 2), (window - 1) // 2) if center else by(key, order).rowsBetween(-(window - 1), 0)
    base = F.percentile(F.col(value), quantile).over(w)
    return df.withColumn("baseline", F.when(F.count(F.col(value)).over(w) >= min_periods, base) if min_periods > 1 else base)


def rolling_median_detrend(df: DataFrame, window: int = 1000, *, engine: str | None = None, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Adds `detrended`: the value less its trailing rolling median."""
    out = rolling_quantile(df, window, engine=engine, key=key, order=order, value=value)
    return out.withColumn("detrended", F.col(value) - F.col("baseline")).drop("baseline")


def rolling_percentile_detrend(df: DataFrame, window: int = 1200, *, quantile=0.1, center=True, min_periods: int | None = None, engine: str | None = None, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Adds `detrended`: the value less a rolling quantile whose gaps are interpolated."""
    least = max(10, window // 5) if min_periods is None else min_periods
    out = rolling_quantile(df, window, quantile=quantile, center=center, min_periods=least, engine=engine, key=key, order=order, value=value)
    out = interpolate(out, key=key, order=order, value="baseline", name="baseline")
    return out.withColumn("detrended", F.col(value) - F.col("baseline")).drop("baseline")


# Gaps


def interpolate(df: DataFrame, *, key=KEY, order=ORDER, value=VALUE, name="filled") -> DataFrame:
    """Adds `name`: the value, straight lines across gaps inside the trace and the nearest value at its ends."""
    before, after = by(key, order).rowsBetween(W.unboundedPreceding, 0), by(key, order).rowsBetween(0, W.unboundedFollowing)
    v, at = F.col(value), F.when(F.col(value).isNotNull(), F.col(order))
    out = df.withColumns({
        "_a": F.last(v, ignorenulls=True).over(before), "_b": F.first(v, ignorenulls=True).over(after),
        "_i": F.last(at, ignorenulls=True).over(before), "_j": F.first(at, ignorenulls=True).over(after),
    })
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col(order) - F.col("_i")) / F.nullif(F.col("_j") - F.col("_i"), F.lit(0))
    return out.withColumn(name, F.coalesce(v, line, "_a", "_b")).drop("_a", "_b", "_i", "_j")


def forward_fill(df: DataFrame, *, key=KEY, order=ORDER, value=VALUE, name="filled") -> DataFrame:
    return df.withColumn(name, F.last(F.col(value), ignorenulls=True).over(by(key, order).rowsBetween(W.unboundedPreceding, 0)))


def fill_held(df: DataFrame, *, recording: str, mode: str = "compat", key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Adds `filled`: frames in which the acquisition held its value, found in the recording's first trace, become ramps.

    A frame is good if the next one differs from it. Between consecutive good frames more than one frame apart there is a
    gap. mode "compat" ramps from the good frame's own value to the held one and starts at the good frame, if at least
    five good frames follow; "bridge" leaves good frames alone and ramps to the next good frame's value.
    """
    first = df.groupBy(recording).agg(F.min(key).alias("_first"))
    one = df.join(first, recording).where(F.col(key) == F.col("_first"))
    w = W.partitionBy(recording).orderBy(order)
    good = one.withColumn("_d", F.lead(value).over(w) - F.col(value)).where(F.col("_d") != 0)
    good = good.select(recording, F.col(order).alias("_from"), F.lead(order).over(w).alias("_to"), F.lead(order, 5).over(w).isNotNull().alias("_more"))
    gaps = good.where((F.col("_to") - F.col("_from") > 1) & (F.col("_more") if mode == "compat" else F.lit(True))).withColumnRenamed(recording, "_rec")
    start = 0 if mode == "compat" else 1
    inside = gaps.withColumn("_at", F.explode(F.sequence(F.col("_from") + start, F.col("_to") - 1)))
    out = df.join(inside, (F.col(recording) == F.col("_rec")) & (F.col(order) == F.col("_at")), "left")
    # The ends of a gap lie in the same trace, so a window reads them; no second join.
    same = W.partitionBy(key, "_from")
    k, g = F.col(order) - F.col("_from"), F.col("_to") - F.col("_from")
    out = out.withColumn("_next", F.lead(value).over(by(key, order)))
    if mode == "compat":
        y0 = F.min_by(value, order).over(same)
        y1 = F.max_by("_next", order).over(same)
        ramp = y0 + (y1 - y0) * (k + 1) / (g + 1)
    else:
        out = out.withColumn("_prev", F.lag(value).over(by(key, order)))
        y0 = F.min_by("_prev", order).over(same)
        y1 = F.max_by("_next", order).over(same)
        ramp = y0 + (y1 - y0) * k / g
    # A trace that ends inside a gap has no value to go to and stays as it is there.
    out = out.withColumn("filled", F.coalesce(F.when(F.col("_from").isNotNull(), ramp), F.col(value)))
    return out.select(*df.columns, "filled")


def drop_held(df: DataFrame, *, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Frames whose next frame differs; the last frame goes."""
    return df.withColumn("_next", F.lead(value).over(by(key, order))).where(F.col("_next") != F.col(value)).drop("_next")


# Scores and smoothing


def islands(df: DataFrame, flag: Column, *, key=KEY, order=ORDER, name="island") -> DataFrame:
    """Adds `name`: equal numbers for the consecutive rows of a key with equal flags."""
    w = by(key, order)
    out = df.withColumn("_flag", flag)
    change = (~F.col("_flag").eqNullSafe(F.lag("_flag").over(w))).cast("int")
    return out.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_flag", "_change")


def mad_zscore(df: DataFrame, *, min_flat_run=2, flat_eps=1e-12, guard_frames=0, fill_unsafe=0.0, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Adds `z` = (x - median) / (1.4826 MAD) over safe samples, and `safe`.

    Unsafe samples are missing or in a run of at least min_flat_run equal ones, widened by guard_frames; they get
    fill_unsafe. With fewer than three safe samples all that are not missing count as safe. A scale below 1e-10 is
    replaced by the standard deviation + 1e-10.
    """
    w, v = by(key, order), F.col(value)
    flat = F.abs(v - F.lag(v).over(w)) <= flat_eps
    out = df.withColumn("_flat", F.coalesce(flat, F.lit(False)))
    # A run of n equal samples has n - 1 flat steps; each sample is in the run of its own step or of the next one's.
    out = islands(out, F.col("_flat"), key=key, order=order, name="_run")
    out = out.withColumn("_steps", F.when(F.col("_flat"), F.count("*").over(W.partitionBy(key, "_run"))).otherwise(0))
    run = F.greatest(F.col("_steps"), F.coalesce(F.lead("_steps").over(w), F.lit(0))) + 1
    out = out.withColumn("_bad", v.isNull() | F.isnan(v) | ((run > 1) & (run >= min_flat_run)))
    if guard_frames:
        out = out.withColumn("_bad", F.max("_bad").over(w.rowsBetween(-guard_frames, guard_frames)))
    whole = by(key, None)
    finite = v.isNotNull() & ~F.isnan(v)
    out = out.withColumn("_n", F.count_if(~F.col("_bad")).over(whole)).withColumn("safe", F.when(F.col("_n") >= 3, ~F.col("_bad")).otherwise(finite))
    x = F.when(F.col("safe"), v)
    out = out.withColumn("_med", F.percentile(x, 0.5).over(whole))
    out = out.withColumn("_mad", 1.4826 * F.percentile(F.abs(x - F.col("_med")), 0.5).over(whole)).withColumn("_sd", F.stddev_pop(x).over(whole))
    scale = F.when(F.col("_mad") < 1e-10, F.col("_sd") + 1e-10).otherwise(F.col("_mad"))
    return out.withColumn("z", F.when(F.col("safe"), (v - F.col("_med")) / scale).otherwise(F.lit(fill_unsafe))).select(*df.columns, "z", "safe")


def savgol1(df: DataFrame, window: int = 11, *, key=KEY, order=ORDER, value=VALUE, name="smooth") -> DataFrame:
    """Adds `name`: the Savitzky-Golay smoothing of degree 1. Inside it is the window's mean; the first and last half
    windows lie on the least-squares line of the first and last window."""
    h, w, whole = window // 2, by(key, order), by(key, None)
    i = F.col(order)
    out = df.withColumns({"_n": F.count("*").over(whole), "_i0": F.min(order).over(whole)}).withColumn("_i", i - F.col("_i0"))
    exprs = {"_mid": F.avg(value).over(w.rowsBetween(-h, h))}
    for side, inside in (("a", F.col("_i") < window), ("b", F.col("_i") >= F.col("_n") - window)):
        x, y = F.when(inside, F.col("_i").cast("double")), F.when(inside, F.col(value))
        exprs[f"_s{side}"] = F.regr_slope(y, x).over(whole)
        exprs[f"_c{side}"] = F.regr_intercept(y, x).over(whole)
    out = out.withColumns(exprs)
    left, right = F.col("_sa") * F.col("_i") + F.col("_ca"), F.col("_sb") * F.col("_i") + F.col("_cb")
    smooth = F.when(F.col("_i") < h, left).when(F.col("_i") >= F.col("_n") - h, right).otherwise(F.col("_mid"))
    return out.withColumn(name, smooth).select(*df.columns, name)


def detrend_zscore(df: DataFrame, *, window: int = 2000, smooth: int = 21, engine: str | None = None, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Adds `z`: rolling median removed, robust score, smoothed."""
    out = rolling_median_detrend(df, window, engine=engine, key=key, order=order, value=value)
    out = mad_zscore(out, key=key, order=order, value="detrended").drop("detrended", "safe").withColumnRenamed("z", "_z")
    return savgol1(out, smooth, key=key, order=order, value="_z", name="z").drop("_z")


# Extrema


def local_extrema(df: DataFrame, span: int, *, kind: str = "min", key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """Rows strictly below (above) the `span` rows on each side; fewer at the ends, none at the very ends."""
    w, v = by(key, order), F.col(value)
    best = F.min if kind == "min" else F.max
    a, b = best(v).over(w.rowsBetween(-span, -1)), best(v).over(w.rowsBetween(1, span))
    out = df.withColumns({"_a": a, "_b": b})
    return out.where((v < F.col("_a")) & (v < F.col("_b")) if kind == "min" else (v > F.col("_a")) & (v > F.col("_b"))).drop("_a", "_b")


def jump_frames(df: DataFrame, span: int = 50, *, smooth: int | None = 11, recording: str = "recording", key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """(recording, kind, frame): minima and maxima of the mean of a recording's (smoothed) traces."""
    if smooth:
        df = savgol1(df, smooth, key=[recording, key], order=order, value=value, name="_v")
    else:
        df = df.withColumn("_v", F.col(value))
    mean = df.groupBy(recording, order).agg(F.avg("_v").alias("_v"))
    both = [local_extrema(mean, span, kind=k, key=recording, order=order, value="_v").select(recording, F.lit(k).alias("kind"), order) for k in ("min", "max")]
    return both[0].unionByName(both[1])


# Stacking and joining


def stacked(df: DataFrame, *, recording: str, key=KEY, value=VALUE) -> DataFrame:
    """Adds `stacked`: each trace raised by the sum of the maxima of the traces before it."""
    top = df.groupBy(recording, key).agg(F.max(value).alias("_top"))
    w = W.partitionBy(recording).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    top = top.withColumn("_offset", F.coalesce(F.sum("_top").over(w), F.lit(0.0))).drop("_top")
    return df.join(top, [recording, key]).withColumn("stacked", F.col(value) + F.col("_offset")).drop("_offset")


def concatenate(df: DataFrame, *, group: str, sequence: str, key: str, gap: int = 1000, fps: float | None = None, order=ORDER, value=VALUE) -> DataFrame:
    """Recordings of a group one after another on one time axis, `gap` frames apart: adds `position`, and time_s with fps.

    Cells that a recording lacks have no rows there. What is not a value at the end of a cell is not kept.
    """
    size = df.groupBy(group, sequence).agg((F.max(order) + 1).alias("_size"))
    w = W.partitionBy(group).orderBy(sequence).rowsBetween(W.unboundedPreceding, -1)
    size = size.withColumn("_start", F.coalesce(F.sum(F.col("_size") + gap).over(w), F.lit(0))).drop("_size")
    out = df.join(size, [group, sequence]).withColumn("position", F.col("_start") + F.col(order)).drop("_start")
    last = F.max(F.when(F.col(value).isNotNull(), F.col("position"))).over(W.partitionBy(group, key))
    out = out.withColumn("_last", last).where(F.col("position") <= F.col("_last")).drop("_last")
    return out.withColumn("time_s", F.col("position") / F.lit(fps)) if fps else out


def active_fraction(df: DataFrame, spans: DataFrame, *, key=KEY, order=ORDER) -> DataFrame:
    """key, percent: share of a trace's frames inside the union of its spans [start, end)."""
    total = df.groupBy(key).agg(F.count("*").alias("_n"))
    inside = spans.select(key, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(order)).where("start < end") if "start" in spans.columns else spans
    covered = inside.join(df.select(key, order), [key, order]).groupBy(key).agg(F.count_distinct(order).alias("_c"))
    return total.join(covered, key, "left").select(key, (100.0 * F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("percent"))


def inactive(df: DataFrame, spans: DataFrame, *, key=KEY, order=ORDER) -> DataFrame:
    """Rows outside all spans [start, end) of their key: an anti join on the frames that spans cover."""
    inside = spans.where("start < end").select(key, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(order)).distinct()
    return df.join(inside, [key, order], "left_anti")


def noise_sd(df: DataFrame, spans: DataFrame, first: int = 500, *, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """key, noise_sd: population deviation of a trace's first inactive frames."""
    quiet = inactive(df, spans, key=key, order=order).withColumn("_k", F.row_number().over(by(key, order)))
    return quiet.where(F.col("_k") <= first).groupBy(key).agg(F.stddev_pop(value).alias("noise_sd"))


def best_reference(df: DataFrame, *, recording: str, roi: str, order=ORDER, value=VALUE) -> DataFrame:
    """recording, roi, score: the trace with the largest weighted deviation, weights falling from 1 to a half; the first of equals."""
    n = F.count("*").over(W.partitionBy(recording, roi))
    weight = 1.0 - 0.5 * F.try_divide(F.col(order), F.col("_n") - 1)
    out = df.withColumn("_n", n).withColumn("_w", F.coalesce(weight, F.lit(1.0)))
    mean = F.sum(F.col("_w") * F.col(value)) / F.sum("_w")
    out = out.join(out.groupBy(recording, roi).agg(mean.alias("_m")), [recording, roi])
    scores = out.groupBy(recording, roi).agg(F.sqrt(F.sum(F.col("_w") * (F.col(value) - F.col("_m")) ** 2) / F.sum("_w")).alias("score"))
    best = F.max_by(F.struct(roi, "score"), F.struct(F.round("score", 9), -F.col(roi)))
    return scores.groupBy(recording).agg(best.alias("_b")).select(recording, f"_b.{roi}", "_b.score")


def mean_reference(df: DataFrame, *, recording: str, smooth: int | None = 11, channels: int = 1, first: int = 0, last: int | None = None, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """recording, frame, mean over traces of frames [first, last) of each channel; smoothed before the first channel of
    interleaved ones is taken, as the acquisition writes them."""
    span = df.where((F.col(order) >= first * channels) & (F.lit(True) if last is None else F.col(order) < last * channels))
    span = savgol1(span, smooth, key=[recording, key], order=order, value=value, name="_v") if smooth else span.withColumn("_v", F.col(value))
    mean = span.groupBy(recording, order).agg(F.avg("_v").alias("mean"))
    return mean.where((F.col(order) - first * channels) % channels == 0).withColumn(order, F.floor(F.col(order) / channels).cast("int"))


def nearest_trace(df: DataFrame, x: float, y: float, *, key=KEY, order=ORDER, value=VALUE) -> DataFrame:
    """key, distance: traces by the distance of a point (frame, value) to their line, nearest first."""
    w = by(key, order)
    seg = df.select(key, F.col(order).cast("double").alias("_x0"), F.col(value).alias("_y0"), F.lead(F.col(order).cast("double")).over(w).alias("_x1"), F.lead(value).over(w).alias("_y1"))
    seg = seg.withColumns({"_x1": F.coalesce("_x1", "_x0"), "_y1": F.coalesce("_y1", "_y0")}).withColumns({"_dx": F.col("_x1") - F.col("_x0"), "_dy": F.col("_y1") - F.col("_y0")})
    t = F.coalesce(F.try_divide((x - F.col("_x0")) * F.col("_dx") + (y - F.col("_y0")) * F.col("_dy"), F.col("_dx") ** 2 + F.col("_dy") ** 2), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    near = F.hypot(F.col("_x0") + t * F.col("_dx") - x, F.col("_y0") + t * F.col("_dy") - y)
    return seg.groupBy(key).agg(F.min(near).alias("distance")).orderBy("distance", key)
