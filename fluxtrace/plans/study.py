"""The two analyses end to end: cells of recordings with their peaks, and the tables of a study made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import correlation as co
from ..operators import events as ev
from ..operators import labels as lb
from ..operators import peaks as pk
from ..operators import rollups as ro
from ..operators import traces as tr
from .storage import settle


#: Decimals of scores and of means around peaks. Equal sums in another order differ in their last bits, which would make a slope of a
#: flat top and put a mean half-way between two roundings below it.
DIGITS = 12


def scores(traces: DataFrame, *, window: int, smooth: int, engine: str | None = None) -> DataFrame:
    """Adds `z`: the detrended score, smoothed; scores that agree to DIGITS decimals are equal."""
    return tr.detrend_zscore(traces, window=window, smooth=smooth, engine=engine).withColumn("z", F.round("z", DIGITS))


def build_cells(recordings: DataFrame, traces: DataFrame, labels: DataFrame, annotations: DataFrame, *, median_window=2000, smooth=21, prominence=4.01, distance=150, old: DataFrame | None = None, engine: str | None = None) -> dict[str, DataFrame]:
    """cells (one row each: type, centroid, peaks) and dff0 traces. traces: (recording, roi, frame, f); with `old`, cells
    that are there keep their curated peaks and only new ones are detected.

    Recordings whose traces and typed regions differ in number are left out and returned as `odd`.
    """
    key = F.concat_ws("_", F.col("recording").cast("string"), F.col("roi").cast("string"))
    good = recordings.where(sc.kept("discard") & F.col("recording").isNotNull())
    traces = traces.join(good.select("recording"), "recording", "left_semi").withColumn("cell", key)
    typed = lb.annotation_median(labels, annotations, name="cell_type").withColumnRenamed("label", "roi")
    middle = lb.properties(labels).select("recording", F.col("label").alias("roi"), "cy", "cx")
    counts = traces.groupBy("recording").agg(F.count_distinct("roi").alias("_a")).join(typed.groupBy("recording").agg(F.count("*").alias("_b")), "recording", "full")
    odd = settle(counts.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("recording"))
    traces = traces.join(odd, "recording", "left_anti")
    filled = tr.fill_held(traces, recording="recording").withColumn("f", F.col("filled")).drop("filled")
    dff0 = settle(tr.dff0_first_half(filled).select("recording", "roi", "cell", "frame", F.col("dff0").alias("f")))
    fresh = dff0 if old is None else dff0.join(old.select("cell"), "cell", "left_anti")
    z = scores(fresh, window=median_window, smooth=smooth, engine=engine)
    found = pk.detect(z, prominence=prominence, distance=distance, value="z")
    lists = found.groupBy("cell").agg(F.sort_array(F.collect_set("peak")).alias("peaks"))
    cells = fresh.groupBy("recording", "roi", "cell").agg(F.count("*").alias("n_frames")).join(typed, ["recording", "roi"], "left").join(middle, ["recording", "roi"], "left")
    cells = cells.join(lists, "cell", "left").withColumn("peaks", F.coalesce("peaks", F.array().cast("array<int>"))).join(good.drop("discard"), "recording")
    return {"cells": cells if old is None else old.unionByName(cells, allowMissingColumns=True), "traces": dff0, "odd": odd}


def concatenated(traces: DataFrame, *, preprocessing: str | None = None, group: str, sequence: str, key: str, fps: float | None = None, gap: int = 1000, **how) -> DataFrame:
    """Recordings of a group on one time axis, each trace after one of the ways to take trends off (see `correlation.prepared`)."""
    flat = co.prepared(traces, preprocessing, recording=[group, sequence], key=key, **({"fps": fps} if fps else {}), **how)
    return tr.concatenate(flat, group=group, sequence=sequence, key=key, gap=gap, fps=fps)


def study_tables(cells: DataFrame, traces: DataFrame, *, fps: float, cell_type: int = 1, window=1000, median_window=2000, smooth=21) -> dict[str, DataFrame]:
    """peaks, parts, events, cells and pairs of a study from its cells (with peaks) and traces.

    Widths are measured on the detrended z-scored trace that peaks were found on, at the peak moved to that trace's largest value
    nearby; amplitudes are the trace itself: `amplitude` at the peak, and for the responders of an event the mean around it.
    """
    from pyspark.sql import Window as W

    cells = cells.where(F.col("cell_type") == cell_type).withColumn("seq", F.row_number().over(W.partitionBy("recording").orderBy("roi")) - 1)
    cells = cells.withColumn("age_group", sc.age_group("age"))
    traces = traces.join(cells.select("cell"), "cell", "left_semi")
    flat = settle(tr.rolling_median_detrend(traces, window).select("recording", "cell", "frame", F.col("detrended").alias("f")))
    peaks = cells.select("recording", "cell", "seq", F.explode("peaks").alias("peak"))
    z = settle(scores(traces, window=median_window, smooth=smooth).select("cell", "frame", "z"))
    moved = settle(pk.realign(peaks, z, value="z"))
    shape = pk.half_widths(z, moved.select("cell", F.col("aligned").alias("peak")).distinct(), value="z").withColumn("half_width_s", (F.col("right") - F.col("left")) / fps)
    peaks = peaks.join(moved, ["cell", "peak"]).join(shape.withColumnRenamed("peak", "aligned"), ["cell", "aligned"])
    peaks = pk.amplitudes(pk.intervals_between(peaks, fps), traces)
    spans = peaks.select("cell", F.bround("left").cast("int").alias("start"), F.bround("right").cast("int").alias("end"))
    noise, active = tr.noise_sd(flat, spans), tr.active_fraction(flat, spans).withColumnRenamed("percent", "percent_active")
    peaks = settle(ro.quality(peaks, noise))
    highest = peaks.groupBy("cell").agg(F.max("amplitude").alias("max_amplitude"))
    threshold = int(2 * fps)
    found = settle(ev.responses(peaks, ev.leaders(peaks, threshold), threshold, fps))
    means = pk.mean_around(found, traces, 10).withColumn("mean", F.round("mean", DIGITS))
    whole = ev.events(found, cells, amplitudes=means)
    parts = ev.split(found)
    counted = ev.participation(peaks, parts).drop("n_peaks")
    table = ro.cell_peaks(cells, peaks.select("cell", "peak"), fps=fps).join(noise, "cell", "left").join(active, "cell", "left").join(counted, ["recording", "cell"], "left").join(ro.kept_peaks(peaks), "cell", "left").join(highest, "cell", "left")
    pairs = co.pairs(co.large_recordings(flat), least=int(5 * 60 * fps))
    return {"peaks": peaks, "events": ev.classified(parts), "whole_events": whole, "parts": parts, "cells": table, "pairs": pairs}
