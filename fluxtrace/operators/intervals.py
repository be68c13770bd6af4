"""Intervals of frames: from jumps and from bad runs, united, merged, cut out of traces or bridged by the last good frame.

Intervals are half-open [start, end) rows of a recording, except those around jumps, whose ends count as given.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .traces import by, islands


def trim_jumps(jumps: DataFrame, left: Column | int, right: Column | int, *, recording="recording", order="frame") -> DataFrame:
    """Without the first jump of a recording if the window before it would begin before the recording; none if both windows are 0."""
    left, right = (x if isinstance(x, Column) else F.lit(x) for x in (left, right))
    first = F.min(order).over(W.partitionBy(recording))
    return jumps.withColumn("_first", first).where(~((F.col(order) == F.col("_first")) & (left > F.col(order))) & ~((left == 0) & (right == 0))).drop("_first")


def around(jumps: DataFrame, left: Column | int, right: Column | int, *, recording="recording", order="frame") -> DataFrame:
    """[frame - left, frame + right] of each jump."""
    return jumps.select(recording, (F.col(order) - left).alias("start"), (F.col(order) + right).alias("end"))


def united(*parts: DataFrame) -> DataFrame:
    """All intervals of all sources, with `source` from 0 in the order given; none is merged."""
    return reduce(DataFrame.unionByName, [p.select("*", F.lit(i).alias("source")) for i, p in enumerate(parts)])


def merged(intervals: DataFrame, gap: int = 0, *, recording="recording") -> DataFrame:
    """Intervals that overlap or are at most `gap` frames apart become one."""
    w = W.partitionBy(recording).orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") - upto > gap).cast("int"), F.lit(1))
    out = intervals.withColumn("_new", new).withColumn("_group", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy(recording, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def covered(intervals: DataFrame, *, recording="recording", order="frame") -> DataFrame:
    """The frames of the intervals, each once: an equi-join key instead of a range condition."""
    return intervals.where("start < end").select(recording, F.explode(F.sequence("start", F.col("end") - 1)).alias(order)).distinct()


def masked(df: DataFrame, intervals: DataFrame, *, recording="recording", order="frame", value="f", name="masked") -> DataFrame:
    """Adds `name`: the value, NULL inside the intervals."""
    inside = covered(intervals, recording=recording, order=order).withColumn("_in", F.lit(True))
    return df.join(inside, [recording, order], "left").withColumn(name, F.when(F.col("_in").isNull(), F.col(value))).drop("_in")


def hold_last(df: DataFrame, intervals: DataFrame, *, recording="recording", key: str | list[str] = "recording", order="frame", value="f") -> DataFrame:
    """Adds `held`: inside intervals the last value before them; at the very start the first value after."""
    out = masked(df, intervals, recording=recording, order=order, value=value, name="held")
    before, after = by(key, order).rowsBetween(W.unboundedPreceding, 0), by(key, order).rowsBetween(0, W.unboundedFollowing)
    return out.withColumn("held", F.coalesce(F.last("held", ignorenulls=True).over(before), F.first("held", ignorenulls=True).over(after)))


def hold_last_in_order(df: DataFrame, intervals: list[tuple[int, int]], *, key="recording", order="frame", value="f") -> DataFrame:
    """As `hold_last`, but a given list is applied one after another: later intervals read what earlier ones wrote."""
    out = df.withColumn("held", F.col(value))
    for start, end in intervals:
        source = F.max(F.when(F.col(order) == start - 1, F.col("held"))).over(W.partitionBy(key))
        out = out.withColumn("held", F.when((F.col(order) >= start) & (F.col(order) < end), F.coalesce(source, "held")).otherwise(F.col("held")))
    return out


def runs(df: DataFrame, flag: Column, *, key="recording", order="frame", least: int = 1) -> DataFrame:
    """(key, start, end) of runs of at least `least` consecutive rows with the flag."""
    out = islands(df.withColumn("_bad", F.coalesce(flag, F.lit(False))), F.col("_bad"), key=key, order=order, name="_run")
    found = out.where("_bad").groupBy(key, "_run").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"))
    return found.where(F.col("end") - F.col("start") >= least).drop("_run")


def out_of_focus(df: DataFrame, *, mean="mean", sd: str | None = None, mean_fraction=0.7, sd_fraction=0.6, least=2, gap=5, key="recording", order="frame") -> DataFrame:
    """Intervals in which the reference trace falls below a fraction of its baseline, the median of its upper half; with `sd`
    also those in which its deviation does. Short runs go, close ones merge."""

    def low(column: str, fraction: float) -> Column:
        return F.col(column) < fraction * F.col(f"_b_{column}")

    for c in (mean, *([sd] if sd else [])):
        df = df.withColumn("_m", F.percentile(c, 0.5).over(by(key, None)))
        df = df.withColumn(f"_b_{c}", F.percentile(F.when(F.col(c) >= F.col("_m"), F.col(c)), 0.5).over(by(key, None))).drop("_m")
    flag = low(mean, mean_fraction) | (low(sd, sd_fraction) if sd else F.lit(False))
    return merged(runs(df, flag, key=key, order=order, least=least), gap, recording=key)


def cutoff_frame(df: DataFrame, *, window=1000, deviation=0.2, baseline=1000, key="recording", order="frame", value="mean") -> DataFrame:
    """(key, cutoff): the frame after the last whose centred rolling median is within `deviation` of the median of the first
    `baseline` frames; the whole length if the last frame is. The window shrinks to a fifth of short recordings. A trace is a
    group, and its rolling median is one pass over it."""
    kind = df.schema[key].dataType.simpleString()

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, at = pdf[value].astype(float).reset_index(drop=True), pdf[order].to_numpy()
        w = min(window, len(x) // 5 + 1)
        rolled = x.rolling(w, center=True, min_periods=max(1, w // 10)).median().bfill().ffill()
        base = x.iloc[:baseline].median()
        bad = ((rolled < base * (1 - deviation)) | (rolled > base * (1 + deviation))).to_numpy()
        good = np.flatnonzero(~bad)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "cutoff": [int(at[good[-1]]) + 1 if len(good) else 0]})

    return df.select(key, order, value).groupBy(key).applyInPandas(measure, f"{key} {kind}, cutoff int")
