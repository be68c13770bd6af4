"""Multi-cell events: leaders, responders, splitting along the sequence of cells, classes and counts.

Peaks are rows (recording, cell, seq, peak): `seq` is the cell's place in its recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import compensated_mean


def leaders(peaks: DataFrame, threshold: int, *, recording="recording") -> DataFrame:
    """(recording, leader): a distinct peak leads an event if it is more than `threshold` after the last leader.

    The rule looks back at the leader, not at the neighbour, so it is a fold over a recording's distinct peaks.
    """
    lists = peaks.groupBy(recording).agg(F.sort_array(F.collect_set("peak")).alias("_p"))
    start = F.array().cast(lists.schema["_p"].dataType)
    step = lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > threshold), F.concat(a, F.array(x))).otherwise(a)
    # element_at of an empty array fails, so the fold starts from the first peak.
    first = F.slice("_p", 1, 1)
    folded = F.aggregate(F.slice("_p", 2, 1 << 30), F.coalesce(first, start), step)
    return lists.select(recording, F.explode(folded).alias("leader"))


def responses(peaks: DataFrame, leads: DataFrame, threshold: int, fps: float = 1.0, *, recording="recording") -> DataFrame:
    """(recording, leader, cell, seq, peak, offset_s): each cell's first peak in [leader, leader + threshold)."""
    # Every peak lies behind exactly one leader; that leader is found by a window over leaders and peaks together.
    marks = leads.select(recording, F.col("leader").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).alias("cell"))
    rows = peaks.select(recording, F.col("peak").alias("at"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "cell")
    w = W.partitionBy(recording).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn("leader", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(w))
    both = both.where((F.col("kind") == 1) & (F.col("at") < F.col("leader") + threshold))
    first = both.groupBy(recording, "leader", "cell", "seq").agg(F.min("at").alias("peak"))
    return first.withColumn("offset_s", (F.col("peak") - F.col("leader")) / F.lit(float(fps)))


def events(found: DataFrame, cells: DataFrame, *, amplitudes: DataFrame | None = None, recording="recording") -> DataFrame:
    """A row for each event: n_responding, total_cells, share_responding and percent_responding, first_seq (of the earliest responder)
    and parallel arrays, in order of seq, of cells, offsets, distances from the earliest and sequential distances. With
    `amplitudes` (cell, peak, mean; see `peaks.mean_around`) also the responders' amplitudes, their largest and their mean."""
    total = cells.groupBy(recording).agg(F.count_distinct("cell").alias("total_cells"))
    w = W.partitionBy(recording, "leader")
    out = found.withColumn("_first", F.min_by("seq", F.struct("offset_s", "seq")).over(w))
    out = out.withColumn("_gap", F.col("seq") - F.lag("seq").over(w.orderBy("seq")))
    columns = {"cells": "cell", "offsets_s": "offset_s", "distances": "distance", "steps": "step"}
    more, sums = [], []
    if amplitudes is not None:
        out = out.join(amplitudes.select("cell", "peak", F.col("mean").alias("amplitude")), ["cell", "peak"], "left")
        more, columns = ["amplitude"], columns | {"amplitudes": "amplitude"}
        sums = [F.max("amplitude").alias("max_amplitude")]
    item = F.struct("seq", "cell", "offset_s", F.abs(F.col("seq") - F.col("_first")).alias("distance"), F.col("_gap").alias("step"), *more)
    grouped = out.groupBy(recording, "leader").agg(F.count("*").alias("n_responding"), F.first("_first").alias("first_seq"), F.sort_array(F.collect_list(item)).alias("_r"), *sums)
    grouped = grouped.select("*", *[F.col(f"_r.{c}").alias(n) for n, c in columns.items()]).drop("_r")
    if amplitudes is not None:
        grouped = grouped.withColumn("mean_amplitude", compensated_mean(F.col("amplitudes")))
    share = F.col("n_responding") / F.col("total_cells")
    return grouped.join(total, recording).withColumns({"share_responding": share, "percent_responding": 100.0 * F.col("n_responding") / F.col("total_cells")})


def split(found: DataFrame, max_skip: int = 4, *, recording="recording") -> DataFrame:
    """Responses with `part`: an event breaks where neighbouring responders are more than max_skip cells apart."""
    w = W.partitionBy(recording, "leader").orderBy("seq")
    far = F.coalesce((F.col("seq") - F.lag("seq").over(w) > max_skip).cast("int"), F.lit(0))
    return found.withColumn("_far", far).withColumn("part", F.sum("_far").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_far")


def classified(parts: DataFrame, max_skip: int = 4, *, recording="recording") -> DataFrame:
    """A row for each part of an event: n_cells, event_type (Single or Multiple) and skipping (of three or more cells, any
    neighbours not next to each other but at most max_skip apart)."""
    w = W.partitionBy(recording, "leader", "part").orderBy("seq")
    step = F.col("seq") - F.lag("seq").over(w)
    out = parts.withColumn("_skip", (F.abs(step) != 1) & (F.abs(step) <= max_skip))
    grouped = out.groupBy(recording, "leader", "part").agg(F.count("*").alias("n_cells"), F.coalesce(F.bool_or("_skip"), F.lit(False)).alias("_skip"))
    kind = F.when(F.col("n_cells") == 1, "Single").otherwise("Multiple")
    return grouped.select(recording, "leader", "part", "n_cells", kind.alias("event_type"), (F.col("_skip") & (F.col("n_cells") >= 3)).alias("skipping"))


def participation(peaks: DataFrame, parts: DataFrame, *, recording="recording") -> DataFrame:
    """A row for each cell with peaks: single (events of its own), multiple (of three or more cells) and orphan (all other peaks)."""
    sizes = parts.withColumn("_n", F.count("*").over(W.partitionBy(recording, "leader", "part")))
    counts = sizes.groupBy(recording, "cell").agg(F.count_if(F.col("_n") == 1).alias("single"), F.count_if(F.col("_n") >= 3).alias("multiple"))
    out = peaks.groupBy(recording, "cell").agg(F.count("*").alias("n_peaks")).join(counts, [recording, "cell"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("single", "multiple")})
    return out.withColumn("orphan", F.col("n_peaks") - F.col("single") - F.col("multiple"))


def skipping_share(classes: DataFrame, *, recording="recording", more_than: int = 0) -> DataFrame:
    """recording, n_events and share of skipping ones, of recordings with more than so many events."""
    out = classes.groupBy(recording).agg(F.count("*").alias("n_events"), F.avg(F.col("skipping").cast("double")).alias("share"))
    return out.where(F.col("n_events") > more_than)
