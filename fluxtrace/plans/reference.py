"""Reference traces of recordings: grid, traces of its boxes, the best one, its usable length and its out-of-focus intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import movie as mv
from ..operators import traces as tr
from .storage import settle


def reference_traces(pixels: DataFrame, *, grid: int | tuple[int, int] | list[int | tuple[int, int]] = 4, overlap: float = 0.5, smooth: int = 11, done: DataFrame | None = None, step: int = 1) -> dict[str, DataFrame]:
    """best (recording, roi, score), trace (recording, slice, frame, mean, sd; whole and smoothed), cutoff and the intervals of the
    whole trace, for all recordings at once; recordings in `done` are skipped. With a list of grids the boxes of all compete.
    slice counts from 1 in steps, as other tools write it."""
    if done is not None:
        pixels = pixels.join(done.select("recording"), "recording", "left_anti")
    boxes = settle(mv.many_grids(pixels, grid if isinstance(grid, list) else [grid], overlap))
    plain, both = mv.box_traces(pixels, boxes), ["recording", "roi"]
    level = tr.savgol1(plain.drop("sd"), smooth, key=both, value="mean")
    spread = tr.savgol1(plain.drop("mean"), smooth, key=both, value="sd").select(*both, "frame", F.col("smooth").alias("sd"))
    traces = settle(level.join(spread, [*both, "frame"]))
    best = settle(tr.best_reference(traces, recording="recording", roi="roi", value="smooth"))
    trace = traces.join(best.select("recording", "roi"), ["recording", "roi"]).select("recording", "frame", F.col("smooth").alias("mean"), "sd")
    trace = settle(trace.withColumn("slice", (F.col("frame") + 1) * step))
    return {"best": best, "trace": trace, "cutoff": iv.cutoff_frame(trace), "intervals": iv.out_of_focus(trace, sd="sd")}
