"""Movies as pixel tables (recording, frame, y, x, v): averages, regions' traces, binning, background, leaks, registration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grids, kernels
from ..functions.scalars import clipped_u16
from .nearest import nearest_by_tiles

REC = "recording"
PLACE = ["y", "x"]


def with_extents(pixels: DataFrame) -> DataFrame:
    """Adds `_n`, `_h` and `_w`: frames, height and width of the recording. A sum over tasks and a join with a row for each
    recording, not a window over all its pixels."""
    size = pixels.groupBy(REC).agg((F.max("frame") + 1).alias("_n"), (F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    return pixels.join(size, REC)


def channels(pixels: DataFrame, n: int = 2) -> DataFrame:
    """Interleaved frames as `channel` (from 0) and the channel's own frame; an incomplete last group goes."""
    out = with_extents(pixels).where(F.col("frame") < F.floor(F.col("_n") / n) * n)
    return out.withColumn("channel", F.col("frame") % n).withColumn("frame", F.floor(F.col("frame") / n).cast("int")).drop("_n", "_h", "_w")


def mean_image(pixels: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Mean of frames [first, last)."""
    span = pixels.where(F.col("frame") >= first)
    return (span if last is None else span.where(F.col("frame") < last)).groupBy(REC, *PLACE).agg(F.avg("v").alias("v"))


def region_traces(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """recording, label, frame, f: mean of each label's pixels in each frame."""
    return pixels.join(labels.select(REC, *PLACE, "label"), [REC, *PLACE]).groupBy(REC, "label", "frame").agg(F.avg("v").alias("f"))


def wave_profile(pixels: DataFrame, waves: DataFrame, lead: int = 10) -> DataFrame:
    """recording, label, frame, f: mean inside each wave's box [y0, y1) x [x0, x1) for frames [start - lead, end).
    The box is spelled out in pixels, so the join is on equality."""
    side = lambda a: F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}1") - 1))
    boxes = waves.withColumn("y", side("y")).withColumn("x", side("x")).select(REC, "label", *PLACE, "start", "end")
    inside = pixels.join(boxes, [REC, *PLACE]).where((F.col("frame") >= F.col("start") - lead) & (F.col("frame") < F.col("end")))
    return inside.groupBy(REC, "label", "frame").agg(F.avg("v").alias("f"))


def grid_rois(pixels: DataFrame, grid: int | tuple[int, int] = 4, overlap: float = 0.0) -> DataFrame:
    """recording, roi, y0, x0, y1, x1: the boxes of a grid of so many boxes an axis over each recording's image, and of its
    copies shifted along the diagonal by shares of a box, as far as they lie inside the image."""
    n_y, n_x = (grid, grid) if isinstance(grid, int) else grid
    layers = int(round(1 / (1 - overlap))) if 0 < overlap < 1 else 1
    size = pixels.groupBy(REC).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    out = size.withColumn("_k", each(layers - 1)).withColumn("_i", each(n_y)).withColumn("_j", each(n_x))
    for axis, side, n, at in (("y", "_h", n_y, "_i"), ("x", "_w", n_x, "_j")):
        step = F.col(side) / F.lit(float(n))
        edge = lambda more, step=step, at=at: F.floor(F.col("_k") / F.lit(float(layers)) * step + (F.col(at) + more) * step).cast("int")
        out = out.withColumn(f"{axis}0", edge(0)).withColumn(f"{axis}1", edge(1))
    out = out.where((F.col("y1") <= F.col("_h")) & (F.col("x1") <= F.col("_w")))
    roi = F.row_number().over(W.partitionBy(REC).orderBy("_k", "_i", "_j")) - 1
    return out.select(REC, roi.alias("roi"), "y0", "x0", "y1", "x1")


def many_grids(pixels: DataFrame, grids: list[int | tuple[int, int]], overlap: float = 0.0) -> DataFrame:
    """The boxes of several grids, numbered through: all of the first, then all of the second, and so on."""
    out = None
    for k, grid in enumerate(grids):
        one = grid_rois(pixels, grid, overlap).withColumn("_g", F.lit(k))
        out = one if out is None else out.unionByName(one)
    number = F.row_number().over(W.partitionBy(REC).orderBy("_g", "roi")) - 1
    return out.withColumn("roi", number).drop("_g")


def box_traces(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """recording, roi, frame, mean and sd (population, over pixels) of each box (roi, y0, x0, y1, x1): of all recordings, or of the
    box's own if it names one."""
    side = lambda a: F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}1") - 1))
    keys = [c for c in (REC, *PLACE) if c != REC or REC in boxes.columns]
    inside = boxes.where("y0 < y1 and x0 < x1").withColumn("y", side("y")).withColumn("x", side("x")).select("roi", *keys)
    return pixels.join(inside, keys).groupBy(REC, "roi", "frame").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def temporal_bin(pixels: DataFrame, k: int) -> DataFrame:
    """Means of k frames, rounded down; frames that don't fill a bin go, unless there are fewer than k in all."""
    out = with_extents(pixels).withColumn("_b", F.floor(F.col("frame") / k).cast("int"))
    out = out.where((F.col("_b") < F.floor(F.col("_n") / k)) | (F.col("_n") < k))
    return out.groupBy(REC, F.col("_b").alias("frame"), *PLACE).agg(F.floor(F.avg("v")).cast("int").alias("v"))


def spatial_bin(pixels: DataFrame, k: int = 2) -> DataFrame:
    """Means of k x k blocks; what does not fill a block at the edge goes."""
    out = with_extents(pixels)
    by, bx = F.floor(F.col("y") / k).cast("int"), F.floor(F.col("x") / k).cast("int")
    out = out.where((by < F.floor(F.col("_h") / k)) & (bx < F.floor(F.col("_w") / k)))
    return out.groupBy(REC, "frame", by.alias("y"), bx.alias("x")).agg(F.avg("v").alias("v"))


def every(pixels: DataFrame, k: int = 2) -> DataFrame:
    """Every k-th frame, numbered anew."""
    return pixels.where(F.col("frame") % k == 0).withColumn("frame", F.floor(F.col("frame") / k).cast("int"))


def minus_background(pixels: DataFrame, first: int, last: int) -> DataFrame:
    """Less the mean of frames [first, last) at each pixel, not below 0."""
    base = mean_image(pixels, first, last).withColumnRenamed("v", "_b")
    return pixels.join(base, [REC, *PLACE]).withColumn("v", clipped_u16(F.floor(F.col("v") - F.col("_b")))).drop("_b")


def minus_constant(pixels: DataFrame, constant: float) -> DataFrame:
    return pixels.withColumn("v", clipped_u16(F.floor(F.col("v") - constant)))


def _smoothed(image: np.ndarray, there: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """The image under a symmetric kernel along an axis; weights on absent samples are left out and the others scaled up to 1."""
    half = len(kernel) // 2
    total, weight = np.zeros(image.shape), np.zeros(image.shape)
    for d, w in zip(range(-half, half + 1), kernel, strict=True):
        if abs(d) < image.shape[axis]:
            to = tuple(slice(max(0, d), image.shape[a] + min(0, d)) if a == axis else slice(None) for a in range(image.ndim))
            of = tuple(slice(max(0, -d), image.shape[a] + min(0, -d)) if a == axis else slice(None) for a in range(image.ndim))
            total[to] += w * image[of]
            weight[to] += w * there[of]
    return np.where(there, total / np.where(weight > 0, weight, 1.0), 0.0)


def _arrays(change, along: list[str], axes: list[str]):
    """A function of the lists of places (along) and values of an array: the values after change(values, there, axis) along some axes."""

    @F.pandas_udf("array<double>")
    def smooth(*columns: pd.Series) -> pd.Series:
        done = []
        for *at, v in zip(*columns, strict=True):
            at = tuple(np.asarray(a) - np.min(a) for a in at)
            image, there = np.zeros([a.max() + 1 for a in at]), np.zeros([a.max() + 1 for a in at], bool)
            image[at], there[at] = v, True
            for a in axes:
                image = change(image, there, along.index(a))
            done.append(image[at])
        return pd.Series(done)

    return smooth


def along_axes(pixels: DataFrame, axes: tuple[str, ...], change) -> DataFrame:
    """recording, frame, y, x, v after change(values, there, axis) along each of the axes.

    Along y and x a frame is an array, along frames a pixel's samples are: each is gathered once and changed in NumPy, so the
    shuffle holds every sample once for frames and once for pixels, whatever the change looks at.
    """
    out = pixels.select(REC, "frame", *PLACE, F.col("v").cast("double").alias("v"))
    flat = [a for a in PLACE if a in axes]
    for inner, keys in ((["frame"] if "frame" in axes else [], [REC, *PLACE]), (flat, [REC, "frame"])):
        if not inner:
            continue
        along = ["frame"] if inner == ["frame"] else PLACE

        lists = out.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in (*along, "v")])
        lists = lists.select(*keys, *along, _arrays(change, along, inner)(*along, "v").alias("v"))
        out = lists.select(*keys, F.explode(F.arrays_zip(*along, "v")).alias("_p")).select(*keys, *[f"_p.{c}" for c in (*along, "v")])
    return out.select(REC, "frame", *PLACE, "v")


def blurred(pixels: DataFrame, sigma: float = 2.0, axes: tuple[str, ...] = ("frame", "y", "x"), truncate: float = 4.0) -> DataFrame:
    """Gaussian blur, an axis at a time. At the edges the weights that fall inside are scaled up to 1."""
    reach = int(truncate * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return along_axes(pixels, axes, lambda image, there, axis: _smoothed(image, there, kernel, axis))


def ratio(pixels: DataFrame) -> DataFrame:
    """recording, frame, y, x and ratio of channel 1 to channel 0."""
    a, b = (pixels.where(F.col("channel") == c).select(REC, "frame", *PLACE, F.col("v").alias(f"v{c}")) for c in (0, 1))
    return a.join(b, [REC, "frame", *PLACE]).select(REC, "frame", *PLACE, F.try_divide(F.col("v1").cast("double"), F.col("v0")).alias("ratio"))


def less_dark(pixels: DataFrame, first: int, last: int) -> DataFrame:
    """Each pixel less its mean over frames [first, last), which may be below 0: the background of a channel."""
    base = mean_image(pixels, first, last).withColumnRenamed("v", "_b")
    return pixels.join(base, [REC, *PLACE]).withColumn("v", F.col("v") - F.col("_b")).drop("_b")


def leak_scale(
    green: DataFrame, red: DataFrame, *, least_green: float = 100, most: float | None = 2.0, share: float = 0.99, quantile: float | None = 0.99,
    background: tuple[int, int] | None = None, smoothing: float = 0.0,
) -> DataFrame:
    """recording, y, x, scale: red over green in the first frame in which green reaches `share` of its quantile (its maximum
    without one); 0 where green is dim, and within [0, most]. background: frames whose mean is taken off both channels first;
    smoothing: the sigma of a blur of the map."""
    if background:
        green, red = (less_dark(x, *background) for x in (green, red))
    w = W.partitionBy(REC, *PLACE)
    top = F.percentile("v", quantile).over(w) if quantile is not None else F.max("v").over(w)
    high = green.withColumn("_top", top).where(F.col("v") >= (share if quantile is not None else 1.0) * F.col("_top"))
    peak = high.groupBy(REC, *PLACE).agg(F.min(F.struct("frame", "v")).alias("_p")).select(REC, *PLACE, F.col("_p.frame").alias("frame"), F.col("_p.v").alias("_g"))
    both = peak.join(red.select(REC, "frame", *PLACE, F.col("v").alias("_r")), [REC, "frame", *PLACE])
    scale = F.greatest(F.try_divide(F.col("_r").cast("double"), F.col("_g")), F.lit(0.0))
    scale = F.when(F.col("_g") >= least_green, scale if most is None else F.least(scale, F.lit(most))).otherwise(F.lit(0.0))
    out = both.select(REC, *PLACE, scale.alias("scale"))
    if smoothing:
        out = blurred(out.select(REC, F.lit(0).alias("frame"), *PLACE, F.col("scale").alias("v")), smoothing, axes=("y", "x")).select(REC, *PLACE, F.col("v").alias("scale"))
    return out


def minus_leak(green: DataFrame, red: DataFrame, scale: DataFrame) -> DataFrame:
    """Red less the scaled green, not below 0."""
    g = green.select(REC, "frame", *PLACE, F.col("v").alias("_g"))
    out = red.join(g, [REC, "frame", *PLACE]).join(scale, [REC, *PLACE])
    return out.withColumn("v", F.greatest(F.col("v") - F.col("scale") * F.col("_g"), F.lit(0.0))).drop("_g", "scale")


# Registration


def reference_frames(pixels: DataFrame, n: int = 1) -> DataFrame:
    """recording, first, last: n frames around the brightest one, moved inside the recording."""
    mean = pixels.groupBy(REC, "frame").agg(F.avg("v").alias("_m"))
    best = mean.groupBy(REC).agg(F.max_by("frame", F.struct("_m", -F.col("frame"))).alias("_b"), (F.max("frame") + 1).alias("_n"))
    first = F.greatest(F.lit(0), F.least(F.col("_b") - n // 2, F.col("_n") - n))
    return best.select(REC, first.alias("first"), F.least(first + n, F.col("_n")).alias("last"))


def reference_image(pixels: DataFrame, n: int = 1) -> DataFrame:
    span = reference_frames(pixels, n)
    return pixels.join(span, REC).where((F.col("frame") >= F.col("first")) & (F.col("frame") < F.col("last"))).groupBy(REC, *PLACE).agg(F.avg("v").alias("v"))


def shifts(pixels: DataFrame, reference: DataFrame) -> DataFrame:
    """recording, frame, dy, dx: whole-pixel motion of each frame against the reference, by phase correlation. A frame comes as
    three arrays (places and values), of which NumPy makes an image at once."""
    pack = [F.collect_list(F.col(c).cast(t)).alias(f"_{c}") for c, t in (("y", "int"), ("x", "int"), ("v", "double"))]
    ref = reference.groupBy(REC).agg(*pack).select(REC, *[F.col(f"_{c}").alias(f"_r{c}") for c in "yxv"])
    rows = pixels.groupBy(REC, "frame").agg(*pack).join(ref, REC)

    @F.pandas_udf("dy int, dx int")
    def moved(*columns: pd.Series) -> pd.DataFrame:
        def image(y, x, v, size) -> np.ndarray:
            out = np.zeros(size)
            out[y, x] = v
            return out

        found = []
        for y, x, v, ry, rx, rv in zip(*columns, strict=True):
            size = max(y.max(), ry.max()) + 1, max(x.max(), rx.max()) + 1
            found.append(kernels.phase_shift(image(ry, rx, rv, size), image(y, x, v, size)))
        return pd.DataFrame(found, columns=["dy", "dx"])

    return rows.select(REC, "frame", moved(*[f"_{c}" for c in "yxv"], *[f"_r{c}" for c in "yxv"]).alias("_s")).select(REC, "frame", "_s.dy", "_s.dx")


def rigid_motion(pixels: DataFrame, reference: DataFrame, *, rotate: bool = True, upsample: int = 50) -> DataFrame:
    """recording, frame, angle (degrees), dy, dx: the motion of each frame against the reference image: turned by the angle about the image's
    middle, then moved. The angle comes from the log-polar spectra, the shift (to 1 / upsample pixels) from an upsampled transform
    around the peak of the phase correlation."""
    pack = [F.collect_list(F.col(c).cast(t)).alias(f"_{c}") for c, t in (("y", "int"), ("x", "int"), ("v", "double"))]
    ref = reference.groupBy(REC).agg(*pack).select(REC, *[F.col(f"_{c}").alias(f"_r{c}") for c in "yxv"])
    rows = pixels.groupBy(REC, "frame").agg(*pack).join(ref, REC)

    @F.pandas_udf("angle double, dy double, dx double")
    def found(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for y, x, v, ry, rx, rv in zip(*columns, strict=True):
            size = max(y.max(), ry.max()) + 1, max(x.max(), rx.max()) + 1
            one, two = np.zeros(size), np.zeros(size)
            one[ry, rx], two[y, x] = rv, v
            out.append(kernels.rigid(one, two, rotate, upsample))
        return pd.DataFrame(out, columns=["angle", "dy", "dx"])

    return rows.select(REC, "frame", found(*[f"_{c}" for c in "yxv"], *[f"_r{c}" for c in "yxv"]).alias("_s")).select(REC, "frame", "_s.angle", "_s.dy", "_s.dx")


def rigid_transforms(motion: DataFrame, pixels: DataFrame) -> DataFrame:
    """recording, frame, m: the matrices with which `warped` takes the motion back (x and y of a place in the result to those in the frame)."""
    size = pixels.groupBy(REC).agg((F.max("y") / 2).alias("_cy"), (F.max("x") / 2).alias("_cx"))
    a, cy, cx = F.radians("angle"), F.col("_cy"), F.col("_cx")
    c, s = F.cos(a), F.sin(a)
    m = F.array(c, -s, cx - c * cx + s * cy + F.col("dx"), s, c, cy - s * cx - c * cy + F.col("dy"), *[F.lit(v) for v in (0.0, 0.0, 1.0)])
    return motion.join(size, REC).select(REC, "frame", m.alias("m"))


def moved_back(pixels: DataFrame, motion: DataFrame) -> DataFrame:
    """Frames with their shifts undone; what falls outside goes, what was outside has no rows."""
    out = with_extents(pixels).join(motion, [REC, "frame"])
    out = out.withColumn("y", F.col("y") - F.col("dy")).withColumn("x", F.col("x") - F.col("dx"))
    return out.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w"))).select(*pixels.columns)


def warped(pixels: DataFrame, transforms: DataFrame) -> DataFrame:
    """Frames through an affine map of target to source coordinates (recording, frame, m: 9 numbers, x before y), bilinear:
    each target pixel joins its four source pixels, outside counts as 0."""
    m = lambda i: F.col("m")[i]
    grid = pixels.select(REC, "frame", F.col("y").alias("_y"), F.col("x").alias("_x")).join(transforms, [REC, "frame"])
    grid = grid.withColumns({"_sx": m(0) * F.col("_x") + m(1) * F.col("_y") + m(2), "_sy": m(3) * F.col("_x") + m(4) * F.col("_y") + m(5)})
    fx, fy = F.col("_sx") - F.floor("_sx"), F.col("_sy") - F.floor("_sy")
    corner = lambda i, j: F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    parts = grid.withColumn("_c", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    parts = parts.select(REC, "frame", "_y", "_x", (F.floor("_sy") + F.col("_c.j")).cast("int").alias("y"), (F.floor("_sx") + F.col("_c.i")).cast("int").alias("x"), F.col("_c.w").alias("_w"))
    out = parts.join(pixels.select(REC, "frame", *PLACE, "v"), [REC, "frame", *PLACE], "left")
    value = F.round(F.coalesce(F.sum(F.col("_w") * F.col("v")), F.lit(0.0)), 6)
    return out.groupBy(REC, "frame", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(clipped_u16(F.floor(value)).alias("v"))


def interpolated_transforms(transforms: DataFrame, target: Column | int, *, m="m") -> DataFrame:
    """(recording, bin, m) stretched to `target` frames (a number, or a column of the recording), element by element and linearly."""
    n = F.max("bin").over(W.partitionBy(REC)) + 1
    known = transforms.withColumn("_n", n).withColumn("_t", F.lit(target) if isinstance(target, int) else target)
    frames = known.groupBy(REC).agg(F.first("_n").alias("_n"), F.first("_t").alias("_t")).withColumn("frame", F.explode(F.expr("sequence(0, _t - 1)")))
    frames = frames.withColumn("_x", F.coalesce(F.try_divide(F.col("frame") * (F.col("_n") - 1), F.col("_t") - 1), F.lit(0.0)))
    frames = frames.withColumn("_i", F.floor("_x").cast("int")).withColumn("_j", F.least(F.col("_i") + 1, F.col("_n") - 1).cast("int"))
    a, b = (transforms.select(REC, F.col("bin").alias(i), F.col(m).alias(v)) for i, v in (("_i", "_a"), ("_j", "_b")))
    out = frames.join(a, [REC, "_i"]).join(b, [REC, "_j"])
    t = F.col("_x") - F.col("_i")
    return out.select(REC, "frame", F.zip_with("_a", "_b", lambda p, q: p + (q - p) * t).alias(m))


def intensity_offset(original: DataFrame, corrected: DataFrame, *, frames: int = 100, margin: float = 0.2, least: float = 1.0) -> DataFrame:
    """recording, offset: mean of corrected less original in the central part of the first frames; 0 if it is below `least`.
    Taking it off the corrected movie (`minus_offset`) brings the original's intensity back."""
    c = with_extents(corrected.where(F.col("frame") < frames))
    inside = [(F.col(a) >= F.floor(F.col(s) * margin)) & (F.col(a) < F.col(s) - F.floor(F.col(s) * margin)) for a, s in (("y", "_h"), ("x", "_w"))]
    c = c.where(inside[0] & inside[1]).select(REC, "frame", *PLACE, F.col("v").alias("_c"))
    d = original.join(c, [REC, "frame", *PLACE]).groupBy(REC).agg((F.avg("_c") - F.avg("v")).alias("_d"))
    return d.select(REC, F.when(F.abs("_d") >= least, F.col("_d")).otherwise(F.lit(0.0)).alias("offset"))


def minus_offset(pixels: DataFrame, offsets: DataFrame) -> DataFrame:
    """Each recording less its offset (recording, offset), clipped to 16 bits and cut to whole numbers; those without one stay."""
    off = F.coalesce("offset", F.lit(0.0))
    return pixels.join(offsets.select(REC, "offset"), REC, "left").withColumn("v", F.when(off == 0, F.col("v")).otherwise(clipped_u16(F.floor(F.col("v") - off)))).select(*pixels.columns)


# Kymographs


def along_line(vertices: list[tuple[float, float]], points: int) -> list[tuple[int, float, float, float, float]]:
    """(s, y, x, ny, nx): places at equal distances along a polyline, with its normal there."""
    v = np.asarray(vertices, float)
    length = np.r_[0, np.cumsum(np.hypot(*np.diff(v, axis=0).T))]
    at = np.linspace(0, length[-1], points)
    y, x = np.interp(at, length, v[:, 0]), np.interp(at, length, v[:, 1])
    k = np.clip(np.searchsorted(length, at, "right") - 1, 0, len(v) - 2)
    d = np.diff(v, axis=0)[k]
    d = d / np.maximum(np.hypot(d[:, 0], d[:, 1])[:, None], 1e-12)
    return [(int(s), float(a), float(b), float(-e), float(c)) for s, (a, b, (c, e)) in enumerate(zip(y, x, d, strict=True))]


def kymograph(pixels: DataFrame, line: DataFrame, half: int = 2) -> DataFrame:
    """recording, frame, s, v: the movie along a line (s, y, x, ny, nx), bilinear, mean of 2 * half + 1 parallel lines."""
    at = line.withColumn("_k", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    at = at.select("s", "_k", (F.col("y") + F.col("_k") * F.col("ny")).alias("_y"), (F.col("x") + F.col("_k") * F.col("nx")).alias("_x"))
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    corner = lambda i, j: F.struct((F.floor("_y") + j).cast("int").alias("y"), (F.floor("_x") + i).cast("int").alias("x"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    corners = at.withColumn("_c", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).select("s", "_k", "_c.y", "_c.x", F.col("_c.w").alias("_w"))
    each = pixels.join(corners, PLACE).groupBy(REC, "frame", "s", "_k").agg((F.sum(F.col("v") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_v"))
    return each.groupBy(REC, "frame", "s").agg(F.avg("_v").alias("v"))


def spline_coefficients(pixels: DataFrame) -> DataFrame:
    """Coefficients of the cubic B-spline through each frame (absent places count as 0), with the two mirrored rows and columns that a
    place at the border needs."""
    size = pixels.groupBy(REC).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    every = pixels.select(REC, "frame").distinct().join(size, REC).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_h") * F.col("_w") - 1)))
    every = every.select(REC, "frame", F.expr("cast(_i div _w AS int)").alias("y"), (F.col("_i") % F.col("_w")).cast("int").alias("x"))
    dense = every.join(pixels.select(REC, "frame", *PLACE, "v"), [REC, "frame", *PLACE], "left").withColumn("v", F.coalesce(F.col("v").cast("double"), F.lit(0.0)))
    out = along_axes(dense, tuple(PLACE), lambda image, there, axis: grids.spline_coefficients(image, axis)).join(size, REC)
    for c, n in (("y", "_h"), ("x", "_w")):
        p, last = F.col(c), F.col(n) - 1
        copies = F.array(p, F.when(p.isin(1, 2), -p), F.when((p >= last - 2) & (p < last), 2 * last - p))
        out = out.withColumn(c, F.explode(F.array_compact(copies)))
    return out.select(REC, "frame", *PLACE, "v")


def cubic_kymograph(pixels: DataFrame, line: DataFrame, half: int = 2) -> DataFrame:
    """As `kymograph`, by the cubic spline through each frame. Places outside the image have no value and are left out of the mean."""
    at = line.withColumn("_k", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    at = at.select("s", "_k", (F.col("y") + F.col("_k") * F.col("ny")).alias("_y"), (F.col("x") + F.col("_k") * F.col("nx")).alias("_x"))
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    weights = lambda t: [(1 - t) ** 3 / 6, 2 / 3 - t * t * (2 - t) / 2, 2 / 3 - (1 - t) ** 2 * (1 + t) / 2, t**3 / 6]
    tap = lambda j, wy, i, wx: F.struct((F.floor("_y") + j).cast("int").alias("y"), (F.floor("_x") + i).cast("int").alias("x"), (wy * wx).alias("w"))
    taps = F.array(*[tap(j - 1, wy, i - 1, wx) for j, wy in enumerate(weights(fy)) for i, wx in enumerate(weights(fx))])
    each = at.withColumn("_c", F.explode(taps)).select("s", "_k", "_y", "_x", "_c.y", "_c.x", F.col("_c.w").alias("_weight"))
    size = pixels.groupBy(REC).agg((F.max("y")).alias("_h"), (F.max("x")).alias("_w"))
    inside = spline_coefficients(pixels).join(each, PLACE).join(size, REC).where("_y >= 0 AND _x >= 0 AND _y <= _h AND _x <= _w")
    lines = inside.groupBy(REC, "frame", "s", "_k").agg(F.sum(F.col("v") * F.col("_weight")).alias("_v"))
    return lines.groupBy(REC, "frame", "s").agg(F.avg("_v").alias("v"))


def kymo_background(kymo: DataFrame, quantile: float = 0.05) -> DataFrame:
    """Each place less a low quantile over time."""
    return kymo.withColumn("v", F.col("v") - F.percentile("v", quantile).over(W.partitionBy(REC, "s")))


def kymo_events(shapes: DataFrame, *, fps: float, um_per_pixel: float) -> DataFrame:
    """index, kind (rectangles are IHCs, ellipses GER), extent_um and start_s of drawn shapes (index, shape_type, axis0: frame, axis1: place)."""
    kind = F.when(F.first("shape_type") == "rectangle", "IHCs").when(F.first("shape_type") == "ellipse", "GER")
    return shapes.groupBy(REC, "index").agg(kind.alias("kind"), ((F.max("axis1") - F.min("axis1")) * um_per_pixel).alias("extent_um"), (F.min("axis0") / fps).alias("start_s"))


# Segmentation of single frames


#: Rows of a table with one row for each frame or recording that a join may broadcast; a larger one is joined by shuffle.
FEW = 100_000


def beside(pixels: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """pixels with the columns of `one`, which has a row for each value of `on` (NULL is a value). If those are few, pixels stay where they
    are; a shuffle on `on` would bring a frame or recording to one task."""
    few = one.limit(FEW + 1).count() <= FEW
    one = one.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in one.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return pixels.join(F.broadcast(one) if few else one, same).drop(*[f"_on_{c}" for c in on])


def otsu_threshold(pixels: DataFrame, bins: int = 256, *, settle=None) -> DataFrame:
    """recording, frame, threshold: the split of the frame's histogram with the largest variance between classes. Ends and histograms are
    aggregates, so no task sees a whole frame."""
    w, settle = W.partitionBy(REC, "frame"), settle or (lambda d: d)
    ends = settle(pixels.groupBy(REC, "frame").agg(F.min("v").cast("double").alias("_lo"), F.max("v").cast("double").alias("_hi")))
    out = beside(pixels, ends, [REC, "frame"])
    b = F.least(F.floor((F.col("v") - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(bins - 1))
    h = out.withColumn("_b", F.coalesce(b, F.lit(0))).groupBy(REC, "frame", "_b").agg(F.count("*").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    h = h.withColumn("_mid", F.col("_lo") + (F.col("_b") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins)
    upto = w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumns({"_w": F.sum("_n").over(upto), "_s": F.sum(F.col("_n") * F.col("_mid")).over(upto), "_all": F.sum("_n").over(w), "_sum": F.sum(F.col("_n") * F.col("_mid")).over(w)})
    rest = F.nullif(F.col("_all") - F.col("_w"), F.lit(0))
    between = F.col("_w") * rest * (F.col("_s") / F.col("_w") - (F.col("_sum") - F.col("_s")) / rest) ** 2
    best = F.max_by("_mid", F.struct(F.coalesce(between, F.lit(-1.0)), -F.col("_b")))
    return h.groupBy(REC, "frame").agg(best.alias("threshold"))


def opened_difference(pixels: DataFrame, radius: int) -> DataFrame:
    """White top-hat with a disk: the image less its opening. Frames are arrays; minima and maxima over the disk are running ones along
    its chords, so a chord's length costs nothing."""

    def opened(image: np.ndarray, there: np.ndarray, axis: int) -> np.ndarray:
        least = grids.disk_extreme(np.where(there, image, np.inf), radius, True)
        return grids.disk_extreme(np.where(there, least, -np.inf), radius, False)

    out = _per_frame(pixels, opened).withColumnRenamed("v", "_o")
    return pixels.join(out, [REC, "frame", *PLACE]).withColumn("v", F.col("v") - F.col("_o").cast(pixels.schema["v"].dataType)).drop("_o")


def _per_frame(pixels: DataFrame, change) -> DataFrame:
    """recording, frame, y, x, v after change(image, there, 0) of each frame's array."""
    lists = pixels.groupBy(REC, "frame").agg(*[F.collect_list(F.col(c).cast("double") if c == "v" else F.col(c)).alias(c) for c in (*PLACE, "v")])
    lists = lists.select(REC, "frame", *PLACE, _arrays(change, PLACE, ["y"])(*PLACE, "v").alias("v"))
    return lists.select(REC, "frame", F.explode(F.arrays_zip(*PLACE, "v")).alias("_p")).select(REC, "frame", *[f"_p.{c}" for c in (*PLACE, "v")])


def seeded_regions(pixels: DataFrame, *, sigma: float = 2.0, span: int = 3, settle=None) -> DataFrame:
    """recording, frame, y, x, label: pixels above the Otsu threshold of the blurred frame, each with its nearest local maximum
    (the first of equals). Seeds are numbered within the frame; pixels meet the seeds of the tiles around them."""
    settle = settle or (lambda d: d.checkpoint())
    smooth = settle(blurred(pixels, sigma, axes=("y", "x")))
    bright = settle(beside(smooth, settle(otsu_threshold(smooth, settle=settle)), [REC, "frame"]).where(F.col("v") > F.col("threshold")).drop("threshold"))
    highest = lambda image, there, axis: grids.running(grids.running(np.where(there, image, -np.inf), span, 0, False), span, 1, False)
    top = _per_frame(smooth, highest).withColumnRenamed("v", "_top")
    seeds = bright.join(top, [REC, "frame", *PLACE]).where(F.col("v") >= F.col("_top"))
    seeds = seeds.select(REC, "frame", F.row_number().over(W.partitionBy(REC, "frame").orderBy("y", "x")).alias("target"), F.col("y").alias("ty"), F.col("x").alias("tx"))
    found = nearest_by_tiles(bright.select(REC, "frame", *PLACE), settle(seeds), group=[REC, "frame"], settle=settle)
    return found.select(REC, "frame", *PLACE, F.col("target").alias("label"))
