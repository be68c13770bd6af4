"""Column expressions: identifiers, age groups, list literals, frames, rates and small geometry. Missing values are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: Column | str) -> Column:
    """Missing readings arrive as NaN; inside the engine they are NULL."""
    return F.when(~F.isnan(col(x)), col(x))


def kept(discard: Column | str) -> Column:
    """Rows not marked 1; unmarked rows stay."""
    return ~col(discard).eqNullSafe(F.lit(1))


def last_segment(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]+)$", 1)


def cell_id(date: Column | str, strain: Column | str, mouse: Column | str, folder: Column | str, roi: Column | str) -> Column:
    return F.concat_ws("_", col(date), col(strain), col(mouse).cast("string"), last_segment(folder), col(roi))


def mouse_id(strain: Column | str, number: Column | str) -> Column:
    return F.concat(col(strain), col(number).cast("string"))


def unique_cell_id(recording: Column | str, matched_roi: Column | str) -> Column:
    """The matched number keeps its decimal point, e.g. A_3.0."""
    return F.concat_ws("_", col(recording), col(matched_roi).cast("double").cast("string"))


def age_group(age: Column | str) -> Column:
    a = col(age)
    return F.when(a >= 12, "Posthearing").when(a >= 7, "Second week").when(a < 7, "First week")


def age_group_of_pairs(age: Column | str) -> Column:
    """The grouping used for pairs of cells: it differs from `age_group` between whole days."""
    a = col(age)
    return F.when(a >= 12, "Posthearing").when(a > 6, "Second week").when(a <= 6, "First week")


def frame_range(text: Column | str, n_frames: Column | str, channels: int = 1) -> Column:
    """'a-b', counted from 1 with both ends, as a half-open range from 0; the whole recording where it cannot be read."""
    parts = F.split(col(text), "-")
    first, last = (F.trim(F.get(parts, F.lit(i))).try_cast("int") for i in (0, 1))
    valid = first.isNotNull() & last.isNotNull()
    whole = (col(n_frames) / channels).cast("int")
    return F.struct(F.when(valid, first - 1).otherwise(F.lit(0)).alias("start"), F.when(valid, last).otherwise(whole).alias("end"))


def int_list(text: Column | str) -> Column:
    """A list literal; an empty list where it cannot be read."""
    return F.coalesce(F.from_json(col(text), "array<int>"), F.array().cast("array<int>"))


def interval_list(text: Column | str) -> Column:
    """A list of [start, end] pairs as structs."""
    pairs = F.coalesce(F.from_json(col(text), "array<array<int>>"), F.array().cast("array<array<int>>"))
    return F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end")))


def peak_positions(text: Column | str) -> Column:
    """Whole numbers from a list literal, a single number or nothing; what is not a number goes."""
    t = F.trim(col(text))
    listed = F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), "array<string>")
    numbers = F.transform(listed, lambda x: F.floor(x.try_cast("double")).cast("int"))
    return F.coalesce(F.filter(numbers, lambda x: x.isNotNull()), F.array().cast("array<int>"))


def float_or_null(text: Column | str) -> Column:
    return F.nullif(F.trim(col(text)), F.lit("")).try_cast("double")


def truth(text: Column | str) -> Column:
    return F.lower(F.trim(col(text))).isin("1", "true", "yes", "y", "t")


def as_list(values: Column | str, single: Column | str) -> Column:
    return F.coalesce(col(values), F.array(col(single)))


def extrema_order(order: Column | str, default: int = 50) -> Column:
    o = F.coalesce(col(order), F.lit(default))
    return F.when(o == 1, default).otherwise(o)


def odd_window(order: Column | str, default: int = 11) -> Column:
    o = F.coalesce(col(order), F.lit(default))
    return o + (o % 2 == 0).cast("int")


def microns(pixels: Column | str, per_pixel: Column | str) -> Column:
    return col(pixels) * col(per_pixel)


def seconds(frames: Column | str, fps: Column | str) -> Column:
    return F.try_divide(col(frames).cast("double"), col(fps))


def per_minute(n: Column | str, frames: Column | str, fps: Column | str) -> Column:
    return F.try_divide(60.0 * col(n), seconds(frames, fps))


def percent(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(100.0 * col(part), col(whole))


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(col(x1) - col(x2), col(y1) - col(y2))


def is_left(ax, ay, bx, by, cx, cy) -> Column:
    """Whether c is strictly left of the line from a to b."""
    return (col(bx) - col(ax)) * (col(cy) - col(ay)) - (col(by) - col(ay)) * (col(cx) - col(ax)) > 0


def clipped_u16(v: Column | str) -> Column:
    return F.least(F.greatest(col(v), F.lit(0)), F.lit(65535)).cast("int")


def local_path(root: str, folder: Column | str) -> Column:
    """A path from another machine's drive under a local root."""
    return F.concat(F.lit(root), F.replace(F.substring(col(folder), 3, 1 << 20), F.lit("\\"), F.lit("/")))


def fisher_mean(r: Column | str) -> Column:
    """Mean of correlations through Fisher's z."""
    return F.tanh(F.avg(F.atanh(col(r))))


def fisher_sd(r: Column | str) -> Column:
    return F.tanh(F.stddev_pop(F.atanh(col(r))))


def distance_bin(d: Column | str, width: int = 20, upto: int = 180) -> Column:
    """Lower end of the bin (lower, lower + width] of a distance above 0 and up to `upto`."""
    d = col(d)
    return F.when((d > 0) & (d <= upto), (F.ceil(d / width) - 1) * width).cast("int")


def model_for_rate(fps: Column | str, models: dict[float, str], tolerance: float = 0.005) -> Column:
    """The name of the model trained for a frame rate."""
    out = F.lit(None).cast("string")
    for rate, name in models.items():
        out = F.when(F.abs(col(fps) - rate) <= tolerance, name).otherwise(out)
    return out


def with_interval(intervals: Column | str, start: Column | int, end: Column | int) -> Column:
    """A list of intervals with one more."""
    one = F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((start, "start"), (end, "end"))])
    return F.array_append(F.coalesce(col(intervals), F.array().cast("array<struct<start:int,end:int>>")), one)


def without_last(intervals: Column | str) -> Column:
    """A list of intervals without the one added last; an empty list stays empty."""
    return F.slice(col(intervals), F.lit(1), F.greatest(F.size(col(intervals)) - 1, F.lit(0)))


def fill_metadata(recordings: DataFrame, found: DataFrame, key: str = "folder") -> DataFrame:
    """Fills what a recording sheet lacks (height, width, um_width, um_per_pixel, fps, frames, seconds) from file metadata."""
    names = ("height", "width", "um_width", "um_per_pixel", "fps", "frames", "seconds")
    found = found.select(F.col(key).alias("_key"), *[F.col(n).alias(f"_{n}") for n in names[:-1] if n in found.columns])
    out = recordings.join(found, F.col(key) == F.col("_key"), "left")
    for n in names[:-1]:
        have = [F.col(c) for c in (n, f"_{n}") if c in out.columns]
        if have:
            out = out.withColumn(n, F.coalesce(*have))
    out = out.withColumn("um_per_pixel", F.coalesce("um_per_pixel", F.try_divide("um_width", "width")))
    out = out.withColumn("seconds", F.try_divide("frames", "fps"))
    return out.select(*recordings.columns, *[n for n in names if n in out.columns and n not in recordings.columns])


def register(spark: SparkSession) -> None:
    """fisher_mean's parts as SQL functions, for use in spark.sql."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fisher_z(r DOUBLE) RETURNS DOUBLE RETURN atanh(r)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fisher_r(z DOUBLE) RETURNS DOUBLE RETURN tanh(z)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION age_group(a DOUBLE) RETURNS STRING RETURN CASE WHEN a >= 12 THEN 'Posthearing' WHEN a >= 7 THEN 'Second week' WHEN a < 7 THEN 'First week' END")


def compensated_mean(values: Column) -> Column:
    """Mean of an array of doubles without its NULLs, by Kahan's sum: to the last digit in nearly all cases, whatever the order."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc: Column, v: Column) -> Column:
        y = v - acc.c
        t = acc.s + y
        return F.struct(t.alias("s"), ((t - acc.s) - y).alias("c"))

    there = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(there, start, add, lambda acc: acc.s), F.size(there))
