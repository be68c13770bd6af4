"""Label images as sparse tables (recording, y, x, label): properties, filters, renumbering, erosion, components, assignment.

Labels are positive; background has no rows. Neighbours are found by equi-joins on shifted coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import is_left
from . import outlines
from .nearest import nearest_by_tiles
from .volumes import SIDE
from .volumes import components as tiled_components

REC = "recording"


def properties(labels: DataFrame, *, recording=REC) -> DataFrame:
    """Area, bounding box [min, max), centroid, orientation and axis lengths (of the ellipse with the same second moments)."""
    out = labels.groupBy(recording, "label").agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), (F.var_pop("y") + 1 / 12).alias("_yy"), (F.var_pop("x") + 1 / 12).alias("_xx"), F.covar_pop("y", "x").alias("_yx"),
    )
    mean, spread = (F.col("_yy") + F.col("_xx")) / 2, F.sqrt(((F.col("_yy") - F.col("_xx")) / 2) ** 2 + F.col("_yx") ** 2)
    return out.withColumns({"major": 4 * F.sqrt(mean + spread), "minor": 4 * F.sqrt(F.greatest(mean - spread, F.lit(0.0))), "orientation": 0.5 * F.atan2(2 * F.col("_yx"), F.col("_yy") - F.col("_xx"))}).drop("_yy", "_xx", "_yx")


def large(labels: DataFrame, least: int, *, recording=REC) -> DataFrame:
    """Labels of at least so many pixels."""
    keep = labels.groupBy(recording, "label").count().where(F.col("count") >= least).select(recording, "label")
    return labels.join(keep, [recording, "label"], "left_semi")


def left_to_right(labels: DataFrame, *, recording=REC) -> DataFrame:
    """Labels renumbered from 1 by the column of their centroid."""
    middle = labels.groupBy(recording, "label").agg(F.avg("x").alias("_x"))
    new = middle.select(recording, "label", F.row_number().over(W.partitionBy(recording).orderBy("_x", "label")).alias("_new"))
    return labels.join(new, [recording, "label"]).withColumn("label", F.col("_new")).drop("_new")


def by_start(labels: DataFrame, *, recording=REC, time="t") -> DataFrame:
    """Labels in time renumbered from 1 by their first frame."""
    first = labels.groupBy(recording, "label").agg(F.min(time).alias("_t"))
    new = first.select(recording, "label", F.row_number().over(W.partitionBy(recording).orderBy("_t", "label")).alias("_new"))
    return labels.join(new, [recording, "label"]).withColumn("label", F.col("_new")).drop("_new")


def contiguous(labels: DataFrame, *, recording=REC) -> DataFrame:
    """recording, ok: whether labels are 1..n without a gap."""
    return labels.groupBy(recording).agg((F.max("label") == F.count_distinct("label")).alias("ok"))


def _shifted(labels: DataFrame, reach: int, keys: list[str], axes: list[str]) -> DataFrame:
    """Each pixel at the places of its neighbours, itself not among them."""
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    out = labels
    for a in axes:
        out = out.withColumn(f"_d{a}", F.explode(steps))
    still = F.lit(True)
    for a in axes:
        still &= F.col(f"_d{a}") == 0
    return out.where(~still).select(*keys, *[(F.col(a) + F.col(f"_d{a}")).alias(a) for a in axes], "label")


def eroded(labels: DataFrame, *, recording=REC) -> DataFrame:
    """Pixels whose eight neighbours have the same label."""
    around = _shifted(labels, 1, [recording], ["y", "x"])
    full = around.groupBy(recording, "y", "x", "label").count().where("count = 8").drop("count")
    return labels.join(full, [recording, "y", "x", "label"], "left_semi")


def squares(labels: DataFrame, half: int, *, recording=REC) -> DataFrame:
    """[c - half, c + half) squares around the labels' centroids; where they meet, the larger label wins."""
    c = labels.groupBy(recording, "label").agg(F.floor(F.avg("y")).cast("int").alias("_y"), F.floor(F.avg("x")).cast("int").alias("_x"))
    side = lambda a: F.explode(F.sequence(F.col(a) - half, F.col(a) + half - 1))
    out = c.withColumn("y", side("_y")).withColumn("x", side("_x")).where("y >= 0 and x >= 0")
    return out.groupBy(recording, "y", "x").agg(F.max("label").alias("label"))


def enlarged(labels: DataFrame, factor: int = 2, *, recording=REC) -> DataFrame:
    """Each pixel as a square of pixels."""
    steps = F.array(*[F.lit(i) for i in range(factor)])
    out = labels.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
    return out.select(recording, (F.col("y") * factor + F.col("_a")).alias("y"), (F.col("x") * factor + F.col("_b")).alias("x"), "label")


def touching(labels: DataFrame, area: DataFrame, *, recording=REC) -> DataFrame:
    """Labels with a pixel in the area (recording, y, x), in any frame."""
    hit = labels.join(area.select(recording, "y", "x").distinct(), [recording, "y", "x"], "left_semi").select(recording, "label").distinct()
    return labels.join(hit, [recording, "label"], "left_semi")


def without_frames(labels: DataFrame, first: int, last: int, *, time="t") -> DataFrame:
    """Without the pixels of frames first to last, both included; swapped ends are put right."""
    return labels.where(~F.col(time).between(max(0, min(first, last)), max(first, last)))


def waves(labels: DataFrame, *, recording=REC, time="t") -> DataFrame:
    """recording, label, start, duration and area (voxels) of each wave."""
    return labels.groupBy(recording, "label").agg(F.min(time).alias("start"), (F.max(time) + 1 - F.min(time)).alias("duration"), F.count("*").alias("area"))


def neighbours_in_time(table: DataFrame, *, recording=REC) -> DataFrame:
    """Each wave's middle frame, and the waves before and after it."""
    w = W.partitionBy(recording).orderBy("start", "label")
    return table.withColumn("middle", F.col("start") + (F.col("duration") - 1) / 2).withColumns({"previous": F.lag("label").over(w), "next": F.lead("label").over(w)})


def components(labels: DataFrame, *, recording=REC, axes=("y", "x"), reach: int = 1, side: int = SIDE, settle=None) -> DataFrame:
    """Connected regions of equal labels (all neighbours within `reach`), numbered from 1 in order of their first pixel; see
    `volumes.components`. `settle` (DataFrame -> DataFrame) cuts the lineage, checkpoint() by default."""
    return tiled_components(labels, settle=settle or (lambda d: d.checkpoint()), axes=axes, reach=reach, side=side, recording=recording)


def merged_touching(labels: DataFrame, *, recording=REC, axes=("y", "x"), settle=None) -> DataFrame:
    """Labels that touch become one: regions of any labels, connected, numbered from 1."""
    return components(labels.withColumn("label", F.lit(1)), recording=recording, axes=axes, settle=settle).select(recording, *axes, F.col("component").alias("label"))


# Annotations and assignment


def annotation_median(labels: DataFrame, annotation: DataFrame, *, zeros: bool = False, recording=REC, name="kind") -> DataFrame:
    """recording, label, median of the annotation's values on the label's pixels; NULL where there are none. With `zeros`, pixels
    without an annotation count as 0."""
    inside = labels.join(annotation.select(recording, "y", "x", F.col("label").alias("_a")), [recording, "y", "x"], "left")
    return inside.groupBy(recording, "label").agg(F.percentile(F.coalesce("_a", F.lit(0)) if zeros else F.col("_a"), 0.5).alias(name))


def annotation_mode(labels: DataFrame, annotation: DataFrame, *, recording=REC, name="kind") -> DataFrame:
    """The most frequent annotation on each label, the smallest of equals."""
    inside = labels.join(annotation.select(recording, "y", "x", F.col("label").alias("_a")), [recording, "y", "x"])
    return inside.groupBy(recording, "label").agg(F.mode("_a", True).alias(name))


def nearest(points: DataFrame, targets: DataFrame, *, recording=REC, settle=None) -> DataFrame:
    """recording, label, target and distance of the nearest target of each point; both have (recording, label, cy, cx). Points
    are compared with the targets of the tiles around them."""
    settle = settle or (lambda d: d.checkpoint())
    p = points.select(recording, "label", F.col("cy").alias("y"), F.col("cx").alias("x"))
    t = targets.select(recording, F.col("label").alias("target"), F.col("cy").alias("ty"), F.col("cx").alias("tx"))
    return nearest_by_tiles(settle(p), settle(t), group=[recording], settle=settle).select(recording, "label", "target", "distance")


def bouton_classes(points: DataFrame, cells: DataFrame, *, cutoff: float = 75, close: float = 10, labels: DataFrame | None = None, recording=REC, settle=None) -> DataFrame:
    """recording, label, class: 1 and 2 for boutons left (modiolar) and right of the row of cells, 5 close to its line, 3 and 4
    for fibres, which are farther than `cutoff` from all cells. The line runs from the first cell's centroid to the last's. With
    `labels`, the boutons' pixels, closeness is their outlines' to the piece of line between the two; else their centroids' to the whole line."""
    ends = cells.groupBy(recording).agg(F.min_by(F.struct("cy", "cx"), "label").alias("_a"), F.max_by(F.struct("cy", "cx"), "label").alias("_b"))
    out = nearest(points, cells, recording=recording, settle=settle).join(points.select(recording, "label", "cy", "cx"), [recording, "label"]).join(ends, recording)
    ay, ax, by_, bx = (F.col(c) for c in ("_a.cy", "_a.cx", "_b.cy", "_b.cx"))
    left = is_left(ax, ay, bx, by_, F.col("cx"), F.col("cy"))
    off = F.abs((bx - ax) * (F.col("cy") - ay) - (by_ - ay) * (F.col("cx") - ax)) / F.nullif(F.hypot(bx - ax, by_ - ay), F.lit(0.0))
    if labels is not None:
        lines = ends.select(recording, *[F.col(f"_{e}.{c}").alias(f"{e}{c[1]}") for e in "ab" for c in ("cy", "cx")])
        out = out.join(outlines.line_distances(labels, lines, recording=recording).withColumnRenamed("distance", "_off"), [recording, "label"])
        off = F.col("_off")
    near = F.when(off < close, 5).when(left, 1).otherwise(2)
    return out.select(recording, "label", F.when(F.col("distance") < cutoff, near).when(left, 3).otherwise(4).alias("class"))


def overlap_assignment(points: DataFrame, cells: DataFrame, *, annotation: DataFrame | None = None, reach: int = 3, missing: int = 666, shapes: str = "pixels", recording=REC) -> DataFrame:
    """recording, label, cell: the cell with the largest overlap, else the last one with a pixel nearer than `reach`, else none (0).
    By the median of an annotation on all pixels of the label, 0 where there is none (without one all are of type 1), types 1 and 2 without a cell get `missing`, and
    type 5 always does. Overlap and nearness are the labels' pixels' or, with shapes="outline", those of their outlines; nearness is
    an equi-join of shifted pixels or of tiles, not a comparison of all."""
    c = cells.select(recording, "y", "x", F.col("label").alias("cell"))
    if shapes == "outline":
        over = outlines.overlaps(points, cells, recording=recording).select(recording, "label", F.col("other").alias("cell"), F.col("area").alias("count"))
    else:
        over = points.join(c, [recording, "y", "x"]).groupBy(recording, "label", "cell").count()
    best = over.groupBy(recording, "label").agg(F.max_by("cell", F.struct("count", -F.col("cell"))).alias("_over"))
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    disc = points.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).where(F.col("_dy") * F.col("_dy") + F.col("_dx") * F.col("_dx") < reach * reach)
    close = disc.select(recording, "label", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x")).join(c, [recording, "y", "x"])
    if shapes == "outline":
        close = outlines.distances(points, cells, reach, recording=recording).withColumnRenamed("other", "cell")
    close = close.groupBy(recording, "label").agg(F.max("cell").alias("_close"))
    kinds = points.select(recording, "label", F.lit(1.0).alias("_kind")).distinct() if annotation is None else annotation_median(points, annotation, zeros=True, recording=recording, name="_kind")
    out = kinds.join(best, [recording, "label"], "left").join(close, [recording, "label"], "left")
    cell = F.coalesce("_over", "_close", F.when(F.col("_kind").isin(1.0, 2.0), missing), F.lit(0))
    return out.select(recording, "label", F.when(F.col("_kind") == 5, F.lit(missing)).otherwise(cell).alias("cell"))


def matched_numbers(typed: DataFrame, labels: DataFrame, matching: DataFrame, *, recording=REC) -> DataFrame:
    """recording, label, matched: median of the matching mask on the label, else its place among the recording's cells of type 1;
    NULL for other types. typed: (recording, label, kind)."""
    median = annotation_median(labels, matching, recording=recording, name="_m")
    place = F.sum((F.col("kind") == 1).cast("int")).over(W.partitionBy(recording).orderBy("label").rowsBetween(W.unboundedPreceding, 0))
    out = typed.join(median, [recording, "label"], "left").withColumn("_place", place.cast("double"))
    return out.select(recording, "label", F.when(F.col("kind") == 1, F.coalesce("_m", "_place")).alias("matched"))


def shifted_numbers(labels: DataFrame, shift: int, *, recording=REC) -> DataFrame:
    """Labels moved cyclically by `shift`: what falls below 1 comes back at the top."""
    top = labels.groupBy(recording).agg(F.max("label").alias("_top"))
    moved = F.col("label") + shift
    return labels.join(top, recording).withColumn("label", F.when(moved > 0, moved).otherwise(F.col("_top") + moved - 1)).drop("_top")


def stacked_images(labels: DataFrame, sizes: DataFrame, *, group: str, sequence: str) -> DataFrame:
    """Images of a group one below the other: adds `stacked_y`. sizes: (group, sequence, height)."""
    w = W.partitionBy(group).orderBy(sequence).rowsBetween(W.unboundedPreceding, -1)
    top = sizes.select(group, sequence, F.coalesce(F.sum("height").over(w), F.lit(0)).alias("_top"))
    return labels.join(top, [group, sequence]).withColumn("stacked_y", F.col("y") + F.col("_top")).drop("_top")


def polygon_pairs(shapes: DataFrame, *, recording=REC) -> DataFrame:
    """Shapes 2j and 2j + 1 as one event, if their boxes meet and their types differ (`outlines.shape_pairs` compares the polygons). shapes: (recording, index, kind, y, x) vertices."""
    box = shapes.groupBy(recording, "index").agg(F.first("kind").alias("kind"), *[f(c).alias(f"{c}{n}") for c in ("y", "x") for f, n in ((F.min, 0), (F.max, 1))])
    out = box.withColumn("_k", F.row_number().over(W.partitionBy(recording).orderBy("index")) - 1)
    a, b = out.where("_k % 2 = 0").withColumn("event", F.expr("_k div 2")), out.where("_k % 2 = 1").withColumn("event", F.expr("_k div 2"))
    b = b.select(recording, "event", *[F.col(c).alias(f"_{c}") for c in ("index", "kind", "y0", "y1", "x0", "x1")])
    meet = (F.col("y0") <= F.col("_y1")) & (F.col("_y0") <= F.col("y1")) & (F.col("x0") <= F.col("_x1")) & (F.col("_x0") <= F.col("x1"))
    return a.join(b, [recording, "event"]).where(meet & (F.col("kind") != F.col("_kind"))).select(recording, "event", F.col("index").alias("first"), F.col("_index").alias("second"))


def cells_to_match(labels: DataFrame, matching: DataFrame, annotations: DataFrame, *, only_type: int | None = 1, recording=REC, settle=None) -> DataFrame:
    """The label image to match recordings by: the stored matching mask where a recording has one, else its labels of one type,
    as connected regions numbered from left to right."""
    stored = matching.select(recording).distinct()
    rest = labels.join(stored, recording, "left_anti")
    if only_type is not None:
        typed = annotation_median(rest, annotations, recording=recording).where(F.col("kind") == only_type).select(recording, "label")
        rest = rest.join(typed, [recording, "label"], "left_semi")
    regions = components(rest, recording=recording, settle=settle).select(recording, "y", "x", F.col("component").alias("label"))
    return matching.select(recording, "y", "x", "label").unionByName(left_to_right(regions, recording=recording).select(recording, "y", "x", "label"))
