"""Volumes in tiles: components, growth from seeds through a mask, expansion of labels, and segmentation by all three.

A volume is sparse rows (recording, axes ..., label). Tiles are boxes of `side` places an axis; a task works on the arrays of
one tile, and only places next to a tile's border are shuffled to other tiles. A tile and its halo are bounded by
(side + 2 * reach) ** axes places whatever the volume.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import grids
from .graphs import roots

REC = "recording"
SIDE = 64


def tile_of(axis: str, side: int) -> Column:
    return F.floor(F.col(axis) / side).cast("long").alias(f"_t{axis}")


def _tiled(df: DataFrame, axes: list[str], side: int) -> DataFrame:
    return df.select("*", *[tile_of(a, side) for a in axes])


def _spread(rows: DataFrame, axes: list[str], side: int, reach: int) -> DataFrame:
    """The rows once for each other tile that lies within `reach` of them, with that tile instead of their own."""
    out = rows
    for a in axes:
        near = F.array_distinct(F.array(*[F.floor((F.col(a) + d) / side).cast("long") for d in (-reach, 0, reach)]))
        out = out.withColumn(f"_o{a}", F.col(f"_t{a}")).withColumn(f"_t{a}", F.explode(near))
    other = F.lit(False)
    for a in axes:
        other |= F.col(f"_t{a}") != F.col(f"_o{a}")
    return out.where(other).drop(*[f"_o{a}" for a in axes])


def _schema(df: DataFrame, **more) -> StructType:
    return StructType([*df.schema.fields, *[StructField(n, t) for n, t in more.items()]])


def components(labels: DataFrame, *, settle, axes=("frame", "y", "x"), reach: int = 1, side: int = SIDE, recording=REC) -> DataFrame:
    """Connected regions of equal labels (all neighbours within `reach`), numbered from 1 in each recording in order of their first
    place: labels with `component`.

    Regions are found inside tiles; regions of neighbouring tiles that touch are edges of a graph, whose components are found by
    contraction. So places are shuffled once to their tile and once for their number, and rounds see only regions on seams.
    """
    axes, tile = list(axes), [f"_t{a}" for a in axes]
    df = _tiled(labels.select(recording, *axes, F.col("label").cast("long").alias("label")), axes, side)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axes, ignore_index=True)
        at = grids.sparse_components(pdf[axes].to_numpy(np.int64), pdf["label"].to_numpy(), reach)
        return pdf.assign(**{f"_f{a}": pdf[a].to_numpy()[at] for a in axes})

    found = settle(df.groupBy(recording, *tile).applyInPandas(work, _schema(df, **{f"_f{a}": df.schema[a].dataType for a in axes})))
    node = F.struct(recording, *[F.col(f"_f{a}").alias(a) for a in axes])
    found = found.select(recording, *axes, "label", *tile, node.alias("node"))
    edge = F.lit(False)
    for a in axes:
        edge |= (F.pmod(F.col(a), F.lit(side)) < reach) | (F.pmod(F.col(a), F.lit(side)) >= side - reach)
    seam = settle(found.where(edge))
    there = seam.select(recording, *axes, "label", F.col("node").alias("b"))
    steps = F.array(*[F.lit(d) for d in range(-reach, reach + 1)])
    here = seam.select(recording, "label", F.col("node").alias("a"), *axes, *tile)
    for a in axes:
        here = here.withColumn(f"_d{a}", F.explode(steps)).withColumn(a, (F.col(a) + F.col(f"_d{a}")).cast(labels.schema[a].dataType)).drop(f"_d{a}")
    other = F.lit(False)
    for a in axes:
        other |= F.col(f"_t{a}") != F.floor(F.col(a) / side)
    pairs = here.where(other).join(there, [recording, *axes, "label"]).select("a", "b").distinct()
    rooted, _ = roots(pairs, settle)
    nodes = found.select("node").distinct().join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    nodes = settle(nodes.withColumn("first", F.min("node").over(W.partitionBy("root"))))
    order = nodes.select(F.col(f"first.{recording}").alias("_rec"), "first").distinct()
    order = order.withColumn("component", F.row_number().over(W.partitionBy("_rec").orderBy("first"))).drop("_rec")
    numbered = nodes.join(order, "first").select("node", "component")
    return found.join(numbered, "node").select(recording, *axes, F.col("label").cast(labels.schema["label"].dataType).alias("label"), "component")


def growing(mask: DataFrame, seeds: DataFrame, *, settle, axes=("frame", "y", "x"), side: int = SIDE, recording=REC) -> DataFrame:
    """recording, axes, label and distance: each place of the mask with the seed that reaches it in the fewest steps through the mask
    (all neighbours are one step; the smallest label of equals). Places that no seed reaches are left out.

    Seeds (recording, axes, label) grow inside tiles, then what changed on borders is handed to the tiles next to it, until
    borders agree. A round works only on tiles that were handed something.
    """
    axes, tile = list(axes), [f"_t{a}" for a in axes]
    kept = [recording, *axes]
    start = mask.select(*kept).join(seeds.select(*kept, F.col("label").cast("long").alias("_key")), kept, "left")
    start = start.withColumn("_new", F.col("_key").isNotNull()).withColumn("_key", F.coalesce("_key", F.lit(int(grids.NOTHING))))
    todo, done = settle(_tiled(start, axes, side)), None
    schema, halo = todo.schema, None

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pdf[axes].to_numpy(np.int64)
        at = tuple((places - places.min(0)).T)
        own = pdf["_own"].to_numpy(bool)
        key, inside = np.full(places.max(0) - places.min(0) + 1, grids.NOTHING), np.zeros(places.max(0) - places.min(0) + 1, bool)
        key[at], inside[at] = pdf["_key"].to_numpy(np.int64), own
        before = key[at]
        after = grids.grown(key, inside)[at]
        out = pdf.assign(_key=after, _new=(after != before) | pdf["_new"].to_numpy(bool))
        return out.loc[own, [f.name for f in schema.fields]]

    while True:
        rows = todo.withColumn("_own", F.lit(True))
        rows = rows if halo is None else rows.unionByName(halo.withColumn("_own", F.lit(False)))
        grew = settle(rows.groupBy(recording, *tile).applyInPandas(work, schema))
        state = (grew if done is None else done.unionByName(grew)).withColumn("_new", F.lit(False))
        halo = settle(_spread(grew.where("_new"), axes, side, 1))
        if halo.isEmpty():
            break
        touched = halo.select(recording, *tile).distinct()
        todo, done = settle(state.join(touched, [recording, *tile], "left_semi")), settle(state.join(touched, [recording, *tile], "left_anti"))
    key = F.col("_key")
    return state.where(key < F.lit(int(grids.NOTHING))).select(*kept, key.bitwiseAND(F.lit((1 << grids.SHIFT) - 1)).alias("label"), F.shiftright(key, grids.SHIFT).cast("int").alias("distance"))


def expanded(labels: DataFrame, radius: float, *, bounds: DataFrame | None = None, axes=("frame", "y", "x"), side: int = SIDE, recording=REC) -> DataFrame:
    """Labels grown into places without one whose nearest labelled place is within `radius` (Euclidean; the smaller label of equals). With
    `bounds` (recording, axes) only places that it lists. A tile sees the labels within the radius around it."""
    axes, tile, reach = list(axes), [f"_t{a}" for a in axes], int(radius)
    own = labels.select(recording, *axes, F.col("label").cast("long").alias("label"))
    if not reach:
        return own
    df = _tiled(own, axes, side)
    rows = df.unionByName(_spread(df, axes, side, reach))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.array(key[1:], np.int64) * side - reach
        dense = np.zeros((side + 2 * reach,) * len(axes), np.int64)
        dense[tuple((pdf[axes].to_numpy(np.int64) - low).T)] = pdf["label"].to_numpy()
        grown = grids.expanded(dense, radius)[tuple(slice(reach, reach + side) for _ in axes)]
        at = np.nonzero(grown)
        return pd.DataFrame({recording: key[0], **{a: at[k] + low[k] + reach for k, a in enumerate(axes)}, "label": grown[at]})

    types = {a: labels.schema[a].dataType for a in axes}
    out = rows.groupBy(recording, *tile).applyInPandas(work, StructType([StructField(recording, labels.schema[recording].dataType), *[StructField(a, t) for a, t in types.items()], StructField("label", LongType())]))
    return out if bounds is None else out.join(bounds.select(recording, *axes), [recording, *axes], "left_semi")


def merged(labels: DataFrame, radius: float = 0.5, *, settle, bounds: DataFrame | None = None, axes=("frame", "y", "x"), side: int = SIDE, recording=REC) -> DataFrame:
    """Labels expanded by a radius; those that then touch become one, numbered from 1 in order of their first place."""
    wide = settle(expanded(labels, radius, bounds=bounds, axes=axes, side=side, recording=recording))
    one = components(wide.withColumn("label", F.lit(1)), settle=settle, axes=axes, side=side, recording=recording)
    return one.select(recording, *axes, F.col("component").alias("label"))


def otsu_of_volume(pixels: DataFrame, bins: int = 256, *, settle=None) -> DataFrame:
    """recording, threshold: Otsu's split of the histogram of a whole recording."""
    from .movie import otsu_threshold

    return otsu_threshold(pixels.withColumn("frame", F.lit(0)), bins, settle=settle).drop("frame")


def numbered(places: DataFrame, *, axes=("frame", "y", "x"), recording=REC, name="label") -> DataFrame:
    """recording, axes and their number from 1 through the recording in order of the axes. A window holds the places of one line along
    the last axis, or the counts of what lies on one value of the axes before; none holds all places of a recording."""
    *before, last = axes
    starts, inner = None, [recording, *before]
    while len(inner) > 1:
        *outer, axis = inner
        w = W.partitionBy(*outer).orderBy(axis).rowsBetween(W.unboundedPreceding, -1)
        counts = places.groupBy(*inner).agg(F.count("*").alias("_n"))
        counts = counts.select(*inner, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_{axis}"))
        starts = counts if starts is None else starts.join(counts, inner)
        inner = outer
    line = F.row_number().over(W.partitionBy(recording, *before).orderBy(last)).cast("long")
    out = places.select(recording, *axes, line.alias(name))
    if starts is None:
        return out
    start = sum((F.col(f"_{a}") for a in before), F.lit(0))
    return out.join(starts.select(recording, *before, start.alias("_start")), [recording, *before]).select(recording, *axes, (F.col(name) + F.col("_start")).alias(name))


def tops(pixels: DataFrame, span: int, *, axes=("frame", "y", "x"), side: int = SIDE) -> DataFrame:
    """recording, axes, v of the places whose value no place within `span` along every axis exceeds: running maxima an axis at a time, over
    tiles that see `span` places around them. Absent places don't count."""
    axes, tile = list(axes), [f"_t{a}" for a in axes]
    df = _tiled(pixels.select(REC, *axes, F.col("v").cast("double").alias("v")), axes, side)
    rows = df.withColumn("_own", F.lit(True)).unionByName(_spread(df, axes, side, span).withColumn("_own", F.lit(False)))
    kept = StructType([f for f in df.schema.fields if f.name not in tile])

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple((pdf[axes].to_numpy(np.int64) - np.array(key[1:], np.int64) * side + span).T)
        top = np.full((side + 2 * span,) * len(axes), -np.inf)
        top[at] = pdf["v"].to_numpy()
        for k in range(len(axes)):
            top = grids.running(top, span, k, False)
        return pdf.loc[pdf["_own"].to_numpy(bool) & (pdf["v"].to_numpy() >= top[at]), [f.name for f in kept.fields]]

    return rows.groupBy(REC, *tile).applyInPandas(work, kept)


def seeded(pixels: DataFrame, *, spot_sigma: float = 2.0, outline_sigma: float = 2.0, span: int = 3, bins: int = 256, side: int = SIDE, settle) -> DataFrame:
    """recording, frame, y, x, label: places above the volume's Otsu threshold after one blur, grown from the local maxima after another.
    Seeds are numbered through the recording in order of frame, y, x. Sigma 0: no blur."""
    from .movie import beside, blurred

    def smooth(sigma: float) -> DataFrame:
        return settle(blurred(pixels, sigma) if sigma else pixels.select(REC, "frame", "y", "x", F.col("v").cast("double").alias("v")))

    spots = smooth(spot_sigma)
    outline = spots if spot_sigma == outline_sigma else smooth(outline_sigma)
    threshold = settle(otsu_of_volume(outline, bins, settle=settle))
    mask = settle(beside(outline, threshold, [REC]).where(F.col("v") > F.col("threshold")).select(REC, "frame", "y", "x"))
    seeds = tops(spots, span, side=side).join(mask, [REC, "frame", "y", "x"], "left_semi")
    seeds = settle(numbered(settle(seeds.select(REC, "frame", "y", "x"))))
    return growing(mask, seeds, settle=settle, side=side).select(REC, "frame", "y", "x", F.col("label").cast(IntegerType()).alias("label"))
