"""Outlines of labels and drawn shapes: areas, overlaps and distances of polygons.

The outline of a label runs half-way between its pixels and those around it (a contour at half the label's height). Squares
between four neighbouring pixel centres are what it is made of: a square's corners that are of the label decide which of its
eight triangles the outline encloses, so areas and overlaps are sums over squares, joined on their places. Two pixels that touch
at a corner only are apart. A label is all its parts, and a hole in it is not of it. Beyond the image nothing is labelled.
Areas and distances are in pixels; edges come in half pixels, as integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import meet, passes, segment_distance

REC = "recording"

#: Edges of a square by its corners (1 upper left, 2 upper right, 4 lower left, 8 lower right), between its sides' middles (t, r, b, l),
#: with the label to the right of the way.
EDGES = {1: ["tl"], 2: ["rt"], 3: ["rl"], 4: ["lb"], 5: ["tb"], 6: ["rt", "lb"], 7: ["rb"], 8: ["br"], 9: ["tl", "br"], 10: ["bt"], 11: ["bl"], 12: ["lr"], 13: ["tr"], 14: ["lt"]}
_MIDDLE = {"t": (0, 1), "r": (1, 2), "b": (2, 1), "l": (1, 0)}


def squares(labels: DataFrame, *, recording=REC) -> DataFrame:
    """recording, label, y, x, corners, inner: the squares a label has a corner of, by the place of their upper left pixel."""
    corners = F.explode(F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(bit).alias("bit")) for bit, dy, dx in ((1, 0, 0), (2, 0, 1), (4, 1, 0), (8, 1, 1))]))
    out = labels.select(recording, "label", "y", "x", corners.alias("_c"))
    out = out.groupBy(recording, "label", (F.col("y") + F.col("_c.dy")).alias("y"), (F.col("x") + F.col("_c.dx")).alias("x")).agg(F.bit_or("_c.bit").alias("corners"))
    n, apart = F.bit_count("corners"), F.col("corners").isin(6, 9)
    return out.withColumn("inner", F.when(n >= 3, 15).when((n == 2) & ~apart, F.col("corners")).otherwise(0))


def _triangles(corners: Column, inner: Column) -> Column:
    return (F.bit_count(corners) + F.bit_count(inner)) / 8


def edges(labels: DataFrame, *, recording=REC) -> DataFrame:
    """recording, label, y0, x0, y1, x1: the outline's directed edges in half pixels, each a side's middle to another's of one square."""
    table = F.create_map(*[c for code, ways in EDGES.items() for c in (F.lit(code), F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("y0", "x0", "y1", "x1"), (*_MIDDLE[w[0]], *_MIDDLE[w[1]]), strict=True)]) for w in ways]))])
    out = squares(labels, recording=recording).where("corners < 15").withColumn("_e", F.explode(table[F.col("corners")]))
    return out.select(recording, "label", *[(2 * F.col(n[0]) + F.col(f"_e.{n}")).alias(n) for n in ("y0", "x0", "y1", "x1")])


def measures(labels: DataFrame, *, recording=REC) -> DataFrame:
    """recording, label, area and perimeter of the outline."""
    diagonal = F.bit_count("corners").isin(1, 3)
    length = F.when(F.col("corners").isin(6, 9), 2 * F.sqrt(F.lit(0.5))).when(F.col("corners") == 15, 0.0).when(diagonal, F.sqrt(F.lit(0.5))).otherwise(1.0)
    return squares(labels, recording=recording).groupBy(recording, "label").agg(F.sum(_triangles(F.col("corners"), F.col("inner"))).alias("area"), F.sum(length).alias("perimeter"))


def overlaps(a: DataFrame, b: DataFrame, *, recording=REC) -> DataFrame:
    """recording, label, other, area of what the outlines of a label of `a` and one of `b` both enclose, where that is not nothing."""
    left = squares(a, recording=recording)
    right = squares(b, recording=recording).select(recording, "y", "x", F.col("label").alias("other"), F.col("corners").alias("_c"), F.col("inner").alias("_i"))
    both = _triangles(F.col("corners").bitwiseAND(F.col("_c")), F.col("inner").bitwiseAND(F.col("_i")))
    return left.join(right, [recording, "y", "x"]).groupBy(recording, "label", "other").agg(F.sum(both).alias("area")).where("area > 0")


def _ends(prefix: str = "") -> tuple:
    return tuple((F.col(f"{prefix}y{k}").cast("double") / 2, F.col(f"{prefix}x{k}").cast("double") / 2) for k in (0, 1))


def distances(a: DataFrame, b: DataFrame, reach: float, *, recording=REC) -> DataFrame:
    """recording, label, other, distance of the outlines that are nearer than `reach` to each other; 0 where they overlap.

    Edges are at most a pixel long, so those within reach lie in neighbouring tiles of reach + 2 pixels: an equi-join on tiles, in which
    edges between two tiles of a long outline are never compared with all of another.
    """
    side = int(2 * reach) + 4
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = edges(a, recording=recording).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    left = left.select(recording, "label", "y0", "x0", "y1", "x1", (tile("y0") + F.col("_i")).alias("_ty"), (tile("x0") + F.col("_j")).alias("_tx"))
    right = edges(b, recording=recording).select(recording, F.col("label").alias("other"), tile("y0").alias("_ty"), tile("x0").alias("_tx"), *[F.col(c).alias(f"_{c}") for c in ("y0", "x0", "y1", "x1")])
    near = left.join(right, [recording, "_ty", "_tx"]).select(recording, "label", "other", segment_distance(*_ends(), *_ends("_")).alias("distance")).where(F.col("distance") < reach)
    over = overlaps(a, b, recording=recording).select(recording, "label", "other", F.lit(0.0).alias("distance"))
    return near.unionByName(over).groupBy(recording, "label", "other").agg(F.min("distance").alias("distance"))


def line_distances(labels: DataFrame, lines: DataFrame, *, recording=REC) -> DataFrame:
    """recording, label, distance of each outline from its recording's line (recording, ay, ax, by, bx), 0 where it meets or holds it."""
    line = (F.col("ay"), F.col("ax")), (F.col("by"), F.col("bx"))
    out = edges(labels, recording=recording).join(lines, recording).groupBy(recording, "label").agg(F.min(segment_distance(*_ends(), *line)).alias("_d"), F.count_if(passes(line[0], *_ends())).alias("_n"))
    return out.select(recording, "label", F.when(F.col("_n") % 2 == 1, 0.0).otherwise(F.col("_d")).alias("distance"))


def rings(labels: DataFrame, *, recording=REC) -> DataFrame:
    """recording, label, ring, vertex, y, x: the outline's rings from the topmost, leftmost point on, outer ones and holes.

    Edges of one label are put in order in one group, which holds its perimeter, not its pixels; straight stretches become one edge.
    """
    kind = labels.schema[recording].dataType.simpleString()
    name = labels.schema["label"].dataType.simpleString()

    def trace(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        after = dict(zip(zip(rows["y0"], rows["x0"]), zip(rows["y1"], rows["x1"])))  # a side's middle is the start of one edge only
        out, ring = [], 0
        for first in sorted(after):
            if first not in after:
                continue
            way, p = [], first
            while p in after:
                way.append(p)
                p = after.pop(p)
            bends = [q for o, q, r in zip([way[-1], *way], way, [*way[1:], way[0]]) if (q[0] - o[0]) * (r[1] - q[1]) != (q[1] - o[1]) * (r[0] - q[0])]
            out += [(ring, k, y / 2, x / 2) for k, (y, x) in enumerate(bends)]
            ring += 1
        found = pd.DataFrame(out, columns=["ring", "vertex", "y", "x"])
        yield found.assign(**{recording: key[0], "label": key[1]})[[recording, "label", "ring", "vertex", "y", "x"]]

    return edges(labels, recording=recording).groupBy(recording, "label").applyInPandas(trace, f"{recording} {kind}, label {name}, ring int, vertex int, y double, x double")


def shape_pairs(shapes: DataFrame, *, recording=REC, vertex="vertex") -> DataFrame:
    """recording, event, first, second: drawn shapes 2j and 2j + 1 that are one event, for they share a point and their types differ.

    shapes: (recording, index, kind, vertex, y, x), the vertices of closed polygons in order. Polygons share a point if edges meet or a
    vertex of one is inside the other; a pair is compared where both arrays of vertices are, in one row.
    """
    corner = F.sort_array(F.collect_list(F.struct(F.col(vertex).alias("k"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))))
    out = shapes.groupBy(recording, "index").agg(F.min("kind").alias("kind"), corner.alias("p"))
    out = out.withColumn("_k", F.row_number().over(W.partitionBy(recording).orderBy("index")) - 1).withColumn("event", F.expr("_k div 2"))
    ring = lambda p: F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    a = out.where("_k % 2 = 0").select(recording, "event", F.col("index").alias("first"), F.col("kind").alias("_ka"), ring(F.col("p")).alias("_a"))
    b = out.where("_k % 2 = 1").select(recording, "event", F.col("index").alias("second"), F.col("kind").alias("_kb"), ring(F.col("p")).alias("_b"))
    at = lambda e: (e["y"], e["x"])
    crossed = F.exists("_a", lambda e: F.exists("_b", lambda g: meet(at(e["a"]), at(e["b"]), at(g["a"]), at(g["b"]))))
    inside = lambda p, of: F.size(F.filter(of, lambda e: passes(at(p), at(e["a"]), at(e["b"])))) % 2 == 1
    one = crossed | inside(F.col("_a")[0]["a"], F.col("_b")) | inside(F.col("_b")[0]["a"], F.col("_a"))
    return a.join(b, [recording, "event"]).where((F.col("_ka") != F.col("_kb")) & one).select(recording, "event", "first", "second")
