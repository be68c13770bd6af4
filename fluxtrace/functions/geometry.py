"""Points, segments and rings as Column expressions. A point is a pair (y, x) of columns, a segment a pair of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def turn(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area of the triangle a, b, c."""
    return (b[1] - a[1]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[1] - a[1])


def point_to_segment(p: Point, a: Point, b: Point) -> Column:
    """Distance of a point from a segment, which may be a point."""
    dy, dx = b[0] - a[0], b[1] - a[1]
    along = ((p[0] - a[0]) * dy + (p[1] - a[1]) * dx) / F.nullif(dy * dy + dx * dx, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return F.hypot(p[0] - a[0] - t * dy, p[1] - a[1] - t * dx)


def _between(p: Point, a: Point, b: Point) -> Column:
    """Whether a point of the segment's line lies in its box."""
    return p[0].between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & p[1].between(F.least(a[1], b[1]), F.greatest(a[1], b[1]))


def meet(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether segments a-b and c-d share a point, ends included."""
    abc, abd, cda, cdb = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    cross = (F.signum(abc) * F.signum(abd) < 0) & (F.signum(cda) * F.signum(cdb) < 0)
    ends = [(abc, c, a, b), (abd, d, a, b), (cda, a, c, d), (cdb, b, c, d)]
    for side, p, q, r in ends:
        cross = cross | ((side == 0) & _between(p, q, r))
    return cross


def segment_distance(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Distance of two segments, 0 where they meet."""
    nearest = F.least(point_to_segment(a, c, d), point_to_segment(b, c, d), point_to_segment(c, a, b), point_to_segment(d, a, b))
    return F.when(meet(a, b, c, d), 0.0).otherwise(nearest)


def passes(p: Point, a: Point, b: Point) -> Column:
    """Whether the ray from p to greater x crosses the edge a-b: a point that does so with an odd number of a ring's edges is inside."""
    at = a[1] + (p[0] - a[0]) * (b[1] - a[1]) / F.nullif((b[0] - a[0]).cast("double"), F.lit(0.0))
    return ((a[0] > p[0]) != (b[0] > p[0])) & F.coalesce(p[1] < at, F.lit(False))
