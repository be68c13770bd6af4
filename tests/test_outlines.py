"""Outlines of labels and drawn shapes against shapes worked by hand and clipping by definition."""

import math
from itertools import pairwise

import numpy as np
import pytest

from fluxtrace.operators import labels as lb
from fluxtrace.operators import outlines as ol


def image(spark, *rows, dx=0):
    places = [(0, y, x + dx, int(c)) for y, row in enumerate(rows) for x, c in enumerate(row) if c != "."]
    return spark.createDataFrame(places, "recording int, y int, x int, label int")


def test_measures_of_hand_worked_shapes(spark):
    got = {r["label"]: (r["area"], r["perimeter"]) for r in ol.measures(image(spark, "1..22.33", "...22..3", "4.......", ".4.555..", "...5.5..", "...555..")).collect()}
    half = math.sqrt(0.5)
    assert got[1] == pytest.approx((0.5, 4 * half))  # a diamond
    assert got[2] == pytest.approx((3.5, 4 + 4 * half))  # 2 x 2 without its corners
    assert got[3] == pytest.approx((3 - 5 / 8 + 1 / 8, 2 + 6 * half))  # five corners go, one is filled
    assert got[4] == pytest.approx((1.0, 8 * half))  # two diamonds: pixels that touch at a corner are apart
    assert got[5] == pytest.approx((9 - 4 / 8 - 4 / 8, 8 + 8 * half))  # a ring and its hole, whose outline is a diamond around a pixel


def test_rings_are_in_order_and_close(spark):
    rows = ol.rings(image(spark, "111", "1.1", "111")).orderBy("ring", "vertex").collect()
    rings = [[(r["y"], r["x"]) for r in rows if r["ring"] == k] for k in sorted({r["ring"] for r in rows})]
    assert len(rings) == 2
    area = [sum((a[1] * b[0] - b[1] * a[0]) / 2 for a, b in pairwise([*ring, ring[0]])) for ring in rings]
    assert abs(sum(area)) == pytest.approx(ol.measures(image(spark, "111", "1.1", "111")).first()["area"])
    assert area[0] * area[1] < 0  # the hole runs the other way


def _inside(edges, p):
    return sum((a[0] > p[0]) != (b[0] > p[0]) and p[1] < a[1] + (p[0] - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in edges) % 2 == 1


def test_overlaps_by_sampled_polygons(spark):
    rng = np.random.default_rng(3)
    pick = lambda: "".join("12."[i] for i in rng.choice(3, 7, p=[0.4, 0.3, 0.3]))
    a, b = image(spark, *[pick() for _ in range(6)]), image(spark, *[pick() for _ in range(6)])
    polygons = [{}, {}]
    for found, df in zip(polygons, (a, b), strict=True):
        for r in ol.edges(df).collect():
            found.setdefault(r["label"], []).append(((r["y0"] / 2, r["x0"] / 2), (r["y1"] / 2, r["x1"] / 2)))
    # Points inside both polygons, by the crossing number, eight by eight to a pixel.
    points = [(y / 8 + 1 / 16, x / 8 + 1 / 32) for y in range(-8, 56) for x in range(-8, 64)]
    want = {}
    for i, p in polygons[0].items():
        mine = [q for q in points if _inside(p, q)]
        for j, o in polygons[1].items():
            want[i, j] = sum(_inside(o, q) for q in mine) / 64
    got = {(r["label"], r["other"]): r["area"] for r in ol.overlaps(a, b).collect()}
    for k, v in want.items():
        assert got.get(k, 0) == pytest.approx(v, abs=0.15 * max(v, 1))
    assert all(v * 8 == int(v * 8) for v in got.values())


def test_overlap_with_itself_is_the_area(spark):
    one = image(spark, "11.22", "1.1.2", ".1122", "11..2")
    areas = {r["label"]: r["area"] for r in ol.measures(one).collect()}
    got = {(r["label"], r["other"]): r["area"] for r in ol.overlaps(one, one).collect()}
    assert {i: got[i, i] for i in areas} == areas and set(got) == {(1, 1), (2, 2)}


def test_distances_of_hand_worked_shapes(spark):
    a, b = image(spark, "1....", ".....", ".....", "2....", "22..."), image(spark, "...1.", ".....", ".....", "2..3.", ".....")
    got = {(r["label"], r["other"]): r["distance"] for r in ol.distances(a, b, 4).collect()}
    assert got[1, 1] == pytest.approx(2)  # the diamonds' tips
    assert got[1, 2] == pytest.approx(2)
    assert got[2, 2] == 0
    assert (1, 3) in got and got[1, 3] == pytest.approx((6 - 1) / math.sqrt(2))  # sides y + x = 1/2 and y + x = 11/2, at right angles to both
    by_hand = {k for k, v in got.items() if v < 2.5}
    assert {(r["label"], r["other"]) for r in ol.distances(a, b, 2.5).collect()} == by_hand


def test_lines_meet_hold_and_miss_outlines(spark):
    a = image(spark, "111....", "111...2", "111....")
    lines = spark.createDataFrame([(0, 1.0, 1.0, 1.2, 1.0)], "recording int, ay double, ax double, by double, bx double")
    got = {r["label"]: r["distance"] for r in ol.line_distances(a, lines).collect()}
    assert got[1] == 0 and got[2] == pytest.approx(4.5)  # the line is inside the first
    lines = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 5.0)], "recording int, ay double, ax double, by double, bx double")
    got = {r["label"]: r["distance"] for r in ol.line_distances(a, lines).collect()}
    assert got == {1: 0, 2: pytest.approx(0.5)}


def test_assignment_by_outlines_differs_from_pixels(spark):
    points, cells = image(spark, "11....", "......", "......", "......"), image(spark, "......", "......", "......", ".7....")
    # Pixel centres are 3 apart, outlines 2.
    assert lb.overlap_assignment(points, cells).first()["cell"] == 666
    assert lb.overlap_assignment(points, cells, shapes="outline").first()["cell"] == 7


@pytest.mark.parametrize(
    ("second", "kind", "one"),
    [
        ([(0, 3), (0, 9), (9, 9)], 2, True),  # boxes meet, polygons too
        ([(0, 7), (0, 9), (2, 9)], 2, False),  # boxes meet, polygons don't
        ([(5, 1), (5, 2), (6, 1)], 2, True),  # held
        ([(0, 3), (0, 9), (9, 9)], 1, False),  # one type
        ([(0, 8), (-1, 8), (-1, 9)], 2, False),
        ([(9, 0), (12, 0), (12, 3)], 2, True),  # a shared vertex
    ],
)
def test_shape_pairs(spark, second, kind, one):
    first = [(0, 0), (9, 0), (0, 6)][::-1] if second[0] != (5, 1) else [(0, 0), (20, 0), (0, 20)]
    rows = [(0, i, k, n, float(y), float(x)) for i, k, shape in ((3, 1, first), (8, kind, second)) for n, (y, x) in enumerate(shape)]
    found = ol.shape_pairs(spark.createDataFrame(rows, "recording int, index int, kind int, vertex int, y double, x double")).collect()
    assert [(r["event"], r["first"], r["second"]) for r in found] == ([(0, 3, 8)] if one else [])


def test_no_labels(spark):
    none = image(spark, "...")
    assert ol.measures(none).count() == ol.overlaps(none, none).count() == ol.distances(none, none, 3).count() == ol.rings(none).count() == 0
