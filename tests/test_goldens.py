"""Small inputs with answers derived by hand."""

import math

import pytest
from pyspark.sql import functions as F

from fluxtrace.functions import scalars as sc
from fluxtrace.operators import correlation as co
from fluxtrace.operators import events as ev
from fluxtrace.operators import intervals as iv
from fluxtrace.operators import labels as lb
from fluxtrace.operators import movie as mv
from fluxtrace.operators import peaks as pk
from fluxtrace.operators import rollups as ro
from fluxtrace.operators import traces as tr

TRACE = [0.10, 0.13, 0.09, 0.20, 0.25, 0.22, 0.18, 0.30, 0.28, 0.24]


def trace(spark, values, cell=1):
    return spark.createDataFrame([(cell, i, None if v is None else float(v)) for i, v in enumerate(values)], "cell int, frame int, f double")


def column(df, name, order="frame"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_baselines(spark):
    df = trace(spark, TRACE)
    assert column(tr.dff0(df), "dff0")[0] == pytest.approx(-0.350649, abs=1e-6)
    assert column(tr.dff0_first_half(df), "dff0")[0] == pytest.approx(-0.056604, abs=1e-6)


def test_dff0_does_not_depend_on_scale(spark):
    a, b = (column(tr.dff0(trace(spark, [v * k for v in TRACE])), "dff0") for k in (1, 7))
    assert a == pytest.approx(b)


@pytest.mark.parametrize(("order", "low", "high"), [(1, [2, 6], [1, 4, 7]), (2, [2, 6], [4, 7])])
def test_extrema(spark, order, low, high):
    df = trace(spark, TRACE)
    assert column(tr.local_extrema(df, order), "frame") == low
    assert column(tr.local_extrema(df, order, kind="max"), "frame") == high


@pytest.mark.parametrize("engine", ["sql", "arrow"])
def test_rolling_median(spark, engine):
    assert column(tr.rolling_quantile(trace(spark, [1, None, 3, 10]), 3, engine=engine), "baseline") == [1, 1, 2, 6.5]


@pytest.mark.parametrize("window", [4, 5, 6])
def test_engines_agree(spark, window):
    df = trace(spark, [(7 * i) % 11 if i % 5 else None for i in range(40)])
    for center in (False, True):
        a, b = (column(tr.rolling_quantile(df, window, quantile=0.3, center=center, min_periods=2, engine=e), "baseline") for e in ("sql", "arrow"))
        assert [x if x is None or x == x else None for x in b] == pytest.approx(a)


def test_held_frames(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7] + list(range(20, 28))
    df = trace(spark, values).withColumn("recording", F.lit(1))
    got = column(tr.fill_held(df, recording="recording"), "filled")
    assert got[5:10] == pytest.approx([6.1666667, 6.3333333, 6.5, 6.6666667, 6.8333333])
    assert got[:5] == [1, 2, 3, 4, 5] and got[10:] == values[10:]
    bridged = column(tr.fill_held(df, recording="recording", mode="bridge"), "filled")
    assert bridged[5] == 6 and bridged[6] == pytest.approx(6.2)


def test_robust_score(spark):
    out = tr.mad_zscore(trace(spark, [1, 2, 2, 5, 9, 4]))
    assert column(out, "z") == pytest.approx([-1.180359, 0, 0, 0.168623, 1.517604, -0.168623], abs=1e-6)
    assert column(out, "safe") == [True, False, False, True, True, True]


def test_jump_intervals(spark):
    jumps = spark.createDataFrame([(1, 20)], "recording int, frame int")
    assert [(r["start"], r["end"]) for r in iv.around(jumps, 3, 5).collect()] == [(17, 25)]
    assert iv.trim_jumps(jumps, 30, 1).count() == 0 and iv.trim_jumps(jumps, 0, 0).count() == 0 and iv.trim_jumps(jumps, 3, 5).count() == 1


def test_hold_last(spark):
    df = trace(spark, [1, 2, 3, 4, 5, 6])
    spans = spark.createDataFrame([(1, 2, 4)], "cell int, start int, end int")
    assert column(iv.hold_last(df, spans, recording="cell", key="cell"), "held") == [1, 2, 2, 2, 5, 6]
    assert column(iv.hold_last_in_order(df, [(2, 4), (1, 3)], key="cell"), "held") == [1, 1, 1, 2, 5, 6]


def test_stacking(spark):
    rows = [(1, c, i, float(v)) for c, vs in enumerate([(1, 3), (2, 0), (5, 4)]) for i, v in enumerate(vs)]
    out = tr.stacked(spark.createDataFrame(rows, "recording int, cell int, frame int, f double"), recording="recording").orderBy("cell", "frame")
    assert [r["stacked"] for r in out.collect()] == [1, 3, 5, 3, 10, 9]


def test_out_of_focus(spark):
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([100] * 3 + [10] * 2 + [100] * 3 + [10] + [100] * 2)], "recording string, frame int, mean double")
    assert [(r["start"], r["end"]) for r in iv.out_of_focus(df).collect()] == [(3, 5)]


@pytest.mark.parametrize(("second", "n"), [((9, 12), 1), ((11, 14), 2)])
def test_merging(spark, second, n):
    df = spark.createDataFrame([("r", 3, 5), ("r", *second)], "recording string, start int, end int")
    assert iv.merged(df, 5).count() == n


def test_cutoff(spark):
    df = spark.createDataFrame([("r", i, 100.0) for i in range(2000)] + [("s", i, 100.0 if i < 60 else 10.0) for i in range(100)], "recording string, frame int, mean double")
    out = {r["recording"]: r["cutoff"] for r in iv.cutoff_frame(df, window=40).collect()}
    assert out["r"] == 2000 and 55 <= out["s"] <= 65


def test_temporal_bin(spark):
    df = spark.createDataFrame([(1, i, 0, 0, i) for i in range(7)], "recording int, frame int, y int, x int, v int")
    assert column(mv.temporal_bin(df, 3), "v") == [1, 4]


def test_transforms(spark):
    df = spark.createDataFrame([(1, i, [float(v)]) for i, v in enumerate((0, 10, 20))], "recording int, bin int, m array<double>")
    assert [r["m"][0] for r in mv.interpolated_transforms(df, 5).orderBy("frame").collect()] == [0, 5, 10, 15, 20]


def test_leaders_and_orphans(spark):
    peaks = [10, 12, 50, 51, 60, 91, 92, 140]
    df = spark.createDataFrame([("r", i, i, p) for i, p in enumerate(peaks)], "recording string, cell int, seq int, peak int")
    leads = ev.leaders(df, 40)
    assert sorted(r["leader"] for r in leads.collect()) == [10, 51, 92, 140]
    answered = {r["peak"] for r in ev.responses(df, leads, 40).collect()}
    assert set(peaks) - answered == {50, 91}


@pytest.mark.parametrize(("seqs", "skipping", "parts"), [([0, 1, 3], True, 1), ([0, 1, 2], False, 1), ([0, 2], False, 1), ([0, 1, 2, 8, 9], False, 2)])
def test_splitting_and_skipping(spark, seqs, skipping, parts):
    df = spark.createDataFrame([("r", 5, s, s, 5, 0.0) for s in seqs], "recording string, leader int, cell int, seq int, peak int, offset_s double")
    out = ev.classified(ev.split(df)).collect()
    assert len(out) == parts and any(r["skipping"] for r in out) == skipping


def test_participation(spark):
    rows = [("r", e, c, c) for e, cs in ((1, [0]), (2, [0, 1]), (3, [0, 1, 2])) for c in cs]
    parts = spark.createDataFrame([(*r, 0) for r in rows], "recording string, leader int, cell int, seq int, part int")
    peaks = spark.createDataFrame([("r", c, c, e) for _, e, c, _ in rows], "recording string, cell int, seq int, peak int")
    r = next(x for x in ev.participation(peaks, parts).collect() if x["cell"] == 0)
    assert (r["single"], r["multiple"], r["orphan"]) == (1, 1, 1)


def test_small_expressions(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (20.0,), (20.5,), (180.0,), (181.0,)], "d double")
    assert [r[0] for r in df.select(sc.distance_bin("d")).collect()] == [None, 0, 0, 20, 160, None]
    ages = spark.createDataFrame([(6,), (7,), (11,), (12,)], "a int").select(sc.age_group("a")).collect()
    assert [r[0] for r in ages] == ["First week", "Second week", "Second week", "Posthearing"]
    marks = spark.createDataFrame([(None,), (1,), (0,)], "x int")
    assert [r[0] for r in marks.select(sc.kept("x")).collect()] == [True, False, True]
    lists = spark.createDataFrame([("[1, 2.0, \"x\", 3]",), ("7",), ("",), (None,), ("nan",)], "t string").select(sc.peak_positions("t")).collect()
    assert [r[0] for r in lists] == [[1, 2, 3], [7], [], [], []]
    assert spark.range(1).select(sc.local_path("/mnt", F.lit("D:\\a\\b"))).first()[0] == "/mnt/a/b"
    pairs = spark.range(1).select(sc.interval_list(F.lit("[[1, 5], [7, 9]]"))).first()[0]
    assert [(p["start"], p["end"]) for p in pairs] == [(1, 5), (7, 9)]


def test_renumbering(spark):
    out = ro.renumbered(spark.createDataFrame([("a", s) for s in (2, 5, 9)], "g string, s int"), "g", "s").orderBy("s").collect()
    assert [r["new_sequence"] for r in out] == [1, 2, 3] and all(r["changed"] for r in out)


def test_group_mean(spark):
    df = spark.createDataFrame([("control", v) for v in (0.20, 0.23, 0.25)] + [("treated", v) for v in (0.33, 0.36)], "g string, v double")
    assert {r["g"]: round(r["mean"], 6) for r in ro.mean_sd(df, "g", "v").collect()} == {"control": 0.226667, "treated": 0.345}


def test_correlation_is_symmetric_and_bounded(spark):
    rows = [(1, c, i, math.sin(i * (c + 1)) + c) for c in range(4) for i in range(30)]
    out = co.pairs(spark.createDataFrame(rows, "recording int, cell int, frame int, f double")).collect()
    assert len(out) == 6 and all(-1 <= r["r"] <= 1 and r["a"] > r["b"] for r in out)


def test_pixel_correlation_is_the_matrix_mean(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(20, 5))
    df = spark.createDataFrame([(1, p, t, float(x[t, p])) for t in range(20) for p in range(5)], "roi int, pixel int, frame int, v double")
    got = {r["frame"]: r["r"] for r in co.pixel_rolling(df, 4).collect()}
    assert got[10] == pytest.approx(np.corrcoef(x[6:14].T).mean())


def test_components(spark):
    pixels = [(1, 0, 0), (1, 1, 1), (1, 5, 5), (1, 5, 6), (1, 9, 0)]
    df = spark.createDataFrame([(*p, 1) for p in pixels], "recording int, y int, x int, label int")
    from fluxtrace.plans.storage import settle

    out = {(r["y"], r["x"]): r["component"] for r in lb.components(df, settle=settle).collect()}
    assert out == {(0, 0): 1, (1, 1): 1, (5, 5): 2, (5, 6): 2, (9, 0): 3}


def test_widths_of_a_triangle(spark):
    out = pk.detect(trace(spark, [0, 1, 2, 3, 4, 3, 2, 1, 0]), height=None, distance=None, prominence=None).collect()
    assert [(r["peak"], r["prominence"], r["left"], r["right"]) for r in out] == [(4, 4, 2, 6)]


def test_shift_is_found(spark):
    import numpy as np

    a = np.random.default_rng(2).integers(0, 1000, (12, 10))
    b = np.roll(a, (2, -3), axis=(0, 1))
    rows = [(1, t, y, x, int(m[y, x])) for t, m in enumerate((a, b)) for y in range(12) for x in range(10)]
    df = spark.createDataFrame(rows, "recording int, frame int, y int, x int, v int")
    got = {r["frame"]: (r["dy"], r["dx"]) for r in mv.shifts(df, df.where("frame = 0")).collect()}
    assert got == {0: (0, 0), 1: (2, -3)}
