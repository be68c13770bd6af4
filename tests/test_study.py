"""The two analyses end to end, and streams over several triggers."""

import math

from pyspark.sql import functions as F

from fluxtrace.plans.storage import folder
from fluxtrace.plans.study import build_cells, study_tables
from fluxtrace.streaming import traces as st


def test_from_traces_to_tables(spark):
    bump = lambda i, at: math.exp(-(((i - at) / 4) ** 2))
    rows = [("r", roi, i, 100.0 + 0.3 * math.sin(i * 1.7 + roi) + 60 * (bump(i, 100 + roi) + bump(i, 300 + 2 * roi))) for roi in range(1, 6) for i in range(500)]
    traces = spark.createDataFrame(rows, "recording string, roi int, frame int, f double")
    labels = spark.createDataFrame([("r", roi, 5 * roi + x, roi) for roi in range(1, 6) for x in range(3)], "recording string, y int, x int, label int")
    recordings = spark.createDataFrame([("r", None, 8.0), ("gone", 1, 8.0)], "recording string, discard int, age double")
    kinds = labels.withColumn("label", F.lit(1))
    out = build_cells(recordings, traces, labels, kinds, median_window=200, distance=50)
    cells = {r["roi"]: r for r in out["cells"].collect()}
    assert len(cells) == 5 and all(len(c["peaks"]) == 2 for c in cells.values())
    assert all(abs(c["peaks"][0] - 100 - roi) <= 2 for roi, c in cells.items()) and out["odd"].count() == 0
    tables = study_tables(out["cells"], out["traces"], fps=10.0, window=200)
    assert tables["peaks"].count() == 10
    assert [r["n_cells"] for r in tables["events"].orderBy("leader").collect()] == [5, 5]
    assert all(r["n_events"] == 2 and r["multiple"] == 2 and r["noise_sd"] < 0.1 for r in tables["cells"].collect())
    assert tables["pairs"].count() == 10
    again = build_cells(recordings, traces, labels, kinds, median_window=200, distance=50, old=out["cells"])
    assert again["cells"].count() == 5


def test_streams(spark, tmp_path):
    for i, peaks in enumerate(([10, 12, 50], [51, 60, 91], [92, 140])):
        spark.createDataFrame([("r", p) for p in peaks], "recording string, peak long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    stream = st.samples(spark, str(tmp_path / "in"), like, files_per_trigger=1)
    found = sorted(r["leader"] for r in st.run(st.leaders(stream, 40), folder(spark)).collect())
    assert found[0] == 10 and all(b - a > 40 for a, b in zip(found, found[1:], strict=False))
    for peaks in ([50, 10], [91, 12, 140], [60, 300]):  # out of order
        spark.createDataFrame([("r", p) for p in peaks], "recording string, peak long").coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = st.samples(spark, str(tmp_path / "late"), like, files_per_trigger=1)
    assert sorted(r["leader"] for r in st.run(st.leaders(stream, 40, late=150), folder(spark)).collect()) == [10, 60, 140]
    write = st.upserting(str(tmp_path / "table"), "k")
    write(spark.createDataFrame([(1, "old")], "k int, v string"), 0)
    write(spark.createDataFrame([(1, "new"), (2, "new"), (2, "new")], "k int, v string"), 1)
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {1: "old", 2: "new"}


def test_two_animals_with_the_same_numbers(spark):
    """Constant traces of two animals with one sequence number and one region: nothing is left after detrending either."""
    from fluxtrace.plans.study import concatenated

    rows = [(animal, 1, 1, i, v) for animal, v in (("a", 100.0), ("b", 200.0), (None, 300.0), ("None", 400.0)) for i in range(30)]
    df = spark.createDataFrame(rows, "animal string, seq int, roi int, frame int, f double")
    for how in ({"preprocessing": "rolling_median", "median_window": 10}, {"preprocessing": "rolling_percentile", "percentile_window": 10, "percentile": 0.1}):
        out = concatenated(df, group="animal", sequence="seq", key="roi", fps=20.0, **how)
        assert {abs(r["f"]) for r in out.collect()} == {0.0}


def test_held_frames_go_before_the_frame_that_repeats(spark):
    from fluxtrace.operators import correlation as co

    values = {1: [1, 5, 5, 2, 7], 2: [2, 9, 1, 4, 3], 3: [3, 1, 4, 1, 5]}
    df = spark.createDataFrame([("r", c, i, float(v)) for c, x in values.items() for i, v in enumerate(x)], "recording string, cell int, frame int, f double")
    assert sorted({r["frame"] for r in co.without_held(df).collect()}) == [0, 2, 3, 4]
    got = {(r["a"], r["b"]): r["r"] for r in co.correlations(df, preprocessing=None).collect()}
    assert abs(got[2, 1] + 0.14142) < 1e-3  # of (1, 5, 2, 7) and (2, 1, 4, 3)
    gap = df.where("not (cell = 1 and frame = 1)")  # frames 0 and 2 are no neighbours
    assert co.without_held(gap.withColumn("f", F.when(F.col("cell") == 1, 5.0).otherwise(F.col("f")))).select("frame").distinct().count() == 3


def test_matches_may_start_before_one_found(spark):
    import numpy as np

    from fluxtrace.functions import kernels as k

    profile = np.array([9, 9, 9, 0.4, 0, 9, 9, 9, 9, 3.0])
    assert k.best_matches(profile, 3, 1) == [4, 3] and k.best_matches(profile, 3, 1, apart=True) == [4, 9]


def test_the_reference_trace_is_whole_and_smoothed(spark):
    """A trace that falls for good: it is not cut, the low stretch is an interval, mean and deviation are smoothed; boxes of two grids."""
    from fluxtrace.operators import movie as mv
    from fluxtrace.plans.reference import reference_traces

    rows = [("r", t, y, x, int((100 if t < 60 else 40) + 10 * ((y + x) % 2) + (t % 3))) for t in range(80) for y in range(8) for x in range(8)]
    movie = spark.createDataFrame(rows, "recording string, frame int, y int, x int, v int")
    out = reference_traces(movie, grid=[2, (1, 4)], overlap=0.0, smooth=3)
    trace = out["trace"].orderBy("frame").collect()
    assert [r["frame"] for r in trace] == list(range(80)) and out["cutoff"].first()["cutoff"] < 70
    assert [(r["start"], r["end"]) for r in out["intervals"].collect()] == [(60, 80)]
    assert abs(trace[10]["mean"] - 106.0) < 1e-9 and abs(trace[10]["sd"] - 5.0) < 1e-9
    assert mv.many_grids(movie, [2, (1, 4)]).count() == 8 and {r["roi"] for r in mv.many_grids(movie, [2, (1, 4)]).collect()} == set(range(8))


def test_a_type_is_the_median_of_all_pixels(spark):
    from fluxtrace.operators import labels as lb

    points = spark.createDataFrame([("r", 0, x, 1) for x in range(10)] + [("r", 5, x, 2) for x in range(10)], "recording string, y int, x int, label int")
    marks = spark.createDataFrame([("r", 0, x, 1) for x in range(3)] + [("r", 5, x, 1) for x in range(6)], points.schema)
    cells = spark.createDataFrame([("r", 50, 50, 1)], points.schema)
    assert {r["label"]: r["cell"] for r in lb.overlap_assignment(points, cells, annotation=marks).collect()} == {1: 0, 2: 666}


def test_events_hold_amplitudes(spark):
    from fluxtrace.operators import events as ev
    from fluxtrace.operators import peaks as pk

    traces = spark.createDataFrame([(c, i, float(c * i)) for c in (1, 2) for i in range(40)], "cell int, frame int, f double")
    peaks = spark.createDataFrame([("r", 1, 0, 20), ("r", 2, 1, 22), ("r", 3, 2, 90)], "recording string, cell int, seq long, peak int")
    found = ev.responses(peaks, ev.leaders(peaks, 10), 10)
    got = {r["leader"]: r for r in ev.events(found, peaks, amplitudes=pk.mean_around(found, traces, 2)).collect()}
    assert got[20]["amplitudes"] == [19.5, 43.0] and got[20]["max_amplitude"] == 43.0 and abs(got[20]["share_responding"] - 2 / 3) < 1e-12
    assert got[90]["amplitudes"] == [None]
