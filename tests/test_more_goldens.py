"""Further small inputs: edits, paths, shapes, matching, metadata."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxtrace.functions import scalars as sc
from fluxtrace.operators import intervals as iv
from fluxtrace.operators import labels as lb
from fluxtrace.operators import movie as mv
from fluxtrace.operators import peaks as pk
from fluxtrace.operators import rollups as ro
from fluxtrace.plans.storage import settle
from fluxtrace.sources import tables


def test_interval_edits(spark):
    df = spark.range(1).select(sc.interval_list(F.lit("[[1, 5]]")).alias("i"))
    df = df.withColumn("i", sc.with_interval("i", 7, 9))
    assert [tuple(x) for x in df.first()["i"]] == [(1, 5), (7, 9)]
    once = df.withColumn("i", sc.without_last("i"))
    assert [tuple(x) for x in once.first()["i"]] == [(1, 5)]
    assert once.withColumn("i", sc.without_last("i")).withColumn("i", sc.without_last("i")).first()["i"] == []


def test_local_root(spark, tmp_path):
    (tmp_path / "b" / "x").mkdir(parents=True)
    folders = spark.createDataFrame([("D:\\x",)], "folder string")
    assert tables.local_root(folders, [str(tmp_path / "a"), str(tmp_path / "b")]) == str(tmp_path / "b")
    assert tables.local_root(folders, [str(tmp_path / "a")]) is None


def test_metadata(spark):
    sheet = spark.createDataFrame([("a", None, 10, None, None, 5.0, 50, None), ("b", 1, None, None, None, None, None, None)], "folder string, height int, width int, um_width double, um_per_pixel double, fps double, frames int, seconds double")
    found = spark.createDataFrame([("a", 3, 99, 20.0)], "folder string, height int, width int, um_width double")
    r = {x["folder"]: x for x in sc.fill_metadata(sheet, found).collect()}
    assert (r["a"]["height"], r["a"]["width"], r["a"]["um_per_pixel"], r["a"]["seconds"]) == (3, 10, 2.0, 10.0)
    assert r["b"]["height"] == 1 and r["b"]["seconds"] is None


def test_sql_functions(spark):
    sc.register(spark)
    r = spark.sql("SELECT fisher_r(fisher_z(0.5D)) AS r, age_group(8.0D) AS g").first()
    assert r["r"] == pytest.approx(0.5) and r["g"] == "Second week"


def test_models_by_rate(spark):
    df = spark.createDataFrame([(27.163,), (30.0,)], "fps double")
    assert [r[0] for r in df.select(sc.model_for_rate("fps", {27.163: "m27", 94.422: "m94"})).collect()] == ["m27", None]


def test_shapes_in_pairs(spark):
    rows = [(1, i, k, y, x) for i, k, box in ((0, "rectangle", (0, 0)), (1, "ellipse", (1, 1)), (2, "rectangle", (9, 9)), (3, "ellipse", (50, 50))) for y, x in (box, (box[0] + 2, box[1] + 2))]
    df = spark.createDataFrame(rows, "recording int, index int, kind string, y int, x int")
    assert [(r["event"], r["first"], r["second"]) for r in lb.polygon_pairs(df).collect()] == [(0, 0, 1)]
    shapes = df.select("recording", "index", F.col("kind").alias("shape_type"), F.col("y").cast("double").alias("axis0"), F.col("x").cast("double").alias("axis1"))
    r = mv.kymo_events(shapes, fps=10.0, um_per_pixel=0.5).orderBy("index").collect()[3]
    assert (r["kind"], r["extent_um"], r["start_s"]) == ("GER", 1.0, 5.0)


def test_matching_mask_or_regions(spark):
    labels = spark.createDataFrame([(1, 0, 5, 3), (1, 0, 6, 3), (1, 0, 0, 4), (2, 0, 0, 1)], "recording int, y int, x int, label int")
    matching = spark.createDataFrame([(2, 7, 7, 9)], "recording int, y int, x int, label int")
    out = {(r["recording"], r["y"], r["x"]): r["label"] for r in lb.cells_to_match(labels, matching, labels.withColumn("label", F.lit(1)), settle=settle).collect()}
    assert out == {(2, 7, 7): 9, (1, 0, 0): 1, (1, 0, 5): 2, (1, 0, 6): 2}


def test_stacked_images(spark):
    labels = spark.createDataFrame([("m", 1, 0, 0, 1), ("m", 2, 0, 0, 1)], "g string, s int, y int, x int, label int")
    sizes = spark.createDataFrame([("m", 1, 10), ("m", 2, 12)], "g string, s int, height int")
    assert sorted(r["stacked_y"] for r in lb.stacked_images(labels, sizes, group="g", sequence="s").collect()) == [0, 10]


def test_peak_edits_last_one_counts(spark):
    peaks = spark.createDataFrame([("a", [3, 9]), ("b", None)], "cell string, positions array<int>")
    log = spark.createDataFrame([("a", 1, "remove", 3), ("a", 2, "add", 3), ("a", 3, "remove", 9), ("a", 4, "add", 5)], "cell string, at int, action string, position int")
    assert {r["cell"]: r["positions"] for r in pk.edit(peaks, log).collect()} == {"a": [3, 5], "b": []}


def test_sampling_is_the_same_again(spark):
    a, b = (sorted(r["id"] for r in ro.sampled(spark.range(100).repartition(n), "id", 5, seed=1).collect()) for n in (1, 7))
    assert a == b and len(a) == 5


def corners(spark, height, width):
    return spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, height - 1, width - 1, 1)], "recording int, frame int, y int, x int, v int")


def test_grid(spark):
    boxes = lambda *how: [tuple(r)[2:] for r in mv.grid_rois(*how).orderBy("roi").collect()]
    plain = boxes(corners(spark, 100, 80), 4)
    assert len(plain) == 16 and plain[:2] == [(0, 0, 25, 20), (0, 20, 25, 40)] and {(c - a, d - b) for a, b, c, d in plain} == {(25, 20)}
    both = boxes(corners(spark, 100, 80), 4, 0.5)
    assert both[:16] == plain and len(both) == 25 and both[16] == (12, 10, 37, 30)
    assert boxes(corners(spark, 10, 7), (3, 2)) == [(0, 0, 3, 3), (0, 3, 3, 7), (3, 0, 6, 3), (3, 3, 6, 7), (6, 0, 10, 3), (6, 3, 10, 7)]


def test_intensity_offset_is_taken_off(spark):
    rows = [(1, t, y, x, 100 + 10 * y + x) for t in range(3) for y in range(10) for x in range(10)]
    original = spark.createDataFrame(rows, "recording int, frame int, y int, x int, v int")
    # Seven brighter in the middle, dark where the correction left a border.
    corrected = original.withColumn("v", F.when(F.col("y") < 2, 0).otherwise(F.col("v") + 7))
    off = mv.intensity_offset(original, corrected)
    assert off.collect()[0]["offset"] == 7.0
    back = mv.minus_offset(corrected, off)
    assert back.where("y >= 2").exceptAll(original.where("y >= 2")).count() == 0 and back.agg(F.min("v")).first()[0] == 0
    assert mv.intensity_offset(original, original.withColumn("v", F.col("v") + 0.5)).collect()[0]["offset"] == 0.0


def test_cutoff_baseline_is_the_first_thousand_frames(spark):
    values = [200.0] * 30 + [100.0] * 1470 + [50.0] * 500
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "recording string, frame int, mean double")
    found = iv.cutoff_frame(df, window=20).collect()
    assert len(found) == 1 and 1490 <= found[0]["cutoff"] <= 1500


def test_nearest_of_scattered_points(spark):
    rng = np.random.default_rng(2)
    points = [(g, i, *map(float, rng.uniform(-50, 50, 2) if i % 5 else rng.uniform(-900, 900, 2))) for g in (1, 2, 3) for i in range(60)]
    targets = [(g, i, *map(float, rng.uniform(-60, 60, 2))) for g in (1, 2) for i in range(25)] + [(1, 25, 500.0, 500.0), (1, 26, 500.0, 500.0)]
    p, t = (spark.createDataFrame(x, "recording int, label int, cy double, cx double") for x in (points, targets))
    got = {(r["recording"], r["label"]): (r["target"], r["distance"]) for r in lb.nearest(p, t, settle=settle).collect()}
    want = {(g, i): min((np.hypot(y - ty, x - tx), k) for h, k, ty, tx in targets if h == g) for g, i, y, x in points if g < 3}
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][0]) < 1e-9 for k in want)
    assert lb.nearest(p, t.limit(0), settle=settle).count() == 0 and lb.nearest(p.limit(0), t, settle=settle).count() == 0


def test_shifts_by_the_definition_of_the_transform(spark, data):
    from fluxtrace.plans import registry

    m = registry.movie(spark, data)
    rows, ref = m.collect(), {(r["y"], r["x"]): r["v"] for r in mv.reference_image(m, 1).collect()}
    h, w = (max(max(r[a] for r in rows), max(k[i] for k in ref)) + 1 for i, a in enumerate("yx"))

    def transform(image, sign=-1):
        a, b = (np.exp(sign * 2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n) for n in (h, w))
        return a @ image @ b

    def image(points):
        out = np.zeros((h, w))
        for (y, x), v in points.items():
            out[y, x] = v
        return out

    got = {r["frame"]: (r["dy"], r["dx"]) for r in mv.shifts(m, mv.reference_image(m, 1)).collect()}
    for frame in {r["frame"] for r in rows}:
        cross = transform(image({(r["y"], r["x"]): r["v"] for r in rows if r["frame"] == frame})) * np.conj(transform(image(ref)))
        peak = np.abs(transform(cross / np.maximum(np.abs(cross), 1e-12), 1))
        dy, dx = got[frame]
        assert peak[dy % h, dx % w] >= peak.max() * (1 - 1e-9)


@pytest.mark.parametrize("how", ["none", "rolling_median", "highpass", "rolling_percentile", "global"])
def test_correlation_after_each_way_to_take_trends_off(spark, how):
    from fluxtrace.functions import kernels
    from fluxtrace.operators import correlation as co

    rng = np.random.default_rng(6)
    x = rng.normal(size=(3, 200)).cumsum(axis=1)
    x[1, 50] = x[1, 49]  # held: the frame goes for all
    df = spark.createDataFrame([(1, c, t, float(v)) for c in range(3) for t, v in enumerate(x[c])], "recording int, cell int, frame int, f double")
    name = "highpass" if how == "global" else how
    got = {(r["a"], r["b"]): r["r"] for r in co.correlations(df, preprocessing=name, fps=2.0, median_window=15, percentile_window=40, regress_global=how == "global").collect()}
    frame = pd.DataFrame(x.T)
    if how == "rolling_median":
        frame = frame - frame.rolling(15, min_periods=1).median()
    elif how == "rolling_percentile":
        frame = frame - frame.rolling(40, min_periods=10, center=True).quantile(0.1).interpolate(limit_direction="both")
    elif name == "highpass":
        frame = pd.DataFrame({c: kernels.highpass(x[c], 2.0) for c in range(3)})
        if how == "global":
            g = frame.mean(axis=1)
            frame = frame - np.outer(g, [np.polyfit(g, frame[c], 1)[0] for c in range(3)]) - [np.polyfit(g, frame[c], 1)[1] for c in range(3)]
    want = frame[~(frame.diff().shift(-1) == 0).any(axis=1)].corr()  # the frame before one that repeats it goes
    assert set(got) == {(1, 0), (2, 0), (2, 1)} and all(abs(r - want.loc[a, b]) < 1e-6 for (a, b), r in got.items())
    with pytest.raises(ValueError):
        co.correlations(df, preprocessing="other")


def test_constant_frames_keep_one_region(spark):
    df = spark.createDataFrame([(1, 0, y, x, 200 if (y - 5) ** 2 + (x - 5) ** 2 <= 4 else 10) for y in range(12) for x in range(12)], "recording int, frame int, y int, x int, v int")
    out = mv.seeded_regions(df, sigma=1.0, settle=settle).collect()
    assert {r["label"] for r in out} == {1} and (5, 5) in {(r["y"], r["x"]) for r in out}


def test_pixel_rolling_corr_reads_whole_traces(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(cell * 1000 + t, cell, float(v)) for cell in (1, 2, 11, 12, 21, 22, 31) for t, v in enumerate(rng.normal(size=50 if cell == 31 else 70).round(3))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    events.selectExpr("event_id", "user_id", "value", "'view' AS event_type", "timestamp_seconds(event_id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    from fluxtrace.plans import QUERIES

    got = {(r["roi"], r["frame"]): r["r"] for r in QUERIES["pixel_rolling_corr"](spark, str(tmp_path)).collect()}
    x = {c: np.array([v for _, cell, v in rows if cell == c]) for c in (1, 2, 11, 12, 21, 22, 31)}
    want = {}
    for roi in (1, 2):
        for j in range(6, 64):
            parts = [v[j - 6 : j + 6] for c, v in x.items() if c % 10 == roi]
            want[roi, j] = np.corrcoef(parts).mean() if all(len(p) == 12 for p in parts) else None
    assert set(got) == set(want) and any(j > 40 and r is not None for (_, j), r in got.items())
    for k, r in want.items():
        assert got[k] is None if r is None else abs(got[k] - r) < 2e-6
