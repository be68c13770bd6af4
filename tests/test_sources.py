"""Readers and writers by round trip."""

import numpy as np
from pyspark.sql import functions as F

from fluxtrace.operators import rollups as ro
from fluxtrace.plans import batch
from fluxtrace.sources import movies, tables


def test_raw_and_tiff(spark, tmp_path):
    spark.dataSource.register(movies.RawMovie)
    spark.dataSource.register(movies.TiffMovie)
    stack = np.random.default_rng(0).integers(0, 65536, (7, 4, 5))
    movies.write_raw(stack, str(tmp_path / "m.raw"))
    movies.write_tiff(stack, str(tmp_path / "m.tif"))
    for kind, options in (("raw_movie", {"path": str(tmp_path / "m.raw"), "width": 5, "height": 4}), ("tiff_movie", {"path": str(tmp_path / "m.tif")})):
        df = spark.read.format(kind).options(**options).load()
        assert {r["frame"]: r["data"] for r in df.collect()} == {i: f.ravel().tolist() for i, f in enumerate(stack)}
        part = spark.read.format(kind).options(start=2, end=4, **options).load()
        assert sorted(r["frame"] for r in part.collect()) == [2, 3]
        odd = spark.read.format(kind).options(channel=1, n_channels=2, **options).load()
        assert {r["frame"]: r["data"] for r in odd.collect()} == {i: f.ravel().tolist() for i, f in enumerate(stack[1::2])}
        px = movies.pixels(df, "r")
        assert px.count() == stack.size and px.where("frame = 3 and y = 2 and x = 4").first()["v"] == stack[3, 2, 4]


def test_csv_and_fallback(spark, tmp_path):
    (tmp_path / "reference.csv").write_text("recording,frame,mean,sd\nr,0,1.5,NaN\nr,1,,2.0\n")
    rows = tables.csv(spark, str(tmp_path / "reference.csv"), "reference").orderBy("frame").collect()
    assert rows[0]["sd"] is None and rows[1]["mean"] is None and rows[1]["sd"] == 2.0
    assert tables.optional(spark, str(tmp_path / "none.csv"), "jump").count() == 0
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    assert tables.load(spark, str(tmp_path / "plain")).count() == 3


def test_xml(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Experiment.xml").write_text('<E><LSM pixelX="1024" pixelY="288" pixelSizeUM="0.72" widthUM="737" heightUM="207" frameRate="27.163"/></E>')
    r = tables.experiment_xml(spark, str(tmp_path / "a" / "Experiment.xml")).first()
    assert (r["width"], r["height"], r["fps"]) == (1024, 288, 27.163) and r["folder"].endswith("/a")


def test_files_and_companions(spark, tmp_path):
    for n in ("x.raw", "x-mc.tif", "y.raw"):
        (tmp_path / n).write_bytes(b"12")
    found = tables.files(spark, str(tmp_path))
    assert found.count() == 3
    pairs = {r["stem"].rsplit("/", 1)[-1]: r["companion"] is not None for r in tables.companions(found, "-mc").collect()}
    assert pairs == {"x": True, "y": False}


def test_long_and_wide(spark):
    wide = spark.createDataFrame([(0, 1.0, float("nan")), (1, 2.0, 3.0)], "Frame int, ROI_1 double, ROI_2 double")
    long = tables.long_traces(wide)
    assert sorted(map(tuple, long.collect())) == [(1, 0, 1.0), (1, 1, 2.0), (2, 1, 3.0)]
    assert tables.wide_traces(long, [1, 2]).orderBy("frame").collect()[1]["ROI_2"] == 3.0


def test_upsert(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "mine")], "k int, v string"), spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    old.write.parquet(str(tmp_path / "old"))
    assert tables.write_new(str(tmp_path / "old"), new, "k", str(tmp_path / "out"))
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "mine", 2: "new"}
    assert not tables.write_new(str(tmp_path / "out"), new, "k", str(tmp_path / "again"))
    assert {r["k"]: r["v"] for r in ro.upsert_new(old, new, "k", override=True).collect()} == {1: "new", 2: "new"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], 0.5)], "recording string, peaks array<int>, f double")
    tables.write_master(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first()["peaks"] == "[1,2]"
    tables.write_traces(df, str(tmp_path / "t"))
    tables.write_traces(df.withColumn("recording", F.lit("b")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_one_after_another(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "frame int, v int")
    assert sorted(r["frame"] for r in tables.one_after_another([a, a]).collect()) == [0, 1, 2, 3]
    one = spark.createDataFrame([(0, 5)], "frame int, v int")
    assert sorted(r["frame"] for r in tables.one_after_another([one, one, one.limit(0), one]).collect()) == [0, 1, 2]


def test_movies_of_other_types_and_ranges(spark, tmp_path):
    spark.dataSource.register(movies.RawMovie)
    stack = np.random.default_rng(1).integers(-128, 128, (9, 3, 4)).astype("i1")
    stack.tofile(tmp_path / "m.raw")
    df = spark.read.format("raw_movie").options(path=str(tmp_path / "m.raw"), width=4, height=3, dtype="int8")
    assert {r["frame"]: r["data"] for r in df.load().collect()} == {i: f.ravel().tolist() for i, f in enumerate(stack)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = df.option("pushdown", "true").load().where("frame >= 2 and frame < 5 and frame <= 3 and w = 4")
        assert sorted(r["frame"] for r in part.collect()) == [2, 3]
        odd = spark.read.format("raw_movie").options(path=str(tmp_path / "m.raw"), width=4, height=3, dtype="int8", channel=1, n_channels=2, pushdown="true").load()
        assert [r["data"] for r in odd.where("frame = 1").collect()] == [stack[3].ravel().tolist()]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_batch_skips_what_is_done_and_keeps_errors(spark, tmp_path):
    rows = [(f"{tmp_path}/in{i}", f"{tmp_path}/out{i}") for i in range(3)]
    recordings, ran = spark.createDataFrame(rows, "input_path string, output_path string"), []

    def step(session, source, target):
        ran.append(source[-1])
        if source.endswith("1") and len(ran) < 4:
            raise OSError("unreadable")
        session.range(5).write.mode("overwrite").parquet(target)
        return 5

    first = {r["input_path"][-1]: r for r in batch.run_all(recordings, step, f"{tmp_path}/log").collect()}
    assert [first[k]["success"] for k in "012"] == [True, False, True] and first["1"]["error_message"] == "OSError: unreadable" and first["0"]["n_frames"] == 5
    assert [r["input_path"][-1] for r in batch.run_all(recordings, step, f"{tmp_path}/log").collect()] == ["1"] and ran == list("0121")
    assert batch.run_all(recordings, step, f"{tmp_path}/log").count() == 0 and batch.log(spark, f"{tmp_path}/log").count() == 4
    assert batch.run_all(recordings, step, f"{tmp_path}/log", override=True).count() == 3


def test_chunks_replace_themselves(spark, tmp_path):
    frames = spark.createDataFrame([("a", i, 1) for i in range(10)], "recording string, frame int, v int")
    batch.write_frames(frames, f"{tmp_path}/m", chunk=4)
    batch.write_frames(frames.where("frame >= 8").withColumn("v", F.lit(2)), f"{tmp_path}/m", chunk=4)
    batch.write_frames(frames.withColumn("recording", F.lit("b")), f"{tmp_path}/m", chunk=4)
    got = spark.read.parquet(f"{tmp_path}/m")
    assert [r["v"] for r in got.where("recording = 'a'").orderBy("frame").collect()] == [1] * 8 + [2, 2] and got.count() == 20
    t = spark.createDataFrame([("a", 0, [1.0])], "recording string, bin int, m array<double>")
    batch.write_provenance(t, {"bin": 3, "kind": "rigid"}, f"{tmp_path}/p")
    batch.write_provenance(t.withColumn("recording", F.lit("b")), {"bin": 4}, f"{tmp_path}/p")
    assert {(r["recording"], r["name"]): r["value"] for r in spark.read.parquet(f"{tmp_path}/p/parameters").collect()} == {("a", "bin"): "3", ("a", "kind"): "rigid", ("b", "bin"): "4"}
    assert spark.read.parquet(f"{tmp_path}/p/transforms").count() == 2


def test_recordings_side_by_side(spark, tmp_path):
    """Three at a time: each waits until all three have begun, which only works side by side; failures stop nothing."""
    import threading

    recordings = spark.createDataFrame([(f"in{i}", f"out{i}") for i in range(6)], "input_path string, output_path string")
    together = threading.Barrier(3, timeout=60)

    def step(session, source, target):
        together.wait()
        if source == "in4":
            raise ValueError("broken")
        return session.range(int(source[-1]) + 1).count()

    got = {r["input_path"]: r for r in batch.run_all(recordings, step, f"{tmp_path}/log", jobs=3).collect()}
    assert {k: r["n_frames"] for k, r in got.items()} == {f"in{i}": None if i == 4 else i + 1 for i in range(6)}
    assert batch.log(spark, f"{tmp_path}/log").count() == 6 and not got["in4"]["success"]
