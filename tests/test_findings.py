"""Queries against their SQL on small tables made to hold what the given ones rarely do: flat tops, halves, many cells of a recording."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from fluxtrace.functions import kernels
from fluxtrace.operators import correlation as co
from fluxtrace.operators import movie as mv
from fluxtrace.operators import peaks as pk
from fluxtrace.operators import volumes as vo
from fluxtrace.operators.traces import each_trace
from fluxtrace.plans import QUERIES, SQL
from fluxtrace.plans.registry import r6, r6_plain

START = dt.datetime(2024, 1, 1)


def _events(folder, traces: dict[int, list[float]]) -> str:
    rows = [(START + dt.timedelta(minutes=i), user, v) for user, values in traces.items() for i, v in enumerate(values)]
    df = pd.DataFrame([(k, ts, user, "view", v, '{"k": 1}') for k, (ts, user, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM df) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def _same(spark, folder, name: str, table: str = "events") -> list[tuple]:
    """Row for row and digit for digit."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, folder).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(tuple, df.astype(object).where(df.notna(), None).to_numpy().tolist()), key=repr)
    assert rows(got) == rows(want)
    return rows(got)


@pytest.mark.parametrize(("name", "peaks"), [("peak_widths", 3), ("peaks_spaced_wide", 2)])
def test_flat_tops_are_no_peaks_of_the_width_queries(spark, tmp_path, name, peaks):
    wave = [0.0, 60.0, 60.0, 5.0, 40.0, 90.0, 30.0, 2.0, 50.0, 50.0, 50.0, 1.0, 70.0, 0.0, *[0.0] * 10, 30.0, 45.0, 44.0, 0.0]
    assert len(_same(spark, _events(tmp_path, {4: wave}), name)) == peaks


@pytest.mark.parametrize("cells", [3, 4096])
def test_pairs_of_blocks_are_those_of_a_join(spark, monkeypatch, cells):
    """Missing, doubled, constant and not finite samples, pairs with one joint sample, an offset that swamps the spread, no keys."""
    monkeypatch.setattr(co, "CELLS", cells)
    rng = np.random.default_rng(3)
    wave = lambda k, n: [(k, f, float(v)) for f, v in enumerate(rng.normal(size=n))]
    rows = [(r, *x) for r in (1, 2, None) for k in ("a", "b", "c", "d", "e", "f", "é") for x in wave(k, 12) if rng.random() < 0.8]
    rows += [(1, "flat", f, 0.1) for f in range(12)] + [(1, "step", f, 1e9 if f else 0.25) for f in range(12)] + [(1, "late", f, 1e7 + v) for _, f, v in wave("", 12)]
    rows += [(2, "one", 3, 1.0), (2, "a", 2, 7.0), (2, "nan", 1, float("nan")), (2, "nan", 2, 1.0), (2, "nan", 5, 3.0), (2, None, 1, 1.0), (1, "none", 4, None)]
    df = spark.createDataFrame(rows, "recording int, cell string, frame int, f double")
    cells = {}
    for r, c, f, v in rows:
        if None not in (r, c, v):
            cells.setdefault((r, c), []).append((f, v))
    want = {}
    for (r, a), x in cells.items():
        for b, y in [(b, y) for (q, b), y in cells.items() if q == r and b < a]:
            joint = [(u, w) for f, u in x for g, w in y if f == g]
            if joint:
                p, q = np.array(joint).T
                flat = len(p) < 2 or p.min() == p.max() or q.min() == q.max()
                want[r, a, b] = len(p), np.nan if flat else np.corrcoef(p, q)[0, 1]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in co.pairs(df).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert {k: r for k, (_, r) in got.items()} == pytest.approx({k: r for k, (_, r) in want.items()}, abs=1e-8, nan_ok=True)
    assert {r for n, r in (tuple(r)[3:] for r in co.pairs(df, least=13).collect())} == {None}


@pytest.mark.parametrize("cells", [3, 4096])
def test_pairs_of_whole_traces(spark, monkeypatch, cells):
    monkeypatch.setattr(co, "CELLS", cells)
    x = np.random.default_rng(5).normal(size=(9, 6))
    x[4] = 2.5
    df = spark.createDataFrame([(1, c, f, float(v)) for c, row in enumerate(x) for f, v in enumerate(row)], "recording int, cell int, frame int, f double")
    got = {(r["a"], r["b"]): r["r"] for r in co.pairs(df).collect()}
    want = {(a, b): np.nan if 4 in (a, b) else np.corrcoef(x[a], x[b])[0, 1] for a in range(9) for b in range(a)}
    assert got == pytest.approx(want, abs=1e-12, nan_ok=True)


def test_traces_are_shuffled_a_constant_number_of_times(spark):
    sizes = spark.createDataFrame([(5_000, 64), (30_000, 64), (72_000, 64), (150_000, 64), (1_000_000, 64), (300, 100_000)], "n long, samples long")
    assert [r[0] for r in sizes.select(co.blocks(F.col("n"), F.col("samples"))).collect()] == [2, 6, 6, 6, 31, 15]


def test_pairs_of_blocks_are_not_merged_by_their_bytes(spark):
    df = spark.createDataFrame([(r, c, f, float(c * f)) for r in range(3) for c in range(4) for f in range(3)], "recording int, cell int, frame int, f double")
    assert co.pairs(df).rdd.getNumPartitions() >= co.PARTS


@pytest.mark.parametrize("name", ["pair_correlation", "pair_correlation_minperiods", "pair_correlation_moving", "pair_correlation_detrended", "pair_correlation_highpass"])
def test_pairs_are_rounded_by_plain_arithmetic(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "rint(" in plan


def test_plain_rounding_is_the_same(spark):
    rng = np.random.default_rng(6)
    halves = [(k + 0.5) / 1e6 for k in range(-40, 40)] + [-1e-6 * (k + 0.5) for k in range(900, 999)]
    values = [None, 0.0, -0.0, float("nan"), float("inf"), 1.0, -1.0, 0.4999999999999999e-6, 5e-7, -5e-7, 1.5e-6, 2.5e-6, 1e300, 0.1234565, -0.1234565, *halves, *rng.uniform(-1, 1, 3000).tolist()]
    values += np.nextafter(halves, 9).tolist() + np.nextafter(halves, -9).tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [repr(a) for a, b in df.select(r6("x"), r6_plain("x")).collect()] == [repr(b) for a, b in df.select(r6("x"), r6_plain("x")).collect()]


def test_places_come_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(co, "CELLS", 2)
    df = spark.createDataFrame([(1, c, f, float((c * 7 + f * f) % 5)) for c in range(6) for f in range(8)], "recording int, cell int, frame int, f double")
    at = spark.createDataFrame([(1, c, c // 2, 3.0 * c, None if c == 4 else 4.0 * c) for c in range(5)], "recording int, cell int, seq int, x double, y double")
    got = {(r["a"], r["b"]): (r["cell_distance"], r["um_distance"]) for r in co.with_distances(df, at).collect()}
    assert got == {(a, b): (abs(a // 2 - b // 2), None if 4 in (a, b) else 5.0 * (a - b)) for a in range(5) for b in range(a)}


def test_short_windows_need_no_python_for_each_trace(spark):
    df = spark.createDataFrame([("m", 1, c, f, float((c + f * f) % 7)) for c in range(3) for f in range(30)], "animal string, recording int, cell int, frame int, f double")
    plan = lambda window: co.prepared(df, "rolling_median", median_window=window, recording=["animal", "recording"])._jdf.queryExecution().toString()
    assert "InPandas" not in plan(10) and "InPandas" in plan(2000)


def test_means_around_peaks_do_not_depend_on_the_order_of_sums(spark):
    import math

    values = [0.1, 52.37, 33.33, 17.71, 90.02, 16.47, 0.3, 75.94]
    peaks = spark.createDataFrame([(1, 4)], "cell int, peak int")
    for rows in (list(enumerate(values)), list(enumerate(values))[::-1]):
        df = spark.createDataFrame([(1, f, v) for f, v in rows], "cell int, frame int, f double")
        assert pk.mean_around(peaks, df, 4).collect()[0]["mean"] == math.fsum(values) / 8


def test_traces_longer_than_a_batch_are_whole(spark):
    df = spark.createDataFrame(pd.DataFrame({"cell": np.repeat([3, 1, 2], [25_000, 4, 12_000]), "frame": np.r_[0:25_000, 0:4, 0:12_000]})).withColumn("f", F.col("frame") % 5 + 0.0)
    out = each_trace(df, lambda at, x: {"n": np.array([len(at)]), "total": np.array([x.sum()])}, "n long, total double", "frame", "f")
    assert sorted(map(tuple, out.collect())) == [(1, 4, 6.0), (2, 12_000, 24_000.0), (3, 25_000, 50_000.0)]


@pytest.mark.parametrize("name", ["study_cells", "study_events"])
@pytest.mark.parametrize("shift", [0, 3 * 10**11])
def test_last_bits_make_no_slope_of_a_flat_top(spark, tmp_path, name, shift):
    """Frames 27 and 28 of user 205's score are means of equal values in another order. Shifted users have rows beyond 32 bits."""
    levels = {5: "007103173632004123951446163751a2002037599497256378327593a02007235213991a30372", 205: "9991a721699611a6270005393a5a8868262276221607a23a3842342a4189808784373"}
    assert _same(spark, _events(tmp_path, {shift + user: [100.0 + 7 * int(c, 16) for c in text] for user, text in levels.items()}), name)


def test_means_around_peaks_at_a_half_go_up(spark, tmp_path):
    """The mean around user 20's peak at frame 15 is 2.0171875; sums of rounded quotients fall below it."""
    levels = "39 180 62 54 15 49 113 53 20 216 177 40 202 33 84 51 2 159 291 63 73 155 34 54 30 69 3 46 15 274 33 8 20 37 7 83 134 78 56 10 71 0 256 1 39 32 296 19 112 37 81 167 3 320 208 5 33 90 41 85 15 41 91 28 67 44 95 112 81 89 11 1 40"
    rows = _same(spark, _events(tmp_path, {20: [round(0.64 * int(k), 2) for k in levels.split()]}), "study_events")
    assert (0, 15, 1, 0, 1, 2.017188) in rows


def _volume(spark, recordings=("a", "b")):
    rng = np.random.default_rng(4)
    rows = [(r, f, y, x, float(rng.integers(0, 90))) for r in recordings for f in range(4) for y in range(-3, 6) for x in range(7) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "recording string, frame int, y int, x int, v double")


def test_thresholds_take_no_window_over_pixels(spark, monkeypatch):
    df = _volume(spark, ("a", "b", None))
    plans = [mv.otsu_threshold(df), vo.otsu_of_volume(df)]
    for out in plans:
        assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString().rsplit("Window", 1)[1]
    rows = lambda out: {(r["recording"], r["frame"]): r["threshold"] for r in out.collect()}
    few = rows(plans[0])
    assert len(few) == 12 and (None, 0) in few
    monkeypatch.setattr(mv, "FEW", 2)
    assert rows(mv.otsu_threshold(df)) == few


def test_seeds_are_numbered_without_a_window_over_a_recording(spark):
    df = _volume(spark)
    out = vo.numbered(df)
    got = {r["recording"]: [] for r in out.collect()}
    for r in out.collect():
        got[r["recording"]].append((r["label"], r["frame"], r["y"], r["x"]))
    for recording, numbers in got.items():
        places = sorted((r["frame"], r["y"], r["x"]) for r in df.where(F.col("recording") == recording).collect())
        assert sorted(numbers) == [(k + 1, *p) for k, p in enumerate(places)]
    line = vo.numbered(df.where("frame = 0 and y = 0").select("recording", "x"), axes=("x",)).where("recording = 'a'")
    assert sorted(r["label"] for r in line.collect()) == list(range(1, line.count() + 1))


def test_the_filter_needs_no_call_for_each_trace(spark):
    """Traces of two recordings that share a cell, one longer than a batch, one with gaps, one too short to filter, a missing key."""
    rng = np.random.default_rng(8)
    rows = [(r, c, f, None if c == 2 and f % 11 == 9 else float(v)) for r, c, n in ((1, 1, 25_000), (1, 2, 60), (2, 1, 40), (2, 3, 4), (2, None, 30)) for f, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "recording int, cell int, frame int, f double").repartition(7)
    out = pk.highpass(df, fps=20.0, cutoff_hz=0.5, key=["recording", "cell"])
    assert out.columns == [*df.columns, "filtered"] and "InPandas" not in out._jdf.queryExecution().toString()
    got, want = {}, {}
    for r, c, f, v, y in out.collect():
        got.setdefault((r, c), {})[f] = y
    for r, c, f, v in rows:
        want.setdefault((r, c), []).append(np.nan if v is None else v)
    assert set(got) == set(want)
    for k, x in want.items():
        y = kernels.highpass(np.array(x), 20.0, 0.5, 3)
        assert [got[k][f] for f in range(len(x))] == [None if np.isnan(v) else v for v in y]
