"""Volumes in tiles and chunks against whole-array brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxtrace.functions import grids
from fluxtrace.operators import correlation as co
from fluxtrace.operators import graphs
from fluxtrace.operators import labels as lb
from fluxtrace.operators import movie as mv
from fluxtrace.operators import volumes as vo
from fluxtrace.plans.storage import folder, settle
from fluxtrace.streaming import traces as st_traces
from fluxtrace.streaming import volumes as sv

PLACE = "recording string, frame int, y int, x int"


def flooded(places, label=lambda p: 1, reach=1):
    """Regions by flood fill, numbered in order of their first place."""
    out, n = {}, 0
    steps = [d for d in itertools.product(range(-reach, reach + 1), repeat=len(next(iter(places), (0,)))) if any(d)]
    for p in sorted(places):
        if p not in out:
            n += 1
            out[p], todo = n, [p]
            while todo:
                q = todo.pop()
                for d in steps:
                    r = tuple(a + b for a, b in zip(q, d))
                    if r in places and r not in out and label(r) == label(q):
                        out[r] = n
                        todo.append(r)
    return out


def table(spark, places, **more):
    names = "".join(f", {k} int" for k in more)
    return spark.createDataFrame([("r", *p, *[f(p) for f in more.values()]) for p in places], PLACE + names)


@pytest.mark.parametrize("shape", ["chain", "star", "many"])
def test_roots(spark, shape):
    rng = random.Random(4)
    edges = {"chain": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(100)], "many": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]}[shape]
    out, rounds = graphs.roots(spark.createDataFrame(edges + [(7, 7)], "a int, b int"), settle)
    at = {r["node"]: r["root"] for r in out.collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {}
    for k in near:
        if k not in want:
            todo = [k]
            while todo:
                q = todo.pop()
                if q not in want:
                    want[q] = k
                    todo += near[q]
    assert {k for k in at if k in near or k != 7} == set(near) and rounds <= 14
    for a, b in itertools.combinations(sorted(near), 2):
        assert (at[a] == at[b]) == (want[a] == want[b])


def test_components_over_tiles(spark):
    rng = random.Random(2)
    places = {(f, y, x) for f in range(9) for y in range(14) for x in range(11) if rng.random() < 0.22} | {(-3, -2, -1), (-4, -2, -1)}
    label = lambda p: (p[0] * 7 + p[1] // 3 + p[2] // 4) % 3
    for side, reach, kind in ((4, 1, lambda p: 1), (3, 1, label), (5, 2, label), (64, 1, label)):
        out = vo.components(table(spark, places, label=kind), settle=settle, side=side, reach=reach).collect()
        assert {(r["frame"], r["y"], r["x"]): r["component"] for r in out} == flooded(places, kind, reach)


def test_a_spiral_over_a_hundred_tiles(spark):
    n, places = 60, set()
    low, high, y, x, d = 0, n - 1, 0, 0, 0
    bounds, steps = [0, n - 1, n - 1, 0], [(0, 1), (1, 0), (0, -1), (-1, 0)]  # right, down, left, up
    path, limits = [(0, 0)], {"right": n - 1, "down": n - 1, "left": 0, "up": 2}
    for turn in range(40):
        way = ("right", "down", "left", "up")[turn % 4]
        dy, dx = steps[turn % 4]
        end = limits[way]
        if {"right": x >= end, "down": y >= end, "left": x <= end, "up": y <= end}[way]:
            break
        while {"right": x < end, "down": y < end, "left": x > end, "up": y > end}[way]:
            y, x = y + dy, x + dx
            path.append((y, x))
        limits[way] += {"right": -2, "down": -2, "left": 2, "up": 2}[way]
    places = set(path)
    df = spark.createDataFrame([("r", y, x, 1) for y, x in places], "recording string, y int, x int, label int")
    out = lb.components(df, side=6, settle=settle)
    assert len(places) > 1000 and out.count() == len(places) and {r["component"] for r in out.collect()} == {1}


def test_growth_over_tiles(spark):
    rng = random.Random(8)
    mask = {(f, y, x) for f in range(5) for y in range(17) for x in range(13) if rng.random() < 0.45}
    seeds = {p: k + 1 for k, p in enumerate(sorted(rng.sample(sorted(mask), 9)))}
    best = {p: (0, k) for p, k in seeds.items()}
    while True:
        new = dict(best)
        for p, (d, k) in best.items():
            for s in itertools.product((-1, 0, 1), repeat=3):
                q = tuple(a + b for a, b in zip(p, s))
                if q in mask and (d + 1, k) < new.get(q, (9**9, 0)):
                    new[q] = (d + 1, k)
        if new == best:
            break
        best = new
    for side in (3, 64):
        out = vo.growing(table(spark, mask), table(spark, seeds, label=lambda p: seeds[p]), settle=settle, side=side).collect()
        assert {(r["frame"], r["y"], r["x"]): (r["distance"], r["label"]) for r in out} == best
    assert max(d for d, _ in best.values()) > 5


@pytest.mark.parametrize("radius", [0.5, 1.0, 2.5])
def test_expansion_by_all_pairs(spark, radius):
    rng = random.Random(3)
    places = {(f, y, x): rng.randint(1, 4) for f in range(4) for y in range(9) for x in range(9) if rng.random() < 0.06}
    out = vo.expanded(table(spark, places, label=lambda p: places[p]), radius, side=4).collect()
    want = {}
    for p in itertools.product(range(-3, 8), range(-3, 13), range(-3, 13)):
        d, label = min((sum((a - b) ** 2 for a, b in zip(p, q)), k) for q, k in places.items())
        if d <= radius * radius:
            want[p] = label
    assert {(r["frame"], r["y"], r["x"]): r["label"] for r in out} == want
    joined = vo.merged(table(spark, places, label=lambda p: places[p]), radius, settle=settle, side=4).collect()
    assert {(r["frame"], r["y"], r["x"]): r["label"] for r in joined} == flooded(set(want))


def test_seeds_of_a_volume(spark):
    """Two blobs in time: each place goes to its own, although both are one region above the threshold."""
    f, y, x = np.mgrid[:12, :16, :16]
    v = 100 * np.exp(-((f - 3) ** 2 + (y - 5) ** 2 + (x - 5) ** 2) / 8) + 90 * np.exp(-((f - 8) ** 2 + (y - 9) ** 2 + (x - 9) ** 2) / 8)
    rows = [("r", *map(int, p), float(v[p])) for p in np.ndindex(v.shape)]
    df = spark.createDataFrame(rows, PLACE + ", v double")
    out = {(r["frame"], r["y"], r["x"]): r["label"] for r in vo.seeded(df, spot_sigma=1.0, outline_sigma=0.5, side=5, settle=settle).collect()}
    assert set(out.values()) == {1, 2} and out[3, 5, 5] == 1 and out[8, 9, 9] == 2 and len(out) > 100
    steps = lambda p, q: max(abs(a - b) for a, b in zip(p, q))
    for p, k in out.items():  # the mask is all of both blobs, so the fewest steps lead straight to a seed
        a, b = steps(p, (3, 5, 5)), steps(p, (8, 9, 9))
        assert a == b or k == 1 + (a > b)


def test_tops_of_a_sparse_volume(spark):
    rng = random.Random(6)
    v = {(f, y, x): float(rng.randrange(60)) for f in range(5) for y in range(9) for x in range(8) if rng.random() < 0.5}
    df = spark.createDataFrame([("r", *p, a) for p, a in v.items()], PLACE + ", v double")
    for span, side in ((1, 64), (2, 3)):
        want = {p for p, a in v.items() if a >= max(b for q, b in v.items() if max(abs(i - j) for i, j in zip(p, q)) <= span)}
        assert {(r["frame"], r["y"], r["x"]) for r in vo.tops(df, span, side=side).collect()} == want


@given(st.integers(0, 10**6), st.integers(0, 9), st.booleans())
@settings(max_examples=60, deadline=None)
def test_running_extremes(seed, half, low):
    a = np.random.default_rng(seed).integers(0, 50, (5, 13)).astype(float)
    best = np.min if low else np.max
    for axis in (0, 1):
        got = grids.running(a, half, axis, low)
        for p in np.ndindex(a.shape):
            cut = tuple(slice(max(0, p[k] - half), p[k] + half + 1) if k == axis else p[k] for k in range(2))
            assert got[p] == best(a[cut])
    r = half % 5
    got = grids.disk_extreme(a, r, low)
    for y, x in np.ndindex(a.shape):
        assert got[y, x] == best([a[j, i] for j, i in np.ndindex(a.shape) if (j - y) ** 2 + (i - x) ** 2 <= r * r])


def test_top_hat_with_large_disks(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 100, (20, 23))
    rows = [("r", 0, y, x, int(image[y, x])) for y, x in np.ndindex(image.shape) if (y + x) % 11]
    df = spark.createDataFrame(rows, PLACE + ", v int")
    there = {(y, x): v for _, _, y, x, v in rows}
    r = 6
    near = lambda d, y, x, best: best(v for (j, i), v in d.items() if (j - y) ** 2 + (i - x) ** 2 <= r * r)
    least = {p: near(there, *p, min) for p in there}
    want = {p: there[p] - near(least, *p, max) for p in there}
    assert {(q["y"], q["x"]): q["v"] for q in mv.opened_difference(df, r).collect()} == want


def test_rolling_correlation_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4, 90)).cumsum(1)
    x[1, 40:60] = x[1, 40]
    df = spark.createDataFrame([("r", p, t, float(x[p, t])) for p, t in np.ndindex(x.shape) if (p, t) != (2, 15)], "roi string, pixel int, frame int, v double")
    half = 5
    for block in (1024, 11):
        monkeypatch.setattr(co, "BLOCK", block)
        got = {r["frame"]: r["r"] for r in co.pixel_rolling(df, half).collect()}
        assert sorted(got) == list(range(half, 90 - half))
        for t, r in got.items():
            w = x[:, t - half : t + half]
            bad = t - half <= 15 < t + half or (np.ptp(w, axis=1) == 0).any()
            assert (r is None) if bad else abs(r - np.corrcoef(w).mean()) < 1e-9


def test_chunks_of_a_volume(spark, tmp_path):
    """A horseshoe whose arms meet only in the last chunk, and noise; the stream is stopped and started again half way."""
    rng = random.Random(5)
    arms = {(f, 2, x) for f in range(12) for x in (2, 6)} | {(11, 2, x) for x in range(2, 7)}
    noise = {(f, y, x) for f in range(12) for y in range(6, 16) for x in range(16) if rng.random() < 0.12}
    places = arms | noise
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def write(frames):
        table(spark, [p for p in places if p[0] in frames]).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = st_traces.samples(spark, source, table(spark, []), files_per_trigger=1)
        q = sv.labelled(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    for chunk in (range(0, 4), range(4, 6)):
        write(chunk)
    run()
    for chunk in (range(6, 9), range(9, 12)):
        write(chunk)
        run()
    rows = spark.read.parquet(f"{out}/rows")
    got = {(r["frame"], r["y"], r["x"]): r["label"] for r in sv.whole(rows, settle=settle).collect()}
    assert got == flooded(places) and len({got[p] for p in arms}) == 1
    assert rows.where("other IS NOT NULL").count() > 3
    table(spark, [(3, 0, 0)]).coalesce(1).write.mode("append").parquet(source)
    run()  # a frame that is over gets no label
    assert spark.read.parquet(f"{out}/rows").where("label IS NULL").count() == 1 and folder(spark)


def smooth_image(seed, n=96):
    rng = np.random.default_rng(seed)
    f = np.fft.fft2(rng.normal(size=(n, n)))
    k = np.hypot(np.fft.fftfreq(n)[:, None], np.fft.fftfreq(n)[None])
    image = np.fft.ifft2(f * np.exp(-((k / 0.06) ** 2))).real
    return 30000 + 4000 * image / image.std()


@pytest.mark.parametrize("angle, dy, dx", [(0.0, 0.0, 0.0), (0.0, 3.4, -2.7), (4.0, 1.3, 2.6), (-9.5, -3.2, 0.4), (25.0, 0.0, 5.0)])
def test_rigid_motion_comes_back(spark, angle, dy, dx):
    from fluxtrace.functions import kernels

    n, big = 96, smooth_image(3, 160)
    y, x = np.mgrid[:n, :n].astype(float)
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    u, v = y - dy - (n - 1) / 2, x - dx - (n - 1) / 2
    cut = lambda a, b: kernels.sampled(big, a + 32, b + 32)
    still, frame = cut(y, x), cut(c * u - s * v + (n - 1) / 2, s * u + c * v + (n - 1) / 2)
    got = kernels.rigid(still, frame)
    assert abs(got[0] - angle) < 0.25 and abs(got[1] - dy) < 0.1 and abs(got[2] - dx) < 0.1
    rows = [("r", k, i, j, float(a[i, j])) for k, a in enumerate((still, frame)) for i, j in np.ndindex(n, n)]
    df = spark.createDataFrame(rows, PLACE + ", v double")
    motion = mv.rigid_motion(df, df.where("frame = 0").drop("frame"))
    assert abs({r["frame"]: r["dy"] for r in motion.collect()}[1] - dy) < 0.1
    back = {(r["y"], r["x"]): r["v"] for r in mv.warped(df.where("frame = 1"), mv.rigid_transforms(motion, df)).collect()}
    inner = [(i, j) for i in range(28, 68) for j in range(28, 68)]
    off = np.array([back[p] - still[p] for p in inner])
    assert np.abs(off).mean() < 0.05 * still.std()


@given(st.integers(0, 10**6), st.integers(2, 9))
@settings(max_examples=40, deadline=None)
def test_spline_goes_through_its_samples(seed, n):
    a = np.random.default_rng(seed).normal(size=n)
    c = grids.spline_coefficients(a, 0)
    mirror = lambda k: n - 1 - abs(n - 1 - k % (2 * n - 2))
    for i in range(n):
        assert sum(w * c[mirror(i + d)] for d, w in zip((-1, 0, 1, 2), grids.spline_weights(0.0))) == pytest.approx(a[i])


def test_movies_are_written_by_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from fluxtrace.sources import movies

    stack = np.random.default_rng(0).integers(0, 65536, (23, 4, 5))
    df = spark.createDataFrame([(i, 4, 5, f.ravel().tolist()) for i, f in enumerate(stack)], "frame int, h int, w int, data array<int>").repartition(6)
    for kind, name in (("raw_movie", "m.raw"), ("tiff_movie", "m.tif")):
        path = str(tmp_path / name)
        movies.write_movie(df, path, kind, width=5, height=4)
        read = spark.read.format(kind).options(path=path, width=5, height=4).load()
        assert {r["frame"]: r["data"] for r in read.collect()} == {i: f.ravel().tolist() for i, f in enumerate(stack)}
        with pytest.raises(Exception, match="FileExists"):
            movies.write_movie(df, path, kind, width=5, height=4, overwrite=False)
        movies.write_movie(df.where("frame < 9"), path, kind, width=5, height=4)
        assert spark.read.format(kind).options(path=path, width=5, height=4).load().count() == 9
        before = (tmp_path / name).read_bytes()
        for bad in (df.where("frame <> 3"), df.withColumn("h", F.when(F.col("frame") == 20, 9).otherwise(F.col("h")))):
            with pytest.raises(Exception):
                movies.write_movie(bad, path, kind, width=5, height=4)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.raw", "m.tif"] and (tmp_path / "m.tif").read_bytes() == before
    px = spark.createDataFrame([(f, y, x, f * 100 + y * 10 + x) for f in range(3) for y in range(3) for x in range(4) if (y, x) != (1, 1)], "frame int, y int, x int, v int")
    rows = movies.frames_of(px).orderBy("frame").collect()
    assert rows[2]["data"] == [200, 201, 202, 203, 210, 0, 212, 213, 220, 221, 222, 223]
