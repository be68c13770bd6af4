"""Streams in order of event time against the batch operators, for files whose rows come out of order within the stated lateness."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxtrace.operators import traces as tr
from fluxtrace.streaming import timed
from fluxtrace.streaming import traces as st

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Four files of rows up to ten seconds out of order, and a fifth of another key, an hour later, which moves the watermark on."""
    where = str(tmp_path_factory.mktemp("rows") / "in")
    rng = np.random.default_rng(5)
    rows = [(f"k{k}", START + dt.timedelta(seconds=float(s) / 2), i, None if i % 17 == 3 else float(rng.integers(0, 50))) for i, (k, s) in enumerate(zip(rng.integers(0, 3, 240), rng.integers(0, 480, 240), strict=True))]
    rows.sort(key=lambda r: r[1].timestamp() + rng.uniform(0, 10))
    rows += [("k1", None, 999, 1.0)]
    kind = "key string, ts timestamp, tie long, value double"
    for part in (*[rows[i : i + 61] for i in range(0, 241, 61)], [("late", START + dt.timedelta(hours=1), 1000, 3.0)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(where)
    return where, spark.createDataFrame([r for r in rows if r[1] is not None], kind)


def _stream(spark, shuffled):
    return st.samples(spark, shuffled[0], shuffled[1], files_per_trigger=1)


@pytest.mark.parametrize(("window", "quantile"), [(1, 0.5), (7, 0.5), (10, 0.1), (500, 0.9)])
def test_rolling_quantiles_are_the_batch_operators(spark, shuffled, tmp_path, window, quantile):
    out = st.run(timed.rolling_quantile(_stream(spark, shuffled), window, quantile=quantile, late="20 seconds"), str(tmp_path)).where("key <> 'late'")
    df = shuffled[1].withColumn("_at", F.struct("ts", "tie"))
    want = {r["tie"]: r["baseline"] for r in tr.rolling_quantile(df, window, quantile=quantile, key="key", order="_at", value="value").collect()}
    got = out.collect()
    assert len(got) == len(want) and {r["tie"]: r["baseline"] for r in got} == pytest.approx(want, nan_ok=True)


def test_leaders_are_a_fold_over_times(spark, shuffled, tmp_path):
    got = st.run(timed.leaders(_stream(spark, shuffled), 9.5, late="20 seconds", recording="key"), str(tmp_path)).where("key <> 'late'").collect()
    want, last = set(), {}
    for r in shuffled[1].orderBy("ts").collect():
        if r["key"] not in last or (r["ts"] - last[r["key"]]).total_seconds() > 9.5:
            last[r["key"]] = r["ts"]
            want.add((r["key"], r["ts"]))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_rows_later_than_stated_are_left_out(spark, tmp_path):
    where, kind = str(tmp_path / "in"), "key string, ts timestamp, tie long, value double"
    at = lambda s: START + dt.timedelta(seconds=s)
    for part in ([("a", at(0), 0, 1.0)], [("a", at(100), 1, 5.0)], [("b", at(101), 4, 0.0)], [("a", at(50), 2, 9.0)], [("b", at(500), 3, 0.0)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(where)
    stream = st.samples(spark, where, spark.createDataFrame([], kind), files_per_trigger=1)
    out = st.run(timed.rolling_quantile(stream, 3, late="10 seconds"), str(tmp_path)).orderBy("key", "ts").collect()
    assert [(r["key"], r["tie"], r["baseline"]) for r in out] == [("a", 0, 1.0), ("a", 1, 3.0), ("b", 4, 0.0)]  # the last row still waits
