"""Queries over streams, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import timed
from ..streaming import traces as st
from .registry import q6, query, r6, table
from .storage import folder


def _stream(spark, d):
    return st.samples(spark, f"{d}/event[s].parquet", table(spark, d, "events"))


@query(f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, value, ts FROM events), g AS (SELECT event_type, start, {q6('avg(value)')} AS mean, count(*) AS n FROM w GROUP BY ALL)
 SELECT event_type, cast(epoch(start) AS BIGINT) AS start_s, mean, n FROM g WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_temporal_bin(spark, d):
    """Windows that the watermark has passed; the last ones stay open, in the SQL as well."""
    stream = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.run(st.binned(stream, "6 hours", key="event_type"), folder(spark))
    return out.select("event_type", F.unix_timestamp("start").alias("start_s"), r6("mean").alias("mean"), "n")


@query("""WITH p AS (SELECT user_id % 10 AS recording, event_id // 10 AS peak FROM events WHERE value > 100), l AS (SELECT recording, list_sort(list(DISTINCT peak)) AS l FROM p GROUP BY recording),
 f AS (SELECT recording, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] > 3 THEN list_concat(a, x) ELSE a END) AS l FROM l) SELECT recording, unnest(l) AS leader FROM f""")
def stream_event_leaders(spark, d):
    peaks = _stream(spark, d).where("value > 100").select((F.col("user_id") % 10).alias("recording"), F.expr("event_id div 10").alias("peak"))
    return st.run(st.leaders(peaks, 3), folder(spark))


@query("""WITH e AS (SELECT max(ts) - INTERVAL 1 HOUR AS upto FROM events WHERE value > 50), p AS (SELECT user_id % 10 AS recording, list_sort(list(DISTINCT epoch_us(ts))) AS l FROM events, e WHERE value > 50 AND ts <= upto GROUP BY ALL),
 f AS (SELECT recording, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] > 21600000000 THEN list_concat(a, x) ELSE a END) AS l FROM p) SELECT recording, unnest(l) AS leader_us FROM f""")
def stream_leaders_in_time(spark, d):
    """Leaders by time, of all peaks that the watermark has passed, whatever recording has moved it."""
    peaks = _stream(spark, d).where("value > 50").select((F.col("user_id") % 10).alias("recording"), F.col("ts").cast("timestamp").alias("ts"))
    return st.run(timed.leaders(peaks, 6 * 3600, late="1 hour"), folder(spark)).select("recording", F.unix_micros("leader").alias("leader_us"))


@query(f"""WITH t AS (SELECT user_id AS cell, ts, event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 20 PRECEDING) AS b FROM events)
 SELECT cell, event_id, {q6('value - b')} AS detrended FROM t WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_rolling_median(spark, d):
    """The trailing rolling median of 21 rows, of rows that come in any order within an hour."""
    rows = _stream(spark, d).select(F.col("user_id").alias("cell"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    out = st.run(timed.rolling_quantile(rows, 21, late="1 hour", key="cell", tie="event_id"), folder(spark))
    return out.select("cell", "event_id", r6("detrended").alias("detrended"))
