"""Streams of samples (key, ts, value) and of peaks (recording, peak).

Sources are rate-limited files (`maxFilesPerTrigger`); results go to files, so nothing is gathered in the driver. A query
resumes from its checkpoint, which also makes work that is done skip itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rollups import upsert_new


def samples(spark: SparkSession, path: str, like: DataFrame, *, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def binned(stream: DataFrame, width: str, *, key="key", ts="ts", value="value", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """key, start, mean and n of each window of the event time; windows close when the watermark passes them."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(key, window.alias("_w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(key, F.col("_w.start").alias("start"), "mean", "n")


def leaders(stream: DataFrame, threshold: int, *, late: int = 0, recording="recording", peak="peak") -> DataFrame:
    """(recording, leader): as the batch operator, across triggers, for peaks that come at most `late` frames after a later one.

    The state is the last leader, the latest peak and the peaks less than `late` before it: they wait, and those that nothing
    follows wait for ever, as windows do that no watermark passes. A peak that comes later than that is not led again.
    """
    kind = stream.schema[recording].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, top, waiting = state.get if state.exists else (None, None, [])
        waiting = sorted({*waiting, *(int(x) for part in parts for x in part[peak])})
        top = max([*waiting[-1:], *([] if top is None else [top])], default=None)
        found = []
        while waiting and waiting[0] <= top - late:
            p = waiting.pop(0)
            if last is None or p - last > threshold:
                last = p
                found.append(p)
        if top is not None:
            state.update((last, top, waiting))
        yield pd.DataFrame({recording: [key[0]] * len(found), "leader": found})

    return stream.groupBy(recording).applyInPandasWithState(step, f"{recording} {kind}, leader long", "last long, top long, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def upserting(path: str, key: str):
    """For foreachBatch: adds the rows of new keys to the table at `path`, as a new set of files next to the old."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        new = batch.dropDuplicates([key])
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            old = spark.read.parquet(path)
            new = upsert_new(old.limit(0), new.join(old.select(key), key, "left_anti"), key)
        new.write.mode("append").parquet(path)

    return write


def run(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet files under `folder`, and reads them."""
    spark, out = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
