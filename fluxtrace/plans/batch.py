"""Many recordings, some at a time: what is done is skipped, what fails is written down and does not stop the rest.

Each recording is a Spark job of its own; threads of the driver only start them, `jobs` side by side, so that the tail of one does
not leave executors idle. The log has a row about each (see SCHEMAS["result"]), written by one thread as they end.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import SCHEMAS, empty


def log(spark: SparkSession, path: str) -> DataFrame:
    """The rows written so far; none if there is no log yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(SCHEMAS["result"]).parquet(path) if there else empty(spark, "result")


def pending(recordings: DataFrame, done: DataFrame) -> DataFrame:
    """Recordings (input_path, output_path) whose output no successful row of the log names."""
    return recordings.join(done.where("success").select("output_path").distinct(), "output_path", "left_anti").select("input_path", "output_path")


def run_all(recordings: DataFrame, step: Callable[[SparkSession, str, str], int], log_path: str, *, override: bool = False, jobs: int = 1) -> DataFrame:
    """Runs step(spark, input_path, output_path), which returns the number of frames, for every recording not done yet (all
    with override), `jobs` of them at a time. Returns the rows of this run."""
    spark = recordings.sparkSession
    todo = recordings.select("input_path", "output_path") if override else pending(recordings, log(spark, log_path))
    rows = []

    def run(source: str, target: str) -> tuple:
        began, frames, error = time.perf_counter(), None, None
        try:
            frames = step(spark, source, target)
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        return source, target, error is None, error, frames, time.perf_counter() - began

    with ThreadPoolExecutor(jobs) as pool:
        started = [pool.submit(run, r["input_path"], r["output_path"]) for r in todo.orderBy("input_path").collect()]  # one row a file
        for one in as_completed(started):
            rows.append(one.result())
            spark.createDataFrame(rows[-1:], SCHEMAS["result"]).coalesce(1).write.mode("append").parquet(log_path)
    return spark.createDataFrame(rows, SCHEMAS["result"])


def write_frames(frames: DataFrame, path: str, *, chunk: int = 500, order: str = "frame", recording: str = "recording") -> None:
    """Frames in folders by recording and chunk of frames. A chunk that is written again replaces itself only, so a movie can be
    written a piece at a time and a failed piece repeated."""
    out = frames.withColumn("chunk", F.floor(F.col(order) / chunk).cast("int"))
    out.repartition(recording, "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(recording, "chunk").parquet(path)


def write_provenance(transforms: DataFrame, parameters: dict[str, object], path: str) -> None:
    """The transforms of a registration and the parameters that made them, side by side; a recording's own are replaced."""
    spark = transforms.sparkSession
    transforms.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(f"{path}/transforms")
    rows = [(str(r["recording"]), k, str(v)) for r in transforms.select("recording").distinct().collect() for k, v in sorted(parameters.items())]
    table = spark.createDataFrame(rows, "recording string, name string, value string")
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(f"{path}/parameters")
