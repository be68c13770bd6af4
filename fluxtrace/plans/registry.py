"""Registered queries and the tables that stand in for recordings.

cell traces: `events`, a user's values in order of time; embedding traces: `embeddings`, a vector's elements in order, its
label as recording; movie and labels: `lineitem`, a part's place in a 40-column image, the line number as frame and the
mean quantity as intensity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traces import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with DuckDB SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Rounded for comparison as DuckDB does, half away from zero after the product with a million, without a negative zero. Spark's own
    round looks at the shortest decimal of x instead, which lies on the other side of some halves."""
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") * 1e6) / 1e6 + 0.0


def r6_plain(x: Column | str) -> Column:
    """r6 by plain arithmetic on doubles, a tenth of its time, for results of very many rows. Of what rint leaves only an exact half differs."""
    y = (F.col(x) if isinstance(x, str) else x).cast("double") * 1e6
    size = F.abs(y)
    up = F.when(size - F.rint(size) == 0.5, 1.0).otherwise(0.0)
    return F.signum(y) * (F.rint(size) + up) / 1e6 + 0.0


def q6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def traces(spark: SparkSession, d: str) -> DataFrame:
    """cell, frame, f, kind."""
    df = table(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("value").alias("f"), F.col("event_type").alias("kind"), "ts", "event_id")
    return frames(df, "cell", "ts", "event_id").select("cell", "frame", "f", "kind")


TRACES = "t AS (SELECT user_id AS cell, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, value AS f, event_type AS kind FROM events)"


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """Traces whose purchases are missing."""
    return traces(spark, d).withColumn("f", F.when(F.col("kind") != "purchase", F.col("f")))


GAPPY = TRACES + ", g AS (SELECT cell, frame, CASE WHEN kind <> 'purchase' THEN f END AS f FROM t)"


def held(spark: SparkSession, d: str) -> DataFrame:
    """Traces in whole tens with runs of equal values; recording is a tenth of the cells."""
    return traces(spark, d).select("cell", "frame", (F.floor(F.col("f") / 25) * 25.0).alias("f"), (F.col("cell") % 10).alias("recording"))


HELD = TRACES + ", h AS (SELECT cell, frame, floor(f / 25) * 25.0 AS f, cell % 10 AS recording FROM t)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """recording, cell, frame, f."""
    df = table(spark, d, "embeddings").select(F.col("label").alias("recording"), F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("frame", "f"))
    return df.withColumn("f", F.col("f").cast("double"))


VECTORS = "v AS (SELECT label AS recording, vec_id AS cell, cast(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS frame, cast(unnest(embedding) AS DOUBLE) AS f FROM embeddings)"


def movie(spark: SparkSession, d: str) -> DataFrame:
    """recording (1), frame, y, x, v: hundredths of the mean quantity."""
    df = table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("frame"), F.expr("cast(l_partkey div 40 AS int)").alias("y"), (F.col("l_partkey") % 40).cast("int").alias("x"), "l_quantity")
    return df.groupBy("frame", "y", "x").agg(F.floor(F.avg("l_quantity") * 100 + 1e-6).cast("int").alias("v")).withColumn("recording", F.lit(1))


MOVIE = "m AS (SELECT 1 AS recording, l_linenumber - 1 AS frame, cast(l_partkey // 40 AS INTEGER) AS y, cast(l_partkey % 40 AS INTEGER) AS x, cast(floor(avg(l_quantity) * 100 + 1e-6) AS INTEGER) AS v FROM lineitem GROUP BY ALL)"


def regions(spark: SparkSession, d: str) -> DataFrame:
    """recording, y, x, label: bright pixels of frame 0, labelled by 8 x 8 tiles."""
    m = movie(spark, d).where("frame = 0 and v >= 2300")
    return m.select("recording", "y", "x", F.expr("cast((y div 8) * 5 + (x div 8) + 1 AS int)").alias("label"))


REGIONS = MOVIE + ", l AS (SELECT recording, y, x, cast((y // 8) * 5 + (x // 8) + 1 AS INTEGER) AS label FROM m WHERE frame = 0 AND v >= 2300)"


def waves(spark: SparkSession, d: str) -> DataFrame:
    """recording, t, y, x, label: bright voxels of all frames."""
    return movie(spark, d).where("v >= 4000").select("recording", F.col("frame").alias("t"), "y", "x", F.expr("cast((y div 5) * 8 + (x div 5) + 1 AS int)").alias("label"))


WAVES = MOVIE + ", w AS (SELECT recording, frame AS t, y, x, cast((y // 5) * 8 + (x // 5) + 1 AS INTEGER) AS label FROM m WHERE v >= 4000)"
