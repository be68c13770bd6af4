"""Tables settled in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster that is an error, for
    executors would write what nobody reads."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _local(application: str) -> str:
    return tempfile.mkdtemp(prefix="fluxtrace-")


def settle(df: DataFrame) -> DataFrame:
    """Writes df in the shared folder and reads it again."""
    path = f"{folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
