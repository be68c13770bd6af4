"""Tables from CSV, Parquet and XML with declared schemas; sinks that are wide or text at the very end only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null

# Schemas of the tables of a study; missing values are NULL, never NaN.
SCHEMAS = {
    "recording": "folder string, discard int, date string, strain string, mouse string, age double, fps double, um_per_pixel double, um_width double, height int, width int, frames int, seconds double, independent_recording int, sequence int, first_last string, n_channels int, rois string",
    "corr_params": "folder string, window_left int, window_right int, minima_order int, window_max_left int, window_max_right int, maxima_order int, smooth_order int, extra_intervals string, template_intervals string",
    "jump": "recording string, kind string, frame int",
    "reference": "recording string, frame int, mean double, sd double",
    "trace": "recording string, cell string, frame int, f double",
    "corr_trace": "recording string, cell string, frame int, r double",
    "pixel": "recording string, channel int, frame int, y int, x int, v int",
    "label": "recording string, layer string, t int, y int, x int, label int",
    "master": "cell string, recording string, roi int, cell_type double, mouse string, strain string, age double, fps double, peaks array<int>, cy double, cx double, sequence int, independent_recording string, matched_roi double",
    "transform": "recording string, bin int, m array<double>",
    "shape": "recording string, index int, shape_type string, axis0 double, axis1 double",
    "result": "input_path string, output_path string, success boolean, error_message string, n_frames int, processing_time double",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def csv(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """A CSV with header; NaN becomes NULL."""
    df = spark.read.schema(SCHEMAS[table]).option("header", True).option("nanValue", "NaN").csv(path)
    return df.select(*[nan_to_null(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def excel(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A recording sheet from a workbook, where pandas has an engine for it; sheets are small and read by the driver."""
    import pandas as pd

    frame = pd.read_excel(path)
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    return spark.createDataFrame(rows, SCHEMAS[table] if table else list(map(str, frame.columns)))


def local_root(folders: DataFrame, candidates: list[str], column: str = "folder", checks: int = 3, seed: int = 0) -> str | None:
    """The first candidate root under which a few seeded folders all exist."""
    from ..functions.scalars import local_path
    from ..operators.rollups import sampled

    some = sampled(folders.select(column).distinct(), column, checks, seed)
    jvm, conf = folders.sparkSession._jvm, folders.sparkSession._jsc.hadoopConfiguration()
    for root in candidates:
        paths = [jvm.org.apache.hadoop.fs.Path(r[0]) for r in some.select(local_path(root, column)).collect()]
        if paths and all(p.getFileSystem(conf).exists(p) for p in paths):
            return root
    return None


def load(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """By the name's ending; without a known one Parquet, CSV and Excel are tried, and the last error is raised."""
    readers = {"xlsx": lambda p: excel(spark, p, table), "xls": lambda p: excel(spark, p, table), "parquet": spark.read.parquet, "csv": lambda p: csv(spark, p, table) if table else spark.read.option("header", True).csv(p), "orc": spark.read.orc, "json": spark.read.json}
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in readers:
        return readers[ending](path)
    for kind in ("parquet", "csv", "xlsx"):
        try:
            return readers[kind](path)
        except Exception as e:  # noqa: BLE001
            last = e
    raise last


def optional(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table whose file may be absent; then it is empty."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return load(spark, path, table) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else empty(spark, table)


def experiment_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """folder, height, width, um_per_pixel, um_width, fps from the LSM element of acquisition files."""
    schema = "_pixelX int, _pixelY int, _pixelSizeUM double, _widthUM double, _heightUM double, _frameRate double"
    df = spark.read.format("xml").option("rowTag", "LSM").schema(schema).load(path)
    folder = F.regexp_extract(F.input_file_name(), r"^(.*)[/\\][^/\\]*$", 1)
    names = {"_pixelY": "height", "_pixelX": "width", "_pixelSizeUM": "um_per_pixel", "_widthUM": "um_width", "_frameRate": "fps"}
    return df.select(folder.alias("folder"), *[F.col(a).alias(b) for a, b in names.items()])


def files(spark: SparkSession, folder: str, pattern: str = "*", *, recursive: bool = True) -> DataFrame:
    """path and length of matching files; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder)
    return df.select("path", "length")


def companions(found: DataFrame, suffix: str) -> DataFrame:
    """Files with the companion of the same name and another ending; either may be missing."""
    stem = F.regexp_replace("path", rf"({suffix})?\.[^.]+$", "")
    one = found.where(~F.col("path").rlike(rf"{suffix}\.[^.]+$")).select(stem.alias("stem"), "path")
    two = found.where(F.col("path").rlike(rf"{suffix}\.[^.]+$")).select(stem.alias("stem"), F.col("path").alias("companion"))
    return one.join(two, "stem", "full")


def one_after_another(parts: list[DataFrame], order: str = "frame") -> DataFrame:
    """Several tables as one, each behind the frames of those before it."""
    offset, out = 0, []
    for p in parts:
        out.append(p.withColumn(order, F.col(order) + offset))
        last = p.agg(F.max(order).alias("n")).first()["n"]
        offset += 0 if last is None else last + 1
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def long_traces(wide: DataFrame, order: str = "Frame", prefix: str = "ROI_", recording: str | None = None) -> DataFrame:
    """roi, frame, f from a table with a column for each region; padding goes."""
    keys = [order] + ([recording] if recording else [])
    rois = [c for c in wide.columns if c.startswith(prefix)]
    out = wide.unpivot(keys, rois, "roi", "f")
    return out.select(*([recording] if recording else []), F.element_at(F.split("roi", "_"), -1).cast("int").alias("roi"), F.col(order).cast("int").alias("frame"), nan_to_null(F.col("f").cast("double")).alias("f")).where(F.col("f").isNotNull())


def wide_traces(df: DataFrame, names: list, *, key="roi", order="frame", value="f", prefix="ROI_") -> DataFrame:
    """A column for each key of a stated list, for export only."""
    out = df.groupBy(order).pivot(key, names).agg(F.first(value))
    return out.select(order, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])


def write_master(df: DataFrame, path: str) -> None:
    """Arrays as JSON text, one CSV folder."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_traces(df: DataFrame, path: str, recording: str = "recording") -> None:
    """Long traces, a folder for each recording; recordings that are written again replace their own folder only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(recording).parquet(path)


def write_new(old_path: str, new: DataFrame, key: str, out_path: str, *, override: bool = False) -> bool:
    """Writes old and new rows if there are new keys (or override). Whether it wrote."""
    from ..operators.rollups import upsert_new

    spark = new.sparkSession
    old = spark.read.parquet(old_path)
    if not override and new.join(old.select(key), key, "left_anti").isEmpty():
        return False
    upsert_new(old, new, key, override=override).write.mode("overwrite").parquet(out_path)
    return True
