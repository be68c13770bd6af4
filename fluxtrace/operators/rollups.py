"""Rollups from peaks to cells, matched cells and animals, and the statistics behind figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_known(value: str, order: str | Column) -> Column:
    """The first value that is not NULL, in the order given."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), order))


def cell_peaks(cells: DataFrame, peaks: DataFrame, *, fps: float, key="cell", recording="recording", frames="n_frames") -> DataFrame:
    """Cells with n_events, duration_s, frequency (1/min), mean_isi, cv and cells_in_recording; cells without peaks stay."""
    from .peaks import interval_stats

    out = cells.join(interval_stats(peaks, fps, key=key), key, "left")
    out = out.withColumn("n_events", F.coalesce("n_peaks", F.lit(0))).drop("n_peaks").withColumn("duration_s", F.col(frames) / F.lit(float(fps)))
    out = out.withColumn("frequency", F.try_divide(60.0 * F.col("n_events"), F.col("duration_s")))
    return out.withColumn("cells_in_recording", F.count("*").over(W.partitionBy(recording)))


def quality(peaks: DataFrame, noise: DataFrame, *, rule="all", snr=2.0, width_s=0.2, key="cell") -> DataFrame:
    """Adds `good`. rule "all" keeps every peak; "snr_width" asks for amplitude over noise and half width."""
    if rule == "all":
        return peaks.withColumn("good", F.lit(True))
    good = (F.try_divide("amplitude", "noise_sd") >= snr) & (F.col("half_width_s") >= width_s)
    return peaks.join(noise, key, "left").withColumn("good", F.coalesce(good, F.lit(False))).drop("noise_sd")


def kept_peaks(peaks: DataFrame, *, key="cell") -> DataFrame:
    return peaks.groupBy(key).agg(F.count_if("good").alias("kept"), (100.0 * F.avg(F.col("good").cast("double"))).alias("percent_kept"))


def independent_recordings(df: DataFrame, *, folder: str, strain: str, number: Column | str, order: str) -> DataFrame:
    """Adds `independent_recording`: strain and number of the first row of each folder, joined by an underscore."""
    name = F.concat_ws("_", F.col(strain), (F.col(number) if isinstance(number, str) else number).cast("string"))
    return df.withColumn("independent_recording", F.first(name).over(W.partitionBy(folder).orderBy(order)))


def peak_table(cells: DataFrame, lists: list[str], *, keep: list[str]) -> DataFrame:
    """A row for each peak from parallel arrays."""
    return cells.select(*keep, F.posexplode(F.arrays_zip(*lists)).alias("i", "_p")).select(*keep, "i", *[F.col(f"_p.{c}").alias(c) for c in lists])


def grouped(df: DataFrame, key: str, *, sums=(), means=(), firsts=(), joined=(), order: str) -> DataFrame:
    """One row for each known key: sums (0 if all NULL), means, first known values, and strings put together in order."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums] + [F.avg(c).alias(c) for c in means] + [first_known(c, order).alias(c) for c in firsts]
    aggs += [F.concat_ws("", F.array_sort(F.collect_list(F.struct(order, c)))[c]).alias(c) for c in joined]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def matched_cells(cells: DataFrame, *, order: str) -> DataFrame:
    """One row for each cell matched across recordings, with rates from the summed counts and durations."""
    counts = ("n_events", "kept", "single", "multiple", "orphan", "duration_s")
    out = grouped(cells, "unique_cell", sums=counts, means=("percent_active",), firsts=("age", "age_group", "mouse", "strain"), joined=("folder",), order=order)
    for c in ("n_events", "kept", "single", "multiple"):
        out = out.withColumn(f"{c}_per_min", F.try_divide(60.0 * F.col(c), F.col("duration_s")))
    return out.withColumn("percent_single", F.try_divide(100.0 * F.col("single"), F.col("kept"))).withColumn("percent_multiple", F.try_divide(100.0 * F.col("multiple"), F.col("kept")))


def animals(cells: DataFrame, *, order: str, least_s: float = 300, means=("n_events_per_min", "kept_per_min", "n_events", "duration_s")) -> DataFrame:
    """One row for each animal from cells observed for longer than least_s."""
    return grouped(cells.where(F.col("duration_s") > least_s), "mouse", means=means, firsts=("age", "age_group", "strain"), order=order)


# Statistics behind figures


def shares(df: DataFrame, group: str, level: str) -> DataFrame:
    """group, level, n and percent of the group."""
    out = df.groupBy(group, level).agg(F.count("*").alias("n"))
    return out.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(group)))


def mean_sd(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, group: str) -> DataFrame:
    """group, bin (from 1), n and share of the group; what is below or above has bins 0 and bins + 1."""
    out = df.withColumn("bin", F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins))).groupBy(group, "bin").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def ecdf(df: DataFrame, value: str, group: str) -> DataFrame:
    """Distinct values with the share of the group's values up to each."""
    n = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(group).orderBy(value))
    return n.withColumn("share", upto / F.sum("_n").over(W.partitionBy(group))).drop("_n")


def lines(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def density(df: DataFrame, value: str, grid: list[float], group: str) -> DataFrame:
    """Gaussian kernel density of each group on a grid, with Scott's bandwidth: group, x, density."""
    stats = df.groupBy(group).agg(F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"))
    rows = df.where(F.col(value).isNotNull()).join(stats, group).withColumn("_h", F.col("_sd") * F.pow("_n", F.lit(-0.2)))
    rows = rows.withColumn("x", F.explode(F.array(*map(F.lit, grid))))
    kernel = F.exp(-0.5 * ((F.col("x") - F.col(value)) / F.col("_h")) ** 2) / (F.col("_h") * (2 * 3.141592653589793) ** 0.5)
    return rows.groupBy(group, "x").agg(F.avg(kernel).alias("density"))


def outcome(results: DataFrame) -> DataFrame:
    """success, n and mean processing time of a batch's results."""
    return results.groupBy("success").agg(F.count("*").alias("n"), F.avg("processing_time").alias("mean_time"))


def upsert_new(old: DataFrame, new: DataFrame, key: str, *, override: bool = False) -> DataFrame:
    """The curated rows and those of new keys; with override the new rows replace the old ones."""
    if override:
        return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def renumbered(df: DataFrame, group: str, sequence: str) -> DataFrame:
    """Adds new_sequence 1..n in the group and whether it changed."""
    new = F.row_number().over(W.partitionBy(group).orderBy(sequence))
    return df.withColumn("new_sequence", new).withColumn("changed", F.col("new_sequence") != F.col(sequence))


def with_parameters(recordings: DataFrame, parameters: DataFrame, key: str, defaults: dict[str, object], order: str) -> DataFrame:
    """The first parameter row of each recording, defaults where there is none."""
    first = parameters.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_k = 1")
    out = recordings.join(first.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows chosen by a seeded hash of the key: the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def navigation(cells: DataFrame, first: str, second: str) -> DataFrame:
    """The levels of a group, the levels of a second group inside each, and a colour index of each."""
    levels = cells.select(first, second).distinct()
    return levels.withColumn("colour", F.dense_rank().over(W.partitionBy(first).orderBy(second)) - 1)


def described(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of a value in each group."""
    quartiles = [F.percentile(value, q).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), *quartiles, F.max(value).alias("high"))
