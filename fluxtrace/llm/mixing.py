"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

The budget is shared among sources by weight; a source takes at most `epochs` times its size, and what it cannot take is
shared again among the others by weight until no source is above its cap. That end state has one water level L:
target = min(cap, weight * L). Sorted by cap / weight, the clamped sources are a prefix, so L is the largest value of
(budget - caps before) / (weights from here on) over the sorted sources.

Each source takes its documents whole as often as the target allows, and for the rest of the target once more those
with the smallest seeded hashes, up to the target. The place where that ends is found in two steps, so no task sorts a
whole source: sizes by range of hashes (4096 ranges a source), then only the documents of the range that crosses.

Edge cases: a null text has size 0; a null source sorts last and is a source; equal rows have equal hashes and are taken
alike; sources without words have target 0; an empty table gives an empty result; extra columns stay, except
those with the names that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PLAIN_WORD, settle, unwrapped, wrapped

WEIGHTS = (3, 1, 2)
SHARE, EPOCHS = 1.5, 2
RANGE_BITS = 48  # of a hash's 60 bits, those below the range
#: Shares per source are broadcast up to this number of sources.
BROADCAST_SOURCES = 100_000

_OWN = ("size", "source_size", "target", "taken")


def words() -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(PLAIN_WORD)).cast("long")


def hashed(seed: int) -> Column:
    """60 bits that depend on the seed, the id and the text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size and target from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))))
    sources = sources.withColumn("_w", weight.cast("long")).withColumn("_cap", epochs * F.col("source_size"))
    by_fill = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    level = sources.withColumn("_level", (total * share - before) / rest).withColumn("_level", F.max("_level").over(W.partitionBy()))
    return level.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_level")).alias("target"))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    on = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        on &= a[k] == b[k]
    return on


def shares(docs: DataFrame, *, seed: int, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """For each source its size, target, whole repetitions, and the largest hash that is taken once more (null: none)."""
    rows = settle(docs.select("source", words().alias("size"), hashed(seed).alias("u")).groupBy("source", "u").agg(F.sum("size").alias("size")), "sizes")
    goal = settle(targets(rows, weights=weights, share=share, epochs=epochs), "targets")
    goal = goal.withColumn("whole", F.least(F.floor(F.try_divide("target", "source_size")), F.lit(epochs)).cast("long"))
    goal = goal.withColumn("whole", F.coalesce("whole", F.lit(0).cast("long"))).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    ranges = rows.groupBy("source", F.shiftright("u", RANGE_BITS).alias("range")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("range"))
    ranges = ranges.withColumn("upto", upto).withColumnRenamed("source", "_source")
    crossing = (
        ranges.join(goal.select("source", "rest"), ranges["_source"].eqNullSafe(goal["source"]))
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
        .select("source", "range", "rest", (F.col("upto") - F.col("size")).alias("before"))
    )
    inside = rows.withColumn("range", F.shiftright("u", RANGE_BITS)).select(F.col("source").alias("_source"), F.col("range").alias("_range"), "u", "size")
    inside = inside.join(crossing, inside["_source"].eqNullSafe(crossing["source"]) & (inside["_range"] == crossing["range"]))
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("u")))
    # A row is taken if more than half of it fits. Rows of lower ranges always are.
    last = inside.groupBy("source", "range").agg(F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), F.col("u"))).alias("last"))
    last = last.select(F.col("source").alias("_source"), F.coalesce("last", F.shiftleft("range", RANGE_BITS) - 1).alias("last"))
    return goal.join(last, goal["source"].eqNullSafe(last["_source"]), "left").select("source", "source_size", "target", "whole", "last")


def mix(docs: DataFrame, *, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """docs with size, source_size, target (both of the source) and taken (words the mix takes, repeats counted)."""
    plan = settle(shares(docs, seed=seed, weights=weights, share=share, epochs=epochs), "shares")
    few = plan.count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "_source")
    sized = wrapped(docs, "doc_id", "source", "text").withColumns({"size": words(), "_u": hashed(seed)})
    joined = sized.join(F.broadcast(plan) if few else plan, sized["source"].eqNullSafe(plan["_source"]))
    times = F.col("whole") + F.coalesce((F.col("_u") <= F.col("last")).cast("long"), F.lit(0))
    return unwrapped(joined.withColumn("taken", F.col("size") * F.least(times, F.lit(epochs))), docs, *_OWN)
