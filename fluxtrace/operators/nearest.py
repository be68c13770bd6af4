"""The nearest target of each point of a plane, without comparing all pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_by_tiles(points: DataFrame, targets: DataFrame, *, group: list[str], settle) -> DataFrame:
    """points (group, y, x, ...) with the nearest of the targets (group, target, ty, tx) of their group and its distance; of equally
    near ones the smallest. Points of groups without targets go.

    The plane is cut into tiles of about the mean distance between targets. A point meets the targets of its own tile and the
    eight around it; a target found within a tile's side is the nearest. The other points go on with tiles twice as large,
    until one tile spans all; few points get that far. settle (DataFrame -> DataFrame) cuts the lineage of each round.
    """
    size = targets.groupBy(*group).agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("ty", "tx") for f in (F.min, F.max)])
    place = lambda p: [f(c).alias(f"{f.__name__}_{c}") for c in p for f in (F.min, F.max)]
    area = (F.col("max_ty") - F.col("min_ty") + 1) * (F.col("max_tx") - F.col("min_tx") + 1)
    side = size.agg((F.sum(area) / F.sum("n")).alias("a")).first()["a"]
    if side is None:
        return points.select("*", F.lit(None).cast(targets.schema["target"].dataType).alias("target"), F.lit(None).cast("double").alias("distance")).limit(0)
    ends, far = points.agg(*place("yx")).first(), targets.agg(*place(("ty", "tx"))).first()
    if ends["min_y"] is None:
        return points.select("*", F.lit(None).cast(targets.schema["target"].dataType).alias("target"), F.lit(None).cast("double").alias("distance"))
    span = max(max(ends[f"max_{a}"], far[f"max_t{a}"]) - min(ends[f"min_{a}"], far[f"min_t{a}"]) for a in "yx") + 1
    side = max(1.0, math.sqrt(side))
    rest, done = points.join(targets.select(*group).distinct(), group, "left_semi"), []
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    keys = points.columns
    while True:
        t = targets.withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around))
        t = t.select(*group, "target", "ty", "tx", (F.floor(F.col("ty") / side) + F.col("_a")).alias("_ty"), (F.floor(F.col("tx") / side) + F.col("_b")).alias("_tx"))
        p = rest.withColumns({"_ty": F.floor(F.col("y") / side), "_tx": F.floor(F.col("x") / side)})
        far = F.hypot(F.col("y") - F.col("ty"), F.col("x") - F.col("tx"))
        best = p.join(t, [*group, "_ty", "_tx"], "left").groupBy(*keys).agg(F.min(F.struct(far.alias("distance"), "target")).alias("_best"))
        best = settle(best.select(*keys, "_best.target", "_best.distance"))
        last = side > span
        sure = F.col("distance").isNotNull() & (F.lit(last) | (F.col("distance") <= side))
        done.append(best.where(sure))
        rest = best.where(~sure).select(*keys)
        if last or rest.isEmpty():
            break
        side *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
