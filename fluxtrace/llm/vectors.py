"""Integer vectors from an embeddings table, as the vector operators share them.

A component x becomes floor(256 * x), x as double. Rows whose vector is null or holds a null or non-finite component take
no part. Vectors shorter than the longest are padded with zeros at their end, so every row has one width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SCALE = 256


def usable(vector: Column) -> Column:
    """True where the vector is there and each component is a finite number."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v)), F.lit(False))


def integers(embeddings: DataFrame, *columns: Column, multiple: int = 1) -> tuple[DataFrame, int]:
    """The columns and q (array<bigint>) of the usable rows, settled, and the width of q, a multiple of `multiple`.

    Raises where a component is so large that 100 times an inner product would not fit in 64 bits.
    """
    x = F.col("embedding").cast("array<double>")
    q = F.transform(x, lambda v: F.floor(v * SCALE))
    rows = settle(embeddings.where(usable(F.col("embedding"))).select(*columns, q.alias("q")), "vectors")
    most = rows.agg(F.max(F.size("q")).alias("width"), F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("top")).first()
    width, top = max(most["width"] or 0, 1), most["top"] or 0
    width = -(-width // multiple) * multiple
    if 100 * width * (2 * top) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {top} in {width} dimensions are too large for 64-bit scores")
    padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q")))
    return rows.withColumn("q", padded), width


def matrix(column: pa.Array, width: int, dtype=np.int64) -> np.ndarray:
    """The rows of a list column (no nulls, one length) as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)
