"""What the operators of this subpackage share: word rules, Arrow plumbing and settled tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Java regular expressions of the two kinds of word.
FOLDED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: A task works on so many rows and bytes of text at a time.
ROWS, BYTES = 1000, 8 << 20

#: Odd multiplier of the rolling word hashes.
ODD = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def folded_words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; none for null."""
    return text.translate(FOLD).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, unchanged; none for null."""
    return text.split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist() if len(column) else []


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its
    own; on a cluster that is an error, for executors would write what nobody reads."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _local(application: str) -> str:
    return tempfile.mkdtemp(prefix="fluxtrace-")


def settle(df: DataFrame, name: str, *, partition_by: list[str] | None = None, **options) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**{"compression": "zstd", **options})
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(parts, rows: int = ROWS, limit: int = BYTES):
    """Record batches in slices of at most so many rows and bytes of text (a longer text is a slice of its own): what a
    task holds follows neither the size of Arrow batches nor the lengths of the texts around the longest one."""
    for batch in parts:
        if not batch.num_rows:
            yield batch
            continue
        upto = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                upto += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(upto)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right"))
            end = min(max(end, at + 1), at + rows)
            yield batch.slice(at, end - at)
            at = end


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns; absent ones are null. Extra columns, whatever their names, go."""
    have = {c.lower(): c for c in reversed(df.columns)}
    return df.select(*[F.col(f"`{have[c]}`").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, after one struct `_row` of all others: names it uses itself then clash with none."""
    own = {c.lower() for c in columns}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    return docs.select(F.struct(*(rest or [F.lit(0).alias("_none")])).alias("_row"), *[F.col(f"`{c}`") for c in columns])


def unwrapped(df: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns of docs and those added; an added one replaces one of the same name."""
    own, packed = {a.lower() for a in added}, set(df.schema["_row"].dataType.names)
    return df.select(*[F.col("_row").getField(c).alias(c) if c in packed else F.col(c) for c in docs.columns if c.lower() not in own], *[F.col(a) for a in added])


class WordHashes(dict):
    """64-bit hash of each word, kept for the words seen most recently."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many consecutive words, from the words' hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a = h[:n].copy()
    for j in range(1, width):
        a *= ODD
        a += h[j : j + n]
    return mixed(a)


def batches(columns: dict[str, pa.DataType]):
    """Turns a dictionary of lists into a record batch of these columns."""
    schema = pa.schema(list(columns.items()))

    def make(rows: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x := rows[k], pa.Array) else pa.array(x, t) for k, t in columns.items()], schema=schema)

    return make


NON_WORD = re.compile(rb"[^0-9a-z\x80-\xff]+")
