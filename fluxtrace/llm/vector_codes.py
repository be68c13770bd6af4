"""Vector code compression: product quantisation by Lloyd rounds that compare only what can have changed.

A vector is cut into equal consecutive parts; each part position has a codebook of at most `entries` entries, which starts
as that part of the rows with the smallest ids. A round assigns every part to its nearest entry (squared distance, ties to
the lower index) and replaces each entry by the floored mean of its parts; an unused entry stays. After the last round
parts are assigned once more.

Active entries: a row keeps the code and the exact distance of each part. If the entry of a part did not move, all
entries that did not move are still no better than it (in the order of distance, then index), so only the entries that
moved are compared with the stored distance. Parts whose own entry moved are compared with all entries. All is integer
arithmetic, so results do not depend on how rows are dealt out.

Codebooks have parts x entries x width numbers whatever the input; they are all that the driver holds. Rows stay where
they are: a round is a scan that writes the new codes and one that adds up entries, each of whose tasks sends a row for
each component of the codebooks.

Edge cases: rows that take no part are those of `vectors.integers`; shorter vectors are padded with zeros, as is the width
up to a multiple of the parts; null ids come last among the first rows and ties of ids are ordered by vector; with fewer
rows than entries there are as many entries as rows; repeated rows count and return as often as they occur; null labels
are one label; an empty table gives an empty result; columns besides vec_id, embedding and label do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, pieces, plain, settle
from .vectors import integers, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2

_STATE = "vec_id long, label string, q array<long>, code binary, distance array<long>"
_state = {"vec_id": pa.int64(), "label": pa.string(), "q": pa.list_(pa.int64()), "code": pa.binary(), "distance": pa.list_(pa.int64())}


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to the entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        gap = x[:, d, None] - entries[None, :, d]
        out += gap * gap
    return out


def assign(x: np.ndarray, books: np.ndarray, moved: np.ndarray, code: np.ndarray | None, distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Code and distance of each part of each row of x (rows x parts x width), and how many comparisons that took.

    books: parts x entries x width; moved: parts x entries, those that changed since `code` and `distance` were right."""
    n, parts = x.shape[:2]
    code, distance = (np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)) if code is None else (code.copy(), distance.copy())
    compared = 0
    for p in range(parts):
        again = moved[p, code[:, p]]
        active = np.flatnonzero(moved[p])
        if again.any():
            d = distances(x[again, p], books[p])
            compared += d.size
            best = d.argmin(1)
            code[again, p], distance[again, p] = best, d[np.arange(len(d)), best]
        still = np.flatnonzero(~again)
        if len(active) and len(still):
            d = distances(x[still, p], books[p, active])
            compared += d.size
            first = d.argmin(1)
            least, entry = d[np.arange(len(d)), first], active[first]
            own, at = distance[still, p], code[still, p]
            better = (least < own) | ((least == own) & (entry < at))
            code[still[better], p], distance[still[better], p] = entry[better], least[better]
    return code, distance, compared


def _assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray, first: bool) -> DataFrame:
    """The state with codes and distances under these codebooks, settled."""
    parts, _, width = books.shape
    make = batches(_state)

    def work(batch):
        for b in pieces(batch):
            x = matrix(b.column("q"), parts * width).reshape(-1, parts, width)
            old = None if first else np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            code, distance, _ = assign(x, books, moved, old, None if first else matrix(b.column("distance"), parts))
            ends = np.arange(len(x) + 1, dtype=np.int32) * parts
            yield make({"vec_id": b.column("vec_id"), "label": b.column("label"), "q": b.column("q"), "code": [row.tobytes() for row in code], "distance": pa.ListArray.from_arrays(ends, distance.ravel())})

    return settle(state.mapInArrow(work, _STATE), "codes")


def _replaced(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry replaced by the floored mean of its parts."""
    parts, entries, width = books.shape
    make = batches({"at": pa.int64(), "n": pa.int64(), "total": pa.int64()})

    def work(batch):
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in pieces(batch):
            if b.num_rows:
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                at = (code + np.arange(parts) * entries).ravel()
                n += np.bincount(at, minlength=len(n))
                np.add.at(total, at, matrix(b.column("q"), parts * width).reshape(-1, width))
        used = np.flatnonzero(n)
        yield make({"at": (used[:, None] * width + np.arange(width)).ravel(), "n": np.repeat(n[used], width), "total": total[used].ravel()})

    sums = state.select("q", "code").mapInArrow(work, "at long, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy().ravel()
    for r in sums.collect():  # parts x entries x width rows at most
        out[r["at"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def compress(embeddings: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label (as text), q, code (a byte a part) and distance (of each part) of every usable row; the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    columns = plain(embeddings, "vec_id", "label", "embedding")
    rows, width = integers(columns, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), multiple=parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    state = rows.select("vec_id", "label", "q", F.lit(b"").alias("code"), F.array().cast("array<long>").alias("distance"))
    if not first:
        return state, books
    moved = np.ones(books.shape[:2], bool)
    for k in range(rounds + 1):
        state = _assigned(state, books, moved, first=k == 0)
        if k < rounds:
            now = _replaced(state, books)
            moved, books = (now != books).any(2), now
    return state, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(embeddings: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every usable row."""
    state, books = compress(embeddings, parts=parts, entries=entries, rounds=rounds)
    error = F.aggregate("distance", F.lit(0).cast("long"), lambda a, b: a + b)
    out = state.select("vec_id", F.lower(F.hex("code")).alias("code"), error.alias("error"), "label")
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = out.join(by_label, out["label"].eqNullSafe(by_label["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
