"""Hard negatives by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions. By the triangle inequality on the sphere the angle
between an anchor and a row lies in [max |s - t|, min(s + t, 2 pi - s - t)], s and t their angles to one reference. Its
cosines times both norms, widened by more than rounding can err, bound the inner product. Rows are looked at in blocks of
like direction: first the interval of a whole block, then that of each row; only rows whose bounds overlap the window of
scores that is asked for get their exact integer score.

Two scans over all rows answer a slice of the anchors: in the first the window is "no less than the last of the best so
far" among rows of the anchor's label, in the second the scores that some positive of the anchor allows among rows of other
labels, again no less than the last of the best so far. A task sends no more than the best few of each anchor; the best of
all tasks are merged by anchor. Slices are of SLICE anchors, so what is broadcast (and what a task holds) is bounded
whatever the table; the rows themselves are never shuffled, so a hot label or many copies of a row land nowhere together.

Edge cases: rows that take no part are those of `vectors.integers` and rows without a label; a zero vector has score 0 with
all; shorter vectors are padded with zeros; a row without an id is no anchor and comes after all ids in ties; rows are told
apart as rows, so a repeated row is another row than its copy (and an anchor of its own); anchors without positives, and
positives without negatives in their window, give no rows; an empty table gives an empty result; columns besides
vec_id, embedding and label do not matter.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, plain, settle
from .vectors import integers, matrix

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, WHOLE = 30, 90, 100
EVERY = 100
#: Anchors of one pair of scans, and what a task takes of them and of rows at a time.
SLICE, ANCHOR_BLOCK, ROWS, BLOCK = 8192, 512, 4096, 256
#: Reference directions, chosen among so many rows (those with the smallest hashes of their ids).
REFERENCES, SAMPLE = 8, 2048
#: Angles are widened by far more than arccos errs near its ends, scores by more than a product of doubles does.
ANGLE, SHARE = 1e-6, 1e-9
NO_ID = (1 << 63) - 1

_ROWS = "id long, label long, q array<long>, row long, norm double, angles array<double>"
_rows = {"id": pa.int64(), "label": pa.int64(), "q": pa.list_(pa.int64()), "row": pa.int64(), "norm": pa.float64(), "angles": pa.list_(pa.float64())}
_FOUND = {"slot": pa.int64(), "score": pa.int64(), "id": pa.int64()}


def references(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Unit directions spread over a sample: each the one farthest in angle from those before."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(most, len(unit)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, unit @ unit[at])
    return unit[chosen]


def angles(q: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows and their angles to the directions; a zero vector is at right angles to all."""
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    cosine = (q.astype(np.float64) @ directions.T) / np.where(norm, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


def bounds(norm: np.ndarray, angle: np.ndarray, least_norm: np.ndarray, most_norm: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors (rows) with groups of rows (columns) whose norms and angles lie in these ranges."""
    low, high = np.zeros((len(norm), len(least))), np.full((len(norm), len(least)), pi)
    for r in range(angle.shape[1]):
        a = angle[:, r, None]
        np.maximum(low, np.maximum(least[None, :, r] - a, a - most[None, :, r]), out=low)
        np.minimum(high, np.minimum(a + most[None, :, r], 2 * pi - a - least[None, :, r]), out=high)
    top, bottom = np.cos(np.maximum(low - ANGLE, 0)), np.cos(np.minimum(high + ANGLE, pi))
    size = norm[:, None] * most_norm
    slack = size * SHARE + 1
    upper = np.where(top > 0, size, norm[:, None] * least_norm) * top + slack
    lower = np.where(bottom < 0, size, norm[:, None] * least_norm) * bottom - slack
    return lower, upper


class Best:
    """The best (score, then smaller id) of each slot among the pairs that are added."""

    def __init__(self, slots: int, most: int):
        self.most, self.floor = most, np.full(slots, np.iinfo(np.int64).min)
        self.kept, self.new, self.waiting = np.empty((3, 0), np.int64), [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append(np.stack([slot, score, ids]))
        self.waiting += len(slot)
        if self.waiting > 500_000:
            self.merge()

    def merge(self) -> np.ndarray:
        """slot, score, id: the best of each slot; floor becomes the last score of each full slot."""
        if self.new:
            slot, score, ids = both = np.concatenate([self.kept, *self.new], axis=1)
            slot, score, ids = both = both[:, np.lexsort((ids, -score, slot))]
            rank = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
            self.kept, self.new, self.waiting = both[:, rank < self.most], [], 0
            last = rank == self.most - 1
            self.floor[slot[last]] = score[last]
        return self.kept


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a with rows of b; in doubles where all of these are whole numbers they can hold."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _blocks(parts, width: int):
    """Rows of a task in blocks of like direction: (id, label, row, q, norm, angles)."""
    for batch in parts:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            q, norm = matrix(b.column("q"), width), b.column("norm").to_numpy()
            angle = b.column("angles").flatten().to_numpy().reshape(b.num_rows, -1)
            if angle.shape[1]:
                near = angle.argmin(1)
                order = np.lexsort((angle[np.arange(len(near)), near], near))
            else:
                order = np.arange(len(q))
            ids, labels, rows = (b.column(c).to_numpy() for c in ("id", "label", "row"))
            for k in range(0, len(order), BLOCK):
                o = order[k : k + BLOCK]
                yield ids[o], labels[o], rows[o], q[o], norm[o], angle[o]


def _pairs(anchors: dict, block: tuple, low: np.ndarray, high: np.ndarray, same: bool):
    """Anchors (positions in the slice), rows (in the block) and exact scores of the pairs whose bounds overlap the anchor's window
    [low, high]; `same`: of one label and not one row, else of different labels. Yields nothing where the bounds rule all out."""
    ids, labels, rows, q, norm, angle = block
    for at in range(0, len(low), ANCHOR_BLOCK):
        part = slice(at, at + ANCHOR_BLOCK)
        lower, upper = bounds(anchors["norm"][part], anchors["angles"][part], norm.min(keepdims=True), norm.max(keepdims=True), angle.min(0, keepdims=True), angle.max(0, keepdims=True))
        who = at + np.flatnonzero((upper[:, 0] >= low[part]) & (lower[:, 0] <= high[part]))
        if not len(who):
            continue
        may = (anchors["label"][who, None] == labels) == same
        if same:
            may &= anchors["row"][who, None] != rows
        lower, upper = bounds(anchors["norm"][who], anchors["angles"][who], norm, norm, angle, angle)
        i, j = np.nonzero(may & (upper >= low[who, None]) & (lower <= high[who, None]))
        if not len(i):
            continue
        if 4 * len(i) < may.size:
            score = np.einsum("ij,ij->i", anchors["q"][who[i]], q[j])
        else:
            score = exact(anchors["q"][who], q)[i, j]
        yield who[i], j, score


def _scan(rows: DataFrame, slice_: dict, width: int, most: int, windows: np.ndarray | None) -> DataFrame:
    """slot, score, id: what each task holds best. Without windows a slot is an anchor and takes rows of its label; with windows
    (positives' scores by anchor, -1: none) a slot is an anchor's positive and takes rows of other labels in its window."""
    make = batches(_FOUND)
    shared = rows.sparkSession.sparkContext.broadcast((slice_, windows))

    def work(batch):
        anchors, scores = shared.value
        n = len(anchors["row"])
        if scores is None:
            best, low, high = Best(n, most), np.full(n, -np.inf), np.full(n, np.inf)
        else:
            per, asked = scores.shape[1], scores >= 0
            best = Best(n * per, most)
            high = np.where(asked, HIGH * scores / WHOLE, -np.inf).max(1)
        for block in _blocks(batch, width):
            if scores is None:
                low = best.floor.astype(np.float64)
            else:
                low = np.where(asked, np.maximum(LOW * scores / WHOLE, best.floor.reshape(n, per)), np.inf).min(1)
            for who, j, score in _pairs(anchors, block, low, high, scores is None):
                if scores is None:
                    good = score >= best.floor[who]
                    best.add(who[good], score[good], block[0][j[good]])
                    continue
                for k in range(per):
                    p, slot = scores[who, k], who * per + k
                    good = (p >= 0) & (LOW * p <= WHOLE * score) & (WHOLE * score <= HIGH * p) & (score >= best.floor[slot])
                    best.add(slot[good], score[good], block[0][j[good]])
            if best.waiting > max(2 * len(best.floor), 20_000):
                best.merge()
        slot, score, ids = best.merge()
        yield make({"slot": slot, "score": score, "id": ids})

    return rows.mapInArrow(work, "slot long, score long, id long")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of each slot among what the tasks found, with their ranks from 1."""
    rank = F.row_number().over(W.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def prepared(embeddings: DataFrame, *, labels: int = 10, relabel: int = 7) -> tuple[DataFrame, int]:
    """id, label, q, row, norm and angles of each row that takes part, settled, and the width of q."""
    columns = plain(embeddings, "vec_id", "label", "embedding").where("label IS NOT NULL")
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(F.pmod(vec_id, F.lit(relabel)) == 0, (label + 1) % labels).otherwise(label)
    rows, width = integers(columns, F.coalesce(vec_id, F.lit(NO_ID)).alias("id"), label.alias("label"), F.monotonically_increasing_id().alias("row"))
    sample = rows.orderBy(F.xxhash64("id"), "id", "q").limit(SAMPLE).select("q").collect()
    directions = references(np.array([r["q"] for r in sample], np.float64).reshape(-1, width))
    make = batches(_rows)

    def work(parts):
        for batch in parts:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                norm, angle = angles(matrix(b.column("q"), width), directions)
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * angle.shape[1]
                yield make({c: b.column(c) for c in ("id", "label", "q", "row")} | {"norm": norm, "angles": pa.ListArray.from_arrays(ends, angle.ravel())})

    return settle(rows.select("id", "label", "q", "row").mapInArrow(work, _ROWS), "angles"), width


def _slices(anchors: DataFrame):
    """Anchors in slices of at most SLICE rows, numbered over the whole table; each slice is a bounded collect."""
    order = W.partitionBy("slice").orderBy("row")
    total = anchors.count()
    pieces = max(1, -(-2 * total // SLICE))  # hashed evenly, so that none reaches twice its share
    dealt = settle(anchors.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(pieces))), "anchors")
    dealt = dealt.withColumn("at", F.row_number().over(order) - 1).withColumn("slice", F.col("slice") * 1_000_000 + F.floor(F.col("at") / SLICE))
    dealt = settle(dealt.drop("at"), "slices")
    for s in sorted(r["slice"] for r in dealt.select("slice").distinct().collect()):
        yield dealt.where(F.col("slice") == s).orderBy("row").drop("slice").collect()


def mine(embeddings: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, labels: int = 10, relabel: int = 7) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (ids divisible by `every`) and
    each of its best `positives` rows of the same label, the best `negatives` rows of other labels in the window of scores."""
    spark = embeddings.sparkSession
    rows, width = prepared(embeddings, labels=labels, relabel=relabel)
    out = None
    for some in _slices(rows.where((F.col("id") != NO_ID) & (F.pmod("id", F.lit(every)) == 0))):
        n = len(some)
        held = {k: np.array([r[k] for r in some], np.int64) for k in ("id", "label", "row")} | {"norm": np.array([r["norm"] for r in some])}
        held |= {"q": np.array([r["q"] for r in some], np.int64), "angles": np.array([r["angles"] for r in some], np.float64).reshape(n, -1)}
        best = _ranked(_scan(rows, held, width, positives, None), positives).collect()  # positives x SLICE rows at most
        scores, who = np.full((n, positives), -1, np.int64), np.zeros((n, positives), np.int64)
        for r in best:
            if r["score"] >= 0:  # no score lies in the window of a negative one
                scores[r["slot"], r["rank"] - 1] = r["score"]
            who[r["slot"], r["rank"] - 1] = r["id"]
        names = [(a * positives + k, int(held["id"][a]), int(who[a, k]), int(scores[a, k])) for a in range(n) for k in range(positives) if scores[a, k] >= 0]
        named = spark.createDataFrame(names, "slot long, anchor_id long, positive long, positive_score long")
        found = _ranked(_scan(rows, held, width, negatives, scores), negatives).join(named, "slot")
        real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        found = settle(found.select("anchor_id", real("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
