"""Regions of a movie that comes in chunks of frames: labels with an offset that is carried over, and merges across chunks.

A chunk's regions are numbered after those of the chunks before it. What is kept between chunks is the next number and the last
frame's labelled places; where a new chunk's first frame touches them, pairs of numbers that are one region come out as
rows of their own. So labels go out as frames come in, and `whole` applies the merges to what has come out so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import grids
from ..operators.graphs import roots

_STATE = "next long, frame long, ys array<int>, xs array<int>, labels array<long>"


def labelled(stream: DataFrame, *, recording="recording") -> DataFrame:
    """recording, frame, y, x, label, other from a stream of the places of regions (recording, frame, y, x), whose frames come in order
    (in any order within a trigger). Rows with `other` (and no place) say that two labels are one region. Neighbours are places
    that differ by one at most in frame, y and x. Places in or before a frame that an earlier trigger has ended with get no label.

    A recording's chunk (what one trigger brings of it) is labelled in one task; the source's limit of files a trigger bounds it.
    """
    kind = stream.schema[recording].dataType.simpleString()
    columns = ["frame", "y", "x"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, frame, ys, xs, labels = state.get if state.exists else (1, None, [], [], [])
        rows = pd.concat([p[columns] for p in parts], ignore_index=True).drop_duplicates().sort_values(columns, ignore_index=True)
        late = rows[rows["frame"] <= frame] if frame is not None else rows.iloc[:0]
        rows = rows.drop(late.index)
        out = [late.assign(label=pd.array([None] * len(late), "Int64"), other=pd.array([None] * len(late), "Int64"))]
        if len(rows):
            places = rows.to_numpy(np.int64)
            first = grids.sparse_components(places, np.zeros(len(places), np.int64))
            tops, number = np.unique(first, return_inverse=True)
            label = upto + number
            out.append(rows.assign(label=pd.array(label, "Int64"), other=pd.array([None] * len(rows), "Int64")))
            if frame is not None and places[0, 0] == frame + 1:
                old = {(y, x): n for y, x, n in zip(ys, xs, labels)}
                pairs = {(int(n), old[y + dy, x + dx]) for (f, y, x), n in zip(places.tolist(), label) if f == frame + 1 for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (y + dy, x + dx) in old}
                if pairs:
                    a, b = zip(*sorted(pairs))
                    none = pd.array([None] * len(a), "Int64")
                    out.append(pd.DataFrame({"frame": none, "y": none, "x": none, "label": pd.array(a, "Int64"), "other": pd.array(b, "Int64")}))
            last = places[:, 0] == places[-1, 0]
            state.update((upto + len(tops), int(places[-1, 0]), places[last, 1].tolist(), places[last, 2].tolist(), label[last].tolist()))
        for part in out:
            if len(part):
                yield part.astype({c: "Int64" for c in (*columns, "label", "other")}).assign(**{recording: key[0]})[[recording, *columns, "label", "other"]]

    return stream.groupBy(recording).applyInPandasWithState(step, f"{recording} {kind}, frame int, y int, x int, label long, other long", _STATE, "append", GroupStateTimeout.NoTimeout)


def whole(rows: DataFrame, *, settle, recording="recording") -> DataFrame:
    """recording, frame, y, x, label: what `labelled` has written, with merged labels as one, numbered from 1 in order of first places."""
    node = lambda c: F.struct(recording, F.col(c).alias("n"))
    one, _ = roots(rows.where("other IS NOT NULL").select(node("label").alias("a"), node("other").alias("b")), settle)
    places = rows.where("label IS NOT NULL AND other IS NULL").withColumn("node", node("label"))
    places = settle(places.join(one, "node", "left").select(recording, "frame", "y", "x", F.coalesce("root", "node").alias("root")))
    order = places.groupBy(recording, "root").agg(F.min(F.struct("frame", "y", "x")).alias("_first"))
    order = order.select("root", F.row_number().over(W.partitionBy(recording).orderBy("_first")).alias("label"))
    return places.join(order, "root").select(recording, "frame", "y", "x", "label")
