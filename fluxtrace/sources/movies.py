"""Movies as a Spark data source: raw 16-bit frames and TIFF stacks, plain or packed (PackBits, LZW, Deflate), which tasks unpack.

    spark.dataSource.register(RawMovie)
    spark.read.format("raw_movie").options(path=..., width=512, height=512, start=0, end=900).load()

Rows are frames: (frame int, h int, w int, data array<int>), handed to Spark as Arrow batches of one frame. A partition is a
range of frames, so a read of frames [start, end) opens only those; with the option pushdown=true, which needs Spark's setting spark.sql.python.filterPushdown.enabled, a
condition on `frame` does the same. `dtype` is the type of a raw sample (uint16 by default; uint8, int16, ...). `pixels`
turns frames into pixel rows. Files must be in a folder that executors can open.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.packing import UNPACK, undifferenced

SCHEMA = "frame int, h int, w int, data array<int>"
#: Frames of one partition.
FRAMES = 500


class Frames(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


#: The frames [low, high) that a condition leaves.
_BOUNDS = {
    EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, None), GreaterThanOrEqual: lambda v: (v, None),
    LessThan: lambda v: (None, v), LessThanOrEqual: lambda v: (None, v + 1),
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.channel, self.n_channels = int(options.get("channel", 0)), int(options.get("n_channels", 1))
        if self.n_channels > 2:
            raise NotImplementedError("movies have one or two channels")
        self.open(options)
        self.start, self.end = int(options.get("start", 0)), min(int(options.get("end", self.n)), self.n)

    def partitions(self):
        step = FRAMES
        return [Frames(i, min(i + step, self.end)) for i in range(self.start, max(self.end, self.start), step)] or [Frames(0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as file:
            for i in range(partition.first, partition.last):
                if i % self.n_channels == self.channel or self.n_channels == 1:
                    values = pa.array(self.frame(file, i).astype(np.int32).ravel())
                    data = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                    one = [pa.array([x], pa.int32()) for x in (i // self.n_channels, self.height, self.width)]
                    yield pa.RecordBatch.from_arrays([*one, data], names=["frame", "h", "w", "data"])


class _RawReader(_Reader):
    def open(self, options: dict) -> None:
        size = Path(self.path).stat().st_size
        self.dtype = np.dtype(options.get("dtype", "uint16")).newbyteorder("<")
        if "width" in options:
            self.width, self.height = int(options["width"]), int(options["height"])
        else:
            # Without a stated size: a preview beside the file, else a usual square that divides the file.
            preview = next((p for c in ("ChanC", "ChanA") if (p := Path(self.path).parent / f"{c}_Preview.tif").exists()), None)
            if preview:
                with preview.open("rb") as f:
                    _, self.width, self.height, *_ = tiff_pages(f)[0]
            else:
                self.width = self.height = next((s for s in (512, 256, 1024, 128) if size % (self.dtype.itemsize * s * s) == 0), 512)
        self.n = size // (self.dtype.itemsize * self.width * self.height)

    def frame(self, file, i: int) -> np.ndarray:
        size = self.dtype.itemsize * self.width * self.height
        file.seek(i * size)
        return np.frombuffer(file.read(size), self.dtype).reshape(self.height, self.width)


_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def tiff_pages(file) -> list[tuple[str, int, int, int, list[int], list[int], int, int]]:
    """(byte order, width, height, bits, strip offsets, strip sizes, compression, predictor) of each page of a grey TIFF or BigTIFF."""
    file.seek(0)
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    pages = []
    while at:
        file.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))[0]
        entry, inline = (20, 8) if big else (12, 4)
        table = file.read(n * entry)
        at = struct.unpack(order + ("Q" if big else "I"), file.read(8 if big else 4))[0]
        tags = {}
        for k in range(n):
            e = table[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
            if kind in _TYPES:
                size = struct.calcsize(_TYPES[kind]) * count
                raw = e[-inline:]
                if size > inline:
                    file.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
                    raw = file.read(size)
                tags[tag] = list(struct.unpack(order + _TYPES[kind] * count, raw[:size]))
        packing, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
        if packing not in UNPACK or predictor > 2:
            raise NotImplementedError(f"TIFF with compression {packing} and predictor {predictor}")
        pages.append((order, tags[256][0], tags[257][0], tags.get(258, [8])[0], tags[273], tags[279], packing, predictor))
    return pages


class _TiffReader(_Reader):
    def open(self, options: dict) -> None:
        with open(self.path, "rb") as file:
            self.pages = tiff_pages(file)
        _, self.width, self.height, *_ = self.pages[0]
        self.n = len(self.pages)

    def frame(self, file, i: int) -> np.ndarray:
        order, width, height, bits, offsets, sizes, packing, predictor = self.pages[i]
        data = b""
        for o, s in zip(offsets, sizes, strict=True):
            file.seek(o)
            data += UNPACK[packing](file.read(s))
        frame = np.frombuffer(data, f"{order}u{bits // 8}", height * width).reshape(height, width)
        return undifferenced(frame) if predictor == 2 else frame


class _Pushed:
    """Readers that take conditions on the frame's number."""

    def pushFilters(self, filters):
        """Takes bounds on the frame's number into the range that is read; anything else is left to Spark."""
        n = self.n_channels
        for f in filters:
            bound = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("frame",) or not isinstance(bound, int) or type(f) not in _BOUNDS:
                yield f
                continue
            low, high = _BOUNDS[type(f)](bound)
            self.start = self.start if low is None else max(self.start, low * n)
            self.end = self.end if high is None else min(self.end, high * n)


class _PushedRaw(_Pushed, _RawReader):
    pass


class _PushedTiff(_Pushed, _TiffReader):
    pass


class Part(WriterCommitMessage):
    """What a task has written: how many frames, the first, the last and the sum of their numbers."""

    def __init__(self, n: int, first: int, last: int, total: int):
        self.n, self.first, self.last, self.total = n, first, last, total


class _Writer(DataSourceWriter):
    """Frames written by tasks at their places in one file that has another name until all are there.

    The place of a frame follows from its number and the size of a frame (options width and height), so tasks don't wait for each
    other, a task that runs again writes the same bytes, and the driver sees only counts. The file must lie in a folder that all
    executors share. Frames are numbered from 0 without gaps; else, or if a task fails, nothing is left.
    """

    head = 0

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        if not overwrite and Path(self.path).exists():
            raise FileExistsError(self.path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.size = 2 * self.width * self.height

    def block(self, frame: int, data: bytes) -> bytes:
        return data

    def write(self, rows) -> Part:
        n, first, last, total = 0, 1 << 62, -1, 0
        Path(self.part).parent.mkdir(parents=True, exist_ok=True)
        file = os.open(self.part, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for r in rows:
                if (r["h"], r["w"]) != (self.height, self.width) or len(r["data"]) != self.width * self.height:
                    raise ValueError(f"frame {r['frame']} is {r['h']} x {r['w']}, not {self.height} x {self.width}")
                block = self.block(r["frame"], np.asarray(r["data"], np.int64).astype("<u2").tobytes())
                os.pwrite(file, block, self.head + r["frame"] * len(block))
                n, first, last, total = n + 1, min(first, r["frame"]), max(last, r["frame"]), total + r["frame"]
        finally:
            os.close(file)
        return Part(n, first, last, total)

    def finish(self, file: int, n: int) -> None:
        """What is only known when all frames are there."""

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        n = sum(m.n for m in done)
        if n and (min(m.first for m in done if m.n) != 0 or max(m.last for m in done) != n - 1 or sum(m.total for m in done) != n * (n - 1) // 2):
            self.abort(messages)
            raise ValueError(f"the frames are not numbered from 0 to {n - 1}")
        file = os.open(self.part, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            self.finish(file, n)
        finally:
            os.close(file)
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        Path(self.part).unlink(missing_ok=True)


class _TiffWriter(_Writer):
    """BigTIFF: before each frame its table of tags, so that blocks have one size; the last table ends the list when all are there."""

    head = 16
    TAGS = 9

    def block(self, frame: int, data: bytes) -> bytes:
        table = 8 + self.TAGS * 20 + 8
        at = self.head + frame * (table + len(data))
        tags = [(256, self.width), (257, self.height), (258, 16), (259, 1), (262, 1), (273, at + table), (277, 1), (278, self.height), (279, len(data))]
        out = struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 16, 1, v) for t, v in tags)
        return out + struct.pack("<Q", at + table + len(data)) + data

    def finish(self, file: int, n: int) -> None:
        table = 8 + self.TAGS * 20 + 8
        os.pwrite(file, struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 if n else 0), 0)
        if n:
            os.pwrite(file, struct.pack("<Q", 0), self.head + (n - 1) * (table + self.size) + table - 8)


class RawMovie(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_movie"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushedRaw if self.options.get("pushdown") == "true" else _RawReader)(dict(self.options))


class TiffMovie(RawMovie):
    @classmethod
    def name(cls) -> str:
        return "tiff_movie"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TiffWriter(dict(self.options), overwrite)

    def reader(self, schema) -> DataSourceReader:
        return (_PushedTiff if self.options.get("pushdown") == "true" else _TiffReader)(dict(self.options))


def pixels(frames: DataFrame, recording: str) -> DataFrame:
    """recording, frame, y, x, v of every pixel."""
    out = frames.select(F.lit(recording).alias("recording"), "frame", "w", F.posexplode("data").alias("_i", "v"))
    return out.select("recording", "frame", F.expr("_i div w").alias("y"), (F.col("_i") % F.col("w")).alias("x"), "v")


def frames_of(pixels: DataFrame) -> DataFrame:
    """Rows (frame, h, w, data) of one recording's pixels (frame, y, x, v), 0 where a pixel is absent: what the sinks take."""
    size = pixels.agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w")).first()
    h, w = size["h"] or 1, size["w"] or 1
    lists = pixels.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * w + F.col("x")).cast("int"), F.col("v").cast("int")))).alias("_v"))
    data = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at("_v", i), F.lit(0)))
    return lists.select(F.col("frame").cast("int").alias("frame"), F.lit(h).alias("h"), F.lit(w).alias("w"), data.alias("data"))


def write_movie(frames: DataFrame, path: str, kind: str, *, width: int, height: int, overwrite: bool = True) -> None:
    """Writes rows (frame, h, w, data) as one raw or BigTIFF file (kind raw_movie or tiff_movie) from the tasks that hold them."""
    frames.sparkSession.dataSource.register(TiffMovie if kind == "tiff_movie" else RawMovie)
    frames.select("frame", "h", "w", "data").write.format(kind).options(path=path, width=width, height=height).mode("overwrite" if overwrite else "append").save()


def write_raw(frames: np.ndarray, path: str) -> None:
    frames.astype("<u2").tofile(path)


def write_tiff(frames: np.ndarray, path: str) -> None:
    """Frames as an uncompressed 16-bit grey TIFF; BigTIFF from 2 GiB."""
    frames = frames.astype("<u2")
    n, height, width = frames.shape
    big = frames.nbytes >= 1 << 31
    word, entry = ("<Q", 20) if big else ("<I", 12)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
        for k, frame in enumerate(frames):
            tags = [(256, width), (257, height), (258, 16), (259, 1), (262, 1), (273, 0), (277, 1), (278, height), (279, frame.nbytes)]
            at = f.tell()
            data = at + (8 if big else 2) + len(tags) * entry + (8 if big else 4)
            f.write(struct.pack("<Q" if big else "<H", len(tags)))
            for tag, value in tags:
                value = data if tag == 273 else value
                f.write(struct.pack("<HHQQ", tag, 16, 1, value) if big else struct.pack("<HHII", tag, 4, 1, value))
            f.write(struct.pack(word, 0 if k == n - 1 else data + frame.nbytes))
            f.write(frame.tobytes())
