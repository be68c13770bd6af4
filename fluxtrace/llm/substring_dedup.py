"""Substring dedup with a log-structured fingerprint index.

A window is 13 consecutive words of one document. A word goes if a window that covers it also starts in a document with a
smaller id; windows are judged on the input.

Keeping a fingerprint of every window would cost more than the texts. Instead windows are grouped: the smallest hash of
the five-word grams in a window (its minimiser) depends on the window alone, so equal windows have equal minimisers.
Consecutive windows with one minimiser form a stretch, five or so windows long; the index holds (minimiser, fingerprint
of the stretch's words, smallest document). The documents come in batches of rising ids. Each batch's stretches are
merged, on the minimiser, with the sorted immutable runs of all batches before it. Runs are tables bucketed and sorted by
minimiser, so a batch is shuffled to where they lie and history never moves:

* a stretch seen in an earlier document goes as a whole;
* a stretch whose minimiser occurs in an earlier document inside another stretch is undecided: shared text begins or
  ends there. Its windows are compared one by one with those of the other stretches;
* all others stay.

Stretches are equal if minimiser and fingerprint are, windows if two fingerprints are: 128 bits each time, over 64-bit
hashes of the words. That is the verification; texts of different documents are not brought together to compare words.

Each batch leaves a new sorted run of what it first saw. Runs have levels: so many of one level are compacted into one of
the next, so a row is written again once a level, and levels grow with the logarithm of the batches. An index that the caller passes
also keeps the compressed texts of every batch, which is less than their windows' fingerprints: undecided stretches of
earlier calls are compared window by window from them. It lives in a folder and can be opened again. The last batch of a
call with an index of its own, which no batch follows, leaves no run.

Text that a large share of all documents hold would gather in one task. Minimisers and stretches that would fill a
good part of a bucket, by a sample of the documents (lists of bounded length, which change the plan only), are hot: hot stretches are reduced to their
smallest document in each scan task and judged from a broadcast list in the end, all others of a hot minimiser are dealt by
fingerprint and count as undecided. Windows are judged by an aggregate and a join, which Spark can split.

Edge cases: null texts have no words; texts of fewer than 13 words have no window; rows with one id are one document's
(they don't remove each other's words) and each gives a row; rows with a null id keep all words and remove none; an empty
table gives an empty result; columns other than doc_id and text do not matter. A stretch is one row for each document
however often it occurs in it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from .common import ODD, WordHashes, as_bytes, batches, mixed, pieces, plain, plain_words, rolling, scratch, settle

WIDTH, GRAM = 13, 5
#: Shares of the documents in the batches of one call: small ones first, which also exercises the compaction.
BATCHES = (0.1, 0.1, 0.8)
#: So many runs of one level are compacted into one of the next.
FAN_IN = 2
#: Text in fewer documents of the sample is never hot.
LEAST_HOT = 8

_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


class Powers:
    """Powers of the multiplier and of its inverse, as many as the longest text so far needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, ODD)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)], dtype=np.uint64)
        return self.up, self.down


def stretches(h: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, fingerprint, first window and end (exclusive) of each stretch of a text, from the hashes of its words."""
    n = len(h) - WIDTH + 1
    if n <= 0:
        e = np.empty(0, np.uint64)
        return e, e, e.astype(np.int64), e.astype(np.int64)
    low, span = rolling(h, GRAM), 1
    while 2 * span <= WIDTH - GRAM + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = WIDTH - GRAM + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:])
    begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    end = np.r_[begin[1:], n]
    up, down = powers.get(len(h) + 1)
    total = np.r_[np.uint64(0), np.cumsum(mixed(h ^ np.uint64(0x5BD1E995A7F3C2D1)) * up[: len(h)], dtype=np.uint64)]
    last = end + WIDTH - 1
    mark = mixed((total[last] - total[begin]) * down[begin] + (last - begin).astype(np.uint64))
    return low[begin], mark, begin, end


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of each window."""
    return rolling(h, WIDTH), rolling(mixed(h ^ np.uint64(0x27D4EB2F165667C5)), WIDTH)


_stretch = batches({"k": pa.int64(), "s": pa.int64(), "doc": pa.int64()})
_window = batches({"f": pa.int64(), "g": pa.int64(), "doc": pa.int64()})
_packed = batches({"doc_id": pa.int64(), "packed": pa.binary()})
_out = batches({"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()})


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)


class Hot(NamedTuple):
    """Sorted minimisers and stretches that many documents hold."""

    minimisers: np.ndarray = np.empty(0, np.uint64)
    stretches: np.ndarray = np.empty(0, np.uint64)


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def keys(m: np.ndarray, s: np.ndarray, hot: Hot) -> np.ndarray:
    """Where a stretch is dealt: by its minimiser (even numbers), by its fingerprint too where that is hot (odd numbers)."""
    even = m & ~np.uint64(1)
    return np.where(_among(m, hot.minimisers), mixed(even + (s & np.uint64(0xFFFF)) * ODD) | np.uint64(1), even)


def stretch_rows(docs: DataFrame, hot: Hot = Hot()) -> DataFrame:
    """(k, s, doc): the stretches of each document, each once; hot stretches once for each time their smallest document falls in a task."""

    def find(parts):
        hashes, powers, least = WordHashes(), Powers(), {}
        for batch in pieces(parts):
            ks, ss, ds = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                m, s, _, _ = stretches(hashes.of(plain_words(text)), powers)
                if len(s):
                    s, first = np.unique(s, return_index=True)
                    m = m[first]
                    if len(hot.stretches):
                        keep = ~_among(s, hot.stretches)
                        for i in np.flatnonzero(~keep).tolist():
                            if least.get(x := int(s[i]), doc + 1) > doc:
                                least[x], keep[i] = doc, True
                        m, s = m[keep], s[keep]
                    ks.append(keys(m, s, hot))
                    ss.append(s)
                    ds.append(np.full(len(s), doc))
            yield _stretch({"k": _joined(ks), "s": _joined(ss), "doc": _joined(ds)})

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(find, "k long, s long, doc long")


def frequent(docs: DataFrame, *, one_in: int, rows_share: float, most: int) -> Hot:
    """Minimisers and stretches with more than a share of all rows, told from a sample of the documents (by hash of the id)."""
    some = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(one_in)) == 0))
    rows = settle(stretch_rows(some), "sample")
    least = max(LEAST_HOT, int(rows_share * rows.count()))
    often = lambda c: rows.groupBy(*c).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), *c).limit(most).collect()
    k = np.array([r["k"] for r in often(["k"])], np.int64).view(np.uint64)
    # Hot stretches all have a hot minimiser, so that the row of their smallest document is among the undecided.
    s = np.array([(r["k"], r["s"]) for r in often(["k", "s"])], np.int64).reshape(-1, 2).view(np.uint64)
    return Hot(np.sort(np.concatenate([k, k | np.uint64(1)])), np.sort(s[np.isin(s[:, 0], k), 1]))


class FingerprintIndex:
    """Sorted immutable runs of (k, s, doc), doc the smallest document with that stretch, and the compressed texts behind
    them, in a folder. Each change writes a new generation of the list of parts; `FingerprintIndex(spark, folder)` opens
    the last one. `close` takes its tables out of the session's catalog, `vacuum` deletes files of parts that compaction has replaced."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, fan_in: int = FAN_IN):
        self.fan_in, self.tables = fan_in, []
        self.spark, self.folder = spark, folder or f"{scratch(spark)}/index-{uuid.uuid4().hex}"
        self.runs: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.parts: dict[str, list[str]] = {"run": [], "text": []}
        self.hot, self.generation = Hot(), 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if folder and (last := self._last()):
            self.generation, self.buckets, self.parts = last["generation"], last["buckets"], {k: list(last[k]) for k in self.parts}
            self.hot = Hot(*(np.array(last[k], np.int64).view(np.uint64) for k in ("minimisers", "stretches")))
            self.runs = [self._table(p) for p in self.parts["run"]]
            self.texts = [spark.read.parquet(p) for p in self.parts["text"]]

    _LIST = "generation long, buckets int, run array<string>, text array<string>, minimisers array<long>, stretches array<long>"

    def _last(self):
        try:
            return self.spark.read.schema(self._LIST).parquet(f"{self.folder}/list").orderBy(F.desc("generation")).first()
        except AnalysisException:  # a folder without an index yet
            return None

    def save(self) -> None:
        """Writes down which parts the index has now."""
        self.generation += 1
        row = (self.generation, self.buckets, self.parts["run"], self.parts["text"], *(x.view(np.int64).tolist() for x in self.hot))
        self.spark.createDataFrame([row], self._LIST).coalesce(1).write.mode("append").parquet(f"{self.folder}/list")

    def _table(self, path: str) -> DataFrame:
        """A run as a bucketed table, which Spark reads without a shuffle."""
        name = "fluxtrace_run_" + path.rsplit("-", 1)[1]
        self.tables.append(name)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (k BIGINT, s BIGINT, doc BIGINT) USING parquet CLUSTERED BY (k) SORTED BY (k, s) INTO {self.buckets} BUCKETS LOCATION '{path}/run=1'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, level: int = 0) -> str:
        """Rows that are dealt by k into the index's buckets, as sorted bucketed files: those of the run in a folder of their own, whose
        name begins with its level."""
        path = f"{self.folder}/run-{level}-{uuid.uuid4().hex}"
        self.tables.append("fluxtrace_batch_" + path.rsplit("-", 1)[1])
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", path)
        writer.partitionBy("run").bucketBy(self.buckets, "k").sortBy("k", "s").saveAsTable("fluxtrace_batch_" + path.rsplit("-", 1)[1])
        return path

    def add(self, docs: DataFrame, *, keep_run: bool = True, keep_texts: bool = True) -> DataFrame:
        """Merges a batch whose ids are all larger than those before. Returns (doc, s, whole): stretches that go as a
        whole, and undecided ones with those to compare them with; of hot stretches only the smallest document.
        keep_run: whether the batch becomes a run; keep_texts: whether its texts are kept for later calls."""
        rows = stretch_rows(docs, self.hot).repartition(self.buckets, "k").withColumn("new", F.lit(True))
        for run in self.runs:
            rows = rows.unionByName(run.withColumn("new", F.lit(False)))
        same, group = W.partitionBy("k", "s"), W.partitionBy("k")
        rows = rows.select(
            "*", F.min("doc").over(group).alias("low"), F.max("doc").over(group).alias("high"),
            (F.min("s").over(group) != F.max("s").over(group)).alias("several"),
        ).withColumn("first", F.min("doc").over(same))
        whole = F.col("new") & (F.col("first") < F.col("doc"))
        open_ = (F.col("first") == F.col("doc")) & (F.col("k").bitwiseAND(1) == 1) | (F.col("first") == F.col("doc")) & F.col("several") & (F.col("low") < F.col("high"))
        rows = rows.select("k", "s", "doc", whole.alias("whole"), open_.alias("open"), (F.col("new") & (F.col("first") == F.col("doc"))).cast("int").alias("run"))
        wanted = F.col("whole") | F.col("open")
        if keep_texts:
            self.keep(_pack(docs))
        if not keep_run:
            return settle(rows.where(wanted).select("doc", "s", "whole"), "stretches")
        path = self._write(rows.where(wanted | (F.col("run") == 1)))
        kept = self.spark.read.schema("k long, s long, doc long, whole boolean, open boolean").parquet(path)
        self.parts["run"].append(path)
        self.runs.append(self._table(path))
        self.compact()
        self.save()
        return kept.where("whole or open").select("doc", "s", "whole")

    def keep(self, packed: DataFrame) -> None:
        """Keeps compressed texts, so that the windows of their stretches can be made again."""
        path = f"{self.folder}/text-{uuid.uuid4().hex}"
        packed.where("doc_id is not null").write.option("compression", "none").parquet(path)
        self.parts["text"].append(path)
        self.texts.append(self.spark.read.schema(packed.schema).parquet(path))
        self.save()

    def levels(self) -> list[int]:
        """The level of each run."""
        return [int(p.rsplit("/", 1)[1].split("-")[1]) if p.rsplit("/", 1)[1].count("-") > 1 else 0 for p in self.parts["run"]]

    def compact(self) -> None:
        """Merges runs of one level into a sorted run of the next, wherever there are `fan_in` of them; their buckets fit, so nothing is
        shuffled, and runs of other levels are not read."""
        while full := [n for n in sorted(set(self.levels())) if self.levels().count(n) >= self.fan_in]:
            at = {i for i, n in enumerate(self.levels()) if n == full[0]}
            merged = reduce(DataFrame.unionByName, [self.runs[i] for i in at]).groupBy("k", "s").agg(F.min("doc").alias("doc"))
            path = self._write(merged.withColumn("run", F.lit(1)), full[0] + 1)
            rest = [i for i in range(len(self.runs)) if i not in at]
            self.parts["run"], self.runs = [*(self.parts["run"][i] for i in rest), path], [*(self.runs[i] for i in rest), self._table(path)]

    def close(self) -> None:
        """Takes the index's tables out of the session's catalog; files stay, and the index can be opened again."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables, self.runs = [], []

    def vacuum(self) -> list[str]:
        """Deletes the files of runs that compaction has replaced, and returns their folders. Only when no result of an earlier call is
        still to be read: results of a call read what its batches left."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = {p.rsplit("/", 1)[1] for p in self.parts["run"]}
        gone = [f.getPath() for f in system.listStatus(top) if f.getPath().getName().startswith("run-") and f.getPath().getName() not in kept]
        for path in gone:
            system.delete(path, True)
        return [path.getName() for path in gone]

    def _replace_runs(self, rows: DataFrame) -> None:
        path = self._write(rows.withColumn("run", F.lit(1)), max(self.levels(), default=0))
        self.parts["run"], self.runs = [path], [self._table(path)]

    def heat(self, docs: DataFrame, **limits) -> None:
        """Takes what is hot in these documents into the index's list. Runs written before are made again from the texts
        if that changes where their stretches belong; without a change nothing moves."""
        found = frequent(docs, **limits)
        if self.runs:
            if not len(np.setdiff1d(found.minimisers, self.hot.minimisers)):
                return
            self.hot = Hot(*(np.union1d(a, b) for a, b in zip(self.hot, found, strict=True)))
            texts = _unpack(reduce(DataFrame.unionByName, self.texts))
            rows = stretch_rows(texts, self.hot).repartition(self.buckets, "k")
            self._replace_runs(rows.groupBy("k", "s").agg(F.min("doc").alias("doc")))
            self.save()
        else:
            self.hot = found


def _pack(docs: DataFrame) -> DataFrame:
    """Texts compressed, so that they take less room in shuffles."""

    def pack(parts):
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(parts):
            yield _packed({"doc_id": batch.column(0), "packed": [compress(t or b"") for t in as_bytes(batch.column(1))]})

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, packed binary")


def _unpack(packed: DataFrame) -> DataFrame:
    def unpack(parts):
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in pieces(parts):
            texts = pa.array([decompress(x) for x in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return packed.select("doc_id", "packed").mapInArrow(unpack, "doc_id long, text string")


def _judge_windows(packed: DataFrame, undecided: DataFrame) -> DataFrame:
    """(doc, f): windows of undecided stretches that also start in a smaller document."""
    lists = undecided.groupBy("doc").agg(F.collect_set("s").alias("open"))

    def find(parts):
        hashes, powers = WordHashes(), Powers()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in pieces(parts):
            fs, gs, ds = [], [], []
            for doc, data, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = hashes.of(plain_words(unpack(data)))
                _, s, begin, end = stretches(h, powers)
                f, g = windows(h)
                at = np.isin(s.view(np.int64), np.array(open_, np.int64))
                inside = np.zeros(len(f) + 1, np.int64)
                np.add.at(inside, begin[at], 1)
                np.add.at(inside, end[at], -1)
                inside = np.flatnonzero(np.cumsum(inside)[:-1])
                f, g = f[inside], g[inside]
                f, first = np.unique(f, return_index=True)
                fs.append(f)
                gs.append(g[first])
                ds.append(np.full(len(f), doc))
            yield _window({"f": _joined(fs), "g": _joined(gs), "doc": _joined(ds)})

    rows = packed.join(lists, packed["doc_id"] == lists["doc"]).select("doc_id", "packed", "open").mapInArrow(find, "f long, g long, doc long")
    rows = settle(rows, "windows")
    first = rows.groupBy("f", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    first = settle(first.select(F.col("f").alias("_f"), F.col("g").alias("_g"), "first"), "shared-windows")
    return rows.join(first, (F.col("f") == F.col("_f")) & (F.col("g") == F.col("_g"))).where("first < doc").select("doc", "f")


def removed(words: list[bytes], hashes: WordHashes, powers: Powers, whole: np.ndarray, single: np.ndarray, before: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Which words go, from the text's stretches and windows that do; before: which stretches are hot and go."""
    h = hashes.of(words)
    cover = np.zeros(len(words) + 1, np.int64)
    _, s, begin, end = stretches(h, powers)
    at = np.isin(s.view(np.int64), whole) | before(s)
    np.add.at(cover, begin[at], 1)
    np.add.at(cover, end[at] + WIDTH - 1, -1)
    if len(single):
        at = np.flatnonzero(np.isin(rolling(h, WIDTH).view(np.int64), single))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WIDTH, -1)
    return np.cumsum(cover)[:-1] > 0


def _hot_firsts(rows: DataFrame, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Hot stretches, sorted, and the smallest document of each: as many rows as there are hot stretches."""
    if not len(hot.stretches):
        return hot.stretches, np.empty(0, np.int64)
    some = rows.sparkSession.createDataFrame([(x,) for x in hot.stretches.view(np.int64).tolist()], "_s long")
    found = rows.join(F.broadcast(some), F.col("s") == F.col("_s")).groupBy("s").agg(F.min("doc").alias("doc")).collect()
    s = np.array([r["s"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], np.array([r["doc"] for r in found], np.int64)[order]


def _rewrite(packed: DataFrame, whole: DataFrame, single: DataFrame, hot: tuple[np.ndarray, np.ndarray], texts: bool) -> DataFrame:
    marks = whole.select("doc", F.col("s").alias("w"), F.lit(None).cast("long").alias("f")).unionByName(single.select("doc", F.lit(None).cast("long").alias("w"), "f"))
    marks = marks.groupBy("doc").agg(F.collect_set("w").alias("w"), F.collect_set("f").alias("f"))
    hot = packed.sparkSession.sparkContext.broadcast(hot)

    def rewrite(parts):
        hashes, powers = WordHashes(), Powers()
        unpack = zstandard.ZstdDecompressor().decompress
        known, least = hot.value
        for batch in pieces(parts):
            docs, sizes, gone, digests, kept = [], [], [], [], []
            for doc, data, whole_, single_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = plain_words(unpack(data))
                sizes.append(len(words))
                if doc is not None and (whole_ or single_ or len(known)):

                    def before(s, doc=doc):
                        return _among(s, known) & (least[np.minimum(np.searchsorted(known, s), len(known) - 1)] < doc) if len(known) else np.zeros(len(s), bool)

                    out = removed(words, hashes, powers, np.array(whole_ or [], np.int64), np.array(single_ or [], np.int64), before)
                    words = [w for w, o in zip(words, out.tolist(), strict=True) if not o] if out.any() else words
                rest = b" ".join(words)
                docs.append(doc)
                gone.append(sizes[-1] - len(words))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode() if texts else None)
            yield _out({"doc_id": docs, "n_words": sizes, "n_removed": gone, "kept_sha256": digests, "kept": kept})

    both = packed.join(marks, packed["doc_id"] == marks["doc"], "left").select("doc_id", "packed", "w", "f")
    return both.mapInArrow(rewrite, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(
    docs: DataFrame, *, index: FingerprintIndex | None = None, batch_shares: tuple[float, ...] = BATCHES, texts: bool = True,
    one_in: int = 64, part: float = 0.25, most: int = 50_000,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (the words that stay, joined by spaces) of every row.

    index: what earlier calls saw, with smaller ids; these documents are added to it whole. one_in, part, most: the sample
    that tells hot text, the part of a bucket that one minimiser fills if it is hot, and the length of the lists; results don't
    depend on them.
    """
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    passed = index is not None
    index = index if passed else FingerprintIndex(docs.sparkSession)
    index.heat(docs, one_in=one_in, rows_share=part / index.buckets, most=most)
    history, earlier = list(index.texts), [r.select("s", "doc") for r in index.runs]
    cuts = np.cumsum(batch_shares)[:-1].tolist()
    bounds = sorted(set(map(int, docs.where("doc_id is not null").approxQuantile("doc_id", cuts, 0.01)))) if cuts else []
    found = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = docs.where(F.lit(True) if low is None else F.col("doc_id") > low).where(F.lit(True) if high is None else F.col("doc_id") <= high)
        found.append(index.add(part, keep_run=passed or high is not None, keep_texts=False))
    marks = reduce(DataFrame.unionByName, found)
    packed = _pack(docs)
    if passed:
        index.keep(packed)
    hot = _hot_firsts(reduce(DataFrame.unionByName, [m.select("s", "doc") for m in found] + earlier), index.hot)
    single = _judge_windows(reduce(DataFrame.unionByName, history, packed), marks.where("not whole"))
    out = _rewrite(packed, marks.where("whole"), single, hot, texts)
    if not passed:
        index.close()  # what is left to read is read by path
    return out if texts else out.drop("kept")
