"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the windows of every training text.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A window is 13 consecutive words of an
item; an item with fewer words, but not none, is one window. A hit is confirmed word by word, so hashes never decide.

Edge cases: a null or wordless text has no words and is not contaminated; an empty benchmark hits nothing; repeated
items and rows count as they stand (items by distinct id, a null id as an empty string); extra columns stay, except that
`contamination` replaces those with the names it adds.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WordHashes, as_bytes, batches, folded_words, pieces, plain, rolling, settle, unwrapped, wrapped

WINDOW = 13
#: A broadcast slice of the benchmark holds at most about so many bytes of text; a larger benchmark takes several slices.
SLICE_BYTES = 8_000_000

#: A word before A-Z are lower-cased, as a Java regular expression.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
FOUND = "_text string, _n long, _cover binary, _ids array<string>"
_report = batches({"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()})
_found = batches({"_text": pa.string(), "_n": pa.int64(), "_cover": pa.binary(), "_ids": pa.list_(pa.string())})


class Index:
    """The windows of some items by length and hash, as sorted arrays: about 20 bytes a window, and each distinct word once."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        by_text: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            by_text[text].add("" if item is None else str(item))
        self.ids = list(by_text.values())
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        parts = [np.fromiter(map(number, folded_words(text)), np.int32) for text in by_text]
        hashes = WordHashes(seed=7, most=1 << 62)
        self.hashes = np.r_[np.uint64(0), hashes.of(list(self.vocabulary))]
        self.words = np.concatenate(parts) if parts else np.empty(0, np.int32)
        begins = np.cumsum([0, *map(len, parts)])
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, words in enumerate(parts):
            if len(words):
                by_length[min(window, len(words))].append(k)
        self.windows = [(size, *self._sorted(size, ks, begins)) for size, ks in sorted(by_length.items())]

    def _sorted(self, size: int, ks: list[int], begins: np.ndarray) -> tuple:
        """A table of the hashes' first bits, the hashes in order, and where each window and of which item it is."""
        at = np.concatenate([np.arange(begins[k], begins[k + 1] - size + 1) for k in ks])
        item = np.repeat(np.array(ks), [begins[k + 1] - size + 1 - begins[k] for k in ks])
        h = rolling(self.hashes[self.words], size)[at]
        order = np.argsort(h, kind="stable")
        bits = int(min(max(len(h) * 8, 1 << 16), 1 << 26)).bit_length()
        seen = np.zeros(1 << bits, bool)
        seen[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        return seen, np.uint64(64 - bits), h[order], at[order].astype(np.int32), item[order].astype(np.int32)

    def hits(self, words: list[bytes]) -> list[tuple[int, int, set]]:
        """(first word, words, item ids) of every place where a window occurs, word for word."""
        found = []
        numbers = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        h = self.hashes[numbers]
        for size, seen, shift, hashes, at, item in self.windows:
            r = rolling(h, size)
            places = np.flatnonzero(seen[(r >> shift).astype(np.int64)])
            low, high = (np.searchsorted(hashes, r[places], side) for side in ("left", "right"))
            some = low < high
            for p, i, j in zip(places[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                same = (self.words[at[i:j, None] + np.arange(size)] == numbers[p : p + size]).all(1)
                if same.any():
                    found.append((p, size, set().union(*(self.ids[k] for k in np.unique(item[i:j][same]).tolist()))))
        return found


def _flat(column) -> tuple[list[bytes], list[int]]:
    """The words of a batch in one list, an empty word after each text, and where each text begins."""
    words, begins = [], []
    for text in as_bytes(column):
        begins.append(len(words))
        words += folded_words(text)
        words.append(b"")
    begins.append(len(words))
    return words, begins


def _slices(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The distinct items in slices of bounded size, by hash of id and text, so that neither repeated items nor a text with
    many ids make a large one: one slice for all but very large benchmarks."""
    items = plain(benchmark, "item_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n = -(-2 * size // limit) if size > limit else 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _report_of(sizes, hits, ids: list[list[str]], share: int) -> pa.RecordBatch:
    n, hit = np.asarray(sizes, np.int64), np.asarray(hits, np.int64)
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
    return _report({"n_words": n, "n_hit": hit, "n_items": [len(x) for x in ids], "items_sha256": digests, "contaminated": (hit > 0) & (share * hit >= n)})


def _hits(index: Index, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Of a batch of texts: where each begins and ends among all its words, which words are hit, and the ids of each text."""
    words, begins = _flat(column)
    starts, ends = np.array(begins[:-1], np.int64), np.array(begins[1:], np.int64) - 1
    covered = np.zeros(len(words), np.uint8)
    ids: dict[int, set] = defaultdict(set)
    for p, size, items in index.hits(words):
        covered[p : p + size] = 1
        ids[int(np.searchsorted(starts, p, "right")) - 1] |= items
    return starts, ends, covered, [sorted(ids.get(i, ())) for i in range(len(starts))]


def _index(part: DataFrame, window: int):
    return part.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"].encode()) for r in part.collect()], window))


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, share: int, slice_bytes: int) -> DataFrame:
    """_row, text and the report of each row of docs."""
    out = wrapped(docs, "text")
    slices = _slices(benchmark, slice_bytes)
    if len(slices) > 1:
        return _judged_in_slices(out, slices, window, share)
    index = _index(slices[0], window)

    def scan(parts):
        for batch in pieces(parts):
            starts, ends, covered, ids = _hits(index.value, batch.column(1))
            total = np.r_[0, np.cumsum(covered, dtype=np.int64)]
            more = _report_of(ends - starts, total[ends] - total[starts], ids, share)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *more.columns], names=["_row", "text", *more.schema.names])

    return out.mapInArrow(scan, StructType([*out.schema.fields[:2], *StructType.fromDDL(REPORT).fields]))


def _judged_in_slices(rows: DataFrame, slices: list[DataFrame], window: int, share: int) -> DataFrame:
    """As `_judged`, for a benchmark of several slices: each slice scans the texts and leaves only what it hit (the digest of
    the text, its number of words, a bit for each word, item ids); the texts are joined to all of it once, in the end."""
    digest = F.sha2("text", 256)
    found = []
    for part in slices:
        index = _index(part, window)

        def scan(parts, index=index):
            for batch in pieces(parts):
                starts, ends, covered, ids = _hits(index.value, batch.column(1))
                hit = [i for i, x in enumerate(ids) if x]
                cover = [np.packbits(covered[starts[i] : ends[i]]).tobytes() for i in hit]
                yield _found({"_text": batch.column(0).take(pa.array(hit, pa.int64())), "_n": (ends - starts)[hit], "_cover": cover, "_ids": [ids[i] for i in hit]})

        found.append(settle(rows.where("text IS NOT NULL").select(digest, "text").mapInArrow(scan, FOUND), "benchmark-hits"))
    # Copies of a text leave equal rows: tasks reduce them before the shuffle, and a digest keeps a row for each slice.
    every = reduce(DataFrame.unionByName, found).groupBy("_text").agg(F.first("_n").alias("_n"), F.collect_set("_cover").alias("_covers"), F.array_distinct(F.flatten(F.collect_set("_ids"))).alias("_ids"))

    def merge(parts):
        for batch in pieces(parts):
            hits, ids = [], [sorted(x) for x in batch.column(3).to_pylist()]
            for covers in batch.column(2).to_pylist():
                bits = np.bitwise_or.reduce([np.frombuffer(c, np.uint8) for c in covers])
                hits.append(int(np.unpackbits(bits).sum()))
            more = _report_of(batch.column(1).to_numpy(), hits, ids, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), *more.columns], names=["_text", *more.schema.names])

    report = settle(every.mapInArrow(merge, f"_text string, {REPORT}").drop("n_words"), "benchmark-report")
    counted = rows.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))
    joined = counted.join(report, digest == F.col("_text"), "left")
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "contaminated": F.lit(False)}
    return joined.select("_row", "text", "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = 20, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside windows), n_items, items_sha256 and contaminated (share * n_hit >= n_words).

    One slice of the benchmark is broadcast at a time: with one slice that is one scan of the texts; with more, each scan
    leaves a table of the texts it hit, and the texts are shuffled once, to be joined to all of them.
    """
    return unwrapped(_judged(docs, benchmark, window, share, slice_bytes), docs, *[x.split()[0] for x in REPORT.split(", ")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    return unwrapped(_judged(docs, benchmark, window, share, SLICE_BYTES).where(~F.col("contaminated")), docs)
