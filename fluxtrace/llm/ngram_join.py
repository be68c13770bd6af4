"""N-gram Jaccard self-join with Bayesian candidate pruning: which texts share at least 0.8 of their five-word shingles.

1. Each text becomes the set of its five-word shingles (a shorter text is one shingle), a digest of that set and 128
   MinHash values. Texts with equal sets are copies: one of them, the representative, stands for all from here on.
2. Candidates share one of 32 bands of four MinHash values. A pair of similarity 0.8 shares none with a probability of
   (1 - 0.8^4)^32 = 5e-8. Buckets with the same members count once.
3. Within a bucket MinHash values (a byte of each) are compared 16 at a time. A pair is dropped as soon as the posterior
   probability (uniform prior) that its similarity reaches 0.8 is below 1e-6. A bucket hands on only edges of a spanning
   forest of what is left, and pairs that are already connected there are not compared.
4. The connected components of these edges are clusters that no link leaves. In each cluster every pair is compared
   again in the same way and what is left is verified exactly on the shingle sets; links are counted where they are
   found and, again, only a spanning forest is handed on. Its components are the classes.

No stage emits pairs: rows grow with the documents. Large buckets and clusters are cut into blocks of bounded size, and
each pair of blocks is a task's group of its own, so no task holds a group whole.

Result, one row for each row of the input: doc_id, n_shingles, class_id (the smallest doc_id of the class) and n_links
(rows of similarity 0.8 or more, copies included, itself not).

Edge cases: null texts and texts without words have no shingle, no link and a class of their own; copies and repeated
rows link to each other; a null doc_id is a row like others (class_id is null only where no member has an id); an empty
table gives an empty result; columns other than doc_id and text do not matter; whole texts of any length are read.
"""

from __future__ import annotations

from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, batches, folded_words, mixed, pieces, plain, rolling, settle, unwrapped, wrapped

GRAM, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity of at least 4/5
VALUES, BANDS, STEP = 128, 32, 16
TOLERANCE = 1e-6
#: Most representatives of a bucket, and of a cluster, in one block.
BUCKET_BLOCK, CLUSTER_BLOCK = 512, 512
#: About so many shingles of a cluster's representatives in one block: what a task unpacks follows no length of texts.
BLOCK_SHINGLES = 2_000_000
#: Columns of a tile of the shingle incidence matrix.
TILE = 4096

_MULTIPLIERS = (np.random.default_rng(20240229).integers(0, 1 << 31, VALUES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    return np.unique(rolling(hashes.of(words), min(GRAM, len(words)))) if words else np.empty(0, np.uint64)


def minhash(x: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingle hashes."""
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    x = (x >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 8192):
        np.minimum(low, np.multiply.outer(_MULTIPLIERS, x[i : i + 8192]).min(axis=1), out=low)
    return low


def least_matches(t: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared bytes, the fewest matches with which a pair goes on.

    A byte matches with probability s + (1 - s) / 256 at similarity s. With a uniform prior the posterior probability
    that this reaches its value at t, after m matches of n, is that of at most m successes in n + 1 draws at t.
    """
    p = t + (1 - t) / 256
    least = {}
    for n in range(STEP, VALUES + 1, STEP):
        below, m = 0.0, 0
        while (below := below + comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)) < tolerance:
            m += 1
        least[n] = m
    return least


LEAST = least_matches()


def plausible(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Indexes of the signatures in others that may reach the threshold with one."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        matches += (others[left, n - STEP : n] == one[n - STEP : n]).sum(axis=1)
        keep = matches >= LEAST[n]
        left, matches = left[keep], matches[keep]
        if not len(left):
            break
    return left


class Forest:
    """Union-find over the members of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def edges(self, ids: np.ndarray) -> list[tuple[int, int]]:
        return [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := self.root(i)) != i]


_signature = batches({"doc_id": pa.int64(), "key": pa.int64(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "bytes": pa.binary(), "bands": pa.list_(pa.int64())})
_edge = batches({"u": pa.int64(), "v": pa.int64()})
_link = batches({"u": pa.int64(), "v": pa.int64(), "links": pa.int64()})


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), a and b (digest of the shingle set), n, and for texts with words signature bytes and bands."""

    def sign(parts):
        hashes = WordHashes(3)
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        odd = np.uint64(0x9E3779B97F4A7C15)
        for batch in pieces(parts):
            out: list[list] = [[], [], [], [], []]
            for text in as_bytes(batch.column(2)):
                x = shingles(folded_words(text), hashes)
                low = minhash(x)
                y = low.reshape(BANDS, -1).astype(np.uint64)
                k = band.copy()
                for j in range(y.shape[1]):
                    k = mixed(k * odd + y[:, j])
                out[0].append(int(np.sum(mixed(x)).astype(np.uint64).view(np.int64)))
                out[1].append(int(np.sum(mixed(x ^ odd)).astype(np.uint64).view(np.int64)))
                out[2].append(len(x))
                out[3].append((low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes() if len(x) else None)
                out[4].append(k.view(np.int64) if len(x) else None)
            yield _signature(dict(zip(("doc_id", "key", "a", "b", "n", "bytes", "bands"), [batch.column(0), batch.column(1), *out], strict=True)))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(sign, "doc_id long, key long, a long, b long, n long, bytes binary, bands array<long>")


def _blocks(size: Column, limit: int) -> Column:
    return F.ceil(size / limit).cast("int")


def _to_block_pairs(rows: DataFrame, member: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that its block is in; a group of one block is one pair. `own` is its block."""
    own = F.pmod(F.hash(member, F.lit(11)), F.col(blocks))
    rows = rows.withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return rows.withColumn("_other", other).withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_other")


def _groups(parts, keys: int):
    """The rows of each group, from batches sorted by their first `keys` columns and the next, the member: each once."""

    def rows():
        last = None
        for batch in pieces(parts):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[: keys + 1] != last:
                    last = r[: keys + 1]
                    yield r

    for _, group in groupby(rows(), lambda r: r[:keys]):
        yield list(group)


def bucket_edges(reps: DataFrame) -> DataFrame:
    """(u, v): spanning forests of the plausible pairs in each bucket."""
    band = reps.select("a", F.explode("bands").alias("bucket"))
    buckets = band.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("a")).alias("x"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("y"))
    buckets = buckets.where("size > 1").groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", _blocks(F.col("size"), BUCKET_BLOCK).alias("blocks"))
    members = settle(band.join(buckets, "bucket").select("bucket", "blocks", "a"), "buckets")
    members = members.join(reps.select("a", "bytes"), "a")
    members = _to_block_pairs(members, "a", "blocks").select("bucket", "i", "j", "a", "own", "bytes")
    members = members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "a")

    def connect(parts):
        us, vs = [], []
        for group in _groups(parts, 3):
            ids = np.array([r[3] for r in group], np.int64)
            sig = np.frombuffer(b"".join(r[5] for r in group), np.uint8).reshape(len(ids), VALUES)
            own = np.array([r[4] for r in group])
            forest = Forest(len(ids))
            across = group[0][1] != group[0][2]
            label = np.arange(len(ids))
            for p in range(len(ids)):
                # Members that are not connected to p yet, each pair once; within two blocks only pairs across them.
                mask = label != label[p]
                mask[: p + 1] = False
                if across:
                    mask &= own != own[p]
                others = np.flatnonzero(mask)
                for q in others[plausible(sig[p], sig[others])].tolist() if len(others) else ():
                    forest.join(p, q)
                    label[label == label[q]] = label[p]
            for u, v in forest.edges(ids):
                us.append(u)
                vs.append(v)
            if len(us) > 20_000:
                yield _edge({"u": us, "v": vs})
                us, vs = [], []
        yield _edge({"u": us, "v": vs})

    return members.mapInArrow(connect, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (u, v) edges, root the smallest node: large-star and small-star steps
    until nothing changes, each settled in the shared folder. Their number grows with the logarithm of the edges."""

    def star(rows: DataFrame) -> DataFrame:
        # The minima are settled first, so both sides of the join are shuffled for it alone and Spark can split a hot node.
        low = settle(rows.groupBy("u").agg(F.min("v").alias("low")), "stars")
        return rows.join(low.select(F.col("u").alias("_u"), F.least("low", "u").alias("low")), F.col("u") == F.col("_u"))

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = settle(ordered(edges), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(ordered(star(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))), "edges")
        small = star(large).select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), "low"))).alias("e"))
        now = settle(ordered(small.select(F.col("e.v").alias("u"), F.col("e.low").alias("v"))), "edges")
        was, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if was == state:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def links_in_block(sets: list[np.ndarray], sig: np.ndarray, own: np.ndarray, across: bool) -> np.ndarray:
    """Matrix of verified links: plausible pairs by signature, then exactly by the sizes of the intersections."""
    n = len(sets)
    able = np.zeros((n, n), bool)
    for p in range(n - 1):
        able[p, p + 1 + plausible(sig[p], sig[p + 1 :])] = True
    if across:
        able &= own[:, None] != own[None, :]
    rows, columns = np.nonzero(able)
    if not len(rows):
        return able
    size = np.array([len(s) for s in sets])
    if len(rows) <= 4 * n:
        common = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(rows.tolist(), columns.tolist(), strict=True)])
    else:
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        who = np.repeat(np.arange(n), size)
        shared = times[at] > 1
        at, who = at[shared], who[shared]
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        at = np.cumsum(np.r_[0, at[1:] != at[:-1]]) if len(at) else at
        total = np.zeros((n, n), np.float32)
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, TILE):
            i, j = np.searchsorted(at, (low, low + TILE))
            tile = np.zeros((n, TILE), np.float32)
            tile[who[i:j], at[i:j] - low] = 1
            total += tile @ tile.T
        common = np.rint(total[rows, columns]).astype(np.int64)
    able[rows, columns] = DENOMINATOR * common >= NUMERATOR * (size[rows] + size[columns] - common)
    return able


def cluster_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame) -> DataFrame:
    """(u, v, links): forest edges of the verified links (links null), and the rows linked to representative u (v null)."""
    chosen = reps.select("a", "doc_id", "key", "n", "copies", "bytes").join(clusters, reps["a"] == clusters["node"]).drop("node")
    sizes = chosen.groupBy("root").agg(F.greatest(_blocks(F.count("*"), CLUSTER_BLOCK), _blocks(F.sum("n"), BLOCK_SHINGLES)).alias("blocks"))
    chosen = settle(chosen.join(sizes, "root"), "clusters")

    def pack(parts):
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(parts):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([compress(t or b"") for t in as_bytes(batch.column(2))], pa.binary())], names=["_doc", "_key", "packed"])

    packed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(pack, "_doc long, _key long, packed binary")
    rows = chosen.join(packed, (packed["_key"] == chosen["key"]) & packed["_doc"].eqNullSafe(chosen["doc_id"]))
    rows = _to_block_pairs(rows, "a", "blocks").select("root", "i", "j", "a", "own", "copies", "bytes", "packed")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "a")

    def verify(parts):
        hashes = WordHashes(3)
        unpack = zstandard.ZstdDecompressor().decompress
        out: list[list] = [[], [], []]
        for group in _groups(parts, 3):
            ids = np.array([r[3] for r in group], np.int64)
            copies = np.array([r[5] for r in group], np.int64)
            sig = np.frombuffer(b"".join(r[6] for r in group), np.uint8).reshape(len(ids), VALUES)
            sets = [shingles(folded_words(unpack(r[7])), hashes) for r in group]
            linked = links_in_block(sets, sig, np.array([r[4] for r in group]), group[0][1] != group[0][2])
            counts = linked @ copies + linked.T @ copies
            forest = Forest(len(ids))
            for p, q in zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True):
                forest.join(p, q)
            for u, v in forest.edges(ids):
                out[0].append(u), out[1].append(v), out[2].append(None)
            for k in np.flatnonzero(counts).tolist():
                out[0].append(int(ids[k])), out[1].append(None), out[2].append(int(counts[k]))
            if len(out[0]) > 20_000:
                yield _link(dict(zip("u v links".split(), out, strict=True)))
                out = [[], [], []]
        yield _link(dict(zip("u v links".split(), out, strict=True)))

    return rows.mapInArrow(verify, "u long, v long, links long")


def _rooted(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, root (what identifies a class; null without words), class_id and n_links of
    every row of docs."""
    spark = docs.sparkSession
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = settle(signatures(docs), "signatures")
    first = signed.where("n > 0").groupBy("a", "b").agg(
        F.min_by(F.struct("doc_id", "key", "n", "bytes", "bands"), F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "key")).alias("r"), F.count("*").alias("copies"))
    reps = settle(first.select("a", "b", "copies", "r.*"), "representatives")
    clusters = components(bucket_edges(reps))
    found = settle(cluster_links(docs, reps, settle(clusters, "clusters")), "links")
    links = found.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(found.where("v is not null").select("u", "v"))
    about = reps.select("a", "b", "copies", "doc_id").join(links, F.col("a") == F.col("u"), "left").join(roots, F.col("a") == F.col("node"), "left")
    about = about.select("a", "b", "doc_id", F.coalesce("root", "a").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = about.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    about = about.join(ids, "root").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "root", "class_id", "n_links")
    rows = signed.select("doc_id", "key", "a", "b", "n")
    joined = rows.join(about, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n") > 0), "left")
    return joined.select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "root",
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, class_id and n_links of every row of docs."""
    return _rooted(docs).drop("root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id (then text hash), with the columns it came with.

    A class is told by its root: class_id is null for many, and two may have one. What goes is a list of (doc_id, text
    hash), which is in one class only, so repeated rows of a kept document are left once: the kept row's other copies have
    its id and hash, and only the one with the smallest digest of all its columns is taken. Rows without words have no copies and all stay. The lists grow with the
    documents, so they are joined by shuffle at every size and never broadcast.
    """
    found = settle(_rooted(docs).where("n_links > 0").select("doc_id", "key", "root"), "classes")
    # Null ids come last, apart from every real one.
    found = found.groupBy("root", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key").agg(F.count("*").alias("n"))
    found = settle(found, "copies")
    order = F.struct("none", "id", "key")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("first.*").toDF("_none", "_id", "_key")
    mine = (F.col("none") == F.col("_none")) & (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key"))
    doc = F.when(~F.col("none"), F.col("id")).alias("_id")
    again = settle(found.where("n > 1").join(first, mine, "left_semi").select(doc, F.col("key").alias("_key")), "repeated")
    lost = found.join(first, mine, "left_anti").select(doc, F.col("key").alias("_key"))
    keyed = wrapped(docs, "doc_id", "text").withColumn("_hash", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["_hash"] == F.col("_key"))
    if again.isEmpty():
        return unwrapped(keyed.join(lost.hint("merge"), same, "left_anti"), docs)
    # Rows with one id and one text: one stays. Tasks reduce their own before the shuffle, so many make no large group.
    kept = keyed.join(lost.unionByName(again).hint("merge"), same, "left_anti").select("_row", "doc_id", "text")
    whole = F.sha2(F.concat_ws("\n", F.to_json("_row"), F.col("_row").cast("string")), 256)  # rows that differ in any column differ in it
    once = keyed.join(again.hint("merge"), same, "left_semi").groupBy("doc_id", "_hash").agg(F.min_by(F.struct("_row", "text"), whole).alias("_one"))
    return unwrapped(kept.unionByName(once.select("_one._row", "doc_id", "_one.text")), docs)
