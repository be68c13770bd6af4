"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is never formed: with s_f = sum_i v_if x_i it
is (sum_f s_f^2 - sum_i sum_f v_if^2 x_i^2) / 2, linear in the features of a text (`raw_scores`).

Features of a text: its distinct words (ASCII-folded) hashed into BUCKETS, weighted 1 + ln(count) and scaled to length one
together; statistics of its structure (word lengths, symbols, punctuation, capitals, digits, repeated words and lines, list bars),
each centred and scaled by fixed values; metadata: the logarithm of n_chars, whether it is there and whether it agrees with
the text. doc_id, lang, source and labels are never features.

`fit` learns from labelled documents whose crc32(doc_id as text) mod 5 is not 0. It takes a bounded sample of them: those with
the smallest seeded hashes, at most `sample` rows of at most `features` features together; all else (the scores) covers every
whole text. Features are made where the texts are; the driver sees the sample's packed features and fits by minibatches in
a fixed order, so a rerun gives the same model.

Edge cases: null and empty texts have the structure features of an empty text and get a score; a document's label is the
majority of its rows in `labels` (1 on a tie), labels other than 0 and 1 do not count; a null id is never held out nor
labelled; without labelled rows the model is all zeros and scores are 0.5; repeated rows count and return as often as they
occur; an empty table gives an empty result; extra columns stay, except those with the names that are added.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import FOLD, WordHashes, as_bytes, batches, pieces, plain, settle, unwrapped, wrapped

BUCKETS, RANK = 1 << 16, 8
SAMPLE, FEATURES = 20_000, 8_000_000
#: Passes over the sample: EPOCHS, or as many (at most MOST_EPOCHS) as make STEPS steps of a small sample.
EPOCHS, MOST_EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 8, 60, 1500, 64, 0.1, 1e-5, 12
THRESHOLD, FOLDS = 0.3, 5

# Centre and scale of each statistic: fixed values of plain prose, so that usual texts lie within about one of zero.
STATISTICS = {
    "log_words": (5.0, 1.5), "word_length": (6.0, 2.0), "long_words": (0.01, 0.05), "short_words": (0.3, 0.2), "symbols": (0.005, 0.02), "punctuation": (0.025, 0.02), "marks": (0.005, 0.02), "bars": (0.005, 0.05),
    "capitals": (0.03, 0.1), "digits": (0.01, 0.05), "other_bytes": (0.03, 0.05), "distinct": (0.6, 0.3), "commonest": (0.06, 0.1), "adjacent": (0.01, 0.05), "duplicate_lines": (0.02, 0.2), "line_words": (40.0, 40.0),
    "log_chars": (7.0, 1.5), "chars_known": (1.0, 1.0), "chars_agree": (1.0, 1.0),
}
N = BUCKETS + len(STATISTICS)
_CENTRE = np.array([c for c, _ in STATISTICS.values()])
_SCALE = np.array([s for _, s in STATISTICS.values()])

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL, _PUNCT, _MARK = b"#*$%&<>@^~=_+{}[]\\`", b".,;:'\"()-", b"!?"
_OTHER, _CONTINUED = bytes(range(128, 256)), bytes(range(128, 192))
_LINE = re.compile(rb"[^\n]*\S[^\n]*")


def _among(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def statistics(text: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> np.ndarray:
    """The structure statistics and metadata of a text, centred and scaled, within -3 and 3."""
    size, n = max(len(text), 1), max(len(words), 1)
    lines = [x.strip() for x in _LINE.findall(text)]
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = len(text) - _among(text, _CONTINUED)
    values = [
        math.log1p(len(words)), lengths.mean() if len(words) else 0, (lengths > 20).mean() if len(words) else 0, (lengths < 4).mean() if len(words) else 0,
        _among(text, _SYMBOL) / size, _among(text, _PUNCT) / size, _among(text, _MARK) / size, text.count(b"|") / n,
        _among(text, _UPPER) / size, _among(text, _DIGIT) / size, _among(text, _OTHER) / size, len(counts) / n,
        max(counts.values(), default=0) / n, adjacent / n, 1 - len(set(lines)) / len(lines) if lines else 0, n / max(len(lines), 1),
        math.log1p(max(n_chars or 0, 0)), float(n_chars is not None), float(n_chars == chars),
    ]
    return np.clip((np.array(values) - _CENTRE) / _SCALE, -3, 3) / 3


def features(text: bytes | None, n_chars: int | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of a text's features."""
    text = text or b""
    words = text.translate(FOLD).split()
    counts = Counter(words)
    ids = (hashes.of(list(counts)) % np.uint64(BUCKETS)).astype(np.int32)
    weight = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    weight /= math.sqrt(float(weight @ weight)) or 1
    return np.concatenate([ids, np.arange(BUCKETS, N, dtype=np.int32)]), np.concatenate([weight, statistics(text, words, counts, n_chars)]).astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # N
    factors: np.ndarray  # N x RANK


def blank() -> Model:
    return Model(0.0, np.zeros(N, np.float32), np.zeros((N, RANK), np.float32))


def raw_scores(model: Model, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid of texts whose features begin at `starts`, and the sums s_f of each text."""
    v = model.factors[ids] * x[:, None]
    sums = np.add.reduceat(v, starts, axis=0)
    squares = np.add.reduceat((v * v).sum(1), starts)
    return model.bias + np.add.reduceat(model.linear[ids] * x, starts) + ((sums * sums).sum(1) - squares) / 2, sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(ids: list[np.ndarray], xs: list[np.ndarray], y: np.ndarray, *, rate: float = RATE, seed: int = SEED) -> Model:
    """Logistic loss by minibatches with step sizes that shrink with each weight's own gradients (Adagrad)."""
    model = blank()
    if not len(y):
        return model
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    model.bias = float(np.log(share / (1 - share)))
    model.factors = rng.normal(0, 0.02, model.factors.shape).astype(np.float32)
    seen_bias, seen_linear, seen_factors = 1.0, np.full(N, 1e-2, np.float32), np.full((N, RANK), 1e-2, np.float32)
    batch = min(BATCH, max(8, len(y) // 40))
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, -(-STEPS * batch // len(y))))):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            i, x = np.concatenate([ids[j] for j in some]), np.concatenate([xs[j] for j in some])
            sizes = np.array([len(ids[j]) for j in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            z, sums = raw_scores(model, i, x, starts)
            error = ((sigmoid(z) - y[some]) / len(some)).astype(np.float32)
            each = np.repeat(error, sizes)
            used, at = np.unique(i, return_inverse=True)
            g = np.bincount(at, each * x, len(used)).astype(np.float32) + DECAY * model.linear[used]
            slope = each[:, None] * x[:, None] * (np.repeat(sums, sizes, axis=0) - model.factors[i] * x[:, None])
            gv = np.stack([np.bincount(at, slope[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + DECAY * model.factors[used]
            seen_linear[used] += g * g
            seen_factors[used] += gv * gv
            model.linear[used] -= rate * g / np.sqrt(seen_linear[used])
            model.factors[used] -= rate * gv / np.sqrt(seen_factors[used])
            gb = float(error.sum())
            seen_bias += gb * gb
            model.bias -= rate * gb / math.sqrt(seen_bias)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _packed(docs: DataFrame) -> DataFrame:
    """y, u and the packed features (ids, values) of each labelled document."""
    make = batches({"y": pa.int64(), "u": pa.int64(), "n": pa.int64(), "ids": pa.binary(), "xs": pa.binary()})

    def work(parts):
        hashes = WordHashes()
        for b in pieces(parts):
            got = [features(t, n, hashes) for t, n in zip(as_bytes(b.column("text")), b.column("n_chars").to_pylist())]
            yield make({"y": b.column("y"), "u": b.column("u"), "n": [len(i) for i, _ in got], "ids": [i.tobytes() for i, _ in got], "xs": [x.tobytes() for _, x in got]})

    return docs.select("y", "u", "text", "n_chars").mapInArrow(work, "y long, u long, n long, ids binary, xs binary")


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, most: int = FEATURES, seed: int = SEED) -> Model:
    """The model of at most `sample` labelled documents with at most `most` features together."""
    u = F.xxhash64(F.lit(seed), F.col("_id").cast("string"))
    votes = plain(labels, "doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    votes = votes.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("long").alias("y")).withColumn("u", u)
    own = plain(docs, "doc_id", "text", "n_chars")
    # The sample is chosen by ids alone and broadcast (`sample` rows of three numbers): texts stay where they are.
    chosen = settle(votes.join(own.select("doc_id"), F.col("_id") == F.col("doc_id"), "left_semi").orderBy("u", "_id").limit(sample), "sample")
    joined = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    packed = settle(_packed(joined.select("y", F.col("u"), "text", F.col("n_chars").cast("long").alias("n_chars"))), "features")
    first = packed.select("u", "y", "n").orderBy("u", "y", "n").limit(sample)
    upto = F.sum("n").over(W.orderBy("u", "y", "n"))  # one task, over `sample` rows of three numbers
    fits = first.withColumn("upto", upto).where(F.col("upto") <= most).agg(F.max("u")).first()[0]
    if fits is None:
        return blank()
    rows = packed.where(F.col("u") <= fits).orderBy("u", "y", "ids").limit(sample).collect()
    ids, xs = [np.frombuffer(r["ids"], np.int32) for r in rows], [np.frombuffer(r["xs"], np.float32) for r in rows]
    return train(ids, xs, np.array([r["y"] for r in rows], np.float64), seed=seed)


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted; the model is broadcast (N x (RANK + 1) numbers)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = wrapped(docs, "doc_id", "text", "n_chars") if "n_chars" in docs.columns else wrapped(docs.withColumn("n_chars", F.lit(None).cast("long")), "doc_id", "text", "n_chars")
    own = own.withColumn("n_chars", F.col("n_chars").cast("long"))
    schema = StructType([*own.schema.fields, StructField("score", DoubleType())])

    def work(parts):
        hashes = WordHashes()
        for b in pieces(parts):
            got = [features(t, n, hashes) for t, n in zip(as_bytes(b.column("text")), b.column("n_chars").to_pylist())]
            if got:
                sizes = np.array([len(i) for i, _ in got])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                z, _ = raw_scores(shared.value, np.concatenate([i for i, _ in got]), np.concatenate([x for _, x in got]), starts)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(z.astype(np.float64)), pa.float64())], names=[*b.schema.names, "score"])

    scored = own.mapInArrow(work, schema)
    scored = scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unwrapped(scored, docs, "held_out", "score", "predicted")
