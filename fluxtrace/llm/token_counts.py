"""Token counts without token ids: pieces once per distinct pre-token, joined to per-document pre-token frequencies.

A pre-token is a run of characters other than ASCII white space, with trailing punctuation after an ASCII letter or digit
split off; A-Z are lower-cased where all of it is ASCII and no special string can be in it. The tokenizer composes
characters, lower-cases, drops white space and parts letters from punctuation, so a text has as many tokens as its
pre-tokens have together. The library itself counts the pieces of each distinct pre-token, special strings included.

The most frequent short pre-tokens, a fixed number of them, are broadcast with their counts and summed where the
texts are read. All others meet their counts in a shuffled join: (row, pre-token, frequency) on one side, the distinct
pre-tokens on the other. Frequencies are added up in each task before any shuffle, so frequent pre-tokens are few rows.

Edge cases: a null or blank text has no tokens; repeated rows each give a row; very long pre-tokens are never broadcast;
columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, batches, pieces, plain, plain_words, settle

OVER = 2048
#: Broadcast pre-tokens, at most so many and each at most so many bytes: a few MB whatever the input.
HEAD, HEAD_BYTES = 200_000, 48
#: A task writes its frequencies out when it holds so many distinct pre-tokens.
FLUSH = 40_000

_vocabulary = batches({"pretoken": pa.binary(), "times": pa.int64()})
_pieces = batches({"pretoken": pa.binary(), "times": pa.int64(), "pieces": pa.int64()})
_parts = batches({"doc_id": pa.int64(), "hash": pa.int64(), "n_bytes": pa.int64(), "known": pa.int64(), "pretoken": pa.binary(), "times": pa.int64()})


TRAILING = b".,;:!?"


def pretokens(words: Counter) -> Counter:
    """Frequencies of pre-tokens from those of words between white space."""
    total: Counter = Counter()
    for word, times in words.items():
        if b"<|" not in word and word.isascii():
            word = word.lower()  # elsewhere a capital may first be composed with what follows it
        base = word.rstrip(TRAILING)
        if len(base) < len(word) and base[-1:].isalnum():
            total[word[len(base) :]] += times
            word = base
        total[word] += times
    return total


def frequencies(docs: DataFrame) -> DataFrame:
    """Distinct pre-tokens of all texts and how often they occur."""

    def count(parts):
        total: Counter = Counter()
        for batch in pieces(parts):
            for text in as_bytes(batch.column(0)):
                total.update(plain_words(text))
                if len(total) > FLUSH:
                    some = pretokens(total)
                    yield _vocabulary({"pretoken": list(some), "times": list(some.values())})
                    total.clear()
        some = pretokens(total)
        yield _vocabulary({"pretoken": list(some), "times": list(some.values())})

    return docs.select("text").mapInArrow(count, "pretoken binary, times long").groupBy("pretoken").agg(F.sum("times").alias("times"))


def piece_counts(vocabulary: DataFrame, tokenizer_file: str) -> DataFrame:
    """The number of tokens of each pre-token, from the library."""

    def encode(parts):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in pieces(parts):
            words = batch.column(0).to_pylist()
            sizes: list[int] = []
            for i in range(0, len(words), 500):
                sizes += map(len, tokenizer.encode_batch_fast([w.decode() for w in words[i : i + 500]], add_special_tokens=False))
            yield _pieces({"pretoken": batch.column(0), "times": batch.column(1), "pieces": sizes})

    return vocabulary.select("pretoken", "times").mapInArrow(encode, "pretoken binary, times long, pieces long")


def frequent(vocabulary: DataFrame, head: int) -> DataFrame:
    """The short pre-tokens above the lowest frequency that at most `head` of them reach: no more rows ever leave the executors.

    The window is over distinct frequencies, with one row for each; there are about twice the square root of all words of them at most.
    """
    short = vocabulary.where(F.length("pretoken") <= HEAD_BYTES)
    upto = F.sum("count").over(W.orderBy(F.desc("times")))
    least = short.groupBy("times").count().withColumn("upto", upto).where(F.col("upto") <= head).agg(F.min("times").alias("times")).first()["times"]
    return short.where(F.col("times") >= least) if least is not None else short.limit(0)


def token_counts(docs: DataFrame, tokenizer_file: str, *, over: int = OVER, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs."""
    spark = docs.sparkSession
    docs = plain(docs, "doc_id", "text")
    vocabulary = settle(piece_counts(frequencies(docs), tokenizer_file), "pretokens")
    known = spark.sparkContext.broadcast({bytes(r["pretoken"]): r["pieces"] for r in frequent(vocabulary, head).collect()})

    def split(parts):
        get = known.value.get
        for batch in pieces(parts, 400):
            docs_, keys, sizes, sums, words, counts = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                key = xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)
                total, rest = 0, Counter()
                for word, times in Counter(plain_words(text)).items():
                    if (size := get(word)) is not None:
                        total += size * times
                    else:
                        rest[word] = times
                rest = pretokens(rest)
                for word in [w for w in rest if w in known.value]:
                    total += known.value[word] * rest.pop(word)
                # The row of the text itself meets no pre-token: none has a space.
                docs_ += [doc] * (len(rest) + 1)
                keys += [key] * (len(rest) + 1)
                sizes += [len(text or b""), *[None] * len(rest)]
                sums += [total, *[None] * len(rest)]
                words += [b" " + key.to_bytes(8, "big", signed=True), *rest]
                counts += [1, *rest.values()]
            yield _parts({"doc_id": docs_, "hash": keys, "n_bytes": sizes, "known": sums, "pretoken": words, "times": counts})

    parts = docs.mapInArrow(split, "doc_id long, hash long, n_bytes long, known long, pretoken binary, times long")
    joined = parts.join(vocabulary.select("pretoken", "pieces"), "pretoken", "left")
    # Equal rows share a key: their sums are divided by their number and each is given back.
    each = joined.groupBy("doc_id", "hash").agg(
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce("known", F.col("pieces") * F.col("times"))).alias("tokens"),
        F.count("known").alias("rows"),
    )
    return (
        each.withColumn("n_tokens", F.expr("tokens div rows"))
        .withColumn("_copy", F.explode(F.expr("sequence(1, rows)")))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
    )
