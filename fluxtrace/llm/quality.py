"""Host-level quality rules, in DataFrame functions only.

Each text gets counters and rules. Rule failures are added up by host (the column `source`); each host's failure rate is
shrunk towards the mean of all hosts with a beta prior fitted to the hosts by moments; the verdicts go back to the
documents. A document goes if it fails a base rule, or if its host's shrunk rate is above `host_limit` and the document
itself fails a soft rule: sound documents of a bad host stay.

Edge cases: a null or blank text has no words (it fails the base rules); a null host is a host of its own; repeated rows
count and return as often as they occur; an empty table gives an empty result; extra columns stay, except that `judged`
replaces those with the names it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, SPACE_RUN, settle, unwrapped, wrapped

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 8
HOST_LIMIT = 0.5
#: Condemned hosts are broadcast up to this number; beyond it the join is shuffled and Spark splits hot hosts.
BROADCAST_HOSTS = 100_000
#: Bounds of the prior's weight in documents: hosts that all agree would otherwise give an infinite one.
PRIOR_LOW, PRIOR_HIGH = 1.0, 1e6

COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def counters(docs: DataFrame) -> DataFrame:
    """docs (`source`, `text` and perhaps `_row`) with the counters and rules of each text.

    n_repeat_words: windows of eight words are hashed; hashes that occur twice are found by sorting; the words of their
    places are counted once each. A hash has 64 bits and meets only those of its own text, so texts of a million words
    have two unequal windows of one hash with a probability of 3e-8. Only texts with a repeated window take the second half of that.
    """
    keep = [F.col(c) for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(
        *keep,
        F.array_remove(F.split(text, SPACE_RUN), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(PLAIN_WORD)).alias("_l"),
        _without(text, SPACES).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
    )
    out = out.select(
        *keep, "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    ordinary = [*keep, "word_chars", "n_symbols", "n_words", "n_dup_lines"]
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))
    out = out.select(*ordinary, F.when(F.size("_h") > WINDOW, windows).alias("_h"))
    out = out.select(*ordinary, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"))
    out = out.select(*ordinary, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_s"))
    same = lambda x, j: F.coalesce(F.get("_s", j)["h"] == x["h"], F.lit(False))
    out = out.select(*ordinary, F.sort_array(F.transform(F.filter("_s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])).alias("_p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
    out = out.select(*ordinary, F.coalesce(F.aggregate("_p", start, step, lambda a: a["n"]), F.lit(0)).cast("long").alias("n_repeat_words"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # Soft rules: many symbols, many repeated lines, words too short or too long on average.
    soft = (
        (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > F.col("n_words"))
        | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))
    )
    return out.select(*ordinary, "n_repeat_words", base.alias("base_failed"), soft.alias("soft_failed"))


def host_rates(counted: DataFrame) -> DataFrame:
    """source, n_docs and host_rate: each host's rate of failing documents, shrunk with the empirical beta prior."""
    hosts = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("n_failed"))
    hosts = settle(hosts, "hosts")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f")).first()
    n, mean = total["n"] or 0, (total["f"] or 0) / total["n"] if total["n"] else 0.0
    rate = F.col("n_failed") / F.col("n_docs")
    spread = hosts.agg((F.sum(F.col("n_docs") * (rate - mean) * (rate - mean)) / n).alias("v")).first()["v"] if n else 0.0
    weight = min(max(mean * (1 - mean) / spread - 1, PRIOR_LOW), PRIOR_HIGH) if spread else PRIOR_HIGH
    return hosts.select("source", "n_docs", F.round((F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight), 6).alias("host_rate"))


def _judged(docs: DataFrame, host_limit: float, texts: bool) -> DataFrame:
    counted = counters(wrapped(docs, "source", "text"))
    counted = settle(counted if texts else counted.drop("text"), "counted")
    rates = host_rates(counted)
    few = rates.count() <= BROADCAST_HOSTS
    rates = rates.select(F.col("source").alias("_host"), "host_rate")
    joined = counted.join(F.broadcast(rates) if few else rates, counted["source"].eqNullSafe(rates["_host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~((F.col("host_rate") > host_limit) & F.col("soft_failed")))


def judged(docs: DataFrame, *, host_limit: float = HOST_LIMIT, texts: bool = True) -> DataFrame:
    """docs with counters, rules, the shrunk rate of the host and `kept`, without `text` if texts is false. Each text is counted
    once; the counters are settled and read again for the hosts' rates and for the verdicts."""
    return unwrapped(_judged(docs, host_limit, texts), docs if texts else docs.drop("text"), *COUNTERS, "host_rate", "kept")


def keep_good(docs: DataFrame, *, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    return unwrapped(_judged(docs, host_limit, True).where("kept"), docs)
