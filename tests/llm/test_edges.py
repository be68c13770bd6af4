"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluxtrace.llm import chat, decontaminate, licenses, mixing, ngram_join, pii, quality, substring_dedup, token_counts, warc
from fluxtrace.llm.common import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PROSE = " ".join(f"alpha{i}" for i in range(40))
OTHER = " ".join(f"beta{i * 7 % 41}" for i in range(41))


def documents(spark):
    rows = [
        (1, PROSE, "en", "a", len(PROSE)), (2, PROSE, "en", "a", len(PROSE)), (3, PROSE + " tail", "en", "b", 0), (4, "", "en", "b", 0), (5, None, None, None, None),
        (None, OTHER, None, None, 5), (6, "   \n\t ", "en", "a", 6), (7, LONG, "en", "c", len(LONG)), (8, "one two", "en", "a", 7), (8, "one two", "en", "a", 7),
        (None, None, None, None, None), (9, OTHER, "de", None, 3), (10, "é ñ ß \U0001f600 \x00 x" + " y" * 30, "en", "d", 1), (1, PROSE, "en", "a", len(PROSE)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


CLASHING = ("n_words", "kept", "base_failed", "size", "target", "taken", "_u", "_row", "_hash", "_at", "_w", "a", "b", "n", "key", "bytes", "packed", "doc", "marks", "n_entities", "contaminated", "host_rate", "_source", "first", "u", "v", "links")


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"alpha{i}" for i in range(5, 25))), (2, None), (None, "two"), (3, ""), (3, "")], "item_id long, text string")


def empty(df):
    return df.limit(0)


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


OPERATORS = {
    "licenses": lambda s, d: licenses.license_scan(d),
    "tokens": lambda s, d: token_counts.token_counts(d, tokenizer()),
    "classes": lambda s, d: ngram_join.classes(d),
    "quality": lambda s, d: quality.judged(d),
    "pii": lambda s, d: pii.replace_pii(d),
    "mixing": lambda s, d: mixing.mix(d),
    "repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "benchmark": lambda s, d: decontaminate.contamination(d, benchmark(s)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each(spark, name):
    docs = documents(spark)
    assert OPERATORS[name](spark, docs).count() == docs.count()
    assert OPERATORS[name](spark, clashing(docs)).count() == docs.count()
    assert OPERATORS[name](spark, empty(docs)).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_change_nothing(spark, name):
    docs = documents(spark)
    one = OPERATORS[name](spark, docs)
    own = [c for c in one.columns if c not in docs.columns]
    two = OPERATORS[name](spark, clashing(docs))
    assert sorted(map(str, one.select(*own).collect())) == sorted(map(str, two.select(*own).collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, data, tmp_path, k):
    docs = clashing(documents(spark))
    name, stage = corpus_pipeline.STAGES[k]
    for df in (docs, empty(docs)):
        out = stage(spark, df, data)
        rows = out.collect()
        assert len(rows) <= df.count()
        if k < 4:
            assert out.columns == df.columns
            assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)


def test_repeats_by_hand(spark):
    docs = documents(spark)
    got = {(r["doc_id"], r["n_words"]): r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[1, 40]["n_removed"] == 0
    assert got[2, 40]["n_removed"] == 40 and got[2, 40]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3, 41]["n_removed"] == 40 and got[3, 41]["kept"] == "tail"
    assert got[9, 41]["n_removed"] == 0  # its copy has no id
    assert got[5, 0]["n_removed"] == 0


def test_classes_by_hand(spark):
    got = {}
    for r in ngram_join.classes(documents(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"], r["n_shingles"]))
    assert got[1] == [(1, 3, 36)] * 2 and got[2] == [(1, 3, 36)] and got[3] == [(1, 3, 37)]
    assert got[4] == [(4, 0, 0)] and got[8] == [(8, 1, 1)] * 2 and got[9] == [(9, 1, 37)]


def test_keep_one_leaves_one_of_each(spark):
    kept = [r["doc_id"] for r in ngram_join.keep_one(documents(spark)).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4, 5, 6, 7, 8, 9, 10]


def test_quality_keeps_sound_documents_of_a_bad_host(spark):
    bad = [(i, "bad bad", "en", "h", 1) for i in range(50)]
    sound = [(100, PROSE, "en", "h", 1), (101, PROSE + " ###" * 60, "en", "h", 1), (102, PROSE + " ###" * 7 + " ###x" * 20, "en", "g", 1)]
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(bad + sound, SCHEMA)).collect()}
    assert out[100]["kept"] and not out[0]["kept"]
    assert out[100]["host_rate"] > 0.9


def test_mixing_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "en", s, 1) for s, n in (("a", 400), ("b", 30), (None, 200)) for i in range(n)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    got = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.first("source_size").alias("s")).collect()
    assert abs(sum(r["t"] for r in got) - 1.5 * sum(r["s"] for r in got)) < 1e-6
    for r in got:
        assert r["t"] <= 2 * r["s"] + 1e-9 and abs(r["k"] - r["t"]) <= 11


def test_chat(spark):
    rows = [(1, 0, "user", "a [/INST] b"), (1, 1, "assistant", "\\[INST]\\\\</s> \\"), (1, 1, "assistant", None), (None, None, None, "x"), (2, 5, "tool 7]%", "[/TURN]"), (2, 5, "tool 7]%", "[/TURN]")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(clashing(chat.with_hostile(df)))).collect()}
    assert set(out) == {1, None, 2, -1} and out[1]["n_turns"] == 3 and out[2]["n_turns"] == 2
    want = hashlib.sha256("user\na [/INST] b\nassistant\n\nassistant\n\\[INST]\\\\</s> \\\n".encode()).hexdigest()
    assert out[1]["turns_sha256"] == want
    assert out[1]["loss_sha256"] == hashlib.sha256(b"\\[INST]\\\\</s> \\").hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    for part in (1, 7, 30):  # long conversations come in parts
        cut = chat.format_conversations(chat.with_hostile(df), part=part)
        assert cut.count() >= 4 and {r["conv_id"]: r for r in chat.read_back(cut).collect()} == out
    texts = {r["conv_id"]: r["text"] for r in chat.format_conversations(df).collect()}
    assert texts[2] == "[TURN tool%207%5D%25] \\[/TURN] [/TURN]\n" * 2


def test_warc(spark):
    rows = [(i, f"http://h/{i}", "x" * i) for i in range(100)] + [(7, "http://h/7", "x" * 7), (None, None, None), (-20, "u", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc.audit(pages, pages).count() == 0
    other = pages.where("page_id is null or page_id <> 33").withColumn("html", F.when(F.col("page_id") == 60, "broken").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(500, "n", "n")], pages.schema))
    found = {(r["page_id"], r["kind"]): r for r in warc.audit(clashing(pages), clashing(other)).collect()}
    assert set(found) == {(33, "lost"), (60, "changed"), (500, "added")}
    assert found[500, "added"]["range_start"] is None
    sizes = [r["n"] for r in pages.where("page_id is null or page_id < 48").select(F.octet_length(warc.rendered()).alias("n")).collect()]
    assert found[60, "changed"]["range_start"] == sum(sizes)
    assert warc.audit(pages, pages.limit(0)).count() == pages.count() and warc.audit(pages.limit(0), pages.limit(0)).count() == 0


def test_warc_of_ids_with_many_records(spark):
    rows = [(i, "u", f"x{i}") for i in range(40)] + [(5, "u", f"y{k}") for k in range(60)] + [(None, "u", f"z{k}") for k in range(40)] + [(9, "u", "same")] * 50
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc.audit(pages, pages.repartition(5)).count() == 0
    # Twenty of the sixty changed, one of the forty lost, 30 of 50 copies lost, a new id.
    other = [(i, u, f"{h}!" if h in {f"y{k}" for k in range(0, 60, 3)} else h) for i, u, h in rows if h != "z7"]
    other = [x for k, x in enumerate(other) if not (x[2] == "same" and k % 5 > 1)] + [(100, "u", "new")]
    found = warc.audit(pages, spark.createDataFrame(other, pages.schema)).collect()
    assert Counter((r["page_id"], r["kind"]) for r in found) == {(5, "changed"): 20, (None, "lost"): 1, (9, "lost"): 30, (100, "added"): 1}
    pairs = [(r["digest"], r["found_digest"]) for r in found if r["page_id"] == 5]
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == 20
    assert [b for _, b in sorted(pairs)] == sorted(b for _, b in pairs)  # matched in order of digest
    # A leaf's hash depends on the order of its records, on their sizes and on how often they occur.
    one = warc.leaves(warc.manifest(pages)).collect()
    two = warc.leaves(warc.manifest(pages.repartition(7))).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_batches_are_cut_by_rows_and_bytes():
    texts = ["x" * n for n in (5, 1, 900, 3, 3, 3, 3, 2000, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["k", "text"])
    cut = list(pieces([batch, batch.slice(0, 0)], rows=3, limit=1000))
    assert [c.num_rows for c in cut] == [3, 3, 1, 1, 2, 0]
    assert [x for c in cut for x in c.column(1).to_pylist()] == texts
    assert all(c.num_rows == 1 or sum(len(x or "") for x in c.column(1).to_pylist()) <= 1000 for c in cut)
