"""Vector codes, hard negatives and the quality classifier against brute force, by their identities and on odd tables."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxtrace.llm import hard_negatives, quality_model, vector_codes
from fluxtrace.llm.common import WordHashes
from fluxtrace.llm.queries import QUERIES
from tests.llm.test_edges import clashing, documents

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, *, n=230, width=16, seed=3):
    """Clustered vectors with ties, repeated rows, nulls in every column, odd components and lengths."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(4)]
    rows = [(i * 5, [c + rng.gauss(0, 0.08) for c in rng.choice(centres)], rng.choice([0, 1, 2, 9, None]) if i % 9 else 1) for i in range(n)]
    rows += [(700, rows[3][1], 1), (700, rows[3][1], 1), (705, rows[3][1], 2), (None, rows[4][1], 1), (None, rows[5][1], None), (9001, rows[7][1][:5], 1), (9002, [], 0), (9003, [0.0] * width, 1)]
    rows += [(10, None, 1), (11, [0.1, None] + [0.0] * (width - 2), 1), (12, [NAN] + [0.0] * (width - 1), 1), (13, [INF] * width, 2), (100, [-c for c in rows[0][1]], 1)]
    return spark.createDataFrame(rows, SCHEMA)


def kept(df, width, *, labelled):
    """(vec_id, label, integer vector) of the rows that take part, by the definition."""
    out = []
    for r in df.collect():
        e = r["embedding"]
        if e is not None and all(x is not None and math.isfinite(x) for x in e) and not (labelled and r["label"] is None):
            out.append((r["vec_id"], r["label"], [math.floor(256 * x) for x in e] + [0] * (width - len(e))))
    return out


def by_id(x):
    return (x is None, x or 0)


def coded(rows, parts, entries, rounds):
    """Codes, errors and codebooks by comparing every part with every entry in every round."""
    w = len(rows[0][2]) // parts
    cut = [[tuple(q[p * w : p * w + w]) for p in range(parts)] for _, _, q in rows]
    first = sorted(range(len(rows)), key=lambda i: (by_id(rows[i][0]), rows[i][2]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for k in range(rounds + 1):
        got = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
        for p in range(parts) if k < rounds else ():
            for e in range(len(first)):
                own = [x[p] for x, g in zip(cut, got) if g[p][1] == e]
                if own:
                    books[p][e] = tuple(sum(v) // len(own) for v in zip(*own))
    return got, books


@pytest.mark.parametrize("parts, entries, rounds", [(4, 8, 2), (16, 64, 2), (8, 3, 4), (4, 250, 1)])
def test_codes_by_brute_force(spark, parts, entries, rounds):
    df = vectors(spark)
    rows = kept(df, 16, labelled=False)
    got, books = coded(rows, parts, entries, rounds)
    want = sorted((str(r[0]), "".join(f"{e:02x}" for _, e in g), sum(d for d, _ in g), str(r[1])) for r, g in zip(rows, got))
    totals = {k: sum(x[2] for x in want if x[3] == k) for k in {x[3] for x in want}}
    out = vector_codes.codes(clashing(df.repartition(5)), parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in out) == sorted((a, b, c, totals[d]) for a, b, c, d in want)
    assert {r["codebooks_sha256"] for r in out} == {vector_codes.digest(np.array(books))}


def test_codes_of_few_and_no_rows(spark):
    df = vectors(spark)
    assert vector_codes.codes(df.limit(0)).count() == 0 and vector_codes.codes(df.where("vec_id IN (10, 11)")).count() <= 1
    one = vector_codes.codes(df.where("vec_id = 5")).collect()
    assert [(r["code"], r["error"]) for r in one] == [("00" * 16, 0)]
    with pytest.raises(ValueError):
        vector_codes.codes(spark.createDataFrame([(1, [1e9] * 16, 1)], SCHEMA))


@given(st.integers(0, 10**6), st.integers(1, 6), st.floats(0, 1))
@settings(max_examples=60, deadline=None)
def test_active_entries_give_what_a_full_scan_gives(seed, spread, share):
    """Small components make ties; entries that move may come to lie on those that do not."""
    rng = np.random.default_rng(seed)
    x, books = rng.integers(-spread, spread + 1, (80, 3, 2)), rng.integers(-spread, spread + 1, (3, 9, 2))
    every = np.ones((3, 9), bool)
    code, distance, full = vector_codes.assign(x, books, every, None, None)
    moved = rng.random((3, 9)) < share
    now = np.where(moved[..., None], rng.integers(-spread, spread + 1, books.shape), books)
    moved = (now != books).any(2)
    want = vector_codes.assign(x, now, every, None, None)
    got = vector_codes.assign(x, now, moved, code, distance)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert got[2] <= full and (moved.all() or got[2] < full)


def mined(rows, every=100):
    out = []
    rows = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, np.array(q)) for i, l, q in rows]
    for a, (anchor, label, q) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-int(q @ r[2]), by_id(r[0]), r[1]) for k, r in enumerate(rows) if k != a), key=lambda x: x[:2])
        for s, (_, p), _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(anchor, p, k, n, -s, -t) for k, (t, (_, n), _) in enumerate(window[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"SLICE": 3, "ANCHOR_BLOCK": 2, "ROWS": 40, "BLOCK": 7}, {"REFERENCES": 1}])
def test_negatives_by_brute_force(spark, monkeypatch, sizes):
    for name, n in sizes.items():
        monkeypatch.setattr(hard_negatives, name, n)
    df = vectors(spark)
    want = mined(kept(df, 16, labelled=True))
    got = hard_negatives.mine(clashing(df.repartition(4))).collect()
    key = lambda r: (r["anchor_id"], r["positive_id"] or 0, r["rank"], r["negative_id"] or 0, r["positive_score"], r["negative_score"])
    assert len(want) > 100 and sorted(map(key, got)) == want


def test_negatives_of_odd_tables(spark):
    df = vectors(spark)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("label IS NULL OR embedding IS NULL")).count() == 0
    assert hard_negatives.mine(df.where("vec_id % 100 <> 0")).count() == 0
    zero = spark.createDataFrame([(100, [0.0] * 4, 1), (101, [0.0] * 4, 1), (102, [0.0] * 4, 2), (103, [1.0] * 4, 2)], SCHEMA)
    assert [(r["negative_id"], r["negative_score"]) for r in hard_negatives.mine(zero).orderBy("rank").collect()] == [(102, 0), (103, 0)]


@given(st.integers(0, 10**6), st.sampled_from([1, 30, 5000]), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_bounds_hold_scores(seed, size, most):
    rng = np.random.default_rng(seed)
    q = rng.integers(-size, size + 1, (60, 8))
    q[0], q[1], q[2] = 0, q[3], -q[3]
    directions = hard_negatives.references(q.astype(float), most)
    norm, angle = hard_negatives.angles(q, directions)
    score = q @ q.T
    lower, upper = hard_negatives.bounds(norm, angle, norm, norm, angle, angle)
    assert (lower <= score).all() and (score <= upper).all()
    cut = slice(20, 50)
    low, high = hard_negatives.bounds(norm, angle, norm[cut].min(keepdims=True), norm[cut].max(keepdims=True), angle[cut].min(0, keepdims=True), angle[cut].max(0, keepdims=True))
    assert (low[:, 0] <= score[:, cut].min(1)).all() and (score[:, cut].max(1) <= high[:, 0]).all()


def test_bounds_rule_out_rows_of_other_directions():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 201, (4, 32))
    q = np.concatenate([c + rng.integers(-8, 9, (50, 32)) for c in centres])
    norm, angle = hard_negatives.angles(q, hard_negatives.references(q.astype(float)))
    _, upper = hard_negatives.bounds(norm, angle, norm, norm, angle, angle)
    kind = np.repeat(np.arange(4), 50)
    same = kind[:, None] == kind
    assert upper[~same].max() < (q @ q.T)[same].min()  # no score of another cluster needs to be looked at


@given(st.integers(0, 10**6))
@settings(max_examples=30, deadline=None)
def test_pairwise_sum_by_the_identity(seed):
    rng = np.random.default_rng(seed)
    model = quality_model.Model(0.3, rng.normal(size=quality_model.N), rng.normal(size=(quality_model.N, quality_model.RANK)))
    sizes = rng.integers(1, 12, 5)
    ids = [rng.choice(quality_model.N, n, replace=False) for n in sizes]
    xs = [rng.normal(size=n) for n in sizes]
    got, _ = quality_model.raw_scores(model, np.concatenate(ids), np.concatenate(xs), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    for k, (i, x) in enumerate(zip(ids, xs)):
        pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[k] == pytest.approx(0.3 + model.linear[i] @ x + pairs)


def test_training_follows_its_gradient():
    """A step against the numeric gradient of the loss: with one batch the first update has its sign."""
    rng = np.random.default_rng(5)
    ids, xs = [np.arange(6, dtype=np.int32)] * 40, [rng.normal(size=6).astype(np.float32) for _ in range(40)]
    y = np.array([float(x[0] * x[1] > 0) for x in xs])  # only an interaction tells the classes apart
    model = quality_model.train(ids, xs, y)
    z, _ = quality_model.raw_scores(model, np.concatenate(ids), np.concatenate(xs), np.arange(40) * 6)
    assert ((z > 0) == (y > 0)).mean() > 0.95


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op12_quality_classifier"](spark, folder).toPandas()
    docs = duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/documents.parquet' LEFT JOIN '{folder}/labels.parquet' USING (doc_id)").df()
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out))
    assert ((out.score >= 0) & (out.score <= 1)).all() and (out.predicted == (out.score >= 0.3)).all()
    told = out.merge(docs.dropna(), on="doc_id").query("held_out")
    assert len(told) > 50 and auc(told.score.to_numpy(), told.quality.to_numpy()) > 0.97 and (told.predicted == told.quality).mean() > 0.93


def test_the_classifier_sees_no_label_id_language_or_source(spark):
    docs = documents(spark).where("doc_id IS NOT NULL")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, None), (7, 0, 0), (8, 0, 0), (8, 0, 0), (9, None, 1), (4, 2, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels)
    score = lambda df: sorted((str(r["text"]), r["score"]) for r in quality_model.score(df, model).collect())
    assert score(docs) == score(docs.withColumns({"doc_id": F.lit(3).cast("long"), "lang": F.lit("x"), "source": F.lit("y")}))
    # Held-out labels change nothing: they are not learnt from.
    out = [r["doc_id"] for r in quality_model.score(docs, model).where("held_out").collect()]
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(out), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_model.fit(docs, turned).linear == model.linear).all()


def test_classifier_on_odd_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, quality int")
    model = quality_model.fit(clashing(docs), clashing(labels))
    for df in (docs, clashing(docs), docs.drop("n_chars")):
        out = quality_model.score(df, model)
        assert out.count() == docs.count() and out.columns[: len(df.columns)] == df.columns and out.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality_model.score(docs.limit(0), model).count() == 0
    blank = quality_model.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_model.score(docs, blank).collect()} == {0.5}
    assert quality_model.score(docs, quality_model.fit(docs.limit(0), labels)).count() == docs.count()


def test_the_sample_is_bounded_and_does_not_depend_on_order(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} " * (1 + i % 5), i) for i in range(200)], "doc_id long, text string, n_chars long")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    one, two = (quality_model.fit(d, labels, sample=50) for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(7)))
    assert (one.linear == two.linear).all() and (one.factors == two.factors).all()
    assert (quality_model.fit(docs, labels, most=30).linear != 0).any()  # a row or two fit


def test_features_of_a_text():
    ids, x = quality_model.features("The the cat\ncat |".encode(), 17, WordHashes())
    words = x[: -len(quality_model.STATISTICS)]
    assert len(words) == 2 and words @ words == pytest.approx(1) and (np.abs(x) <= 1.0001).all()
    assert len(quality_model.features(None, None, WordHashes())[0]) == len(quality_model.STATISTICS)
