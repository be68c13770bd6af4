"""Operators against brute force on small tables: what SQL cannot express, and paths that small tables don't reach by themselves."""

import hashlib
import ipaddress
import itertools
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fluxtrace.llm import chat, decontaminate, licenses, ngram_join, oracles, pii, quality, substring_dedup, token_counts
from fluxtrace.llm.common import WordHashes, folded_words, plain_words
from fluxtrace.llm.queries import QUERIES
from tests.compare import connection
from tests.llm.test_edges import SCHEMA, benchmark, documents, tokenizer

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts(folder, table="documents", key="doc_id"):
    return duckdb.sql(f"SELECT {key}, text FROM '{folder}/{table}.parquet'").fetchall()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_words(text):
    assert [w.decode() for w in folded_words(text.encode(errors="replace"))] == FOLDED.findall(lower(text.encode(errors="replace").decode()))
    assert [w.decode() for w in plain_words(text.encode(errors="replace"))] == re.findall(r"[^\x20\x09-\x0D]+", text.encode(errors="replace").decode())


# Licenses


def test_license_places(spark, data):
    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, data).collect()}
    for doc, text in texts(data):
        words = FOLDED.findall(lower(text))
        places = {i: label for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p}
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(set(places.values()))) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def expanded(template, rng):
    """A random text of a template."""

    def region(at, take):
        out = []
        while at < len(parts) and parts[at] != "<</opt>>":
            part = parts[at]
            if part == "<<opt>>":
                inner, at = region(at + 1, rng.random() < 0.5)
                out += inner
            elif part.startswith("<<"):
                low, high = map(int, re.findall(r"\d+", part))
                out += rng.choices(["any", "x", "the", "license"], k=rng.randint(low, high))
            else:
                out.append(part)
            at += 1
        return out if take else [], at

    parts = re.findall(r"<<[^>]*>>|[^\s<]+", template)
    return region(0, True)[0]


OWN_TEMPLATES = {
    "nested": "alpha <<opt>>beta <<opt>>gamma<</opt>> delta <<opt>>eps <<var 1-2>><</opt>><</opt>> omega",
    "leading": "<<var 0-3>> alpha beta <<opt>>gamma<</opt>> omega",
    "leading-opt": "<<opt>>by <<opt>>the<</opt>><</opt>> alpha beta <<var 2-3>> omega",
    "trailing": "alpha beta <<opt>>gamma<</opt>>",
}


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES | OWN_TEMPLATES))
def test_automata_are_regular_expressions(label):
    template = (licenses.TEMPLATES | OWN_TEMPLATES)[label]
    automaton, pattern, rng = licenses.Automaton(label, template), re.compile(oracles._template(template)), random.Random(label)
    accepted = 0
    for k in range(120):
        words = " ".join(expanded(template, rng)).replace(".", " ").split()
        for _ in range(k % 3):  # most of these have other wording than the template
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], ["else"], [words[i], words[i]], [words[i], "any"]])
        text = ["before"] * rng.randrange(3) + words + ["after"] * rng.randrange(2)
        joined = f" {' '.join(text)} "
        got = automaton.places(joined.encode(), [w.encode() for w in text])
        assert bool(got) == bool(pattern.search(joined)), text
        assert all(pattern.match(" " + " ".join(text[i:]) + " ") for i in got)
        accepted += bool(got)
    assert 40 <= accepted < 120


def test_bad_templates():
    for template in ("<<opt>>a", "a <</opt>>", "<<opt>>a<</opt>>", "<<var 0-2>>", ""):
        with pytest.raises(ValueError):
            licenses.Automaton("bad", template)


def test_long_texts_take_linear_time():
    base, others = [(licenses.Automaton(p, p), label) for p, label in licenses.BASE.items()], licenses.compiled()
    began = time.perf_counter()
    assert licenses.scan_text(b"cc by nc " * 400_000, base, others)[1] == 400_000
    assert chat.parse_turn(chat.render_turn("user", "\\" * 1_000_000))[1] == "\\" * 1_000_000
    hostile = "\\\\[/INST]" * 200_000
    assert chat.parse_turn(chat.render_turn("user", hostile))[1] == hostile
    assert time.perf_counter() - began < 40


# Tokens


def test_tokens_are_the_librarys(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    odd = ["it's IT'S 'sword rock'n'roll. wait... x.,! 3.14, a1b2?", "<|endoftext|>. <|ENDOFTEXT|> a<|startoftext|>b", "é. ́x .̸ KÅ   　 \x1c ß İ ΑΣ", "漢字仮名 交じり。 ไทย", "\U0001f600!!\U0001f600", "don't. DON'T, we'll've"]
    rows = [*texts(data), *((10_000 + i, o) for i, o in enumerate(odd))]
    rows += [(20_000 + i, f"J\u030c j\u030c {c}\u0301{d}. {c}{d}\u0327, {c.upper()}\u0308{d.upper()} \u212b{c}") for i, (c, d) in enumerate(itertools.product("aejnsIK", "cgoZ"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for head in (50, 200_000):
        got = {r["doc_id"]: r for r in token_counts.token_counts(df, tokenizer(), head=head).collect()}
        for doc, text in rows:
            n = len(t.encode(text or "", add_special_tokens=False))
            assert (got[doc]["n_tokens"], got[doc]["n_bytes"], got[doc]["over_limit"]) == (n, len((text or "").encode()), n > 2048), text


@given(st.lists(st.text(alphabet=st.sampled_from("aJeOsI.,!<|>'-1\u030c\u0301\u0308\u0327\u212b\u0130\u1e9b\u0323\u1100\u1161\u11a8 \t\x1c\u3000")), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pretokens_add_up(parts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    text = " ".join(parts)
    found = token_counts.pretokens(Counter(plain_words(text.encode())))
    assert sum(n * len(t.encode(w.decode(), add_special_tokens=False)) for w, n in found.items()) == len(t.encode(text, add_special_tokens=False))


# Chat


@given(st.text(alphabet=st.sampled_from("\\ []/INSTANS<>s|TURN% \n]x")), st.sampled_from(["user", "assistant", "system", "tool", "a]b%", ""]))
@settings(max_examples=600, deadline=None)
def test_turns_come_back(text, role):
    formatted = chat.render_turn(role, text)
    back = chat.parse_turn(formatted + "[INST] next [/INST]\n")
    assert back[:2] == (role, text) and back[4] == len(formatted)
    assert chat.unescape(formatted[back[2] : back[3]]) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "a]b%", ""]), st.text(alphabet=st.sampled_from("\\ []/INSTANS<>s|TURN% \n]x"), max_size=30)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_conversations_come_back(turns):
    text, loss = chat._checked(turns)
    assert [x[:2] for x in chat.parse_conversation(text)] == turns
    assert [chat.unescape(text[x["start"] : x["end"]]) for x in loss] == [t for r, t in turns if r == "assistant"]


PREFIXES = sorted({c[:n] for c in (*chat.CONTROLS, "[TURN x]", "[/TURN] ") for n in range(1, len(c) + 1)} | {"\\\\", "\\"})
ROLES = ["user", "assistant", "system", "tool", "a]b%", "[TURN", ""]


@pytest.mark.parametrize("role", ROLES)
def test_every_part_of_a_control_string_at_the_ends_of_a_text(role):
    """Alone, at either end, at both ends, and across the seam of two turns: rendering ends and the texts come back."""
    for a in PREFIXES:
        for text in (a, f"{a} x", f"x {a}", f"x{a}", f" {a}", f"{a} "):
            assert chat.parse_turn(chat.render_turn(role, text))[:2] == (role, text)
        for b in PREFIXES:
            turns = [(role, f"{b}x {a}"), (ROLES[len(b) % len(ROLES)], f"{b}{a}"), (role, b)]
            assert [t[:2] for t in chat.parse_conversation(chat._checked(turns)[0])] == turns


@given(st.lists(st.tuples(st.sampled_from(ROLES), st.lists(st.sampled_from([*PREFIXES, " ", "x", "\n"]), max_size=8).map("".join)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_conversations_of_control_strings_come_back(turns):
    assert [t[:2] for t in chat.parse_conversation(chat._checked(turns)[0])] == turns


def test_escaping_that_changes_nothing_is_an_error(monkeypatch):
    monkeypatch.setattr(chat, "escape", lambda text: text)
    with pytest.raises(chat.Malformed):
        chat.render_turn("user", "a [/INST] b")


def test_other_text_is_malformed():
    for text in ("x", "[INST] a", "[INST] a [/INST]\n[", "[INST] [INST] [/INST]\n", "[INST] a </s>\n", "[INST] a [/INST][ANS] b </s>\n"):
        with pytest.raises(chat.Malformed):
            list(chat.parse_conversation(text))


# Near duplicates


def near_copies(n=120, seed=3):
    rng = random.Random(seed)
    out = []
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(80 + 30 * g)]
        for _ in range(n // 6):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            out.append((len(out), " ".join(words)))
    return out


def brute_links(rows):
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in rows for w in [t.split()]}
    return {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("blocks", [(2048, 512, 1 << 21), (7, 5, 1 << 21), (512, 512, 900)])
def test_links_and_classes(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(ngram_join, "CLUSTER_BLOCK", blocks[1])
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", blocks[2])
    rows = near_copies()
    links = brute_links(rows)
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(links):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    degree = Counter(x for pair in links for x in pair)
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {k: (root(k), degree[k]) for k in parent}


def test_one_is_kept_of_each_class_whatever_its_ids(spark):
    def text(k, end=""):
        return " ".join(f"{k}w{i}" for i in range(60)) + end

    rows = [(None, text("a")), (None, text("a", " more")), (None, text("b")), (None, text("b", " more"))]  # two classes without an id
    rows += [(7, text("c")), (8, text("c")), (7, text("d")), (9, text("d"))]  # two whose smallest id is 7
    rows += [(2**63 - 1, text("e")), (None, text("e")), (3, text("f")), (3, text("f")), (4, text("f", " more"))]
    wordless = [(5, None), (5, None), (6, ""), (6, ""), (None, "?!"), (None, "?!")]
    for extra in ([], [(3, text("g"))] * 2):  # wordless rows stay, with or without repeated rows elsewhere
        out = ngram_join.keep_one(spark.createDataFrame(rows + wordless + extra, "doc_id long, text string")).collect()
        got = [tuple(r) for r in out]
        assert Counter(x for x in got if x in wordless) == Counter(wordless)
        kept = [x for x in got if x not in wordless]
        assert sorted(t[0] for _, t in kept) == list("abcdef") + ["g"] * bool(extra)
        assert {t[0]: i for i, t in kept} == {"a": None, "b": None, "c": 7, "d": 7, "e": 2**63 - 1, "f": 3} | ({"g": 3} if extra else {})


def test_the_kept_row_does_not_follow_the_order_of_rows(spark):
    """Rows with one id and one text that differ in another column: one and the same stays, in any order and partitioning."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", s, n) for s in "abcdefgh" for n in (1, None)] + [(2, text + " more", "en", "z", 1)]
    got = set()
    for order, parts in ((rows, 1), (rows[::-1], 1), (rows, 5), (rows[3:] + rows[:3], 7)):
        out = ngram_join.keep_one(spark.createDataFrame(order, SCHEMA).repartition(parts)).collect()
        assert len(out) == 1 and out[0]["doc_id"] == 1
        got.add(tuple(out[0]))
    assert len(got) == 1


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 800, dtype=np.uint64)
        a, b = np.r_[common, rng.integers(0, 2**63, 100, dtype=np.uint64)], np.r_[common, rng.integers(0, 2**63, 100, dtype=np.uint64)]
        sig = [(ngram_join.minhash(x) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8) for x in (a, b)]
        lost += not len(ngram_join.plausible(sig[0], sig[1][None]))
    assert lost == 0
    far = [(ngram_join.minhash(rng.integers(0, 2**63, 500, dtype=np.uint64)) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8) for _ in range(50)]
    assert all(len(ngram_join.plausible(far[0], np.array(far[1:]))) == 0 for _ in range(1))


# Substrings


@pytest.mark.parametrize("shares", [(1.0,), (0.25, 0.25, 0.25, 0.25), (0.1, 0.1, 0.8)])
def test_repeats(spark, shares):
    rng = random.Random(5)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.randrange(10, 40))] for _ in range(12)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages)[rng.randrange(6) :] if rng.random() < 0.5 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
        rows.append((k, " ".join(words + ["same"] * rng.randrange(30))))
    first = {}
    for k, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), batch_shares=shares).collect()}
    for k, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        assert got[k]["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone) and got[k]["n_removed"] == len(gone)


def firsts(rows):
    first = {}
    for k, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    return first


def check_repeats(rows, got):
    first = firsts(rows)
    for k, t in rows:
        if k in got:
            w = t.split()
            gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
            assert got[k]["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone) and got[k]["n_removed"] == len(gone)


def mosaic(n, seed, low=13, high=21):
    """Texts of passages that begin and end inside one another, between words of their own."""
    rng = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(rng.randrange(low, high))] for k in range(14)]

    def fresh():
        return [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(8, 16))]

    return [(k, " ".join(fresh() + rng.choice(passages) + fresh() + rng.choice(passages)[rng.randrange(3) :] + fresh())) for k in range(n)]


def test_runs_have_levels_and_nothing_is_left_behind(spark):
    """Ten batches of one index: runs of a level are merged four at a time, history of higher levels is not written again, results see all
    batches, replaced runs can be deleted, and the catalog holds no table of the index afterwards."""
    ours = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("fluxtrace_")}
    before, rows = ours(), mosaic(50, 21)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index, levels, got = substring_dedup.FingerprintIndex(spark, fan_in=4), [], {}
    for k in range(10):
        part = docs.where((F.col("doc_id") >= 5 * k) & (F.col("doc_id") < 5 * k + 5))
        out = substring_dedup.remove_repeats(part, index=index, batch_shares=(1.0,), one_in=10**9)
        got |= {r["doc_id"]: r for r in out.collect()}
        levels.append(sorted(index.levels()))
    check_repeats(rows, got)
    assert levels[:5] == [[0], [0, 0], [0, 0, 0], [1], [0, 1]] and levels[-1] == [0, 0, 1, 1]
    assert len(index.vacuum()) == 8 and index.vacuum() == []
    index.close()
    assert ours() == before
    again = substring_dedup.FingerprintIndex(spark, index.folder)
    more = spark.createDataFrame([(1000 + k, t) for k, t in rows], "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(more, index=again, batch_shares=(1.0,)).collect()}
    assert all(out[1000 + k] == len(t.split()) for k, t in rows)
    again.close()
    substring_dedup.remove_repeats(docs).count()
    assert ours() == before


@pytest.mark.parametrize("one_in", [10**9, 1])
@pytest.mark.parametrize("shares", [(1.0,), (0.1, 0.1, 0.8)])
def test_calls_with_one_index_see_all_before(spark, shares, one_in):
    rows = mosaic(48, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = substring_dedup.FingerprintIndex(spark)
    index.add(df.where("doc_id < 6"))
    index.add(df.where("doc_id >= 6 and doc_id < 12"))
    assert len(index.runs) == 1  # compacted
    got = {}
    for low in (12, 24, 36):
        out = substring_dedup.remove_repeats(df.where(f"doc_id >= {low} and doc_id < {low + 12}"), index=index, batch_shares=shares, one_in=one_in, part=1 / 40)
        got |= {r["doc_id"]: r for r in out.collect()}
        index = substring_dedup.FingerprintIndex(spark, index.folder)  # opened again
    assert set(got) == set(range(12, 48))
    check_repeats(rows, got)


def test_hot_text(spark):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(k, f"{t} {common} {'x ' * (k % 5)}{common if k % 7 == 0 else ''}") for k, t in mosaic(90, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hot = substring_dedup.frequent(df, one_in=1, rows_share=1 / 300, most=1000)
    assert len(hot.minimisers) and len(hot.stretches)
    for most in (1000, 3):
        check_repeats(rows, {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, one_in=1, part=1 / 40, most=most).collect()})


def test_history_is_not_shuffled(spark):
    df = spark.createDataFrame(mosaic(30, 2), "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark)
    index.add(df.where("doc_id < 20"))
    index.add(df.where("doc_id >= 20"))
    new = substring_dedup.stretch_rows(df).repartition(index.buckets, "k")
    merged = new.unionByName(index.runs[0]).groupBy("k", "s").agg(F.min("doc"))
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


# Decontamination


def test_slices_of_a_large_benchmark(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet").unionByName(documents(spark)), spark.read.parquet(f"{data}/benchmark.parquet").unionByName(benchmark(spark))
    one = decontaminate.contamination(docs, bench).drop("text")
    many = decontaminate.contamination(docs, bench, slice_bytes=6000).drop("text")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_windows_by_brute_force():
    rng = random.Random(4)
    make = lambda n: [rng.choice("abcd") for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([0, 1, 2, 5, 13, 14, 30])))) for k in range(40)] + [(None, "a a"), (7, "b b b"), (8, "b b b")]
    for width in (3, 13):
        index = decontaminate.Index([(k, t.encode()) for k, t in items], width)
        for _ in range(20):
            words = make(rng.randrange(0, 80)) + ["zz", "a", "a"]
            want = defaultdict(set)
            for k, t in items:
                w = t.split()
                size = min(width, len(w))
                for i in range(len(w) - size + 1) if size else ():
                    for p in range(len(words) - size + 1):
                        if words[p : p + size] == w[i : i + size]:
                            want[p, size].add("" if k is None else str(k))
            assert {(p, n): ids for p, n, ids in index.hits([w.encode() for w in words])} == want


# Personal data

def luhn_valid(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(iban):
    moved = iban[4:] + iban[:4]
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in moved)) % 97 == 1


def with_luhn(body):
    return next(body + str(d) for d in range(10) if luhn_valid(body + str(d)))


def with_mod97(country, account):
    return next(x for x in (f"{country}{k:02d}{account}" for k in range(2, 99)) if iban_valid(x))


def writing(name):
    """The scripts of a name's letters."""
    return {unicodedata.name(c).split()[0] for c in name if c.isalpha()}


def shape(text):
    return re.sub("[^\\W\\d_]", "x", re.sub("[0-9]", "0", text))


def private_texts(seed=3):
    """(doc, pieces): plain strings, and (kind, who, written) for each mention of someone's data."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdgklmnoprstu") for _ in range(rng.randrange(3, 8)))
    people = []
    for k in range(40):
        digits = "".join(rng.choice("0123456789") for _ in range(40))
        family = f"{word()}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}".capitalize()
        people.append({
            "email": [f"{word()}.{k}@mail{k % 7}.example.com"], "card": [with_luhn(f"4{digits[:14]}")], "number": [f"9{digits[14:28]}"],
            "phone": [f"+1 (2{digits[1:3]}) 555-{digits[4:8]}", f"2{digits[1:3]}-555-{digits[4:8]}", f"1-2{digits[1:3]}-555-{digits[4:8]}", f"2{digits[1:3]} 555 {digits[4:8]}"],
            "private": [f"192.168.{k}.{int(digits[:2])}"], "public": [f"8.{k}.{int(digits[2:4])}.{int(digits[4:6])}"], "ipv6": [f"2a00:1450::1{digits[:2]}:{k + 1:x}"],
            "iban": [x := with_mod97("DE", digits[:18]), " ".join(x[i : i + 4] for i in range(0, len(x), 4))], "mac": [f"00:1b:44:{k:02x}:3a:b7", f"00-1B-44-{k:02X}-3A-B7"],
            "family": [family, family.upper()], "greek": ["Παπα" + "αβγδεζηθικλμνξοπρστυ"[k % 20] + "νικα"[k % 4]], "han": ["王李張劉陳"[k % 5] + "小大中文安明國英"[k // 5] + "明"],
            "given": [["John", "Jack", "Paul", "Sven"][k % 4]], "token": [hashlib.sha1(digits.encode()).hexdigest()],
        })
    out = []
    for doc in range(150):
        pieces = [f"{doc} {word()} "]
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(people))
            kind = rng.choice([x for x in people[0] if x not in ("given", "family")] + ["person"] * 3)
            if kind == "person":
                who = people[k]
                pieces += ["Mr ", ("given", who["given"][0], who["given"][0]), " ", ("family", who["family"][0], who["family"][0]), f" {word()} {word()} "]
                pieces += [rng.choice(["Dr. ", "with ", "Mr. "]), ("family", who["family"][0], rng.choice(who["family"])), f" {word()} ", ("given", who["given"][0], who["given"][0]), " ", ("family", who["family"][0], who["family"][0]), f" {word()} "]
            else:
                before = {"greek": "Κύριος ", "han": "Ms ", "token": 'token = "'}.get(kind, f"{word()} ")
                after = {"token": '" '}.get(kind, f" {word()} ")
                pieces += [before, (kind, people[k][kind][0], rng.choice(people[k][kind])), after]
        out.append((doc, pieces))
    return out


def test_private_data_by_brute_force(spark):
    rows = private_texts()
    text = lambda pieces: "".join(x if isinstance(x, str) else x[2] for x in pieces)
    df = spark.createDataFrame([(doc, text(pieces)) for doc, pieces in rows], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.replace_pii(df).collect()}
    served: dict = {}
    for doc, pieces in rows:
        mentions = [x for x in pieces if not isinstance(x, str)]
        found = re.fullmatch("".join(re.escape(x) if isinstance(x, str) else "(.+?)" for x in pieces), got[doc]["text"])
        assert found and got[doc]["n_entities"] == len(mentions), (text(pieces), got[doc]["text"])  # nothing else has changed
        for (kind, who, old), new in zip(mentions, found.groups(), strict=True):
            plain = {"phone": lambda x: re.sub("[^0-9]", "", x)[-10:], "iban": lambda x: x.replace(" ", ""), "mac": lambda x: re.sub("[:-]", "", x).lower(), "family": str.lower}.get(kind, lambda x: x)(new)
            assert served.setdefault((kind, who), plain) == plain, (kind, who)  # coreference
            form = (lambda x: re.sub("[0-9a-fA-F]", "h", x)) if kind in ("token", "mac") else shape
            assert old != new and (form(old) == form(new) or kind in ("given", "family", "greek", "public", "private", "ipv6")), (old, new)
            if kind == "card":
                assert luhn_valid(new)
            if kind == "iban":
                assert iban_valid(plain) and new[:2] == "DE"
            if kind in ("private", "public", "ipv6"):
                assert ipaddress.ip_address(new).is_private == ipaddress.ip_address(old).is_private and (kind != "private" or new.startswith("192.168."))
            if kind in ("given", "family", "greek", "han"):
                assert writing(new) == writing(old) and new.isupper() == old.isupper()
            if kind == "given":
                assert new.endswith("o")  # all were called Mr
            if kind == "phone":
                assert new.startswith(old[: old.find("2")])  # the country code stays
    assert len({(k, v) for (k, _), v in served.items()}) == len(served)  # distinct
    real = {who for _, who in served}
    assert not any(v in real for v in served.values())


ODD = [
    'sep = "--------------------"', 'x = "____________________"', "٠١٢٣٤٥٦٧٨٩٠١٢٣٤ +١٢٣ ٤٥٦٧ ٨٩٠", "ö.ö@é.de", "a@b@c.de @x.de x@ .@.de", "Mr", "Mr Mr Mr Mr", "Mr. J. Smith's and Smith’s", "Prof. Dr. Anna-Maria O'Brien, O'Brien",
    "::1 :: 1:2:3:4:5:6:7:8 a::b std::vector 12:30:45", "0.0.0.0 127.0.0.1 255.255.255.255 256.1.1.1 1.2.3.4.5", "AB12 CDEF GHIJ KLMN", "\x00\x00@\x00.de", "Frau Ǆemal Ǆ", "M. Dupont m. dupont M Dupont", "Ms ßberg Ms İnan İNAN", "Mr 王 王王",
]


def test_odd_texts_do_not_stop_the_run(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"to {x}@y.com") for i, x in enumerate("abcdefghijklmnopqrstuvwxyz")]
    rows += [(200 + i, f"{a}@{b}.com and 192.168.9.{i % 256}") for i, (a, b) in enumerate(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2))]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == ODD[0] and got[1] == ODD[1] and got[2] == ODD[2] and got[3] != ODD[3] and got[11] != ODD[11]
    assert got[10].startswith("0.0.0.0 127.0.0.1 255.255.255.255 256.1.1.1 1.2.3.4.5")
    # The shape x@y.com is full: every address is real, so all surrogates are longer; and they are distinct.
    new = [got[200 + i].split(" and ")[0] for i in range(26 * 26)]
    assert len(set(new)) == 26 * 26 and not set(new) & {t.split(" and ")[0] for k, t in rows if k >= 200}
    assert all(re.fullmatch("[a-z]+@[a-z]+[.]com", x) for x in new)
    inside = {got[200 + i].split(" and ")[1] for i in range(26 * 26)}
    assert len(inside) == 256 and all(ipaddress.ip_address(x).is_private for x in inside) and not inside & {f"192.168.9.{i}" for i in range(256)}


@given(st.text(alphabet=st.sampled_from("aB1.@:-_+ (\"'=/)MrDs王Жω\u0661é\n"), max_size=60))
@settings(max_examples=500, deadline=None)
def test_any_text_is_rewritten(text):
    new, n = pii.replaced(text, {})
    assert (n > 0) == bool(list(pii.entities(text))) and (n or new == text)
    spans = [x[:2] for x in pii.entities(text)]
    assert all(0 <= b < e for b, e in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


@given(st.lists(st.text(alphabet="0123456789", min_size=10, max_size=10), min_size=2, max_size=60, unique=True), st.sampled_from(["phone", "account", "ssn"]))
@settings(max_examples=60, deadline=None)
def test_one_shape_has_no_clash(numbers, kind):
    made = [f"{x[:3]}-{x[3:5]}-{x[5:9]}" for x in numbers] if kind == "ssn" else numbers
    assert len({pii.surrogate(kind, x) for x in set(made)}) == len(set(made))


def test_addresses_are_permuted_within_their_network():
    for base in ("10.0.0.0", "172.16.0.0", "192.168.0.0", "8.8.8.0", "224.0.0.0"):
        first = ipaddress.ip_address(base)
        made = {pii.surrogate("ip", str(first + i)) for i in range(300)}
        assert len(made) == 300 and all(ipaddress.ip_address(x).is_private == first.is_private and ipaddress.ip_address(x).is_multicast == first.is_multicast for x in made)


def test_forms_of_one_address():
    for forms in (("2a00:1450:0:0:0:0:0:7", "2a00:1450::7", "2A00:1450::0007"), ("::ffff:102:304", "0:0:0:0:0:ffff:102:304"), ("fe80::1:2", "fe80:0:0:0:0:0:1:2")):
        new = {pii.replaced(f"at {x} now", {})[0].split()[1].lower() for x in forms}
        assert len(new) == 1 and ipaddress.ip_address(new.pop()) != ipaddress.ip_address(forms[0])


def test_clashes_are_drawn_again(spark):
    first = [f"{i}.{j}@a.de" for i in range(10) for j in range(10)]  # a full shape: every surrogate is a real address
    family = [f"Frau {a}{b}" for a in "ABCDEFGH" for b in ("ann", "orn", "ell", "ist")]
    rows = [(i, f"to {x} and {family[i % len(family)]}") for i, x in enumerate(first)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent = {r["doc_id"]: r["text"] for r in pii.replace_pii(df).collect()}
    joined = {r["doc_id"]: r["text"] for r in pii.replace_pii(df, broadcast_exceptions=-1).collect()}
    assert sent == joined
    assert len({t.split(" and ")[0] for t in sent.values()}) == len(rows)
    by_name = defaultdict(set)
    for i, t in sent.items():
        by_name[family[i % len(family)]].add(t.split(" and ")[1])
    assert all(len(x) == 1 for x in by_name.values()) and len(set.union(*by_name.values())) == len(family)


SIMPLE = {  # the kinds of the test tables, by patterns of their own
    "email": r"[a-z]+\.\d+@mail\d\.example\.com", "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])", "phone": r"\+1 \(\d{3}\) 555-\d{4}", "token": r'(?<=token = ")[0-9a-f]{40}(?=")', "card": r"(?<!\d)\d{16}(?!\d)",
}


def test_names_by_script_mark_and_apostrophe():
    texts = {
        "Mr विकास was here and विकास left": 2, "Mr. Jose\u0301 met Jos\u00e9.": 2, "Mr. O\u2019Neil, O'Neil, O'NEIL but Neil": 3, "Frau D'angelo-Smith": 1, "Mr สมชาย ใจดี": 2,
    }
    for text, n in texts.items():
        new, found = pii.replaced(text, {})
        assert found == n
        old = re.findall(pii._NAME, text)
        made = re.findall(pii._NAME, new)
        assert len(old) == len(made)
        for a, b in zip(old, made, strict=True):
            assert writing(a) == writing(b) and re.findall("['’-]", a) == re.findall("['’-]", b) and [x[:1].isupper() for x in re.split("['’-]", a)] == [x[:1].isupper() for x in re.split("['’-]", b)]
    new = pii.replaced("Mr. Jose\u0301 met Jos\u00e9.", {})[0]
    assert len(set(re.findall(r"M?r?[.]? ?(\w+)", new.replace("Mr. ", "").replace(" met ", " ").rstrip(".")))) == 1 and not re.search("\u0301", new)
    vowels = [x for x in pii.replaced("Mr विकास", {})[0][3:] if unicodedata.category(x) == "Mc"]
    assert len(vowels) == 2 and "ि" not in vowels


def test_numbers_with_and_without_their_country():
    for code, forms in {
        "+44": ["+44 20 7946 0958", "020 7946 0958", "(020) 79460958", "+44 (0)20 7946 0958", "20 7946 0958"], "+33": ["+33 6 12 34 56 78", "06 12 34 56 78", "0612345678"],
        "+49": ["+49 30 123456", "030 123456", "030/123456"], "+39": ["+39 06 1234 5678", "06 12345678"], "+1": ["+1 555 123 4567", "555 123 4567", "(555) 123-4567"],
    }.items():
        new, n = pii.replaced(" or ".join(forms), {})
        made = new.split(" or ")
        assert n == len(forms) and made[0].startswith(code) and made[0] != forms[0]
        core = lambda x: re.sub("[^0-9]", "", x.replace("(0)", "")).removeprefix(code[1:]).lstrip("0")
        assert len(set(map(core, made))) == 1, made
        assert [re.sub("[0-9]", "0", x) for x in made] == [re.sub("[0-9]", "0", x) for x in forms]
        assert [x[0] == "0" for x in made] == [x[0] == "0" for x in forms]
    assert pii.replaced("020 7946 0958 alone", {})[1] == 0


def planted_names(n=400, seed=11):
    """(text, names): invented names of three scripts, called by a form of address once and bare once more."""
    rng = random.Random(seed)
    letters = {"latin": ("bcdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστ", "αεηιο")}
    titles = {"latin": ["Mr.", "Mrs", "Dr.", "Frau", "my name is", "Señora"], "cyrillic": ["Г-н", "Г-жа"], "greek": ["Κύριος", "Κυρία"]}
    for _ in range(n):
        script = rng.choice(sorted(letters))
        c, v = letters[script]
        word = lambda: "".join(rng.choice(c) + rng.choice(v) for _ in range(rng.randrange(2, 5)))
        family = word().capitalize() + rng.choice(["", "-" + word().capitalize()])
        given_ = word().capitalize()
        yield f"{word()} {rng.choice(titles[script])} {given_} {family} {word()}, {word()} {family} {word()} and {given_} {word()}.", (given_, family)


def test_recall_of_planted_names():
    found = total = 0
    for text, names in planted_names():
        new = pii.replaced(text, {})[0]
        for name in names:
            total += 2
            found += 2 - len(re.findall(rf"(?<!\w){re.escape(name)}(?!\w)", new))
    assert found / total > 0.99


def test_no_entity_is_left(spark, data):
    got = {r["doc_id"]: r["text"] for r in QUERIES["op7_pii_surrogates"](spark, data).collect()}
    served, real = {}, set()
    for i, old in texts(data):
        hits = sorted((m.start(), m.end(), kind, m[0]) for kind, p in SIMPLE.items() for m in re.finditer(p, old or ""))
        real |= {x[3] for x in hits}
        if not hits:
            assert got[i] == old
            continue
        plain, end = [], 0
        for b, e, *_ in hits:
            plain.append(re.escape(old[end:b]))
            end = e
        found = re.fullmatch("(.+?)".join([*plain, re.escape(old[end:])]), got[i], re.S)
        assert found, old
        for (_, _, kind, x), new in zip(hits, found.groups(), strict=True):
            assert served.setdefault((kind, x), new) == new and re.fullmatch(SIMPLE[kind].replace('(?<=token = ")', "").replace('(?=")', "").replace("example", "[a-z]+").replace("mail", "[a-z]+").replace("555", r"\d+").replace("com", "[a-z]+"), new), (x, new)
    assert real and len(set(served.values())) == len(served) and not set(served.values()) & real


# The pipeline


def test_pipeline(spark, data):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()
    judged = dict(connection(data).execute(f"SELECT doc_id, kept FROM ({oracles.ORACLES['op6_host_quality_rules']})").fetchall())

    def repeated(words):
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(windows)
        return len({j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)})

    for k, t, _ in rows:
        w = plain_words((t or "").encode())
        if len(w) < 20 or 100 * repeated(w) > 30 * len(w):
            assert not judged[k]
    docs = [r for r in rows if judged[r[0]]]
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t, _ in docs for w in [folded_words(t.encode())]}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    docs = [r for r in docs if root(r[0]) == r[0]]
    windows = set()
    for _, t in texts(data, "benchmark", "item_id"):
        w = folded_words((t or "").encode())
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12)) if w}
    clean = []
    for k, t, s in docs:
        w, hit = folded_words(t.encode()), set()
        for size in {len(x) for x in windows}:
            hit |= {j for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for j in range(i, i + size)}
        if not hit or 20 * len(hit) < len(w):
            clean.append((k, pii.replaced(t, {})[0], s))
    size = {k: len(t.split()) for k, t, _ in clean}
    total = Counter()
    for k, _, s in clean:
        total[s] += size[k]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}
    target, free = {}, set(total)
    budget = 1.5 * sum(total.values())
    while True:  # clamp and share the rest again until no source is above its cap
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = {}
    for s in total:
        whole = min(2, int(target[s] // total[s])) if total[s] else 0
        rest, upto = target[s] - whole * total[s], 0
        for _, k in sorted((int(hashlib.md5(f"17|{k}|{t}".encode()).hexdigest()[:15], 16), k) for k, t, x in clean if x == s):
            upto += size[k]
            taken[k] = size[k] * min(2, whole + (upto - size[k] / 2 <= rest))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(got) == {k for k, *_ in clean}
    for k, t, s in clean:
        assert got[k]["text"] == t and got[k]["taken"] == taken[k] and abs(got[k]["target"] - target[s]) < 1e-6


def test_word_hashes_forget(monkeypatch):
    h = WordHashes(most=3)
    assert [h[w] for w in (b"a", b"b", b"c", b"d", b"a")][0] == h[b"a"] and len(h) <= 3


assert SCHEMA
