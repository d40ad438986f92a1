"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("rankloom.llm.queries")
from rankloom.llm import decontamination, html_crf, language_id, licenses, near_dedup, quality_model, quality_rules, queries, sentencepieces, substring_dedup, token_store  # noqa: E402

DDL = "doc_id bigint, text string, lang string, id string, n int, key string, words string, bucket int, item_id int, score double"
LONG = " ".join(random.Random(1).choices([f"w{i}" for i in range(5000)], k=60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, LONG), (6, LONG), (7, "tie tie tie tie tie tie"), (7, "tie tie tie tie tie tie"), (None, "lost id of ten words and more to be seen here"), (8, "é ß \U0001f600 日本 ▁x\x00")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "x", 1, "k", "w", 2, 3, 0.5) for i, t in ROWS], DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_html(spark):
    page = lambda *ps: spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(ps)], "page_id int, url string, html string, text string")
    cases = [None, "", "<p", "plain words only", "<article><p>A &amp; B<br>c</p><p>d<li>e</article><footer>&copy; x</footer>", "<nav><a href=x>n</a></nav>" + "<article>" + "<p>long.</p>" * 20_000]
    got = {r.page_id: r for r in html_crf.extract(page(*cases)).collect()}
    assert [got[i].text for i in (0, 1, 2)] == ["", "", ""] and got[0].n_chars == 0
    assert got[4].text == "A & B c\nd\ne" and got[5].text.count("\n") == 19_999
    assert html_crf.extract(page()).count() == 0


def test_html_layouts_that_were_not_trained_on():
    model, pages = html_crf.default_model(), html_crf.training_pages(150, seed=1234)
    right = [a == b for chain, y in pages for a, b in zip(model.decode(chain), y)]
    assert np.mean(right) > 0.99


def test_quality(odd, none, spark):
    got = by_id(quality_rules.ledger(odd))
    assert [got[i].n_words for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and got[7].n_repeat_words == 6 and got[5].n_words == 60_000
    assert quality_rules.ledger(odd).count() == len(ROWS) and quality_rules.ledger(none).count() == 0
    rows = quality_rules.ledger(odd)
    for r in quality_rules.ablation(rows).collect():
        rule = next(x for x in quality_rules.RULES if x.name == r.rule)
        rest = quality_rules.mask(quality_rules.CURRENT) & ~(1 << rule.bit)
        assert r.n_failed == rows.where(rule.fails).count() and r.n_kept_without == rows.where(F.expr(f"failures & {rest} = 0")).count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=4))
def test_repeated_words(texts):
    ids, bounds = np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)])
    want = []
    for t in texts:
        wins = [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
        want.append(len({p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 5)}))
    assert quality_rules.repeated_words(ids, bounds).tolist() == want


def test_licenses(spark):
    rows = [
        ("src/LICENSE", "Released under the MIT License."), ("src/a/b/c.txt", "text"), ("src/a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("src/a/d.txt", "SPDX-License-Identifier: GPL-3.0-only\ncode"),
        ("src/b/e.txt", "the licence plate of a car was seen by many people in town"), ("src/a2/f.txt", None), ("other/g.txt", ""), ("other/g.txt", ""), (None, "x"), ("src/LICENSE-2", "Released under the MIT License."),
    ]
    files = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, license string")
    got = {r.path: r for r in licenses.scan(files).collect()}
    assert (got["src/a/b/c.txt"].license, got["src/a/b/c.txt"].origin, got["src/a/b/c.txt"].licensed_by) == ("Apache-2.0", "inherited", "src/a/LICENSE")
    assert (got["src/a/d.txt"].license, got["src/a/d.txt"].origin) == ("GPL-3.0", "own")
    assert (got["src/b/e.txt"].license, got["src/b/e.txt"].licensed_by) == ("MIT", "src/LICENSE") and got["src/a2/f.txt"].license == "MIT"
    assert got["other/g.txt"].origin == "none" and got[None].origin == "none"
    assert licenses.scan(files.where("false")).count() == 0
    assert licenses.scan(files, licenses.templates(spark, {})).where("origin != 'none'").count() == 0


def test_token_store(odd, none):
    path = queries.tokenizer_file("word_bpe_49k.json")
    got = token_store.write_store(odd, path).documents().orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8] and got[0].start == 0
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert token_store.write_store(none, path).documents().count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(0).integers(0, 2**32, 1000, dtype=np.uint32)
    assert (token_store.unplanes(token_store.planes(ids)) == ids).all()
    assert token_store.train_dictionary([]) == b""


def test_words_are_encoded_as_texts_are():
    coder = token_store.Encoder(queries.tokenizer_file("word_bpe_49k.json"), 2)
    rnd, parts = random.Random(3), [*"abZé'sTÉ .,≠́ſİßÀ\n\t()#1²٣-_<>=", "'re", "<|endoftext|>", "the", " "]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(16))) for _ in range(3000)]
    want = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(a[:-1].tolist() == b.ids and a[-1] == 2 for a, b in zip(coder.encode(pa.array(texts, pa.large_string())), want))


def test_quality_model(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (99, 1), (None, 1), (6, None)], "doc_id bigint, quality int")
    w = quality_model.fit(odd, labels, "quality")
    got = quality_model.score(odd, w).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    flat = quality_model.fit(odd, labels.where("false"), "quality")
    assert {r.score for r in quality_model.score(odd, flat).collect()} == {0.5}
    assert quality_model.score(none, w).count() == 0


def test_language(odd, none, spark):
    model = language_id.fit(spark.createDataFrame([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model[0] == ["de", "en"]
    got = by_id(language_id.predict(odd, model))
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[4].lang_pred in ("de", "en")
    assert language_id.predict(none, model).count() == 0
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}


def brute_spans(rows):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if x in seen else set()
            seen.add(x)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(a for k, a in enumerate(w) if k not in gone)).hexdigest())
    return out


def test_substrings(odd, none):
    got = substring_dedup.remove_repeats(odd, keep=("lang",), with_text=True)
    rows = by_id(got)
    assert rows[6].n_removed == 60_000 and rows[6].kept_text == "" and rows[5].n_removed == 0 and rows[1].kept_text in (None, "")
    assert rows[None].n_removed == 0 and got.count() == len(ROWS) and substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("most", [0, 3, 4000])
def test_substrings_against_brute_force(spark, monkeypatch, most):
    """Few words, so that runs repeat in and across documents; shards are dealt anew to the end, a few times and never."""
    monkeypatch.setattr(substring_dedup, "MAX_SEGMENTS", most)
    if most == 3:  # nearly every key counts as hot
        monkeypatch.setattr(substring_dedup, "HOT_PARTS", 50)
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", 1)
    rnd = random.Random(most)
    base = [rnd.choices("ab", k=60) for _ in range(4)]
    rows = []
    for i in range(60):
        words = rnd.choices("abc", k=rnd.randrange(70))
        for _ in range(rnd.randrange(3)):
            b = rnd.choice(base)
            s = rnd.randrange(40)
            words[rnd.randrange(len(words) + 1) : 0] = b[s : s + rnd.randrange(15, 40)]
        rows.append((i, " ".join(words + (["a"] * 45 if i % 10 == 0 else []))))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_spans(rows)


def test_substrings_of_rows_that_share_an_id(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:60])), (1, " ".join(words[100:150])), (1, "short"), (2, " ".join(words[20:60])), (2, " ".join(words[20:60])), (3, " ".join(words[100:150]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    runs = [sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs.repartition(k)).collect()) for k in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert {r[2] for r in runs[0] if r[0] == 1} == {0} and sorted(r[2] for r in runs[0] if r[0] != 1) in ([0, 0, 0], [0, 0, 50], [0, 40, 40], [40, 40, 50])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=4), st.text("abc", max_size=15))
def test_matching_statistics(reference, text):
    a = substring_dedup.SuffixAutomaton()
    for r in reference:
        a.add(r)
    want = [max(n for n in range(e + 2) if n == 0 or any(text[e + 1 - n : e + 1] in r for r in reference)) for e in range(len(text))]
    assert a.statistics(text) == want


def test_given_reference(spark, monkeypatch):
    ref = spark.createDataFrame([("a b c d e",), (None,)], "text string")
    docs = spark.createDataFrame([(1, "x a b c y"), (2, None)], "doc_id int, text string")
    got = by_id(substring_dedup.against_reference(docs, ref, span=3))
    assert (got[1].n_removed, got[1].kept_text) == (3, "x y") and got[2].n_words == 0
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 2)
    monkeypatch.setattr(substring_dedup, "SHARDS_AT_ONCE", 1)
    more = ref.unionByName(spark.createDataFrame([("p q r",), ("c y z",), ("",)], "text string"))
    long = docs.unionByName(spark.createDataFrame([(3, "a b c y z p q r p")], "doc_id int, text string"))
    got = by_id(substring_dedup.against_reference(long, more, span=3))
    assert (got[1].kept_text, got[3].kept_text, got[3].n_removed, got[2].kept_text) == ("x y", "p", 8, "")


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()]
    assert (6, 59_996, 5, False) in got and got.count((7, 1, 7, True)) == 2 and (1, 0, 1, True) in got and (4, 1, 4, True) in got
    assert [g[2:] for g in got if g[0] is None] == [(None, True)]
    assert len(got) == len(ROWS) and near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    """Variants of a few texts at all distances from the threshold, chains among them."""
    rnd, rows = random.Random(seed), []
    for base in range(4):
        words = [f"b{base}w{i}" for i in range(120)]
        for v in range(30):
            if v % 3 == 0:
                words = [w if rnd.random() > 0.02 else f"r{rnd.random()}" for w in words]
            rows.append((len(rows), " ".join(w if rnd.random() > 0.015 * (v % 4) else f"r{rnd.random()}" for w in words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(x, x) == r for x, r in root.items())


def test_decontamination(odd, none, spark):
    words = [f"t{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words[:15]), 0), (2, "Short ITEM", 0), (3, None, 0), (4, "...", 0), (5, " ".join(words[:15]), 0), (6, "uno due tre quattro cinque sei", 0)], "item_id int, text string, doc_id int")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[:10]) + " y"), (2, "a short-item b"), (3, " ".join(words[:9])), (4, None), (5, "UNO, due tre quattro cinque sei! sette"), (5, "UNO, due tre quattro cinque sei! sette"), (None, "short item"), (6, " ".join(words[3:15]) + " " + " ".join(words[:15]))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (10, 2, hashlib.sha256(b"1,5").hexdigest())
    assert (got[2].n_hit, got[2].n_items) == (2, 1) and not got[3].contaminated and got[4].n_words == 0 and got[5].n_hit == 6 and got[None].n_hit == 2 and got[6].n_hit == 27
    assert got[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontamination.decontaminate(none, items).count() == 0 and decontamination.decontaminate(odd, items.where("false")).where("contaminated").count() == 0


def test_pieces(odd, none):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    got = sentencepieces.encode(odd, path)
    assert got.where("not round_trip").count() == 0 and by_id(got)[1].n_pieces == 0 and sentencepieces.encode(none, path).count() == 0
    texts = {(r.doc_id, r.text) for r in sentencepieces.decode(got.select("doc_id", "ids"), path).collect()}
    assert texts == {(i, t or "") for i, t in ROWS}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_pieces_round_trip(text):
    coder = test_pieces_round_trip.__dict__.setdefault("coder", None) or test_pieces_round_trip.__dict__.__setitem__("coder", sentencepieces.Pieces.load(queries.tokenizer_file("piece_bpe_32k.model"))) or test_pieces_round_trip.__dict__["coder"]
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert coder.decode(coder.encode_batch([text])[0].tolist()) == text
