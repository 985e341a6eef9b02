"""Spelling variants, toxicity and infilling against plain versions, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from itembank.llm import infilling, queries, spelling, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "settlement settlement settlemant settlement, settlements Settlement SETTLEMENT settlement"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, WORDS, None, "b", 5), (3, WORDS, None, "b", 5), (None, WORDS * 3, "en", "a", 1), (None, None, None, None, None),
    (8, "you <P> idiot\n\t", "en", "c", 4), (9, "é" * 50_000 + " \x1c\x85 1234 don't \U0001f600\U0001f600 　 ", "en", "c", 4), (10, "#*$%&|<> " * 20, "en", "c", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of odd cases, with columns that are named like those the operators make."""
    docs = spark.createDataFrame(ODD, DOCS)
    return docs.withColumns({c: F.lit("x") for c in ("word", "n", "score", "output", "key", "fold")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_counts(rows):
    seen = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """Near words by their strings with one place left open or out."""
    open_, out = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            open_[w[:i], w[i + 1 :]].add(w)
            out[w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in words}
    for group in open_.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        near[w] |= out.get(w, set())
        for v in out.get(w, ()):
            near[v].add(w)
    return near


def plain_variants(n):
    near = plain_near(n)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return rows


def test_spelling_query(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op11_spelling(spark, sf01).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(plain_counts(docs))
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want and any(r.form for r in rows)


def test_spelling_chains_and_ties(spark):
    n = {"aaaaaaa": 3, "aaaaaab": 40, "aaaaabb": 500, "aaaabbb": 6000, "aaabbbb": 70000, "aaaaaac": 40, "bbbbbbbb": 2, "bbbbbbb": 19, "ccccccc": 2, "cccccccc": 20, "stranger": 2, "srtanger": 900}
    got = spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long")).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == plain_variants(n)
    assert {r.word: r.root for r in got}["aaaaaaa"] == "aaabbbb"


def test_near_words_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(600)} | {"x" * 5000, "x" * 5001})
    got = spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).select("word", "near").collect()
    want = {(w, v) for w, vs in plain_near(words).items() for v in vs}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_spelling_odd(odd, none):
    got = spelling.spelling_variants(odd).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == plain_variants(plain_counts([r[:2] for r in ODD]))
    assert spelling.spelling_variants(none).count() == 0


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 8, 9, 100, 3000):
        widths = rng.integers(1, 9, n).astype(np.int32)
        ends = np.r_[0, np.cumsum(widths)]
        list_ = infilling.SkipList(n, widths)
        assert [list_.reach(k) for k in range(n + 1)] == ends.tolist()
        assert len(list_.lanes) >= (3 if n >= 3000 else 1)
    long = infilling.SkipList(3_000_000)
    assert all(long.reach(k) == k for k in (0, 1, 2_999_999, 3_000_000, 1_234_567))


def test_infill_units_and_marks():
    text = "Two words, \U0001f600 é́ and\nmore  "
    unit = regex.compile(r"\s+|\S+")
    for key in map(str, range(300)):
        for u in (None, unit):
            n, form, before, middle, out = infilling.infill(text, key, u)
            assert n == (len(text) if u is None else len(unit.findall(text)))
            if form == "plain":
                assert out == text and before is None
            else:
                a, b = text[:before], text[before : before + middle]
                want = f"<P>{a}<S>{text[before + middle:]}<M>{b}" if form == "psm" else f"<S>{text[before + middle:]}<P>{a}<M>{b}"
                assert out == want and (u is None or {len(a), len(a + b)} <= {0, *(m.end() for m in unit.finditer(text))})
    assert infilling.infill("a <S> b", "1")[1] == "plain" and infilling.infill("", "1")[1] == "plain"
    with pytest.raises(ValueError):
        infilling.infill("ab c", "1", regex.compile(r"\w+"))


def test_infill_round_trip(spark, odd, none):
    rows = infilling.infill_digest(infilling.fill_in_middle(odd)).collect()
    want = sorted((hashlib.sha256((r[1] or "").encode()).hexdigest(), len(r[1] or "")) for r in ODD)
    assert sorted((r.restored_sha256, r.n) for r in rows) == want
    assert infilling.fill_in_middle(none).count() == 0
    assert infilling.fill_in_middle(odd, unit=r"(?s)\S+|\s+").count() == len(ODD)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    rows = queries.op12_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    score, y, predicted = map(np.array, zip(*held))
    caught, right = (predicted[y == 1]).mean(), y[predicted == 1].mean()
    print(f"held out: {len(y)} rows, {y.sum()} toxic, AUC {auc(score, y):.3f}, recall {caught:.3f}, precision {right:.3f}, mean score {score.mean():.3f} of {y.mean():.3f}")
    assert auc(score, y) > 0.9 and caught > 0.75 and right > 0.8 and abs(score.mean() - y.mean()) < 0.04


def test_toxicity_never_learns_held_out(spark, sf01):
    docs, labels = spark.read.parquet(f"{sf01}/documents.parquet"), spark.read.parquet(f"{sf01}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.toxicity_scores(docs, toxicity.fitted(docs, rows)).collect()} for rows in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_odd(spark, sf01, odd, none):
    docs, labels = spark.read.parquet(f"{sf01}/documents.parquet"), spark.read.parquet(f"{sf01}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    rows = toxicity.toxicity_scores(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.toxicity_scores(none, model).count() == 0
    assert toxicity.fitted(odd, labels.where("false")) is None
    assert {r.score for r in toxicity.toxicity_scores(odd, None).collect()} == {0.0}


def test_toxicity_features():
    table = toxicity.TokenTable({"idio": 4.0, "idiot": 5.0, "loser": 2.0})
    x = {f: v for f, v in zip(toxicity.FEATURES, toxicity.text_features(["You IDIOT! you l0ser, i d i o t and idi*ot."], table)[0])}
    assert x["hits"] * 11 == pytest.approx(4) and x["spaced"] * 11 == pytest.approx(1) and x["disguised"] * 11 == pytest.approx(3) and x["near_second_person"] * 11 == pytest.approx(2)
    assert x["shouted"] * 11 == pytest.approx(1) and x["second_person"] * 11 == pytest.approx(2) and x["exclaimed"] * 11 == pytest.approx(1)


def test_isotonic_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        s, y, w = rng.random(30), rng.integers(0, 2, 30).astype(float), rng.random(30) + 0.1
        at, p = toxicity.isotonic(s, y, w)
        assert (np.diff(p) > 0).all() and (np.diff(at) > 0).all()
        order = np.argsort(s)
        y, w = y[order], w[order]
        lower = [max(min((w[a : b + 1] * y[a : b + 1]).sum() / w[a : b + 1].sum() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
        assert sorted(set(np.round(lower, 9))) == sorted(set(np.round(p, 9)))
