"""Sets of a thousand items and more, repeated ids, and rules that run only where a text needs them."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from itembank.functions import glyph
from itembank.functions import patterns as P
from itembank.functions.glyph import rejoined
from itembank.operators import pages as PG
from itembank.plans import bank
from itembank.sources import derive


def documents(spark, path, rows):
    """A folder of tables with these documents."""
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{path}/documents.parquet")
    for table in derive.TABLES[1:]:
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(1).write.parquet(f"{path}/{table}.parquet")
    return str(path)


def test_numbers_go_on_over_nulls_and_repeated_ids(spark):
    rows = [(2, "a", "y"), (1, "a", "x"), (2, "a", "x"), (2, "a", "x"), (None, "a", "n"), (7, None, None), (9, None, "z")]
    got = sorted((r.set_id or "", r.item, r.doc_id or 0, r.text) for r in derive.numbered(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect())
    assert [r[:2] for r in got] == [("", 1), ("", 2), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5)]
    assert [r[2:] for r in got if r[0] == "a"] == [(0, "n"), (1, "x"), (2, "x"), (2, "x"), (2, "y")]
    assert [r[2:] for r in got if r[0] == ""] == [(7, ""), (9, "z")]


def test_no_window_holds_texts_of_a_whole_source(spark, sf):
    plan = derive.derived(spark, sf, "pages_q")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any(re.search(r"\[source#\d+\], \[doc_id", line) and "row_number" in line for line in windows)


def test_pages_of_long_sets_keep_their_numbers(spark):
    text = "Exam Section: Item 12345 of 500\n12345. A 30-year-old man has had pain for 2 days.\nWhich of the following is the most likely diagnosis?\nA) Arterial embolism\nB) Chronic gastritis\nC) Viral hepatitis"
    row = PG.parse_question_pages(spark.createDataFrame([("s", 7, text)], "set_id string, page_number int, text string")).first()
    assert row.item == 12345 and row.stem.startswith("A 30-year-old man") and [c.label for c in row.choices] == ["A", "B", "C"]
    answer = "12345. A 30-year-old man has had pain for 2 days.\nCorrect Answer: B.\nThe findings show that this is best."
    row = PG.parse_answer_pages(spark.createDataFrame([("s", 7, answer)], "set_id string, page_number int, text string")).first()
    assert (row.item, row.key) == (12345, "B")


def test_pages_without_a_short_number_are_counted_together(spark, tmp_path):
    sf = documents(spark, tmp_path, [(k, "a", f"text {k}") for k in range(1, 1004)])
    got = {r["item"]: r.n_pages for r in bank.QUERIES["source_for_item"](spark, sf).collect()}
    assert got[None] == 4 and got[999] == 1 and len(got) == 1000
    assert {r["item"] for r in bank.QUERIES["source_stem"](spark, sf).where("page_number > 999").collect()} == {None}


SAMPLES = [
    "lncorrect Answers", "5 /MM 3", "5 µm 3", "an S21", "S 3", "V\t4", "vitamin B,2", "Vitamin B,7", "vitamin b, (x", "Vitamin B 12", "KG/m2", "Pap smears", "papsmear", "HPVx", "the | following", "a | b", "FEV , FVC", "7 %", "150 Ib",
    "a ,b", "a\n,b", "a .b", "see HTTPS://x.y", "x ~~ p, r", 'x "~ p', "x ' ∼ p,", "x r-- ", "x\n ~ ", "x,. ", "2020 Clinical Mastery Series", "microsoft edge", "Profile 3", "Surgery Self-Assessment", "1 hr 02 min", "x · Mark", "a  b",
    "a proceed to next item b", "x Full Screen y", "\nOB)", "\nO DI", "x O B) y", "x A. Bcd", "x.A) Bcd", "x B)y", ") C)", "x O Abc", "a b", "a \nb", "a\n\n\nb", "3 . 4", "a/b c", "39°\nC", "39\n°C", "(9.5\nC)", "°\nC)",
]


@pytest.mark.parametrize("name", ["TYPOGRAPHICS", "FOOTER", "LEADING_PHRASES", "CHOICE_MARKUP", "CLEAN", "GLYPH_REPAIRS", "TEMPERATURE_WRAPS"])
def test_what_a_rule_finds_holds_what_it_needs(spark, name):
    texts = spark.createDataFrame([(t,) for t in SAMPLES], "t string")
    for pattern, _ in getattr(P, name):
        need = P.NEEDS[pattern]
        found = [r.t for r in texts.where(F.col("t").rlike(P.java(pattern))).collect()]
        assert found or need is None, pattern
        for t in found:
            assert need is None or (re.search(need, t) if isinstance(need, str) else any(part in t for part in need)), (pattern, t)


def test_word_boundaries_are_those_of_ascii_words(spark):
    for pattern in (r"(?i)\bthis option is\b|\bis incorrect\b", r"\b(\d+)\s+Ib\b", r"(?i)\b(?:Surgery|[A-P]x)\b", r"\b\d{2}\b", r"\bS\s+([1-4])\b", r"(?i)\b([A-P])\s+is\b"):
        for t in ("this option is", "xthis option is", "éthis option is é", "_is incorrect", "5 Ib", "a5 Ib", "15 Ib x", "surgery", "xsurgery", "Ax", "AAx", "12", "123", "é12", "S 3", "SS 3", "S 34", "b is", "bb is", "b isé"):
            plain = re.search(pattern, t, re.ASCII) is not None
            assert spark.range(1).select(F.lit(t).rlike(P.java(pattern))).first()[0] is plain, (pattern, t)


def test_a_line_of_many_words_is_rejoined_in_linear_time(spark):
    text = "anx i ety and numb ness " * 20_000
    got = spark.createDataFrame([(text,), (None,)], "t string").select(rejoined(F.col("t")).alias("t")).collect()
    assert got[0].t == "anxiety and numbness " * 20_000 and got[1].t is None


def test_rejoining_asks_only_pairs_that_may_join(spark):
    """Every pair of parts joins as PAIR and the kept words say, whatever is asked before."""
    parts = "me a an An ab xyz yst cyst str stra spl splen hy ly pathy der ness ing tion i ety numb anx hepa éab ab, x1 Pre pre- b1 (ne ps psych ic the pain syst thr iso osis 3mg fract ured u".split()
    kept = set(P.KEEP_WORDS)
    pairs = [(a, b) for a in parts for b in parts if re.match("[a-z]", b)]
    got = spark.createDataFrame([(f"{a} {b}",) for a, b in pairs], "t string").select("t", rejoined(F.col("t"), 1).alias("r")).collect()
    fits = re.compile(glyph.PAIR.replace(r"\z", r"\Z"), re.ASCII)
    for row, (a, b) in zip(got, pairs, strict=True):
        m = re.match(r"[^A-Za-z]*([A-Za-z]+) ([a-z]+)[^A-Za-z]*\Z", row.t)
        barred = m is None or m[2] in kept or (m[1].lower() in kept and m[1].lower() != "me")
        assert row.r == (a + b if not barred and fits.search(row.t) else row.t), row
    assert 100 < sum(row.r != row.t for row in got) < len(got) / 2


def test_words_that_cannot_join_are_not_matched_pair_by_pair(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(glyph.re, "compile", lambda p, *a, real=re.compile: Asked(real(p, *a), asked) if p.startswith("^[^A-Za-z]*(?!") else real(p, *a))
    rejoin = glyph._rejoin(8).func
    words = [f"{a}{b}" for a in ("lamin", "corad", "mites", "rodan") for b in ("ado", "isel", "ura", "emon")]
    text = " ".join(f"{a} {b}" for a in words for b in words)
    assert rejoin(pd.DataFrame({"text": [text], "broken": [True]}))[0] == text and not asked


class Asked:
    def __init__(self, pattern, asked):
        self.pattern, self.asked = pattern, asked

    def search(self, text):
        self.asked.append(text)
        return self.pattern.search(text)

    def __getattr__(self, name):
        return getattr(self.pattern, name)
