"""Tests that spare a page its dearer rules: what they leave out changes nothing."""

import random
import re

from pyspark.sql import functions as F

from itembank.functions import choices as C
from itembank.functions import glyph, labs
from itembank.functions import patterns as P
from itembank.functions import text as T
from itembank.functions.rules import _replaced, trim, until_same


def drawn(spark, parts, n, longest, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([("".join(rng.choices(parts, k=rng.randint(1, longest))),) for _ in range(n)], "t string")


def test_one_test_for_all_choice_rules_equals_plain_rules(spark):
    parts = ["A", "B)", "C.", " ", "\n", "  ", "O", "0", "x", "Q", "I", "l)", "1.", "H)", "Dl", "D1 ", "Heart", "no", "(Yes)", "%", ")", "\t", "Full Screen", "proceed to NEXT item", "5", "Oa)", "\n\n", "\r", " ", "\u0085", "O D) "]
    df = drawn(spark, parts, 20000, 14, 7).unionByName(drawn(spark, ["a", "B", "O", "x", "I", " ", "\n", ")", ".", "Cd", "1"], 20000, 9, 8))
    plain = until_same(F.col("t"), lambda t: _replaced(t, P.CHOICE_MARKUP), P.MARKUP_ROUNDS)
    both = df.select("t", C.marked_up(F.col("t")).alias("a"), plain.alias("b")).cache()
    assert both.where("a <> b").take(3) == []
    assert both.where("a <> t").count() > 5000
    assert df.where(~F.rlike(F.concat(F.lit("\n"), F.col("t")), F.lit(P.MARKUP_HINT))).count() > 2000


def test_choices_are_cut_and_temperatures_hidden_as_plain_rules_say(spark):
    df = drawn(spark, ["A)", "B)", "c )", "D.", "E. ", " ", "\n", "\n\n", "O ", "x", "Yes", "no", "39", "°", "F", "C", "(", "102", ")", "deg", " DEG. "], 10000, 16, 9)
    hidden = F.regexp_replace(_replaced(F.col("t"), P.TEMPERATURE_WRAPS), P.java(P.TEMPERATURE), f"$1{C.HOLD}$2$3")
    by_paren = (C.label_votes(F.col("t"))["paren"] >= 4) | (C.label_votes(F.col("t"))["paren"] >= C.label_votes(F.col("t"))["dot"])
    labels = F.transform(F.when(by_paren, F.regexp_extract_all("t", F.lit(P.CHOICE_PAREN), F.lit(1))).otherwise(F.regexp_extract_all("t", F.lit(P.CHOICE_DOT), F.lit(1))), F.upper)
    raw = C.raw_choices(F.col("t"))
    stem = trim(F.split(F.when(by_paren, F.regexp_replace("t", P.CHOICE_PAREN, C.CUT)).otherwise(F.regexp_replace("t", P.CHOICE_DOT, C.CUT)), C.CUT)[0])
    wrong = df.where((C.protect_temperatures(F.col("t")) != hidden) | (F.transform(raw["choices"], lambda c: c["label"]) != labels) | (raw["stem"] != stem))
    assert wrong.take(3) == []
    plan = df.select(C.raw_choices(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?:^|\\n)\\s*(?:[O0" not in plan.replace("\n", "\\n")


def test_lines_are_spelt_and_classed_as_plain_rules_say(spark):
    samples = [" ", "RSC", "Na*", "K+I", "K|", "K•I", "cI -", "CL  -", "c 1 -", "Cl ·", "HCO ,-", "hco - 3", "Hco -", "HC03-", "Pco 2", "PO\t2", "0 2 saturation", "Ca 2+", "Hemoglobin A 1c", "hemoglobin a 2", "Thyroxine ( T 4 )", "Day3", "lgA",
               "y-Glutamyltransferase", "F102", "cm  Hp", "mm Hp", "mmH20", "mEa/LI", "4, mg", "4,µg", "|", "HDL cholesterol", "LDL - cholesterol", "Cholesterol,  total", "5/MM 3", "2 million /mm 3", "µm 3", "μm 3", "N=0o/o"]
    others = [" ", "  ", "\t", "a", "day", "Serum", "12", "mg/dL", "negative", "which of the following", "x" * 60, "Hematocrit", ",", "-", "of", "?"]
    df = spark.createDataFrame([(s,) for s in samples + others], "t string").unionByName(drawn(spark, samples + others * 4, 10000, 5, 11))
    plain = trim(_replaced(F.col("t"), labs.SPELLING))
    both = df.select("t", labs.normalize_token(F.col("t")).alias("a"), plain.alias("b"), labs.is_misspelt(F.col("t")).alias("m")).cache()
    assert both.where("a <> b").take(3) == []
    assert both.where("not m").count() > 500
    value = (F.col("b") != "") & ~F.rlike("b", F.lit(labs.STOP)) & ~F.rlike("b", F.lit("(?i)which of the following")) & (F.lit(False) if not labs.VALUE_LINES else F.rlike("b", F.lit("|".join(labs.VALUE_LINES))))
    assert both.where(labs.is_value(F.col("b")) != value).take(3) == []


def test_the_beginning_of_a_text_tells_the_same_of_glyphs(spark, monkeypatch):
    """With a beginning of a few characters both ways are taken; both agree with all pairs and words of the text."""
    words = ["anx", "iety", "numb", "ness", "the", "of", "pain", "a", "l", "likel", "y", "x1", "Heart", "éab", "patients", "is"]
    df = drawn(spark, [w + b for w in words for b in (" ", " ", "\n", ", ")], 8000, 14, 3)
    kept = set(P.KEEP_WORDS)

    def told(t):
        both = [m.split(" ") for m in re.findall(r"\b[A-Za-z]{2,5} [a-z]{3,7}\b", t, re.ASCII)]
        left = re.findall(r"\b([A-Za-z]{4,8}) [a-z]\b", t, re.ASCII)
        tokens = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if re.fullmatch("[A-Za-z]{2,}", w)]
        odd = sum(len(w) <= 3 and w.lower() not in kept for w in tokens)
        broken = sum(a.lower() not in kept and b.lower() not in kept for a, b in both) + sum(w.lower() not in kept for w in left)
        return broken >= 2 or (len(tokens) >= 8 and odd >= 0.12 * len(tokens))

    for size in (30, 700):
        monkeypatch.setattr(glyph, "BEGINNING", size)
        got = df.select("t", glyph.spaced_glyphs(F.col("t")).alias("flag")).collect()
        assert [r.t for r in got if r.flag != told(r.t)] == []
    assert 500 < sum(r.flag for r in got) < 7500
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(glyph.spaced_glyphs(F.col("t"))).first()[0] is None


def test_gaps_and_prompts_keep_lines_of_their_own(spark):
    text = "He has\npain.\nLaboratory\nstudies show:\nNa*  140\nwhich of the following is it?\nIntravenous infusion of which fluid?\nname\tvalue\nend of\nline"
    got = spark.createDataFrame([(text,)], "t string").select(T.unwrap_prose(F.col("t"))).first()[0]
    assert "\nwhich of the following is it?\nIntravenous infusion of which fluid?\nname\tvalue\nend of line" in got and "\nNa*  140\n" in got
