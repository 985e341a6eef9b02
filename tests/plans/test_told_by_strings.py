"""Patterns that strings tell to be idle, and pairs that single words tell: they give what the patterns alone give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from itembank.functions import patterns as P
from itembank.functions.glyph import PAIR, _pair_by_word

FOUND = [
    "x\nCORRECT\tanswer : b", "Incorrect Answers: A", "Educational  Objective: x", "Educational Objective: x", "\nKey Concept: y", "Choice C :", "\n(A is Correct)", "Time Spent 3", "\nExplanation\n", "this option is", "That IS incorrect.",
    "(B is correct", "B is correct", "\nThis patient has it", "Sets of findings", "set of values", "Laboratory findings is most likely", "additional findings", "most appropriate sensitivity", "Direct antiglobulin", "serum osmolality", "cardiac output",
    "pulmonary capillary wedge", "insulin\n production", "sensitivity \n specificity", "is Shown.", "photograph of the", "graph shows", "curve shows", "25 mm/s", "Time Remaining", "lncorrect Answers", "Vitamin B,2", "PAP smear", "Profile 2", "Self-Assessment", "Microsoft Edge",
]


@pytest.mark.parametrize("pattern", sorted(getattr(P, "LOWER", {"": ()})))
def test_what_a_pattern_finds_holds_a_string(spark, pattern):
    found = [r.t for r in spark.createDataFrame([(t,) for t in FOUND], "t string").where(F.col("t").rlike(P.java(pattern))).collect()]
    assert found and all(any(part in t.lower() for part in P.LOWER[pattern]) for t in found)


def test_kinds_of_words_say_what_the_pair_says():
    fits, kept = re.compile(PAIR.replace(r"\z", r"\Z"), re.ASCII), frozenset(P.KEEP_WORDS)
    first, second, joins = _pair_by_word()
    rng = random.Random(9)
    parts = ["a", "y", "b", "st", "me", "Me", "der", "ing", "tion", "xyz", "sch", "é", "3", "-", "oma", "hy", "strength", "Stra", "io", "aeb"]
    word = lambda ends: "".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) + rng.choice(ends)
    for _ in range(20_000):
        a, b = word([""]), word(["", "", ".", ",", "é"])
        m = re.match(r"[^A-Za-z]*([A-Za-z]+) ([a-z]+)[^A-Za-z]*\Z", f"{a} {b}")
        want = bool(m and m[2] not in kept and (m[1].lower() not in kept or m[1].lower() == "me") and fits.search(f"{a} {b}"))
        assert bool(joins[first[a] + second[b]]) is want, (a, b)
