"""Page, stem, choice and file classifiers as boolean columns. Null text is never classified as anything but a cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .glyph import spaced_glyphs
from .rules import has, holds, letters, once, sub, trim
from .text import is_chrome, strip_chrome


def squeezed(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"\s+", " "))


def is_cover_page(text: Column) -> Column:
    def test(c: Column, compact: Column) -> Column:
        n = F.length(compact)
        item = (has(c, P.ITEM_HEADER) | has(c, P.NUMBERED_STEM)) & has(c, "[A-P][).]")
        keyed = has(c, r"(?i)correct\s*answer") | has(c, "(?i)educational objective")
        index = has(c, r"(?i)system:\s+") & has(c, r":\s*\d") & ~has(c, "(?i)which of the following")
        return (
            F.when((n < 40) | (has(compact, "(?i)^internal medicine cms") & (n < 80)) | index, True)
            .when(item | keyed, False)
            .otherwise((n < 120) & ~has(c, "[A-J][).]"))
        )

    # a line of 120 signs that is no furniture tells that the page is none, unless it is an index
    told = lambda t: F.exists(F.split(t, "\n"), lambda l: (F.length(l) >= 120) & has(l, r"^\s*(?:\S ?){120}") & ~is_chrome(trim(l))) & ~holds(t, "system:")
    return once(F.coalesce(text, F.lit("")), lambda t: F.when(told(t), False).otherwise(once(strip_chrome(t), lambda c: test(c, squeezed(c)))))


def needs_reading_again(text: Column) -> Column:
    return once(strip_chrome(F.regexp_replace(text, "\u00a0", " ")), lambda t: ~has(t, r"\A(?:[^A-Za-z]*+[A-Za-z]){80}") | spaced_glyphs(t))


def needs_figure(stem: Column) -> Column:
    return has(stem, P.FIGURE_HINT) & has(stem, P.FIGURE)


def table_choices(choices: Column) -> Column:
    """Four or more choices of which at least 60 % hold three digits or more and six words or fewer."""

    def like(c: Column) -> Column:
        words = F.filter(F.split(trim(F.regexp_replace(c["text"], "[^A-Za-z]", " ")), r"\s+"), lambda w: F.length(w) > 2)
        return (F.length(F.regexp_replace(c["text"], "[^0-9]", "")) >= 3) & (F.size(words) <= 6)

    n = F.size(choices)
    return (n >= 4) & (F.size(F.filter(choices, like)) >= F.ceil(n * 0.6))


def needs_table(stem: Column, choices: Column) -> Column:
    return has(stem, P.TABLE_STEM) | table_choices(choices)


def explanation_leak(text: Column) -> Column:
    return has(text, "(?i)" + P.EXPLANATION_START) | has(text, P.LEAK_PHRASE)


def is_percent(text: Column) -> Column:
    return has(trim(text), P.PERCENT)


def is_sparse(text: Column) -> Column:
    return once(trim(text), lambda t: (t == "") | has(t, r"^[-–—+]\z") | (~has(t, P.PERCENT) & (letters(t) < 3)))


def filled(choices: Column) -> Column:
    return F.filter(choices, lambda c: F.length(trim(c["text"])) > 2)


def well_formed(choices: Column) -> Column:
    def test(f: Column) -> Column:
        explaining = F.exists(f, lambda c: has(c["text"], P.EXPLAINING_CHOICE))
        long = F.size(F.filter(f, lambda c: F.length(c["text"]) > 180))
        return (F.size(f) >= 2) & F.forall(f, lambda c: has(c["label"], r"^[A-P]\z")) & (F.get(f, 0)["label"] == "A") & ~explaining & (long < F.ceil(F.size(f) * 0.6))

    return F.coalesce(once(filled(choices), test), F.lit(False))


def complete_list(choices: Column) -> Column:
    """Five or more choices labelled in order, none a fragment."""
    in_order = F.forall(F.transform(choices, lambda c, i: c["label"] == F.chr(F.lit(65) + i)), lambda x: x)
    texts = F.transform(choices, lambda c: trim(sub(c["text"], P.BUBBLES)))
    broken = F.exists(texts, lambda t: (F.length(t) < 3) | has(t, r"(?i)^(?:of|or)\s+")) | F.exists(choices, lambda c: has(c["text"], r"(?i)\s+[O0]+\s+(?:of|or)\b"))
    return (F.size(choices) >= 5) & in_order & ~broken


def choice_quality(choices: Column) -> Column:
    def penalty(c: Column) -> Column:
        t = c["text"]
        points = ((r"(?i)correct\s*answer|incorrect answers|educational objective|\([A-P]\s+is\s+correct\)", 8), (r"\s+[O0Q]\s*[A-P]\s*[).]", 4), (r"(?i)~\s*~|p,\s*r", 3))
        total = F.when(F.length(t) > 280, 5).otherwise(0)
        for pattern, cost in points:
            total = total + F.when(has(t, pattern), cost).otherwise(0)
        return total

    return F.size(filled(choices)) * 10 - F.aggregate(F.transform(choices, penalty), F.lit(0), lambda a, x: a + x)


def normalized_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, r"(?i)\.pdf\z", "")), "[_-]+", " "), r"\s+", " "))


NAME_WORDS = [(r"\b(answer|answers|explanation|explanations|key|solutions?)\b", ""), (r"\bquestions?\b", ""), (r"\bset\b", ""), (r"\bq\b", ""), (r"\ba\b", " "), (r"\s+", " ")]


def pairing_key(name: Column) -> Column:
    return once(normalized_name(name), lambda n: once(F.trim(sub(n, NAME_WORDS)), lambda b: F.coalesce(F.nullif(F.regexp_extract(b, r"^(\d+)", 1), F.lit("")), F.nullif(b, F.lit("")), n)))


def is_answer_file(name: Column) -> Column:
    return once(normalized_name(name), lambda n: has(n, NAME_WORDS[0][0]) | has(n, r"\d+\s*a\z") | (has(n, r"a\z") & ~has(n, r"\bq\z")))


def is_question_file(name: Column) -> Column:
    return ~is_answer_file(name) | has(normalized_name(name), r"\bq\b")


def review_status(answer: Column, key: Column) -> Column:
    """Unanswered without an answer, and also without a key."""
    known = (F.coalesce(answer, F.lit("")) != "") & (F.coalesce(key, F.lit("")) != "")
    return F.when(~known, "unanswered").when(answer == key, "correct").otherwise("incorrect")


def matrix_status(flagged: Column, answer: Column) -> Column:
    return F.when(flagged, "flagged").when(F.coalesce(answer, F.lit("")) != "", "answered").otherwise("unanswered")
