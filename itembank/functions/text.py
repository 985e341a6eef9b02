"""Text normalisation of pages: columns in, columns out, no shuffle. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .glyph import collapse_broken_spaces
from .labs import VALUE_BEGINS, line_class, normalize_token
from .rules import count, first, has, has_gap, holds, letters, once, sub, trim, until_same, words_of

BLANKS = [(r"\n{3,}", "\n\n")]


def clean_page_text(text: Column, collapse: bool = True) -> Column:
    """No-break spaces, blanks at line ends and runs of empty lines out; with collapse, glyph spacing repaired as well."""
    cleaned = trim(sub(text, P.CLEAN))
    return collapse_broken_spaces(cleaned) if collapse else cleaned


def is_chrome(line: Column, strict: bool = False) -> Column:
    """line (trimmed) is page furniture. strict: a furniture word has to end where the pattern ends."""
    begins = [p.removeprefix("(?i)^") for p in (P.CHROME_STRICT if strict else P.CHROME, *P.DROPPED_LINES)]
    out = has(line, f"(?i)^(?:{'|'.join(begins)})")
    for a, b in P.DROPPED_PAIRS:
        out = out | (has(line, a) & has(line, b))
    return out | ((F.length(line) < P.SERIES_LINE_BELOW) & has(line, P.SERIES_NAME))


def strip_chrome(text: Column, strict: bool = False) -> Column:
    keep = F.filter(F.split(text, "\n"), lambda l: once(trim(l), lambda t: (t == "") | ~is_chrome(t, strict)))
    return trim(sub(F.array_join(keep, "\n"), BLANKS))


def strip_footer(text: Column) -> Column:
    return trim(sub(text, P.FOOTER))


def strip_leading(text: Column) -> Column:
    return until_same(trim(sub(trim(text), P.LEADING_PHRASES)), lambda t: trim(sub(t, P.LEADING_ROUND)), P.LEADING_ROUNDS)


def fix_typographics(text: Column) -> Column:
    return sub(text, P.TYPOGRAPHICS)


def strip_explanation(text: Column) -> Column:
    return trim(sub(F.coalesce(text, F.lit("")), [(P.EXPLANATION_CUT, "")]))


def is_diagram(line: Column) -> Column:
    def test(t: Column) -> Column:
        # the cheap and rare come first: letters and words are only counted where a line may be a diagram
        junk = count(t, r"[-_=~•·.,/\\|'^]")
        words = F.size(F.filter(F.split(t, r"\s+"), lambda w: has(w, "(?i)[a-z]{4,}") & ~has(w, r"(?i)^(aVR|aVL|aVF)\z")))
        return (
            ((F.length(t) >= 8) & ~has(t, r"^(?:[^A-Za-z]*[A-Za-z]){7}") & (junk >= 5))
            | ((F.length(t) < 40) & has(t, r"^(?:aV[RLF]|V[1-6]|I{1,3})(?:\s|\z)") & (letters(t) < 14))
            | (has(t, r"[-~_.]{2,}") & (junk >= 8) & (words <= 2) & ~has(t, "(?i)year-old|which of the following"))
        )

    return once(trim(line), lambda t: (t != "") & test(t))


def strip_diagram(text: Column) -> Column:
    return trim(sub(F.array_join(F.filter(F.split(text, "\n"), lambda l: ~is_diagram(l)), "\n"), BLANKS))


def is_long(line: Column, gaps: bool = True) -> Column:
    """Longer than any laboratory name or section (56 characters once it is normalised), and not begun like a value; such a line
    need not be normalised to be told from one. gaps: the line may hold several blanks in a row."""
    long = (F.length(line) > 150) & ~has(F.substring(line, 1, 12), VALUE_BEGINS)
    return long & ~(has_gap(line) & has(line, r"\s{3}")) if gaps else long


def unwrap_prose(text: Column) -> Column:
    """Wrapped lines joined to paragraphs. Empty lines, prompts, laboratory lines and columns stay on lines of their own."""
    lines = F.transform(F.split(text, "\n"), lambda raw: once(trim(raw), lambda t: F.struct(raw.alias("raw"), t.alias("text"), F.when(is_long(t), "other").otherwise(once(normalize_token(t), line_class)).alias("kind"))))
    pair = "struct<out:array<string>,held:string>"

    def state(out: Column, held: Column) -> Column:
        return F.struct(out.alias("out"), held.alias("held")).cast(pair)

    def flushed(s: Column, then: Column | None = None) -> Column:
        out = F.when(s["held"] != "", F.concat(s["out"], F.array(trim(s["held"])))).otherwise(s["out"])
        return state(out if then is None else F.concat(out, then), F.lit(""))

    def step(s: Column, line: Column) -> Column:
        t = line["text"]
        gap = F.when((s["held"] == "") & (F.element_at(F.concat(F.array(F.lit("-")), s["out"]), -1) == ""), F.array().cast("array<string>")).otherwise(F.array(F.lit("")))
        own_line = (
            has(F.substring(t, 1, 30), "(?i)^(?:which of the following|intravenous infusion of which)") | line["kind"].isin("section", "name")
            | (F.contains(t, F.lit(":")) & has(t, "(?i)studies show:|urinalysis shows:")) | (has_gap(line["raw"]) & has(line["raw"], r"\S\s{2,}\S")) | F.contains(t, F.lit("\t"))
        )
        # what is held has no gap: lines with one stand on their own
        labels = (~is_long(s["held"], False) & once(normalize_token(s["held"]), lambda h: line_class(h).isin("section", "name"))) | has(s["held"], "(?i)show:")
        joined = (
            F.when(t.isin("2", "3") & has(s["held"], r"(?i)/mm\z"), F.concat(s["held"], F.when(t == "3", "³").otherwise("²")))
            .when(s["held"].endswith("-") & has(t, "^[a-z]"), F.concat(s["held"], t))
            .otherwise(F.concat(s["held"], F.lit(" "), t))
        )
        heading = (F.octet_length(s["held"]) <= 10) & has(s["held"], r"(?i)^(laboratory|serum|urine|plasma|arterial)\z") & has(t, "(?i)studies show|blood gas|show:")
        return (
            F.when(t == "", flushed(s, gap))
            .when(heading, state(F.concat(s["out"], F.array(F.concat(s["held"], F.lit(" "), t))), F.lit("")))
            .when(own_line, flushed(s, F.array(t)))
            .when((line["kind"] == "value") & labels, flushed(s, F.array(t)))
            .when(s["held"] == "", state(s["out"], t))
            .otherwise(state(s["out"], joined))
        )

    start = state(F.array().cast("array<string>"), F.lit(""))
    folded = F.aggregate(lines, start, step, lambda s: flushed(s)["out"])
    return trim(sub(F.array_join(folded, "\n"), BLANKS))


def polish_stem(text: Column) -> Column:
    return unwrap_prose(fix_typographics(strip_leading(strip_footer(strip_explanation(strip_diagram(text))))))


def split_prompt(stem: Column) -> Column:
    """struct(lead, prompt): the last paragraph that asks, and what stands before it."""
    asks = has(stem, P.PROMPT)
    return F.struct(
        F.when(asks, trim(sub(stem, [(P.PROMPT, "")]))).otherwise(stem).alias("lead"),
        F.when(asks, trim(F.regexp_extract(stem, P.PROMPT, 1))).otherwise("").alias("prompt"),
    )


def exam_seconds(n_items: Column, per_item: int = 90) -> Column:
    return n_items * per_item


def format_clock(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(F.pmod(s, F.lit(3600)) / 60)
    tail = F.concat(F.lit(" min "), two(F.pmod(s, F.lit(60))), F.lit(" sec"))
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(" hr "), two(minutes), tail)).otherwise(F.concat(minutes.cast("string"), tail))


def duration_minutes(n_items: Column) -> Column:
    return F.when(n_items % 2 == 0, (n_items * 3 / 2).cast("long").cast("string")).otherwise(F.format_string("%.1f", n_items * 1.5))


def _telling(w: Column) -> Column:
    return (F.length(w) > 2) | w.rlike("^[0-9]{2,}$")


def content_words(text: Column) -> Column:
    return words_of(strip_explanation(text), _telling)


def visual_tokens(text: Column) -> Column:
    return words_of(text, lambda w: F.length(w) > 1)


def vignette_fingerprint(text: Column, n: int = 12) -> Column:
    vignette = sub(strip_explanation(text), [("(?is)which of the following.*$", "")])
    return F.array_join(F.slice(words_of(vignette, _telling), 1, n), " ")


def text_quality(text: Column) -> Column:
    return letters(trim(sub(text, P.CLEAN)))


def source_stem(page: Column, item: Column) -> Column:
    """The stem as its source page has it: after the item's number, up to the first choice."""
    body = strip_footer(strip_chrome(clean_page_text(page, collapse=False)))
    numbered = F.concat(F.lit(r"(?s)^(?:.*?\n)?\s*"), item.cast("string"), F.lit(r"\.\s+"))
    unnumbered = sub(body, [(r"(?i)^(?:item\s+)?\d{1,3}\s*\.\s+", "")])
    body = F.when(item.isNull(), unnumbered).otherwise(F.regexp_replace(body, F.coalesce(numbered, F.lit("^$")), F.lit("")))
    return trim(strip_leading(strip_explanation(sub(body, [(P.SOURCE_CHOICE, "")]))))


def key_of(text: Column) -> Column:
    """The keyed letter: by priority of the wording, not by place."""
    return F.upper(F.coalesce(*[first(text, p) for p in P.CORRECT]))


def item_number(text: Column, longer: bool = False) -> Column:
    """The item a page names: up to three digits, as booklets print it, or up to nine."""
    patterns = [P.ITEM_HEADER, P.NUMBERED_STEM, P.LOOSE_ITEM]
    return F.coalesce(*[first(text, P.longer(p) if longer else p).cast("int") for p in patterns])


def extract_explanation(text: Column, chrome: bool = True) -> Column:
    """chrome: page furniture is taken out first."""

    def finish(body: Column) -> Column:
        return unwrap_prose(fix_typographics(strip_footer(sub(body, [P.NAVIGATION_TAIL, P.URL]))))

    body = once(strip_chrome(text) if chrome else text, lambda c: trim(F.coalesce(*[first(c, p) for p in P.EXPLANATION_STARTS], F.lit(""))))
    found = once(body, lambda b: F.when(b == "", "").otherwise(finish(b)))
    return F.when(holds(text, *[part for p in P.EXPLANATION_STARTS for part in P.LOWER[p]]), found).otherwise("")
