"""Answer choices of a page as an array of struct(label, text), worked on inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .predicates import complete_list, is_percent, is_sparse
from .rules import _replaced, has, letters, once, sub, trim, until_same
from .text import fix_typographics, strip_footer, strip_leading

CHOICES = "array<struct<label:string,text:string>>"
#: Private-use characters: before the unit of a protected temperature, before a cut, between label and text.
HOLD, CUT, FIELD = "\ue000", "\ue001", "\ue002"


def choice(label: Column, text: Column) -> Column:
    return F.struct(label.alias("label"), text.alias("text"))


def no_choices() -> Column:
    return F.array().cast(CHOICES)


def retext(choices: Column, use) -> Column:
    return F.transform(choices, lambda c: choice(c["label"], use(c["text"])))


def protect_temperatures(text: Column) -> Column:
    """Temperatures stitched over line ends, their unit hidden from the choice patterns until `release`."""

    def hidden(t: Column) -> Column:
        may = F.contains(t, F.lit("(")) | F.contains(t, F.lit("°")) | F.contains(F.lower(t), F.lit("deg"))
        return F.when(may, F.regexp_replace(t, P.java(P.TEMPERATURE), f"$1{HOLD}$2$3")).otherwise(t)

    return once(sub(text, P.TEMPERATURE_WRAPS), hidden)


def release(text: Column) -> Column:
    return F.translate(text, HOLD, "")


def marked_up(text: Column) -> Column:
    """One test tells for all rules at once whether any may change the text: a test a rule would read it as often."""

    def step(t: Column) -> Column:
        may = has(F.concat(F.lit("\n"), t), P.MARKUP_HINT) | once(F.lower(t), lambda low: F.contains(low, F.lit("next item")) | F.contains(low, F.lit("full screen")))
        return F.when(may, _replaced(t, P.CHOICE_MARKUP)).otherwise(t)

    return until_same(text, step, P.MARKUP_ROUNDS)


def cut_explanation(text: Column) -> Column:
    """A choice without the explanation or graph that runs on behind it."""

    def cut(t: Column, pattern: str, least: int) -> Column:
        return once(sub(t, [(pattern, "")]), lambda head: F.when((F.length(head) > least) & (F.length(head) < F.length(t)), trim(head)).otherwise(t))

    return strip_footer(once(cut(text, P.CHOICE_EXPLANATION, 8), lambda t: cut(t, P.CHOICE_GRAPH, 12)))


def split_merged(choices: Column) -> Column:
    """Choices that hold others (`B) x C) y`) cut up; a temperature's F or C is no label."""

    def parts(c: Column) -> Column:
        guarded = F.regexp_replace(c["text"], r"(?i)([°\d]\s*)([FC])(\s*[).])", f"$1{HOLD}$2$3")
        marked = F.regexp_replace(guarded, P.MERGED_CHOICE, f"{CUT}$1{FIELD}")
        pieces = F.split(F.concat(c["label"], F.lit(FIELD), marked), CUT)
        cut = F.transform(pieces, lambda p: choice(F.upper(F.split_part(p, F.lit(FIELD), F.lit(1))), cut_explanation(trim(release(F.split_part(p, F.lit(FIELD), F.lit(2)))))))
        return F.when(F.size(pieces) > 1, cut).otherwise(F.array(c))

    def filled(all_: Column) -> Column:
        grid = (F.size(all_) >= 3) & (F.size(F.filter(all_, lambda c: is_sparse(c["text"]))) >= F.ceil(F.size(all_) * 0.5))
        return F.filter(all_, lambda c: has(c["text"], r"[\w%]") | grid)

    return once(F.flatten(F.transform(choices, parts)), filled)


def is_grid(choices: Column) -> Column:
    return (F.size(choices) >= 3) & (F.size(F.filter(choices, lambda c: is_sparse(c["text"]))) >= F.ceil(F.size(choices) * 0.5))


_STATE = f"struct<out:{CHOICES},stopped:boolean>"


def _taken(choices: Column, keep, stop) -> Column:
    """Choices in order: `keep(c, out)` says whether one is taken (null skips it), `stop(c, out)` ends the list."""
    start = F.struct(no_choices().alias("out"), F.lit(False).alias("stopped")).cast(_STATE)

    def step(s: Column, c: Column) -> Column:
        ended = s["stopped"] | F.coalesce(stop(c, s["out"]), F.lit(False))
        got = keep(c, s["out"])
        return F.struct(F.when(ended | got.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(got))).alias("out"), ended.alias("stopped")).cast(_STATE)

    return F.aggregate(choices, start, step, lambda s: s["out"])


def drop_explaining(choices: Column) -> Column:
    """Noise skipped; the list ends where a label jumps onto prose or a long explanation begins."""

    def over(grid: Column) -> Column:
        def noise(c: Column, out: Column) -> Column:
            t = c["text"]
            return (F.size(out) > 0) & (letters(t) < 3) & ~is_percent(t) & ~(grid & is_sparse(t)) & ~has(trim(t), P.SHORT_CHOICE)

        def stop(c: Column, out: Column) -> Column:
            t = c["text"]
            gap = F.ascii(c["label"]) - F.ascii(F.element_at(F.concat(F.array(choice(F.lit("A"), F.lit(""))), out), -1)["label"])
            jumped = (gap > 1) & ((F.length(t) > 80) | has(t, P.NOT_A_CHOICE))
            return (F.size(out) > 0) & ~noise(c, out) & (jumped | ((F.length(t) > 220) & has(t, P.LONG_EXPLANATION)))

        return _taken(choices, lambda c, out: F.when(~noise(c, out), choice(c["label"], cut_explanation(c["text"]))), stop)

    return F.transform(F.array(is_grid(choices)), over)[0]


def last_real(choices: Column) -> Column:
    """Choices before the first that is answer-side text; empty ones go unless the choices are a grid."""
    cut = _taken(choices, lambda c, out: c, lambda c, out: (F.size(out) > 0) & has(c["text"], r"(?i)^correct answer|^incorrect answers|^educational objective"))

    def settle(part: Column) -> Column:
        full = F.filter(part, lambda c: has(c["text"], r"[\w%]"))
        return F.when((F.size(full) >= 2) | ~is_grid(part), full).otherwise(part)

    return once(cut, settle)


def normalize_choices(choices: Column) -> Column:
    """One clean text per label, in order; the list ends at a repeated label or at navigation."""

    def tidy(t: Column) -> Column:
        flat = trim(sub(F.regexp_replace(strip_footer(cut_explanation(t)), r"\s+", " "), [(r"(?is)\s*Proceed to Next Item.*\z", "")]))
        return once(sub(strip_footer(fix_typographics(flat)), [(r"\s+\?\s*\z", "")]), lambda x: F.when(is_percent(t), trim(t)).otherwise(x))

    def over(grid: Column) -> Column:
        def empty(c: Column) -> Column:
            return (F.length(c["text"]) < 2) & ~is_percent(c["text"])

        def seen(c: Column, out: Column) -> Column:
            return F.exists(out, lambda o: o["label"] == c["label"])

        def keep(c: Column, out: Column) -> Column:
            blank = F.when(grid & has(c["label"], r"^[A-F]\z") & ~seen(c, out), choice(c["label"], F.lit("")))
            skipped = has(c["text"], "(?i)^(full screen|settings)") | has(c["text"], "(?i)year-old .*(which of the following)")
            return F.when(empty(c), blank).when(~skipped, c)

        def stop(c: Column, out: Column) -> Column:
            return has(c["text"], r"(?i)^(next|previous|score report|lab values|calculator|help|pause)\z") | (~empty(c) & seen(c, out))

        return _taken(retext(choices, tidy), keep, stop)

    return once(is_grid(choices), over)


def repair_two_columns(choices: Column) -> Column:
    """Where bubbles of a second column leaked into texts: cut there, put `of …`/`or …` fragments behind the next phrase,
    label anew. A complete list only loses its bubbles."""
    leaked = r"\s+[O0]+(?:\s|,|\z)|(?:^|\s)[O0],?\s*\z|^\s*[A-P]\s*[).]|\s+[A-P]\s*[).]\s+[A-Z]"
    bare = lambda t: trim(sub(t, P.BUBBLES))

    def two_titles(p: Column) -> Column:
        left, right = F.regexp_extract(p, r"^(.{8,}?)\s+([A-Z][a-z]{3,}.*)$", 1), F.regexp_extract(p, r"^(.{8,}?)\s+([A-Z][a-z]{3,}.*)$", 2)
        words = F.filter(F.split(right, r"\s+"), lambda w: has(w, "[A-Za-z]"))
        labs = F.size(F.filter(words, lambda w: has(w, rf"(?i)^({P.LAB_WORDS})\z")))
        apart = (
            (left != "") & ~has(right, rf"(?i)^({P.LAB_WORDS})(?:[^A-Za-z]|\z)") & ~((labs >= 1) & (labs >= F.ceil(F.size(words) * 0.5))) & (F.size(F.split(left, r"\s+")) >= 2)
            & has(left, r"[a-z]{3,}\z") & (F.length(right) >= 6) & ((F.size(F.split(right, r"\s+")) > 1) | (F.length(right) >= 8)) & ~has(right, r"(?i)^(and|or|of|the|to|for|with|in|on|at|from)\b")
        )
        return F.when(apart, F.array(trim(left), trim(right))).otherwise(F.array(p))

    def phrases(c: Column) -> Column:
        clean = bare(c["text"])
        parts = F.filter(F.transform(F.split(clean, r"\s+[O0]+\s+|\n+(?=[A-Z][a-z]{3,})"), lambda p: bare(F.regexp_replace(p, r"\s+", " "))), lambda p: ~has(p, r"^[,.]*\z"))
        return F.when(F.size(parts) > 0, F.flatten(F.transform(parts, two_titles))).otherwise(F.filter(F.array(trim(F.regexp_replace(clean, r"\s+", " "))), lambda p: p != ""))

    def joined(parts: Column) -> Column:
        kind = "struct<out:array<string>,held:string>"
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held")).cast(kind)

        def step(s: Column, p: Column) -> Column:
            fragment = has(p, r"(?i)^(?:of|or)\s+") & s["held"].isNull()
            whole = F.when(s["held"].isNull(), p).otherwise(F.concat(p, F.lit(" "), s["held"]))
            return F.when(fragment, F.struct(s["out"].alias("out"), p.alias("held")).cast(kind)).otherwise(F.struct(F.concat(s["out"], F.array(whole)).alias("out"), F.lit(None).cast("string").alias("held")).cast(kind))

        return F.aggregate(parts, start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))

    def relabelled(parts: Column) -> Column:
        enough = (F.size(parts) >= 4) & (F.size(parts) >= F.size(choices))
        return F.when(enough, F.transform(parts, lambda p, i: choice(F.chr((F.lit(65) + i).cast("long")), p))).otherwise(choices)

    needed = (F.size(choices) >= 2) & F.exists(choices, lambda c: has(trim(c["text"]), leaked))
    repaired = once(joined(F.flatten(F.transform(choices, phrases))), relabelled)
    return F.when(~needed, choices).when(complete_list(choices), retext(choices, bare)).otherwise(repaired)


def sort_choices(choices: Column) -> Column:
    """The first choice of each label, by label."""
    firsts = F.filter(F.transform(choices, lambda c, i: F.when(~F.exists(F.slice(choices, 1, i), lambda o: o["label"] == c["label"]), c)), lambda c: c.isNotNull())
    return F.array_sort(firsts, lambda a, b: F.ascii(a["label"]) - F.ascii(b["label"]))


def pad_choices(choices: Column, last: Column | str = "E") -> Column:
    """A to last, with empty text for a label that is missing; other labels go."""
    end = F.ascii(last if isinstance(last, Column) else F.lit(last))

    def padded(given: Column) -> Column:
        def at(k: Column) -> Column:
            label = F.chr(k.cast("long"))
            found = F.try_element_at(F.filter(given, lambda c: c["label"] == label), F.lit(-1))
            return choice(label, F.coalesce(found["text"], F.lit("")))

        return F.transform(F.sequence(F.lit(65), end), at)

    return once(choices, padded)


def expand_table(choices: Column, source: Column) -> Column:
    labels = F.filter(F.transform(choices, lambda c: c["label"]), lambda l: has(l, "[A-F]"))
    most = F.coalesce(F.array_max(labels), F.lit("A"))
    sixth = has(source, r"(?:^|\n)\s*(?:[O0•·*]\s*)?F\s*[).]") | F.array_contains(labels, "F")
    return pad_choices(choices, F.when((most < "E") | (F.size(labels) < 3), F.when(sixth, "F").otherwise("E")).otherwise(most))


def label_votes(text: Column) -> Column:
    """struct(paren, dot): distinct labels marked `A)` and `A.`."""
    votes = lambda p: F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.upper)))
    return F.struct(votes(P.CHOICE_PAREN).alias("paren"), votes(P.CHOICE_DOT).alias("dot"))


def tidy_stem(stem: Column) -> Column:
    head = [(rf"^{P.STEM_NUMBER}\.\s*", ""), (r"^[■~]+\s*", ""), (r"(?i)^mark\s+", ""), (r"(?i)^\d+\s*hr\s+\d+\s*min(?:\s+\d+\s*sec)?\s*", "")]
    return trim(sub(strip_leading(trim(sub(trim(stem), head))), [(rf"(?s)^(?:.*?\n)??\s*{P.STEM_NUMBER}\.\s+([A-Z0-9])", "$1")]))


def behind_line_end(pattern: str) -> str:
    """A pattern of a line's start, for texts that begin with a line end."""
    return pattern.replace(r"(?:^|\n)", r"\n", 1)


def raw_choices(prepared: Column) -> Column:
    """struct(stem, choices) of prepared text, as marked: by the style that has four labels or most."""
    # a line end in front stands for the start of the text, and patterns that begin with a line end are quickly told
    begun = F.concat(F.lit("\n"), prepared)
    votes = lambda p: F.size(F.array_distinct(F.transform(F.regexp_extract_all(begun, F.lit(behind_line_end(p)), F.lit(1)), F.upper)))
    by_paren = once(votes(P.CHOICE_PAREN), lambda n: (n >= 4) | (n >= votes(P.CHOICE_DOT)))
    cut = lambda p: F.regexp_replace(begun, behind_line_end(p), f"{CUT}$1{FIELD}")
    marked = F.when(by_paren, cut(P.CHOICE_PAREN)).otherwise(cut(P.CHOICE_DOT))

    def build(parts: Column) -> Column:
        one = lambda p: choice(F.upper(F.split_part(p, F.lit(FIELD), F.lit(1))), strip_footer(sub(trim(F.split_part(p, F.lit(FIELD), F.lit(2))), P.CHOICE_TAILS)))
        return F.struct(trim(parts[0]).alias("stem"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one).alias("choices"))

    return once(F.split(marked, CUT), build)


def marked_choices(body: Column) -> Column:
    """struct(stem, choices) of a page body, the stem as it stands before the choices."""
    return once(marked_up(protect_temperatures(body)), raw_choices)


def stem_before(raw: Column) -> Column:
    """The stem of marked_choices, tidy where choices follow it."""
    return F.when(F.size(raw["choices"]) == 0, raw["stem"]).otherwise(tidy_stem(raw["stem"]))


def split_choices(body: Column) -> Column:
    """struct(stem, choices) of a page body; its temperatures stay protected (see `release`)."""
    return once(marked_choices(body), lambda raw: F.struct(stem_before(raw).alias("stem"), raw["choices"].alias("choices")))
