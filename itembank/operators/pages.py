"""Pages of text to drafts: one page in, at most one draft out, no shuffle.

Input: pages(set_id, page_number, text). Null text is an empty page and gives no draft; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.choices import (
    choice, drop_explaining, expand_table, last_real, marked_up, normalize_choices, pad_choices, protect_temperatures, raw_choices, release, repair_two_columns, retext, sort_choices, split_merged,
    tidy_stem,
)
from ..functions.lab_blocks import LAST_PERCENT, SALINE, format_labs, peel_tail
from ..functions.labs import join_broken_units
from ..functions.predicates import is_cover_page, is_percent, needs_figure, needs_table
from ..functions.rules import has, once, per_session, settled, sub, trim
from ..functions.text import clean_page_text, extract_explanation, item_number, key_of, polish_stem, strip_chrome, strip_explanation, strip_footer

# Messages that users see.
FEW_CHOICES = "Fewer than two answer choices were detected."
SHORT_STEM = "Question stem may be incomplete."
NO_KEY = "Correct answer letter could not be identified automatically."
NO_EXPLANATION = "Explanation text could not be isolated."
DRAFT = (
    "set_id string, item int, stem string, choices array<struct<label:string,text:string>>, key string, explanation string, warnings array<string>, question_page int, "
    "needs_figure boolean, needs_table boolean"
)
ANSWER_DRAFT = DRAFT.replace("question_page", "page_number")
#: Units of results that take a percentage back from the last choice.
HANDS_BACK = r"(?i)/mm³|/hpf|mEq/L|mg/dL"
#: A stem of a table ends at its question mark, before the head of the table.
TABLE_END = (r"(?is)\A(.*?\?)\s*(?:Specific|Gravity|WBC|RBC|\z).*", "$1")


@per_session
def _hand_over_steps() -> tuple[Column, ...]:
    last = F.coalesce(F.try_element_at("sorted", F.lit(-1))["text"], F.lit(""))
    percent = F.regexp_extract(last, LAST_PERCENT, 2)
    back = F.exists("extra", lambda t: has(t, HANDS_BACK)) & (percent != "") & ~has(percent, SALINE) & ~is_percent(last)
    shorter = lambda c: choice(c["label"], trim(F.regexp_extract(c["text"], LAST_PERCENT, 1)))
    return (
        F.transform("tidied", lambda c: F.struct(c["label"].alias("label"), peel_tail(c["text"]).alias("cut"))),
        sort_choices(F.transform("peeled", lambda c: choice(c["label"], c["cut"]["text"]))),
        F.flatten(F.transform("peeled", lambda c: c["cut"]["tokens"])),
        F.when(back, percent),
        F.transform("sorted", lambda c, i: F.when(F.col("back").isNotNull() & (i == F.size("sorted") - 1), shorter(c)).otherwise(c)),
        F.concat(F.array_compact(F.array("back")), "extra"),
    )


def handed_over(rows: DataFrame) -> DataFrame:
    """rows(tidied choices) with `choices` in order, and `extra`: laboratory names and values that stood on choices, and a
    percentage at the end of the last choice where those values are counts or amounts (not of saline, nor a choice that is
    a percentage)."""
    peeled, in_order, tokens, back, choices, extra = _hand_over_steps()
    out = settled(rows.withColumn("peeled", peeled), "peeled").withColumn("sorted", in_order).withColumn("extra", tokens)
    out = settled(out.withColumn("back", back), "sorted", "extra", "back")
    return out.withColumns({"choices": choices, "extra": extra})


@per_session
def _layout_steps() -> tuple[Column, ...]:
    number = F.coalesce(F.col("item").cast("string"), F.lit(P.STEM_NUMBER))
    marker = F.concat(F.lit(r"(?s)^(.*?)(?:^|\n)\s*"), number, F.lit(r"\.\s+(?=[A-Z0-9])"))
    before = F.call_function("regexp_extract", F.col("prepared"), marker, F.lit(1))
    found = F.regexp_like("prepared", F.concat(F.lit(r"(?:^|\n)\s*"), number, F.lit(r"\.\s+(?=[A-Z0-9])")))
    own = F.col("before").isNotNull() & has(F.col("after"), P.ANY_CHOICE)
    ahead = F.col("before").isNotNull() & has(F.col("before"), P.ANY_CHOICE) & ~own
    body = F.when(F.col("ahead"), F.col("before")).when(F.col("own"), F.concat(F.lit("\n"), F.col("after"))).otherwise(F.col("prepared"))
    stem = F.when(F.size("raw.choices") == 0, F.col("raw.stem")).otherwise(tidy_stem(F.col("raw.stem")))
    stem = F.when(F.col("ahead"), F.concat_ws("\n\n", F.nullif(stem, F.lit("")), F.nullif(F.col("after"), F.lit("")))).otherwise(stem)
    table = needs_table(F.col("stem"), F.col("choices")) | has(F.col("prepared"), P.TABLE_STEM)
    return (
        marked_up(protect_temperatures(strip_footer(F.col("cleaned")))),
        F.when(found, before),
        F.when(found, F.substr(F.col("prepared"), F.length(before) + 1)),
        strip_explanation(sub(trim(F.col("after")), [(rf"^\s*{P.STEM_NUMBER}\.\s+", "")])),
        own,
        ahead,
        once(body, raw_choices),
        split_merged(F.col("raw.choices")),
        drop_explaining(F.col("merged")),
        repair_two_columns(F.col("listed")),
        once(last_real(F.col("repaired")), normalize_choices),
        join_broken_units(strip_explanation(stem)),
        strip_explanation(sub(polish_stem(F.col("stem")), [(r"(?i)\?\s+[\d+.\s\-/%hfpmmdlU]+\s*\z", "?")])),
        table,
        F.when(F.col("table"), expand_table(F.col("choices"), F.col("prepared"))).otherwise(F.col("choices")),
        F.when(F.col("table"), trim(sub(F.col("stem"), [TABLE_END]))).otherwise(F.col("stem")),
        release(F.col("stem")),
        retext(F.col("choices"), release),
    )


def recovered(pages: DataFrame) -> DataFrame:
    """pages (cleaned, item) with stem and choices: choices may stand before or after the vignette, laboratory values on
    choices go back to the stem's block, and the block is written as lines of cells. Steps are columns of their own, so none
    is computed twice."""
    prepared, before, behind, after, own, ahead, raw, merged, listed, repaired, tidied, stem, polished, table, choices, cut, freed_stem, freed_choices = _layout_steps()
    out = pages.withColumn("prepared", prepared).withColumns({"before": before, "after": behind}).withColumn("after", after)
    out = out.withColumns({"own": own, "ahead": ahead}).withColumn("raw", raw)
    out = out.withColumn("merged", merged).withColumn("listed", listed).withColumn("repaired", repaired).withColumn("tidied", tidied)
    out = handed_over(out)
    out = format_labs(settled(out.withColumn("stem", stem), "stem"), "stem", "extra").withColumn("stem", polished)
    out = settled(out.withColumn("table", table), "stem", "table").withColumns({"choices": choices, "stem": cut})
    return out.select(*pages.columns, freed_stem.alias("stem"), freed_choices.alias("choices"))


def _read(pages: DataFrame, footer: bool) -> DataFrame:
    raw = settled(pages.select("set_id", "page_number", clean_page_text(F.coalesce("text", F.lit(""))).alias("raw")), "raw")
    cleaned = strip_chrome(F.col("raw"))
    rows = raw.select("set_id", "page_number", item_number(F.col("raw"), longer=True).alias("item"), key_of(F.col("raw")).alias("key"), (strip_footer(cleaned) if footer else cleaned).alias("cleaned"))
    rows = settled(settled(rows, "item", "key", "cleaned").withColumn("cover", (F.col("cleaned") == "") | is_cover_page(F.col("cleaned"))), "cover").where("not cover").drop("cover")
    # without the footer taken, `cleaned` is free of furniture as it stands
    return settled(recovered(rows).withColumn("explanation", extract_explanation(F.col("cleaned"), chrome=footer)), "stem", "choices", "explanation")


def warnings(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, text) for test, text in found]))


def parse_question_pages(pages: DataFrame) -> DataFrame:
    """drafts: set_id, item (else the page's number), stem, choices, key, explanation, warnings, question_page, needs_figure, needs_table."""
    rows = _read(pages, footer=True).where((F.col("stem") != "") | (F.size("choices") > 0))
    shown = F.when(F.col("stem") == "", F.col("cleaned")).otherwise(F.col("stem"))
    rows = rows.withColumns({"needs_figure": needs_figure(shown), "needs_table": needs_table(shown, F.col("choices")) | has(F.col("cleaned"), P.TABLE_STEM)})
    marked = F.col("needs_figure") | F.col("needs_table")
    sixth = has(F.col("cleaned"), r"(?:^|\n)\s*(?:[O0•·*]\s*)?F\s*[).]") & F.col("needs_table")
    rows = rows.withColumn("choices", F.when((F.size("choices") < 2) & marked, pad_choices(F.col("choices"), F.when(sixth, "F").otherwise("E"))).otherwise(F.col("choices")))
    few = (F.size(F.filter("choices", lambda c: trim(c["text"]) != "")) < 2) & ~marked
    return rows.select(
        "set_id", F.coalesce("item", "page_number").cast("int").alias("item"), strip_explanation(shown).alias("stem"), "choices", "key", "explanation",
        warnings((few, FEW_CHOICES), (F.length("stem") < 20, SHORT_STEM)).alias("warnings"), F.col("page_number").alias("question_page"), "needs_figure", "needs_table",
    )


def parse_answer_pages(pages: DataFrame) -> DataFrame:
    """drafts of answer pages: item is 0 where the page has none; a page without item, key and explanation gives none."""
    rows = _read(pages, footer=False).where(F.col("item").isNotNull() | F.col("key").isNotNull() | (F.col("explanation") != ""))
    shown = F.when(F.col("stem") == "", F.col("cleaned")).otherwise(F.col("stem"))
    bare = F.col("explanation") == ""
    return rows.select(
        "set_id", F.coalesce("item", F.lit(0)).alias("item"), strip_explanation(F.col("stem")).alias("stem"), "choices", "key", F.when(bare, F.col("cleaned")).otherwise(F.col("explanation")).alias("explanation"),
        warnings((F.col("key").isNull(), NO_KEY), (bare, NO_EXPLANATION)).alias("warnings"), "page_number", needs_figure(shown).alias("needs_figure"), needs_table(shown, F.col("choices")).alias("needs_table"),
    )
