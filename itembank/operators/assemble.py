"""Drafts to a keyed item bank: coalescing, continuation pages, merging, matching by wording, source check, set summary.

Keys are (set_id, item): an item number alone repeats in every set. Rows without an item are never grouped together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import choice_quality, explanation_leak, filled, needs_figure, needs_table, squeezed, well_formed
from ..functions.choices import pad_choices
from ..functions.rules import has, once, sub
from ..sources.io import checkpointed
from .carry import CHUNK, carry_last, in_chunks
from .wording import match_in_order
from ..functions.text import content_words, item_number, source_stem, strip_explanation, vignette_fingerprint

# Messages that users see.
NO_ANSWER = "No matching explanation page was found for this question."
SOURCE_WARNING = "Formatted text may not match the original PDF closely. Use “Show image of original question” if needed."
ACCEPTED = 40.0


def first_by(value: Column, order: list[Column], keep: Column) -> Column:
    """value of the least order among rows that keep; null if none."""
    return F.min(F.when(keep, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))["v"]


def union_in_order(pages: Column) -> Column:
    """Distinct entries of arrays gathered as (page, array), by page."""
    return F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(pages.alias("p"), F.col("warnings").alias("w")))), lambda x: x["w"])))


def coalesce_questions(drafts: DataFrame) -> DataFrame:
    """One row per (set_id, item): the longest stem and its page, the best choices (well formed, most filled, earliest), the
    first key and explanation, warnings in order, flags of any page. Drafts without an item stay as they are."""
    page = F.col("question_page")
    length = F.length(F.regexp_replace("stem", r"\s+", " "))
    best = F.min(F.struct((~well_formed(F.col("choices"))).alias("a"), (-F.size(filled(F.col("choices")))).alias("b"), page.alias("c"), F.col("choices").alias("v")))["v"]
    longest = F.min(F.struct((-length).alias("a"), page.alias("b"), F.col("stem").alias("v")))
    keyed = drafts.where("item is not null and item <> 0")
    merged = keyed.groupBy("set_id", "item").agg(
        longest.alias("longest"), best.alias("choices"), first_by(F.col("key"), [page], F.col("key").isNotNull()).alias("key"),
        F.coalesce(first_by(F.col("explanation"), [page], F.col("explanation") != ""), F.lit("")).alias("explanation"),
        union_in_order(page).alias("warnings"), F.bool_or("needs_figure").alias("needs_figure"), F.bool_or("needs_table").alias("needs_table"),
    )
    merged = merged.withColumns({"stem": strip_explanation(F.col("longest.v")), "question_page": F.col("longest.b")}).select(*drafts.columns)
    return merged.unionByName(drafts.where("item is null or item = 0"))


def attach_continuations(pages: DataFrame, starts: Column) -> DataFrame:
    """pages with `anchor`: the last page at or before this one, in its set, for which starts holds; null before the first."""
    chunked = in_chunks(pages, ["set_id"], ["page_number"])
    return carry_last(chunked, ["set_id"], ["page_number"], anchor=F.when(starts, F.col("page_number"))).drop(CHUNK)


def fold_answer_pages(drafts: DataFrame) -> DataFrame:
    """Answer drafts to one row per answer: pages of an item, pages that continue it, and orphans (item 0), which begin at
    a keyed page of six words or more, or stand before any other. Choices and flags are those of pages with the item's number
    and of the page that opens the answer; a page that continues it adds its text, its place and, where none is known, its key."""
    telling = F.col("key").isNotNull() & (F.size(F.split(vignette_fingerprint(F.col("stem")), " ")) >= 6)
    own = attach_continuations(drafts, (F.col("item") > 0) | telling)
    at = own.select("set_id", F.col("page_number").alias("anchor"), F.col("item").alias("anchor_item")).where(F.col("anchor_item") > 0)
    rows = own.join(at, ["set_id", "anchor"], "left")
    rows = rows.withColumns({"own": F.col("item") > 0, "item": F.coalesce("anchor_item", F.lit(0))})
    rows = rows.withColumn("group", F.when(F.col("item") > 0, -F.col("item")).otherwise(F.coalesce("anchor", "page_number")))
    page = F.col("page_number")
    texts = F.transform(F.filter(F.sort_array(F.collect_list(F.struct(page.alias("p"), F.col("explanation").alias("e")))), lambda x: x["e"] != ""), lambda x: x["e"])
    opens = F.col("own") | (page == F.col("group"))
    best = F.min(F.when(opens, F.struct((-choice_quality(F.col("choices"))).alias("a"), page.alias("b"), F.col("choices").alias("v"))))["v"]
    out = rows.groupBy("set_id", "item", "group").agg(
        F.min_by("stem", "page_number").alias("stem"), best.alias("choices"), first_by(F.col("key"), [page], F.col("key").isNotNull()).alias("key"), F.array_join(texts, "\n\n").alias("explanation"),
        F.min_by("warnings", "page_number").alias("warnings"), F.array_sort(F.collect_list("page_number")).alias("answer_pages"),
        F.bool_or(opens & F.col("needs_figure")).alias("needs_figure"), F.bool_or(opens & F.col("needs_table")).alias("needs_table"),
    )
    return out.drop("group")


def pick_choices(q: Column, a: Column, table: Column) -> Column:
    better = (F.size(filled(a)) > F.size(filled(q))) & well_formed(a) & (choice_quality(a) > choice_quality(q))
    return F.when(table | well_formed(q), q).when(better, a).when(F.size(q) >= 2, q).otherwise(a)


def merged_rows(pairs: DataFrame) -> DataFrame:
    """pairs: columns of a question, and `a`, a struct of its answer or null."""
    a = F.col("a")
    none = a.isNull()
    q_stem, a_stem = strip_explanation(F.col("stem")), strip_explanation(a["stem"])
    width = lambda t: F.length(F.regexp_replace(t, r"\s+", " "))
    rows = pairs.withColumns({"q_stem": q_stem, "a_stem": a_stem})
    keep = none | (width(F.col("q_stem")) >= 40) | (width(F.col("q_stem")) >= 0.5 * width(F.col("a_stem"))) | (F.col("a_stem") == "")
    rows = rows.withColumn("stem", F.when(keep, F.col("q_stem")).otherwise(F.col("a_stem")))
    rows = rows.withColumn("choices", F.when(none, F.col("choices")).otherwise(pick_choices(F.col("choices"), a["choices"], F.col("needs_table"))))
    flag = lambda q, of, seen: F.when(none, q).otherwise(q | F.coalesce(of, F.lit(False)) | seen)
    rows = rows.withColumns({
        "needs_figure": flag(F.col("needs_figure"), a["needs_figure"], needs_figure(F.col("stem"))),
        "needs_table": flag(F.col("needs_table"), a["needs_table"], needs_table(F.col("stem"), F.col("choices"))),
    })
    pad = ~none & (F.size("choices") < 2) & (F.col("needs_figure") | F.col("needs_table"))
    return rows.withColumns({
        "choices": F.when(pad, pad_choices(F.col("choices"))).otherwise(F.col("choices")), "key": F.coalesce(a["key"], F.col("key")),
        "explanation": F.coalesce(F.nullif(a["explanation"], F.lit("")), F.col("explanation")),
        "warnings": F.when(none, F.concat("warnings", F.array(F.lit(NO_ANSWER)))).otherwise(F.concat("warnings", F.array_except(a["warnings"], "warnings"))),
        "answer_pages": F.coalesce(a["answer_pages"], F.array().cast("array<int>")),
    }).drop("q_stem", "a_stem", "a")


ANSWER = ("stem", "choices", "key", "explanation", "warnings", "answer_pages", "needs_figure", "needs_table")


def fingerprint_score(left: Column, right: Column) -> Column:
    """100 if equal, 85 on a shared beginning, else 70 times the share of right's words (repeats count) that left has."""
    head = F.substring(left, 1, 48)
    share = once(F.split(left, " "), lambda known: F.size(F.filter(F.split(right, " "), lambda w: F.array_contains(known, w)))) / F.size(F.split(right, " "))
    starts = (F.length(head) >= 24) & (F.startswith(left, F.substring(right, 1, 48)) | F.startswith(right, head))
    return F.when((F.coalesce(left, F.lit("")) == "") | (F.coalesce(right, F.lit("")) == ""), 0.0).when(left == right, 100.0).when(starts, 85.0).otherwise(share * 70)


def scored_pairs(left: DataFrame, right: DataFrame, least: float = ACCEPTED) -> DataFrame:
    """left(set_id, l_id, print), right(set_id, r_id, print) to set_id, l_id, r_id, score of all pairs of a set whose score is
    `least` or more (above 0, at most 70). Three blocks, which lose nothing:

    - a share score needs so many of right's words that one of its rarest is among them: right goes by its rarest words,
      as many as may fail and one more, left by all of its words;
    - a shared beginning of prints of 24 characters or more is one of their first 24;
    - a shorter right print that begins left is one of left's beginnings.

    Null and empty prints pair with nothing."""
    left, right = (df.where("coalesce(print, '') <> ''") for df in (left, right))
    many = left.select("set_id", "l_id", F.explode(F.array_distinct(F.split("print", " "))).alias("word"))
    often = many.groupBy("set_id", "word").agg(F.count("*").alias("n"))
    spread = right.select("set_id", "r_id", "print", F.posexplode(F.split("print", " ")).alias("at", "word")).join(often, ["set_id", "word"], "left")
    rank = F.row_number().over(Window.partitionBy("set_id", "r_id", "print").orderBy(F.coalesce("n", F.lit(0)), "word", "at"))
    words = F.size(F.split("print", " "))
    rare = spread.withColumn("rank", rank).where(F.col("rank") <= words - F.ceil(words * F.lit(least / 70) - 1e-9) + 1)
    keys = "struct<kind:int,key:string>"
    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("key")).cast(keys)
    beginnings = F.transform(F.sequence(F.lit(1), F.least(F.length("print"), F.lit(23))), lambda n: key(2, F.substring(F.col("print"), F.lit(1), n)))
    first = F.when(F.length("print") >= 24, F.array(key(1, F.substring("print", 1, 24)))).otherwise(F.array().cast(f"array<{keys}>"))
    by_left = left.select("set_id", "l_id", F.col("print").alias("lp"), F.explode(F.concat(F.transform(F.array_distinct(F.split("print", " ")), lambda w: key(0, w)), first, beginnings)).alias("k"))
    start = F.when(F.length("print") >= 24, key(1, F.substring("print", 1, 24))).otherwise(key(2, F.col("print")))
    by_right = rare.select("set_id", "r_id", F.col("print").alias("rp"), key(0, F.col("word")).alias("k")).unionByName(right.select("set_id", "r_id", F.col("print").alias("rp"), start.alias("k"))).distinct()
    both = by_left.join(by_right, ["set_id", "k"]).select("set_id", "l_id", "r_id", "lp", "rp").distinct()
    return both.withColumn("score", fingerprint_score(F.col("lp"), F.col("rp"))).where(F.col("score") >= least).select("set_id", "l_id", "r_id", "score")


def components(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(pairs(set_id, l_id, r_id) with `component`, rounds used). Pairs that share a row on either side, directly or by others,
    have one component: the least of its nodes. By large and small stars in turn, which halve the depth of the trees, so a
    chain of n pairs takes some log(n) rounds."""
    node = lambda c, side: (F.col(c).cast("long") * 2 + side)
    edges = pairs.select("set_id", node("l_id", 0).alias("u"), node("r_id", 1).alias("v")).distinct()

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("set_id", "u", "v").unionByName(edges.select("set_id", F.col("v").alias("u"), F.col("u").alias("v")))
        seen = both if large else both.where("v <= u")
        least = seen.groupBy("set_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = seen.join(least, ["set_id", "u"])
        if large:
            return moved.where("v > u").select("set_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = least.select("set_id", "u", F.col("m").alias("v"))
        return moved.select("set_id", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct()

    state, rounds = None, 0
    while True:
        edges = checkpointed(stars(stars(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("set_id", "u", "v").cast("decimal(38,0)"))).first()
        rounds += 1
        if now == state:
            break
        state = now
    root = edges.select("set_id", F.col("u").alias("l_node"), F.col("v").alias("root"))
    rows = pairs.withColumn("l_node", node("l_id", 0)).join(root, ["set_id", "l_node"], "left")
    return rows.withColumn("component", F.coalesce("root", "l_node")).drop("root", "l_node"), rounds


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by component, left row, falling score and right row: each left row takes its first right row that is free.
    What is held is the right rows taken in the component that is read."""
    where, left, done, taken = None, None, False, set()
    for frame in frames:
        keep = []
        for set_id, component, l_id, r_id in zip(frame["set_id"], frame["component"], frame["l_id"], frame["r_id"], strict=True):
            if (set_id, component) != where:
                where, left, taken = (set_id, component), None, set()
            if l_id != left:
                left, done = l_id, False
            wins = not done and r_id not in taken
            if wins:
                done = True
                taken.add(r_id)
            keep.append(wins)
        yield frame[keep].drop(columns="component")


#: Pairs of a component that one task assigns in order; larger components are assigned in rounds of joins, with the same result.
AT_ONCE = 200_000


def greedy_match(scored: DataFrame, least: float = ACCEPTED, at_once: int = AT_ONCE) -> DataFrame:
    """Left rows in order take their best right row (earliest on ties) that none before took, over the pairs that reach
    `least`. Rows of different components do not meet, so components are assigned side by side, each in order in one task; a
    component of more than at_once pairs goes in rounds: a left row whose best free right row no earlier open left row could
    take has it for good."""
    pairs = checkpointed(scored.where(F.col("score") >= least).select("set_id", "l_id", "r_id", "score"))
    rows = checkpointed(components(pairs)[0])
    size = rows.groupBy("set_id", "component").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") > at_once).select("set_id", "component")
    small = rows.join(size.where(F.col("n") <= at_once).select("set_id", "component"), ["set_id", "component"], "left_semi")
    dealt = small.repartition("set_id", "component").sortWithinPartitions("set_id", "component", "l_id", F.desc("score"), "r_id")
    taken = dealt.select("set_id", "component", "l_id", "r_id", "score").mapInPandas(_in_order, pairs.schema)
    open_ = checkpointed(rows.join(large, ["set_id", "component"], "left_semi").select(*pairs.columns))
    while not open_.isEmpty():
        first = open_.groupBy("set_id", "r_id").agg(F.min("l_id").alias("first"))
        best = open_.groupBy("set_id", "l_id").agg(F.min(F.struct((-F.col("score")).alias("cost"), "r_id", "score")).alias("best"))
        best = best.select("set_id", "l_id", "best.r_id", "best.score")
        won = checkpointed(best.join(first, ["set_id", "r_id"]).where("first = l_id").select(*open_.columns))
        taken = taken.unionByName(won)
        open_ = checkpointed(open_.join(won.select("set_id", "l_id"), ["set_id", "l_id"], "left_anti").join(won.select("set_id", "r_id"), ["set_id", "r_id"], "left_anti"))
    return taken


def match_orphans(questions: DataFrame, orphans: DataFrame) -> DataFrame:
    """set_id, l_id (item), r_id (first page of the orphan), score."""
    left = questions.select("set_id", F.col("item").alias("l_id"), vignette_fingerprint(F.col("stem")).alias("print"))
    at = orphans.withColumn("r_id", F.col("answer_pages")[0])
    prints = [at.select("set_id", "r_id", vignette_fingerprint(F.col(c)).alias("print")) for c in ("stem", "explanation")]
    return match_in_order(left, prints[0].unionByName(prints[1]), ACCEPTED)


def merge_sets(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Coalesced questions with their answers: by item, and what is left by wording."""
    packed = F.struct(*ANSWER).alias("a")
    by_item = questions.join(answers.where("item > 0").select("set_id", "item", packed), ["set_id", "item"], "left")
    done, open_ = by_item.where("a is not null"), by_item.where("a is null").drop("a")
    orphans = answers.where("item = 0")
    pairs = match_orphans(open_, orphans)
    found = pairs.join(orphans.withColumn("r_id", F.col("answer_pages")[0]).select("set_id", "r_id", packed), ["set_id", "r_id"]).select("set_id", F.col("l_id").alias("item"), "a")
    return merged_rows(done.unionByName(open_.join(found, ["set_id", "item"], "left")))


def source_texts(pages: DataFrame) -> DataFrame:
    """set_id, item, source: the texts of an item's pages, joined in page order. The item is read from the text where pages
    have none."""
    rows = (pages if "item" in pages.columns else pages.withColumn("item", item_number(F.col("text"), longer=True))).where("item <> 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("set_id", "item").agg(joined.alias("source"))


def source_for_items(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items(set_id, item, question_page, …) with source: the item's pages, else the page that the item came from."""
    by_item = source_texts(pages)
    by_page = pages.groupBy("set_id", "page_number").agg(F.min("text").alias("page_text"))
    out = items.join(by_item, ["set_id", "item"], "left").join(by_page.withColumnRenamed("page_number", "question_page"), ["set_id", "question_page"], "left")
    return out.withColumn("source", F.coalesce("source", "page_text", F.lit(""))).drop("page_text")


def stem_reasons(stem: Column, source: Column, n_filled: Column, figure: Column, table: Column) -> Column:
    """Why a stem may differ from its source (itself a stem); empty if nothing speaks for that."""
    parsed = strip_explanation(stem)
    share = lambda sample, words: (F.size(sample) >= 10) & (F.size(F.filter(sample, lambda w: F.array_contains(words, w))) < 0.5 * F.size(sample))
    diverged = once(F.slice(content_words(source), 1, 18), lambda sample: once(content_words(stem), lambda words: share(sample, words)))
    chrome = has(parsed, r"(?i)^\s*(?:[•·*]?\s*)?Mark\b") | has(parsed, r"~\s*~")
    found = [
        (explanation_leak(stem), "explanation text leaked into the stem"), (chrome, "exam chrome remained in the stem"), (F.length(squeezed(parsed)) < 30, "the stem is too short"),
        (diverged, "the wording diverged from the original PDF"), ((n_filled < 2) & ~figure & ~table, "answer choices were missing"),
    ]
    return F.array_compact(F.array(*[F.when(test, text) for test, text in found]))


def check_against_source(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items with reasons, and a warning for those that have any."""
    rows = source_for_items(items, pages).withColumn("gold", source_stem(F.col("source"), F.col("item")))
    reasons = F.when(F.col("source") != "", stem_reasons(F.col("stem"), F.col("gold"), F.size(filled(F.col("choices"))), F.col("needs_figure"), F.col("needs_table"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("reasons", reasons)
    warning = F.array(F.concat(F.lit(SOURCE_WARNING + " "), F.array_join("reasons", "; ")))
    return rows.withColumn("warnings", F.when(F.size("reasons") > 0, F.array_union("warnings", warning)).otherwise(F.col("warnings"))).drop("source", "gold")


def set_summary(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Per set: questions, answered ones, answer entries, status and set warnings."""
    answered = F.col("key").isNotNull() | (F.col("explanation") != "")
    checked = F.exists("warnings", lambda w: F.startswith(w, F.lit(SOURCE_WARNING))) if "reasons" not in items.columns else F.size("reasons") > 0
    q = items.groupBy("set_id").agg(F.count("*").alias("question_count"), F.count_if(answered).alias("answer_count"), F.count_if(F.col("key").isNotNull()).alias("keyed_count"), F.count_if(checked).alias("doubtful"))
    a = answers.groupBy("set_id").agg(F.count("*").alias("entries"))
    rows = q.join(a, "set_id", "full_outer").fillna(0, ["question_count", "answer_count", "keyed_count", "doubtful", "entries"])
    status = F.when(F.col("question_count") == 0, "error").when(F.col("question_count") != F.col("answer_count"), "mismatch").otherwise("parsed")
    text = [  # fixed values: messages that users see
        F.when((F.col("question_count") != F.col("entries")) & (F.col("entries") > 0), F.format_string("Detected %d question(s) and %d answer/explanation item(s). Counts do not match.", "question_count", "entries")),
        F.when(F.col("question_count") == 0, F.lit("No questions could be extracted from the uploaded PDFs.")),
        F.when(F.col("doubtful") > 0, F.format_string("%d question(s) may need the original page image. Formatted text is still shown; use “Show image of original question” if something looks off.", "doubtful")),
    ]
    return rows.withColumn("status", status).withColumn("set_warnings", F.array_compact(F.array(*text)))


def number_questions(items: DataFrame) -> DataFrame:
    """items with question_number running over sets in order: the number in the set plus the sizes of the sets before it, so
    only the table of sets is ever in one task."""
    sizes = items.groupBy("set_id").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("set_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("set_id").orderBy(F.asc_nulls_last("item"), "question_page"))
    return items.withColumn("inside", inside).join(before, "set_id").withColumn("question_number", (F.col("before") + F.col("inside")).cast("long")).drop("inside", "before")


def import_sets(question_pages: DataFrame, answer_pages: DataFrame, parse_q: Callable, parse_a: Callable, reread: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, answer entries) of all sets: coalesced, merged, held against their source, refined by the second reading of
    their pages where `reread` is given, and numbered over all sets. Tables are kept between the steps, whose expressions
    are long."""
    questions = checkpointed(coalesce_questions(parse_q(question_pages)))
    answers = checkpointed(fold_answer_pages(parse_a(answer_pages)))
    merged = checkpointed(merge_sets(questions, answers))
    items = checkpointed(check_against_source(merged, question_pages))
    if reread is not None:
        items = checkpointed(reread(items))
    return number_questions(items), answers
