"""Attempt logs: folding actions to state, phase gates, the exam clock, scoring, review order, highlights, exports.

Events: event_id, session_id, item_id, ts, action (select, flag, strike, note, highlight, phase), label, text. Ties on ts
go by event_id. Null labels and texts are values like others; events without an item only matter to phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import matrix_status, review_status
from ..functions.rules import sub, trim
from .carry import CHUNK, carry_last, carry_next, carry_sum, in_chunks

ORDER = ("ts", "event_id")
RUNNING = ("exam", "examReview", "endConfirm")


def last_of(value: str, action: str) -> Column:
    return F.max_by(F.col(value), F.when(F.col("action") == action, F.struct(*ORDER)))


def fold_attempts(events: DataFrame) -> DataFrame:
    """session_id, item_id, answer (last select), flagged (odd toggles), struck (labels with odd toggles, sorted), notes
    (last). Strikes are counted by label first, so a hot session spreads over its items."""
    keyed = events.where("item_id is not null and action in ('select', 'flag', 'strike', 'note')")
    strikes = keyed.where("action = 'strike'").groupBy("session_id", "item_id", "label").agg(F.count("*").alias("n")).where("n % 2 = 1")
    struck = strikes.groupBy("session_id", "item_id").agg(F.array_sort(F.collect_list("label")).alias("struck"))
    state = keyed.groupBy("session_id", "item_id").agg(
        last_of("label", "select").alias("answer"), (F.count_if(F.col("action") == "flag") % 2 == 1).alias("flagged"), last_of("text", "note").alias("notes"),
    )
    return state.join(struck, ["session_id", "item_id"], "left").withColumn("struck", F.coalesce("struck", F.array().cast("array<string>")))


def with_phase(events: DataFrame, start: str = "exam", chunks: int | None = None) -> DataFrame:
    """events with the phase that the last phase event of the session before them has set. A session may be of any size."""
    said = F.when(F.col("action") == "phase", F.col("label"))
    carried = carry_last(in_chunks(events, ["session_id"], [*ORDER], chunks), ["session_id"], [*ORDER], include=False, phase=said)
    return carried.withColumn("phase", F.coalesce("phase", F.lit(start))).drop(CHUNK)


def gated_events(events: DataFrame) -> DataFrame:
    """Events that count: selects in the exam, flags and strikes in the exam and in review, everything else always."""
    phase, action = F.col("phase"), F.col("action")
    counts = F.when(action == "select", phase == "exam").when(action.isin("flag", "strike"), phase.isin("exam", "review")).otherwise(True)
    return with_phase(events).where(counts)


def clock_cutoff(events: DataFrame, budget: DataFrame, start: str = "exam", chunks: int | None = None) -> DataFrame:
    """session_id, used_seconds, cutoff: when the time that ran (outside pauses, in running phases) reached the budget; null
    if it never did. budget: session_id, seconds. Pauses are events `pause` and `resume`. A session may be of any size."""
    by = (["session_id"], [*ORDER])
    action = F.col("action")
    rows = carry_last(in_chunks(events, *by, chunks), *by, phase=F.when(action == "phase", F.col("label")), paused=F.when(action.isin("pause", "resume"), action == "pause"))
    rows = carry_next(rows, *by, next_us=F.unix_micros("ts"))
    runs = F.when(F.coalesce("phase", F.lit(start)).isin(*RUNNING) & ~F.coalesce("paused", F.lit(False)), F.coalesce(F.col("next_us") - F.unix_micros("ts"), F.lit(0))).otherwise(0)
    rows = carry_sum(rows.withColumn("runs", runs), *by, before=F.col("runs"))
    rows = rows.withColumn("before", F.col("before") - F.col("runs")).join(budget, "session_id")
    limit = F.col("seconds").cast("long") * 1_000_000
    crossing = F.when((F.col("before") < limit) & (F.col("before") + F.col("runs") >= limit), F.timestamp_micros(F.unix_micros("ts") + limit - F.col("before")))
    return rows.groupBy("session_id").agg((F.least(F.sum("runs"), F.max("seconds").cast("long") * 1_000_000) / 1e6).alias("used_seconds"), F.min(crossing).alias("cutoff"))


def ended_by_clock(events: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """events with a phase event `review` where the clock ran out, so that gates hold from then on."""
    extra = cutoffs.where("cutoff is not null").select(
        *[{"session_id": F.col("session_id"), "ts": F.col("cutoff"), "action": F.lit("phase"), "label": F.lit("review"), "event_id": F.lit(-1)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
    )
    return events.unionByName(extra)


def attempt_rows(sessions: DataFrame, items: DataFrame, state: DataFrame) -> DataFrame:
    """Every item of a session's set with its state and statuses; untouched items too. sessions: session_id, set_id."""
    every = sessions.join(items, "set_id")
    rows = every.join(state, ["session_id", "item_id"], "left")
    rows = rows.withColumns({"flagged": F.coalesce("flagged", F.lit(False)), "struck": F.coalesce("struck", F.array().cast("array<string>"))})
    return rows.withColumns({"review_status": review_status(F.col("answer"), F.col("key")), "matrix_status": matrix_status(F.col("flagged"), F.col("answer"))})


def matrix_counts(rows: DataFrame) -> DataFrame:
    """Counts overlap: an item may be answered and flagged."""
    answered = F.coalesce(F.col("answer"), F.lit("")) != ""
    return rows.groupBy("session_id").agg(F.count_if(answered).alias("answered"), F.count_if("flagged").alias("flagged"), F.count_if(~answered).alias("unanswered"), F.count("*").alias("total"))


def review_subset(rows: DataFrame, kind: str) -> DataFrame:
    """all, flagged, or unanswered (no answer given)."""
    if kind == "flagged":
        return rows.where("flagged")
    return rows.where("coalesce(answer, '') = ''") if kind == "unanswered" else rows


def review_neighbours(rows: DataFrame, kind: str = "all") -> DataFrame:
    """The rows of a subset with their place and the items before and after, by question number."""
    window = Window.partitionBy("session_id").orderBy("question_number")
    return review_subset(rows, kind).withColumns({"place": F.row_number().over(window), "previous_item": F.lag("item_id").over(window), "next_item": F.lead("item_id").over(window)})


def choice_marks(rows: DataFrame, review: bool = True) -> DataFrame:
    """One row per choice with selected, struck, correct, incorrect. rows: session_id, item_id, choices, answer, struck, key."""
    one = rows.select("session_id", "item_id", "answer", "key", "struck", F.explode("choices").alias("c"))
    label = F.col("c.label")
    selected, right = F.coalesce(F.col("answer") == label, F.lit(False)), F.coalesce(F.col("key") == label, F.lit(False))
    return one.select("session_id", "item_id", label.alias("label"), selected.alias("selected"), F.array_contains("struck", label).alias("struck"), (right & review).alias("correct"), (selected & ~right & review).alias("incorrect"))


def noted_items(rows: DataFrame) -> DataFrame:
    """The export: question_number, notes, stem, choices (one per line) of rows whose notes are not blank."""
    notes, stem = trim(F.coalesce("notes", F.lit(""))), sub(trim(F.col("stem")), [(r"\t+", "  ")])
    lines = F.array_join(F.transform("choices", lambda c: F.concat(c["label"], F.lit(". "), c["text"])), "\n")
    return rows.where(notes != "").select("question_number", notes.alias("notes"), stem.alias("stem"), lines.alias("choices"))


def import_counters(rows: DataFrame) -> DataFrame:
    noted = trim(F.coalesce("notes", F.lit(""))) != ""
    return rows.groupBy("set_id").agg(F.count_if(F.col("key").isNull()).alias("unkeyed"), F.count_if(F.col("key").isNotNull()).alias("keyed"), F.count_if(noted).alias("noted"))


def highlights_by_segment(highlights: DataFrame, segments: DataFrame) -> DataFrame:
    """highlights(item_id, h_id, start, end) clipped to segments(item_id, seg, seg_start, seg_length), in their offsets."""
    begin, end = F.col("start") - F.col("seg_start"), F.col("end") - F.col("seg_start")
    both = highlights.join(segments, "item_id").where((end > 0) & (begin < F.col("seg_length")))
    return both.select("item_id", "seg", "h_id", F.greatest(F.lit(0), begin).alias("local_start"), F.least(F.col("seg_length"), end).alias("local_end"))


def highlights_from_segment(highlights: DataFrame, edits: DataFrame) -> DataFrame:
    """The marks of stems after a segment was edited. highlights: item_id, start, end over whole stems. edits: item_id,
    seg_start, seg_length, spans (array of struct(start, end), the segment's marks in its own offsets). Marks that touch an
    edited segment give way to its spans, moved to offsets of the stem; other marks and items stay. Segments do not overlap."""
    touched = edits.select("item_id", "seg_start", "seg_length")
    meets = (highlights["item_id"] == touched["item_id"]) & (F.col("end") > F.col("seg_start")) & (F.col("start") < F.col("seg_start") + F.col("seg_length"))
    others = highlights.join(touched, meets, "left_anti").select("item_id", "start", "end")
    moved = edits.select("item_id", "seg_start", F.inline("spans")).select("item_id", (F.col("start") + F.col("seg_start")).alias("start"), (F.col("end") + F.col("seg_start")).alias("end"))
    return others.unionByName(moved)


def highlight_pieces(highlights: DataFrame, texts: DataFrame, merge: bool = False) -> DataFrame:
    """item_id, piece_start, piece_end, marked. Spans are clipped to the text; what no span before a piece reached is
    unmarked. Overlapping spans each give a piece, or one for all with merge."""
    length = F.col("length")
    start = F.greatest(F.lit(0), F.least(length, F.col("start")))
    spans = highlights.join(texts, "item_id").withColumn("s", start).withColumn("e", F.greatest(F.col("s"), F.least(length, F.col("end"))))
    by = Window.partitionBy("item_id").orderBy("start", "h_id")
    reached = F.coalesce(F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("reached", reached)
    if merge:
        island = F.sum((F.col("s") > F.col("reached")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
        marked = spans.withColumn("island", island).groupBy("item_id", "island").agg(F.min("s").alias("piece_start"), F.max("e").alias("piece_end")).drop("island")
    else:
        marked = spans.select("item_id", F.col("s").alias("piece_start"), F.col("e").alias("piece_end"))
    gaps = spans.where("s > reached").select("item_id", F.col("reached").alias("piece_start"), F.col("s").alias("piece_end"))
    ends = spans.groupBy("item_id").agg(F.max("e").alias("e"))
    tails = texts.join(ends, "item_id", "left").select("item_id", F.coalesce("e", F.lit(0)).alias("piece_start"), F.col("length").alias("piece_end"))
    plain = gaps.unionByName(tails).where("piece_end > piece_start").withColumn("marked", F.lit(False))
    return plain.unionByName(marked.where("piece_end > piece_start").withColumn("marked", F.lit(True)))
