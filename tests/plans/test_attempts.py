"""Attempt logs of a few events: folding, gates, clock, scoring, review, highlights."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from itembank.operators import attempts as A

START = datetime(2024, 5, 1, 9, 0, 0)
EVENT = "event_id long, session_id long, item_id long, ts timestamp, action string, label string, text string"


def log(spark, *steps):
    """Steps (second, action, label or text, item)."""
    rows = [(k, 1, item, START + timedelta(seconds=at), action, value, value) for k, (at, action, value, item) in enumerate(steps)]
    return spark.createDataFrame(rows, EVENT)


def test_fold_keeps_the_last_answer_and_odd_toggles(spark):
    events = log(
        spark, (1, "select", "A", 1), (2, "flag", None, 1), (3, "strike", "C", 1), (4, "note", "first", 1), (5, "select", "B", 2), (6, "note", "second", 2),
        (7, "select", "C", 1), (8, "strike", "D", 1), (9, "strike", "D", 1), (10, "flag", None, 2), (11, "flag", None, 2), (12, "select", "E", None),
    )
    for shuffled in (events, events.orderBy(F.rand(3))):
        got = {r.item_id: (r.answer, r.flagged, r.struck, r.notes) for r in A.fold_attempts(shuffled).collect()}
        assert got == {1: ("C", True, ["C"], "first"), 2: ("B", False, [], "second")}


def test_answers_count_in_the_exam_only(spark):
    events = log(
        spark, (1, "select", "A", 1), (2, "phase", "endConfirm", None), (3, "select", "B", 1), (4, "flag", None, 1), (5, "note", "late", 1), (6, "phase", "review", None), (7, "select", "D", 1), (8, "flag", None, 1),
    )
    got = A.fold_attempts(A.gated_events(events)).collect()[0]
    assert (got.answer, got.flagged, got.notes) == ("A", True, "late")


def test_clock_stops_in_pauses_and_ends_the_exam(spark):
    events = log(spark, (0, "select", "A", 1), (10, "pause", None, None), (100, "resume", None, None), (105, "phase", "examReview", None), (150, "select", "B", 1), (400, "select", "C", 1))
    budget = spark.createDataFrame([(1, 30)], "session_id long, seconds long")
    got = A.clock_cutoff(events, budget).collect()[0]
    assert got.used_seconds == 30 and got.cutoff == START + timedelta(seconds=120)  # 10 s before the pause, 5 s behind it, 15 s in the review of questions
    ended = A.with_phase(A.ended_by_clock(events, A.clock_cutoff(events, budget)))
    assert {r.phase for r in ended.where("label = 'C'").collect()} == {"review"}
    never = A.clock_cutoff(events, spark.createDataFrame([(1, 5000)], "session_id long, seconds long")).collect()[0]
    assert never.cutoff is None and never.used_seconds == 10 + 300


def test_rows_score_count_and_navigate(spark):
    items = spark.createDataFrame([(1, k, k, "B" if k < 4 else None, f" stem\t\t{k} ", [("A", "yes"), ("B", "no")]) for k in range(1, 5)], "set_id long, item_id long, question_number int, key string, stem string, choices array<struct<label:string,text:string>>")
    events = log(spark, (1, "select", "B", 1), (2, "select", "A", 2), (3, "flag", None, 2), (4, "select", "A", 4), (5, "note", "  ", 1), (6, "note", " look ", 3), (7, "strike", "A", 1))
    sessions = spark.createDataFrame([(1, 1)], "session_id long, set_id long")
    rows = A.attempt_rows(sessions, items, A.fold_attempts(events))
    got = {r.item_id: (r.review_status, r.matrix_status) for r in rows.collect()}
    assert got == {1: ("correct", "answered"), 2: ("incorrect", "flagged"), 3: ("unanswered", "unanswered"), 4: ("unanswered", "answered")}
    counts = A.matrix_counts(rows).collect()[0]
    assert (counts.answered, counts.flagged, counts.unanswered, counts.total) == (3, 1, 1, 4)
    assert [A.review_subset(rows, k).count() for k in ("all", "flagged", "unanswered")] == [4, 1, 1]
    assert [(r.item_id, r.previous_item, r.next_item) for r in A.review_neighbours(rows).orderBy("place").collect()][1] == (2, 1, 3)
    note = A.noted_items(rows).collect()
    assert [(r.question_number, r.notes, r.stem, r.choices) for r in note] == [(3, "look", "stem  3", "A. yes\nB. no")]
    mark = {(r.item_id, r.label): (r.selected, r.struck, r.correct, r.incorrect) for r in A.choice_marks(rows).collect()}
    assert mark[1, "B"] == (True, False, True, False) and mark[1, "A"] == (False, True, False, False) and mark[2, "A"] == (True, False, False, True)
    unset = A.import_counters(rows).collect()[0]
    assert (unset.unkeyed, unset.keyed, unset.noted) == (1, 3, 1)


def test_highlights(spark):
    spans = spark.createDataFrame([(1, 1, 2, 6), (1, 2, 4, 9), (1, 3, -5, 1), (1, 4, 30, 40)], "item_id long, h_id int, start int, end int")
    texts = spark.createDataFrame([(1, 12), (2, 5)], "item_id long, length int")
    pieces = sorted((r.item_id, r.piece_start, r.piece_end, r.marked) for r in A.highlight_pieces(spans, texts).collect())
    assert pieces == [(1, 0, 1, True), (1, 1, 2, False), (1, 2, 6, True), (1, 4, 9, True), (1, 9, 12, False), (2, 0, 5, False)]
    merged = sorted((r.piece_start, r.piece_end) for r in A.highlight_pieces(spans, texts, merge=True).where("marked").collect())
    assert merged == [(0, 1), (2, 9)]
    segments = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5, 5)], "item_id long, seg int, seg_start int, seg_length int")
    cut = sorted((r.seg, r.h_id, r.local_start, r.local_end) for r in A.highlights_by_segment(spans, segments).collect())
    assert cut == [(1, 1, 2, 5), (1, 2, 4, 5), (1, 3, 0, 1), (2, 1, 0, 1), (2, 2, 0, 4)]


def test_odd_input(spark):
    none = spark.createDataFrame([], EVENT)
    assert A.fold_attempts(none).count() == 0 and A.gated_events(none).count() == 0
    odd = log(spark, (1, "select", None, 1), (1, "strike", None, 1), (1, "select", "B", 1), (1, "select", "B", 1))
    got = A.fold_attempts(odd).collect()[0]
    assert got.answer == "B" and got.flagged is False  # ties in time go by event
