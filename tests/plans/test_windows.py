"""Windows over keys of any size, lines from items with uneven places, answer folding, streams against batches."""

import random
import re

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from itembank.functions.glyph import PAIR
from itembank.operators import assemble as A
from itembank.operators import attempts as AT
from itembank.operators import carry, layout
from itembank.operators import pages as PG
from itembank.sources import io
from itembank.streaming import jobs

ITEM = "set_id string, page_number int, seq int, str string, x double, y double, width double, height double, has_eol boolean"


@pytest.fixture(scope="module")
def log(spark):
    """Three sessions, one of them with nearly all events."""
    rng = random.Random(7)
    acts = [("phase", p) for p in ("exam", "examReview", "endConfirm")] + [("pause", None), ("resume", None)] + [("select", "A")] * 20
    rows = [(i, 1 if rng.random() < 0.95 else rng.choice([2, 3]), i % 9, 1_700_000_000 + rng.randint(0, 40_000), *rng.choice(acts)) for i in range(3000)]
    return spark.createDataFrame(rows, "event_id long, session_id long, item_id long, s long, action string, label string").withColumn("ts", F.timestamp_seconds("s")).drop("s").withColumn("text", F.lit(None).cast("string"))


def test_carried_windows_equal_plain_ones(log):
    keys, order = ["session_id"], ["ts", "event_id"]
    rows = carry.in_chunks(log, keys, order, 16)
    assert rows.groupBy(carry.CHUNK).count().agg(F.max("count")).first()[0] < 600  # of 3,000, nearly all of one session
    value = F.when(F.col("action") == "phase", F.col("label"))
    number = F.col("event_id") % 7
    got = carry.carry_last(rows, keys, order, upto=value)
    got = carry.carry_last(got, keys, order, include=False, before=value)
    got = carry.carry_next(carry.carry_sum(got, keys, order, total=number), keys, order, next_id=F.col("event_id"))
    by = Window.partitionBy("session_id").orderBy("ts", "event_id")
    past = by.rowsBetween(Window.unboundedPreceding, 0)
    want = log.select("event_id", F.last(value, ignorenulls=True).over(past).alias("upto"), F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum(number).over(past).alias("total"), F.lead("event_id").over(by).alias("next_id"))
    assert {tuple(r) for r in got.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
    assert got.count() == log.count()


def test_clock_and_phases_do_not_depend_on_chunks(log):
    budget = log.select("session_id").distinct().withColumn("seconds", F.lit(9000))
    cuts = [sorted(map(tuple, AT.clock_cutoff(log, budget, chunks=n).collect())) for n in (1, 16)]
    phases = [sorted((r.event_id, r.phase) for r in AT.with_phase(log, chunks=n).collect()) for n in (1, 16)]
    assert cuts[0] == cuts[1] and phases[0] == phases[1] and any(c[2] for c in cuts[0])


def test_clock_ends_the_exam_before_folding(spark):
    base = spark.createDataFrame([(1, 1, 5, 0, "select", "A"), (2, 1, 5, 200, "select", "B"), (3, 1, 5, 210, "flag", None)], "event_id long, session_id long, item_id long, s long, action string, label string")
    rows = base.withColumn("ts", F.timestamp_seconds("s")).drop("s").withColumn("text", F.lit(None).cast("string"))
    cut = AT.clock_cutoff(rows, spark.createDataFrame([(1, 90)], "session_id long, seconds int"))
    state = AT.fold_attempts(AT.gated_events(AT.ended_by_clock(rows, cut))).collect()[0]
    assert (state.answer, state.flagged) == ("A", True)


def lines(spark, *items):
    rows = [("s", 1, k, *i, False) if len(i) == 5 else ("s", 1, k, *i) for k, i in enumerate(items)]
    return [r.line for r in layout.assemble_lines(spark.createDataFrame(rows, ITEM)).orderBy("line_no").collect()]


def test_uneven_lines(spark):
    assert lines(spark, ("The", 0.0, 100.0, 20.0, 10.0), ("patient", 24.0, 100.6, 40.0, 10.0), ("rests", 68.0, 99.5, 30.0, 10.0), ("today.", 0.0, 88.0, 30.0, 10.0)) == ["The patient rests", "today."]
    # a digit below the line belongs to the unit that the line so far ends with, also if the unit comes in parts
    assert lines(spark, ("9000/", 0.0, 100.0, 30.0, 10.0), ("mm", 30.0, 100.0, 12.0, 10.0), ("3", 42.0, 95.0, 5.0, 6.0), ("Serum", 0.0, 88.0, 30.0, 10.0)) == ["9000/mm³", "Serum"]
    # choices in two columns
    assert lines(spark, ("A) Rest", 0.0, 50.0, 40.0, 10.0), ("B) Sleep", 200.0, 50.8, 40.0, 10.0)) == ["A) Rest", "B) Sleep"]
    assert lines(spark, ("no", None, None, 10.0, 10.0), ("place", 12.0, None, None, None)) == ["no place"]


def test_hits_have_boxes(spark):
    rows = spark.createDataFrame([("s", 1, 0, "Sodium low", 5.0, 90.0, 40.0, 9.0, False), ("s", 1, 1, "SODIUM", 50.0, 70.0, None, None, False), ("s", 2, 0, "none", 0.0, 0.0, 1.0, 1.0, False)], ITEM)
    got = layout.term_hits(rows, " sodium ").orderBy("seq").collect()
    assert [(r.page_number, r.left, r.baseline, r.width, r.height) for r in got] == [(1, 5.0, 90.0, 40.0, 9.0), (1, 50.0, 70.0, 30.0, 10.0)]
    assert layout.term_hits(rows, "  ").count() == 0 and layout.term_search(rows, "sodium").collect()[0].hits == 2


def test_answer_pages_keep_flags_and_choices_of_their_opening(spark):
    stem = "A 45-year-old man is brought to the office because of pain in the chest"
    four = [Row(label=c, text=f"a longer choice {c}") for c in "ABCD"]
    rows = [
        ("s", 1, 0, stem, four[:2], "B", "first", True, True), ("s", 2, 0, "", four, None, "second", False, False),  # an orphan and its continuation
        ("s", 3, 7, stem, four[:3], None, "third", False, False), ("s", 4, 0, "", four, "C", "fourth", True, False), ("s", 5, 7, stem, four, "D", "fifth", False, True),
    ]
    schema = "set_id string, page_number int, item int, stem string, choices array<struct<label:string,text:string>>, key string, explanation string, needs_figure boolean, needs_table boolean"
    drafts = spark.createDataFrame(rows, schema).withColumn("warnings", F.array().cast("array<string>"))
    orphan, numbered = A.fold_answer_pages(drafts).orderBy("item").collect()
    assert (orphan.key, orphan.needs_figure, orphan.needs_table, len(orphan.choices), orphan.explanation, orphan.answer_pages) == ("B", True, True, 2, "first\n\nsecond", [1, 2])
    assert (numbered.key, numbered.needs_figure, numbered.needs_table, len(numbered.choices), numbered.answer_pages) == ("C", False, True, 4, [3, 4, 5])


@pytest.mark.parametrize("text,joins", [("me chanical", True), ("me tion", True), ("me dical", False), ("me chanics", True), ("me and", False), ("give me some", False)])
def test_me_before_fragments(text, joins):
    assert bool(re.search(PAIR.replace(r"\z", r"\Z"), text)) is joins


def test_highlights_there_and_back(spark):
    marks = spark.createDataFrame([(1, 1, 2, 8), (1, 2, 40, 50), (2, 3, 0, 5)], "item_id int, h_id int, start int, end int")
    segments = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 12, 10)], "item_id int, seg int, seg_start int, seg_length int")
    local = AT.highlights_by_segment(marks, segments).groupBy("item_id", "seg").agg(F.collect_list(F.struct(F.col("local_start").alias("start"), F.col("local_end").alias("end"))).alias("spans"))
    edits = local.join(segments, ["item_id", "seg"])
    back = AT.highlights_from_segment(marks, edits)
    assert {tuple(r) for r in back.collect()} == {(1, 2, 8), (1, 40, 50), (2, 0, 5)}
    cleared = AT.highlights_from_segment(marks, segments.where("seg = 1").withColumn("spans", F.array().cast("array<struct<start:int,end:int>>")))
    assert {tuple(r) for r in cleared.collect()} == {(1, 40, 50), (2, 0, 5)}


def test_stream_of_shuffled_batches_equals_one(spark, log, tmp_path):
    """The ordered clock does not depend on the batches that events came in; nothing of ended sessions stays."""
    got = []
    for n in (1, 6):
        arriving, out = io.fresh_dir(spark, "log"), io.fresh_dir(spark, "clock")
        closing = spark.createDataFrame([(-1, -1, None, 1_800_000_000, "select", None)], "event_id long, session_id long, item_id long, s long, action string, label string")
        closing = closing.withColumn("ts", F.timestamp_seconds("s")).drop("s").withColumn("text", F.lit(None).cast("string"))
        log.repartition(n, "event_id").write.parquet(arriving)
        closing.coalesce(1).write.mode("append").parquet(arriving)
        # late rows of shuffled files lie within the watermark's delay
        stream = jobs.session_clock(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(arriving), 9000, late="12 hours", remembered_ms=3_600_000)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        got.append((sorted(map(tuple, spark.read.schema(jobs.CLOCK_OUT).parquet(out).collect())), left))
    budget = log.select("session_id").distinct().withColumn("seconds", F.lit(9000))
    batch = {r.session_id: r.used_seconds for r in AT.clock_cutoff(log, budget).where("cutoff is not null").collect()}
    # what stays: the closing session, and those that have neither run out nor been closed (paused to the end)
    assert got[0] == got[1] and got[0][1] == 1 + 3 - len(got[0][0])
    ended = {s: (used, by) for s, used, by in got[0][0]}
    assert all(ended[s] == (used, "clock") for s, used in batch.items()) and 1 in batch


def test_bank_of_arriving_pages_equals_batch(spark):
    v = "A {}-year-old man is brought to the office because of pain in the chest for {} days and some weeks."
    choices = "\n".join(f"O {c}) Choice number {c}" for c in "ABCDE")
    rows = []
    for s in ("one", "two"):
        for i in (1, 2, 3):
            stem = v.format(20 + 9 * i, i)
            rows.append((s, "q", i, f"Exam Section: Item {i} of 50\n{i}. {stem}\nWhich of the following is best?\n{choices}\nNext"))
            rows.append((s, "a", 10 * i, (f"Exam Section: Item {i} of 50\n{i}. " if i < 3 else "") + f"{stem}\nCorrect Answer: {'ABC'[i - 1]}.\nThe reason is {s} {i}."))
    pages = spark.createDataFrame(rows, "set_id string, kind string, page_number int, text string")
    names = ["set_id", "item", "stem", "key", "explanation", "question_page", "answer_pages", "needs_figure"]
    kept = lambda df: sorted(map(repr, df.select(*names).collect()))
    batch = A.merge_sets(A.coalesce_questions(PG.parse_question_pages(pages.where("kind = 'q'"))), A.fold_answer_pages(PG.parse_answer_pages(pages.where("kind = 'a'"))))
    want = kept(batch)
    assert [r for r in want if "key=None" in r] == [] and len(want) == 6
    path = io.fresh_dir(spark, "bank")
    first = pages.where("kind = 'q' or set_id = 'one'")
    jobs.merge_batch(first.where("not (set_id = 'two' and page_number = 3)"), 0, path)
    assert len(kept(jobs.current_bank(spark, path))) == 5
    late = pages.where("set_id = 'two' and (kind = 'a' or page_number = 3)")
    jobs.merge_batch(late, 1, path)
    assert kept(jobs.current_bank(spark, path)) == want
    jobs.merge_batch(late, 1, path)  # tried again
    assert kept(jobs.current_bank(spark, path)) == want
    again = io.fresh_dir(spark, "bank")
    jobs.compact_bank(spark, path, again)
    assert kept(jobs.current_bank(spark, again)) == want
    jobs.merge_batch(late, 1, again)  # tried again after the compaction
    assert kept(jobs.current_bank(spark, again)) == want
    mended = pages.where("set_id = 'one' and kind = 'a' and page_number = 20").withColumn("text", F.replace("text", F.lit("Answer: B"), F.lit("Answer: D")))
    jobs.merge_batch(mended, 2, again)  # a page read once more, otherwise
    assert kept(jobs.current_bank(spark, again)) == [r.replace("key='B'", "key='D'").replace("Answer: B", "Answer: D") if "set_id='one'" in r else r for r in want]
    last = io.fresh_dir(spark, "bank")
    jobs.compact_bank(spark, again, last)
    assert kept(jobs.current_bank(spark, last)) == kept(jobs.current_bank(spark, again)) and kept(jobs.current_bank(spark, path)) == want
