"""Registered queries over attempt logs: folding, gates, clock, scoring, review, highlights, export, live counts. Sessions and
items are derived from events and orders; every query has its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attempts as A
from ..sources import io
from ..sources.derive import EVENTS_K, SQL, derived, duck
from ..streaming import jobs
from .texts import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LETTERS = "ABCDE"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "attempts")


def moment(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


#: Ninety seconds an item; sessions have budgets of different sizes, which many of them exceed.
_BUDGET = "90 * (1000 + 200 * (session_id % 50))"
_PAST = "PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND "
#: cut: when the clock of a session ran out; log: events, with the end of the exam put in there.
_CLOCK = f"""e AS (SELECT *, coalesce(last_value(CASE WHEN action = 'phase' THEN label END IGNORE NULLS) OVER ({_PAST} CURRENT ROW), 'exam') AS phase,
   coalesce(last_value(CASE WHEN action IN ('pause', 'resume') THEN action = 'pause' END IGNORE NULLS) OVER ({_PAST} CURRENT ROW), false) AS paused,
   epoch_us(lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap, 1000000 * {_BUDGET} AS most FROM attempts),
 u AS (SELECT *, CASE WHEN phase IN ('exam', 'examReview', 'endConfirm') AND NOT paused THEN coalesce(gap, 0) ELSE 0 END AS runs FROM e),
 b AS (SELECT *, sum(runs) OVER ({_PAST} CURRENT ROW) - runs AS before FROM u),
 cut AS (SELECT session_id, least(sum(runs), max(most))::DOUBLE / 1000000 AS used_seconds, make_timestamp(CAST(min(CASE WHEN before < most AND before + runs >= most THEN epoch_us(ts) + most - before END) AS BIGINT)) AS cutoff FROM b GROUP BY session_id),
 log AS (SELECT event_id, session_id, item_id, ts, action, label, text FROM attempts UNION ALL SELECT -1, session_id, NULL, cutoff, 'phase', 'review', NULL FROM cut WHERE cutoff IS NOT NULL)"""
#: a: events with the phase before each; g: those that count; state, struck: the fold over g.
_GATED = duck("attempts", "bank") + f""", {_CLOCK}, a AS (SELECT *, coalesce(last_value(CASE WHEN action = 'phase' THEN label END IGNORE NULLS) OVER ({_PAST} 1 PRECEDING), 'exam') AS phase FROM log),
 g AS (SELECT * FROM a WHERE CASE WHEN action = 'select' THEN phase = 'exam' WHEN action IN ('flag', 'strike') THEN phase IN ('exam', 'review') ELSE true END),
 state AS (SELECT session_id, item_id, last(label ORDER BY ts, event_id) FILTER (WHERE action = 'select') AS answer, count(*) FILTER (WHERE action = 'flag') % 2 = 1 AS flagged,
   last(text ORDER BY ts, event_id) FILTER (WHERE action = 'note') AS notes FROM g WHERE item_id IS NOT NULL AND action IN ('select', 'flag', 'strike', 'note') GROUP BY ALL),
 odd AS (SELECT session_id, item_id, label FROM g WHERE item_id IS NOT NULL AND action = 'strike' GROUP BY ALL HAVING count(*) % 2 = 1),
 struck AS (SELECT session_id, item_id, string_agg(label, ',' ORDER BY label) AS struck FROM odd GROUP BY ALL),
 r AS (SELECT b.set_id AS session_id, b.*, answer, coalesce(flagged, false) AS flagged, coalesce(struck, '') AS struck, notes,
   CASE WHEN coalesce(answer, '') = '' OR coalesce(key, '') = '' THEN 'unanswered' WHEN answer = key THEN 'correct' ELSE 'incorrect' END AS review_status,
   CASE WHEN coalesce(flagged, false) THEN 'flagged' WHEN coalesce(answer, '') <> '' THEN 'answered' ELSE 'unanswered' END AS matrix_status
   FROM bank b JOIN (SELECT DISTINCT session_id FROM attempts) s ON s.session_id = b.set_id LEFT JOIN state t ON t.session_id = b.set_id AND t.item_id = b.item_id
   LEFT JOIN struck k ON k.session_id = b.set_id AND k.item_id = b.item_id) """


def budgets(log: DataFrame) -> DataFrame:
    return log.select("session_id").distinct().withColumn("seconds", F.expr(_BUDGET))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that count: those of an exam up to its end by phase or by clock, and those allowed after it."""
    log = events(spark, sf_dir)
    return A.gated_events(A.ended_by_clock(log, A.clock_cutoff(log, budgets(log))))


@query(f"{duck('attempts')}, {_CLOCK} SELECT session_id, used_seconds, strftime(cutoff, '%Y-%m-%d %H:%M:%S.%f') AS cutoff FROM cut")
def exam_clock_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return A.clock_cutoff(log, budgets(log)).select("session_id", "used_seconds", moment(F.col("cutoff")).alias("cutoff"))


@query(_GATED + " SELECT event_id, session_id, action, phase FROM g")
def gated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).select("event_id", "session_id", "action", "phase")


@query(_GATED + " SELECT session_id, item_id, answer, flagged, coalesce(struck, '') AS struck, notes FROM state LEFT JOIN struck USING (session_id, item_id)")
def fold_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fold_attempts(counted(spark, sf_dir)).select("session_id", "item_id", "answer", "flagged", F.array_join("struck", ",").alias("struck"), "notes")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = F.array(*[F.struct(F.lit(c).alias("label"), F.concat(F.lit(f"choice {c} "), F.col("item_id").cast("string")).alias("text")) for c in LETTERS])
    return derived(spark, sf_dir, "bank").withColumn("choices", choices)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of each session with its state, from the events that count."""
    log = events(spark, sf_dir)
    sessions = log.select("session_id", F.col("session_id").alias("set_id")).distinct()
    return A.attempt_rows(sessions, items(spark, sf_dir), A.fold_attempts(counted(spark, sf_dir)))


@query(_GATED + " SELECT session_id, item_id, answer, key, review_status FROM r")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("session_id", "item_id", "answer", "key", "review_status")


@query(_GATED + " SELECT session_id, item_id, flagged, matrix_status FROM r")
def matrix_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("session_id", "item_id", "flagged", "matrix_status")


@query(_GATED + """ SELECT session_id, count(*) FILTER (WHERE coalesce(answer, '') <> '') AS answered, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE coalesce(answer, '') = '') AS unanswered, count(*) AS total
 FROM r GROUP BY session_id""")
def attempt_matrix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.matrix_counts(rows(spark, sf_dir))


_NOTE = r"regexp_replace(coalesce(notes, ''), '^\s+|\s+\z', '', 'g')"


@query(_GATED + f" SELECT set_id, count(*) FILTER (WHERE key IS NULL) AS unkeyed, count(*) FILTER (WHERE key IS NOT NULL) AS keyed, count(*) FILTER (WHERE {_NOTE} <> '') AS noted FROM r GROUP BY set_id")
def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.import_counters(rows(spark, sf_dir))


@query(_GATED + """ SELECT 'all' AS kind, session_id, item_id FROM r UNION ALL SELECT 'flagged', session_id, item_id FROM r WHERE flagged
 UNION ALL SELECT 'unanswered', session_id, item_id FROM r WHERE coalesce(answer, '') = ''""")
def review_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = rows(spark, sf_dir)
    one = lambda kind: A.review_subset(every, kind).select(F.lit(kind).alias("kind"), "session_id", "item_id")
    return one("all").unionByName(one("flagged")).unionByName(one("unanswered"))


@query(_GATED + """ SELECT session_id, item_id, row_number() OVER w AS place, lag(item_id) OVER w AS previous_item, lead(item_id) OVER w AS next_item FROM r WHERE coalesce(answer, '') = ''
 WINDOW w AS (PARTITION BY session_id ORDER BY question_number)""")
def review_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.review_neighbours(rows(spark, sf_dir), "unanswered").select("session_id", "item_id", "place", "previous_item", "next_item")


@query(_GATED + """, c AS (SELECT *, unnest(['A', 'B', 'C', 'D', 'E']) AS label FROM r)
 SELECT session_id, item_id, label, coalesce(answer = label, false) AS selected, list_contains(string_split(struck, ','), label) AS struck, coalesce(key = label, false) AS correct,
  coalesce(answer = label, false) AND NOT coalesce(key = label, false) AS incorrect FROM c""")
def choice_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.choice_marks(rows(spark, sf_dir))


_EXPORT = _GATED + rf""" SELECT question_number, {_NOTE} AS notes, regexp_replace(regexp_replace(stem, '^\s+|\s+\z', '', 'g'), '\t+', '  ', 'g') AS stem,
 array_to_string(list_transform(['A', 'B', 'C', 'D', 'E'], lambda c: c || '. choice ' || c || ' ' || item_id), chr(10)) AS choices FROM r WHERE {_NOTE} <> '' """


@query(_EXPORT)
def export_noted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back."""
    noted = A.noted_items(rows(spark, sf_dir))
    path = io.fresh_dir(spark, "notes")
    io.write_notes(noted, path)
    return spark.read.schema(noted.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


# --- highlights
@query(f"""{duck("spans", "segments")} SELECT item_id, seg, h_id, greatest(0, start - seg_start) AS local_start, least(seg_length, stop - seg_start) AS local_end
 FROM spans JOIN segments USING (item_id) WHERE stop - seg_start > 0 AND start - seg_start < seg_length""")
def highlights_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.highlights_by_segment(derived(spark, sf_dir, "spans").withColumnRenamed("stop", "end"), derived(spark, sf_dir, "segments"))


@query(f"""{duck("spans", "segments")}, f AS (SELECT item_id, seg_start, seg_length, greatest(seg_start, start) AS s, least(seg_start + seg_length, stop) AS e FROM spans JOIN segments USING (item_id) WHERE stop > seg_start AND start < seg_start + seg_length)
 SELECT item_id, s AS start, e AS stop FROM f UNION ALL SELECT item_id, start, stop FROM spans h WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.item_id = h.item_id AND h.stop > f.seg_start AND h.start < f.seg_start + f.seg_length)""")
def highlights_from_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks moved to their segments and, unchanged, back to their stems: what lies outside all marked segments stays."""
    marks, segments = derived(spark, sf_dir, "spans").withColumnRenamed("stop", "end"), derived(spark, sf_dir, "segments")
    local = A.highlights_by_segment(marks, segments).groupBy("item_id", "seg").agg(F.collect_list(F.struct(F.col("local_start").alias("start"), F.col("local_end").alias("end"))).alias("spans"))
    return A.highlights_from_segment(marks, local.join(segments, ["item_id", "seg"])).withColumnRenamed("end", "stop")


_PIECES = f"""{duck("spans", "lengths")}, s AS (SELECT item_id, h_id, start, length, greatest(0, least(length, start)) AS s, greatest(greatest(0, least(length, start)), least(length, stop)) AS e FROM spans JOIN lengths USING (item_id)),
 c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY item_id ORDER BY start, h_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM s)"""


@query(f"""{_PIECES} SELECT item_id, s AS piece_start, e AS piece_end, true AS marked FROM s WHERE e > s UNION ALL SELECT item_id, reached, s, false FROM c WHERE s > reached
 UNION ALL SELECT item_id, coalesce(m, 0), length, false FROM lengths LEFT JOIN (SELECT item_id, max(e) AS m FROM s GROUP BY item_id) USING (item_id) WHERE length > coalesce(m, 0)""")
def coalesce_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.highlight_pieces(derived(spark, sf_dir, "spans").withColumnRenamed("stop", "end"), derived(spark, sf_dir, "lengths"))


@query(f"""{_PIECES}, i AS (SELECT *, sum(CASE WHEN s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY start, h_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM c),
 m AS (SELECT item_id, island, min(s) AS a, max(e) AS b FROM i GROUP BY ALL) SELECT item_id, a AS piece_start, b AS piece_end FROM m WHERE b > a""")
def merged_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.highlight_pieces(derived(spark, sf_dir, "spans").withColumnRenamed("stop", "end"), derived(spark, sf_dir, "lengths"), merge=True)
    return rows.where("marked").drop("marked")


# --- streams
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    raw.createOrReplaceTempView("arriving_events")
    spark.sql(EVENTS_K["spark"].replace("FROM events", "FROM arriving_events")).createOrReplaceTempView("events_k")
    return spark.sql(SQL["attempts"])


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for the files that are there, written by it and read back."""
    spark = stream.sparkSession
    path = io.fresh_dir(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"""{duck("attempts")}, w AS (SELECT date_trunc('day', ts) AS d, session_id, count(*) FILTER (WHERE action = 'select') AS selects, count(*) FILTER (WHERE action = 'flag') AS flags,
  count(*) FILTER (WHERE action = 'strike') AS strikes, count(*) FILTER (WHERE action = 'note') AS notes FROM attempts GROUP BY ALL)
 SELECT strftime(d, '%Y-%m-%d') AS day, session_id, selects, flags, strikes, notes FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM attempts)""")
def stream_attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that are closed once all events have arrived."""
    counts = drained(jobs.attempt_counts(event_stream(spark, sf_dir)), "attempt_counts")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "session_id", "selects", "flags", "strikes", "notes")


_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM attempts)"
#: As the batch rule, but the time behind a session's last event runs on, up to where the watermark stands in the end.
_RUNNING_ON = _CLOCK.replace(_BUDGET, "CAST(500000 AS BIGINT)").replace("epoch_us(lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id)) - epoch_us(ts)", f"greatest(epoch_us(coalesce(lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id), {_MARK})) - epoch_us(ts), 0)")


@query(f"""{duck("attempts")}, {_RUNNING_ON}, rv AS (SELECT session_id, min(ts) AS review FROM attempts WHERE action = 'phase' AND label = 'review' GROUP BY session_id),
 p AS (SELECT b.session_id, max(before) AS used FROM b JOIN rv ON rv.session_id = b.session_id AND rv.review = b.ts WHERE action = 'phase' AND label = 'review' GROUP BY b.session_id),
 k AS (SELECT cut.session_id, used, review, coalesce(cutoff < {_MARK} AND (review IS NULL OR cutoff <= review), false) AS clock FROM cut LEFT JOIN rv ON rv.session_id = cut.session_id LEFT JOIN p ON p.session_id = cut.session_id)
 SELECT session_id, CASE WHEN clock THEN 'clock' ELSE 'phase' END AS ended_by, CASE WHEN clock THEN 500000.0::DOUBLE ELSE used::DOUBLE / 1000000 END AS used_seconds FROM k WHERE clock OR review < {_MARK}""")
def stream_exam_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose clock ran out, or that entered review, while events arrived."""
    return drained(jobs.session_clock(event_stream(spark, sf_dir), 500_000), "clocks")
