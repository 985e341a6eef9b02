"""Registered queries against their DuckDB counterparts on the smallest tables, and streams against batches."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from itembank.operators import attempts as A
from itembank.plans import attempts, bank, imports, labs, texts

TABLES = "documents events lineitem orders part conversations benchmark".split()
#: The rest, which parse whole pages and take longer, are left to the side-by-side comparison of the driver.
QUICK = [(attempts, n) for n in attempts.ORACLES] + [(labs, n) for n in labs.ORACLES]
QUICK += [(imports, n) for n in ("src_pages_json", "sink_lean_snapshot", "split_merged_choices", "trim_choices", "repair_two_column", "temperature_guard", "visual_worklist", "import_sets")]
QUICK += [(bank, n) for n in ("source_stem", "warning_union", "attach_continuations", "fold_answer_pages", "number_questions", "qc_stem", "overlap_score", "qc_discrepancy", "pair_files", "pair_leftover", "dedupe_files", "missing_items", "merge_by_number")]
QUICK += [(texts, n) for n in ("tokens_content", "spaced_glyph_flag", "is_cover_page", "extract_item", "extract_key", "split_choices", "pad_choices", "choice_shape", "classify_file")]


@pytest.fixture(scope="module")
def duck(sf):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return base


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("module,name", QUICK, ids=[n for _, n in QUICK])
def test_query_equals_sql(spark, sf, duck, module, name):
    got = module.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = duck.execute(module.ORACLES[name])
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert len(want.description) == len(names)
    rows = Counter(repr(tuple(plain(x[i]) for i in order)) for x in want.fetchall())
    assert Counter(repr(tuple(plain(r[n]) for n in names)) for r in got.collect()) == rows


def test_stream_of_clocks_equals_batch(spark, sf):
    """A session whose running time reaches the budget, by the batch rule, ends by the clock in the stream, at that time."""
    got = {r.session_id: (r.ended_by, r.used_seconds) for r in attempts.QUERIES["stream_exam_clock"](spark, sf).collect()}
    log = attempts.events(spark, sf)
    cut = A.clock_cutoff(log, log.select("session_id").distinct().withColumn("seconds", F.lit(500_000)))
    review = log.where("action = 'phase' AND label = 'review'").groupBy("session_id").agg(F.min("ts").alias("review"))
    want = cut.join(review, "session_id", "left").collect()
    for r in want:
        if r.cutoff is not None and (r.review is None or r.cutoff < r.review):
            assert got[r.session_id] == ("clock", 500_000.0)
        elif r.review is not None:
            assert got[r.session_id][0] == "phase"
    assert any(r.cutoff is not None for r in want)


def test_every_query_is_registered_once(spark):
    names = [n for module in (texts, bank, attempts, labs, imports) for n in module.QUERIES]
    assert len(names) == len(set(names)) > 100
