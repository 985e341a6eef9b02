"""Input tables for the jobs, derived from the given tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("documents", "benchmark", "conversations", "events", "lineitem", "orders", "part")

_NUMBERED = "SELECT doc_id, source AS set_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS item, coalesce(text, '') AS text FROM documents"
_CHOICES = " || ".join(f"chr(10) || '{c}) ' || CASE (doc_id + {k}) % 5 WHEN 0 THEN 'Arterial embolism' WHEN 1 THEN 'Chronic gastritis' WHEN 2 THEN 'Viral hepatitis' WHEN 3 THEN 'Renal colic and pain' ELSE 'No abnormality' END" for k, c in enumerate("ABCDE"))
_AGED = "'A ' || (20 + doc_id % 60) || '-year-old man has had pain for ' || (1 + doc_id % 9) || ' days. ' || text"
_STEM = "item || '. ' || " + _AGED

SQL: dict[str, str] = {
    # booklet pages: one question page per document, an answer page for most, a continuation for some
    "pages_q": f"""SELECT set_id, 'q' AS kind, item AS page_number, doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Exam Section: Item ' || item || ' of 500' || chr(10) END
      || 'Time Remaining: 1 hr 02 min 33 sec' || chr(10) || 'Lab Values' || chr(10) || {_STEM} || chr(10) || 'Which of the following is the most likely diagnosis?' {'|| ' + _CHOICES}
      || chr(10) || 'Previous' || chr(10) || 'Next' AS text FROM ({_NUMBERED}) n""",
    "pages_a": f"""SELECT set_id, 'a' AS kind, CAST(2 * item AS INTEGER) AS page_number, doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Exam Section: Item ' || item || ' of 500' || chr(10) END
      || CASE WHEN doc_id % 7 = 0 THEN '' ELSE item || '. ' END || {_AGED} || chr(10) || 'Correct Answer: ' || chr(CAST(65 + doc_id % 5 AS INTEGER)) || '.' || chr(10) || 'The findings show that ' || item || ' is best.' || chr(10) || 'Score Report' AS text
      FROM ({_NUMBERED}) n WHERE doc_id % 11 <> 0
      UNION ALL SELECT set_id, 'a' AS kind, CAST(2 * item + 1 AS INTEGER) AS page_number, doc_id, 'Educational Objective: ' || text || ' It is followed by rest and by a second visit after some weeks, when tests are done again.' AS text
      FROM ({_NUMBERED}) n WHERE doc_id % 11 <> 0 AND doc_id % 5 = 0""",
    "files": "SELECT p_partkey AS file_id, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'Form ' || CAST(floor(p_partkey / 6) AS BIGINT) || ' Questions.pdf' WHEN 1 THEN CAST(floor(p_partkey / 4) AS BIGINT) || '_Q.PDF' ELSE 'form-' || CAST(floor(p_partkey / 9) AS BIGINT) || ' q.pdf' END AS name FROM part",
    "answer_files": "SELECT p_partkey AS file_id, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'form ' || CAST(floor(p_partkey / 6) AS BIGINT) || ' answers.pdf' WHEN 1 THEN CAST(floor(p_partkey / 5) AS BIGINT) || ' A.pdf' ELSE 'Set ' || CAST(floor(p_partkey / 8) AS BIGINT) || ' Explanations.pdf' END AS name FROM part WHERE p_partkey % 4 <> 3",
    # answer drafts of conversations: a page per turn, anchored where the user speaks
    "turns": "SELECT conv_id AS set_id, CAST(turn AS INTEGER) AS page_number, role, text FROM conversations",
    # attempt logs: a session per user, an item per key; views become phases, pauses and highlights
    "attempts": """SELECT event_id, user_id AS session_id, CAST(k AS BIGINT) AS item_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'purchase' THEN 'select' WHEN 'click' THEN 'strike' WHEN 'signup' THEN 'flag' WHEN 'error' THEN 'note'
      ELSE CASE event_id % 5 WHEN 0 THEN 'phase' WHEN 1 THEN 'pause' WHEN 2 THEN 'resume' ELSE 'highlight' END END AS action,
      CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'exam' WHEN 1 THEN 'examReview' WHEN 2 THEN 'endConfirm' ELSE 'review' END ELSE chr(CAST(65 + floor(value) % 5 AS INTEGER)) END AS label,
      CASE WHEN event_id % 3 = 0 THEN '  ' ELSE 'note ' || event_id END AS text FROM events_k""",
    # one item per order, a hundred a set; a session takes the set of its number
    "bank": """SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS set_id, o_orderkey % 100 AS item_id, o_orderkey % 100 + 1 AS question_number, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE chr(CAST(65 + o_orderkey % 5 AS INTEGER)) END AS key,
      ' Order' || chr(9) || chr(9) || o_orderkey || ' of a ' || o_custkey || ' ' AS stem, 'because ' || o_custkey AS explanation FROM orders""",
    "spans": "SELECT l_orderkey AS item_id, l_linenumber AS h_id, CAST(l_partkey % 90 AS INTEGER) AS start, CAST(l_partkey % 90 + 1 + l_quantity AS INTEGER) AS stop FROM lineitem",
    "lengths": "SELECT o_orderkey AS item_id, CAST(40 + o_custkey % 60 AS INTEGER) AS length FROM orders",
    "segments": "SELECT DISTINCT l_orderkey AS item_id, l_linenumber AS seg, CAST(30 * (l_linenumber - 1) AS INTEGER) AS seg_start, 25 AS seg_length FROM lineitem",
    "labs": """SELECT l_orderkey AS panel_id, l_linenumber AS pos, CASE l_partkey % 6 WHEN 0 THEN 'Hematocrit' WHEN 1 THEN 'Leukocyte count' WHEN 2 THEN 'Na+' WHEN 3 THEN 'Creatinine' WHEN 4 THEN 'ALT' ELSE 'Ferritin' END AS name,
      CAST(l_quantity AS INTEGER) || CASE l_partkey % 6 WHEN 0 THEN '%' WHEN 1 THEN '00/mm³' WHEN 2 THEN ' mEq/L' WHEN 3 THEN ' mg/dL' WHEN 4 THEN ' U/L' ELSE ' ng/mL' END AS value FROM lineitem""",
    # question pages with results: stacked, names before values, on one line, or with the values glued to the last choice
    "lab_pages": """SELECT panel_id AS page_number, 'Exam Section: Item ' || (panel_id % 300 + 1) || ' of 500' || chr(10) || 'Lab Values' || chr(10) || (panel_id % 300 + 1) || '. A ' || (20 + panel_id % 60) || '-year-old woman has had pain for ' || (1 + panel_id % 9) || ' days.' || chr(10) || 'Laboratory studies show:' || chr(10)
      || CASE form WHEN 0 THEN stacked WHEN 1 THEN names || chr(10) || values_down WHEN 2 THEN packed ELSE names END
      || CASE WHEN panel_id % 3 = 0 THEN chr(10) || 'An x-ray of the chest shows congestion.' ELSE '' END || chr(10) || 'Which of the following is the most likely diagnosis?'
      || chr(10) || 'A) Arterial embolism' || chr(10) || 'B) Chronic gastritis' || chr(10) || 'C) Viral hepatitis' || chr(10) || 'D) Renal colic and pain' || chr(10) || 'E) No abnormality' || CASE WHEN form = 3 THEN ' ' || values_across ELSE '' END
      || chr(10) || 'Previous' || chr(10) || 'Next' AS text, form, cells, packed FROM lab_forms""",
    # blocks of results: names and values in turn; bare blood gases; lines of series; stems with and without results
    "gases": "SELECT l_orderkey AS panel_id, l_linenumber AS pos, CASE l_partkey % 5 WHEN 0 THEN '7.4' WHEN 1 THEN '38 mm Hg' WHEN 2 THEN '60 mm Hg' WHEN 3 THEN 'pH' ELSE '40 mm Hg' END AS token FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_partkey FROM lineitem)",
    "series": """SELECT l_orderkey AS panel_id, l_linenumber AS line_no, l_partkey % 4 AS kind, CASE l_partkey % 4 WHEN 0 THEN 'Months ago 1 2 3' WHEN 1 THEN 'Blood pressure 120/80 130/85 140/90 150/95' WHEN 2 THEN 'He feels well.' ELSE 'Pulse rate 60 70 80 90 100' END AS line
      FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_partkey FROM lineitem)""",
    "stem_lines": """SELECT l_orderkey AS item_id, l_linenumber AS line_no, l_partkey % 5 AS kind, CASE l_partkey % 5 WHEN 0 THEN 'Hematocrit' || chr(9) || '40%' WHEN 1 THEN 'Leukocyte count' WHEN 2 THEN CAST(l_quantity AS INTEGER) || ' mEq/L' WHEN 3 THEN 'The patient returns after ' || l_suppkey || ' days of rest.' ELSE 'She walks.' END AS line
      FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_partkey, min(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_quantity, min(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_suppkey FROM lineitem)""",
    "lab_lines": """SELECT l_orderkey AS panel_id, l_linenumber AS line_no, CASE l_partkey % 11 WHEN 0 THEN 'Serum' WHEN 1 THEN 'Na*' WHEN 2 THEN CAST(l_quantity AS INTEGER) || ',mEq/L' WHEN 3 THEN 'HCO 3 -' WHEN 4 THEN 'Leukocyte  count'
      WHEN 5 THEN '4.2 million / mm 3' WHEN 6 THEN 'which of the following is next?' WHEN 7 THEN 'Day' || l_suppkey WHEN 8 THEN 'An x-ray shows ' || l_suppkey WHEN 9 THEN '1-2/hpf' ELSE 'Hemoglobin A 1c' END AS line FROM lineitem""",
}
#: Keys of events; the two engines read JSON differently.
EVENTS_K = {"spark": "SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "duck": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"}


#: Results of each panel as text in order, percentages last; a panel of percentages alone has no values on its choices.
_JOINED = {"spark": "array_join(transform(array_sort(collect_list(struct(pct, pos, {0} AS v))), x -> x.v), {1})", "duck": "string_agg({0}, {1} ORDER BY pct, pos)"}
LAB_FORMS = {
    engine: f"""SELECT panel_id, CASE WHEN panel_id % 4 = 3 AND min(pct) = 1 THEN 0 ELSE panel_id % 4 END AS form, {joined.format("name", "chr(10)")} AS names, {joined.format("value", "chr(10)")} AS values_down, {joined.format("value", "' '")} AS values_across,
      {joined.format("name || chr(10) || value", "chr(10)")} AS stacked, {joined.format("name || ' ' || value", "' '")} AS packed, {joined.format("name || chr(9) || value", "chr(10)")} AS cells
      FROM (SELECT panel_id, pos, split_part(nv, '|', 1) AS name, split_part(nv, '|', 2) AS value, CASE WHEN right(nv, 1) = '%' THEN 1 ELSE 0 END AS pct
        FROM (SELECT panel_id, pos, min(name || '|' || value) AS nv FROM ({SQL["labs"]}) l GROUP BY panel_id, pos) m) o GROUP BY panel_id"""
    for engine, joined in _JOINED.items()
}


def numbered(documents: DataFrame) -> DataFrame:
    """What _NUMBERED says, without bringing a source's texts to one task: counts of ids are summed up source by source (a narrow
    table), and texts meet the number before theirs where (source, id) is dealt. Rows of one id go by their text."""
    rows = documents.select(F.struct("source", "doc_id").alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    past = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = documents.groupBy("source", "doc_id").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("at").orderBy("text"))
    out = rows.join(ids.select(F.struct("source", "doc_id").alias("at"), "before").hint("shuffle_hash"), "at")
    return out.select("at.doc_id", F.col("at.source").alias("set_id"), (F.col("before") + own).cast("int").alias("item"), "text")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the tables in sf_dir."""
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    spark.sql(EVENTS_K["spark"]).createOrReplaceTempView("events_k")
    if name == "lab_pages":
        spark.sql(LAB_FORMS["spark"]).createOrReplaceTempView("lab_forms")
    if f"({_NUMBERED})" not in SQL[name]:
        return spark.sql(SQL[name])
    numbered(spark.table("documents")).createOrReplaceTempView("numbered_documents")
    return spark.sql(SQL[name].replace(f"({_NUMBERED})", "numbered_documents"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over the session's shuffle partitions: parsing a page costs far more than moving it, and adaptive
    execution would merge small partitions into a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def duck(*names: str) -> str:
    """WITH clause that defines the derived tables for DuckDB."""
    parts = [f"events_k AS ({EVENTS_K['duck']})"] if "attempts" in names else []
    parts += [f"lab_forms AS ({LAB_FORMS['duck']})"] if "lab_pages" in names else []
    return "WITH " + ", ".join(parts + [f"{n} AS ({SQL[n]})" for n in names]) + " "
