"""Registered queries over page texts: normalisation, classifiers, field extraction. Each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labs as L
from ..functions import patterns as P
from ..functions import predicates as C
from ..functions import text as T
from ..functions.choices import label_votes, marked_choices, pad_choices, release, stem_before
from ..functions.glyph import collapse_broken_spaces, spaced_glyphs
from ..functions.rules import duck_first, duck_has, duck_letters, duck_sub, duck_trim, quoted
from ..sources.derive import derived, duck, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PAGES_SQL = duck("pages_q", "pages_a") + ", pages_qa AS (SELECT set_id, kind, page_number, text FROM pages_q UNION ALL SELECT set_id, kind, page_number, text FROM pages_a) "


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("set_id", "kind", "page_number", "text")
    return spread(derived(spark, sf_dir, "pages_q").select(*columns).unionByName(derived(spark, sf_dir, "pages_a").select(*columns)), *columns[:3])


def on_pages(name: str, use: Callable[[Column], Column], sql: str | None = None, table: str = "pages_qa", before: str = "") -> None:
    """Register use(text) over all pages, with sql as the expression over `text` (and CTEs in before)."""
    QUERIES[name] = lambda spark, sf_dir: pages(spark, sf_dir).select("set_id", "kind", "page_number", use(F.col("text")).alias("result"))
    if sql:
        ORACLES[name] = f"{PAGES_SQL}{before} SELECT set_id, kind, page_number, {sql} AS result FROM {table}"


def on_documents(name: str, use: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", use(F.col("text")).alias("result"))

    QUERIES[name], ORACLES[name] = run, f"SELECT doc_id, {sql} AS result FROM documents"


# --- normalisation
CLEAN = duck_trim(duck_sub("text", P.CLEAN))


def duck_chrome(t: str) -> str:
    tests = [duck_has(t, p) for p in [P.CHROME, *P.DROPPED_LINES]] + [f"({duck_has(t, a)} AND {duck_has(t, b)})" for a, b in P.DROPPED_PAIRS] + [f"({duck_has(t, P.SERIES_NAME)} AND length({t}) < {P.SERIES_LINE_BELOW})"]
    return "(" + " OR ".join(tests) + ")"


def duck_strip_chrome(text: str) -> str:
    line = duck_trim("l")
    kept = f"list_filter(string_split({text}, chr(10)), lambda l: {line} = '' OR NOT {duck_chrome(line)})"
    return duck_trim(duck_sub(f"coalesce(array_to_string({kept}, chr(10)), '')", T.BLANKS))


def duck_cut(text: str) -> str:
    return duck_trim(duck_sub(f"coalesce({text}, '')", [(P.EXPLANATION_CUT, "")]))


def duck_words(text: str, keep: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: {keep})"


TELLING = "(length(w) > 2 OR regexp_matches(w, '^[0-9]{2,}$'))"
STRIPPED = f", stripped AS (SELECT *, {duck_strip_chrome('text')} AS c FROM pages_qa) "

on_pages("clean_page_text", lambda t: T.clean_page_text(t, collapse=False), CLEAN)
on_pages("strip_chrome", T.strip_chrome, duck_strip_chrome("text"))
on_pages("fix_typographics", T.fix_typographics, duck_sub("text", P.TYPOGRAPHICS))
on_pages("strip_explanation", T.strip_explanation, duck_cut("text"))
on_pages("strip_footer", T.strip_footer)
on_pages("strip_leading", T.strip_leading)
on_pages("strip_diagram", T.strip_diagram)
on_pages("unwrap_prose", T.unwrap_prose)
on_pages("polish_stem", T.polish_stem)
on_pages("collapse_glyphs", collapse_broken_spaces)
on_pages("extract_explanation", T.extract_explanation)


def split_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("set_id", "kind", "page_number", T.split_prompt(F.col("text")).alias("s")).select("set_id", "kind", "page_number", "s.lead", "s.prompt")


_ASKS = duck_has("text", P.PROMPT)
QUERIES["split_prompt"] = split_prompt
ORACLES["split_prompt"] = (
    f"{PAGES_SQL} SELECT set_id, kind, page_number, CASE WHEN {_ASKS} THEN {duck_trim(duck_sub('text', [(P.PROMPT, '')]))} ELSE text END AS lead, "
    f"CASE WHEN {_ASKS} THEN {duck_trim(f'regexp_extract(text, {quoted(P.PROMPT)}, 1)')} ELSE '' END AS prompt FROM pages_qa"
)
on_documents("tokens_content", lambda t: F.array_join(T.content_words(t), " "), f"array_to_string({duck_words(duck_cut('text'), TELLING)}, ' ')")
on_documents("tokens_visual", lambda t: F.array_join(T.visual_tokens(t), " "), f"array_to_string({duck_words('text', 'length(w) > 1')}, ' ')")
_VIGNETTE = duck_sub(duck_cut("text"), [("(?is)which of the following.*$", "")])
on_documents("vignette_fingerprint", T.vignette_fingerprint, f"array_to_string(({duck_words(_VIGNETTE, TELLING)})[1:12], ' ')")
on_documents("text_quality", T.text_quality, duck_letters(CLEAN))

# --- classifiers
KEPT = "[" + ", ".join(f"'{w}'" for w in P.KEEP_WORDS) + "]"


def duck_glyphs(text: str) -> str:
    kept = lambda w: f"list_contains({KEPT}, lower({w}))"
    both = f"len(list_filter(regexp_extract_all({text}, {quoted(r'\b([A-Za-z]{2,5}) ([a-z]{3,7})\b')}, 0), lambda x: NOT {kept("string_split(x, ' ')[1]")} AND NOT {kept("string_split(x, ' ')[2]")}))"
    left = f"len(list_filter(regexp_extract_all({text}, {quoted(r'\b([A-Za-z]{4,8}) ([a-z])\b')}, 1), lambda x: NOT {kept('x')}))"
    tokens = f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: regexp_matches(x, '^[A-Za-z]{{2,}}$'))"
    odd = f"len(list_filter({tokens}, lambda x: length(x) <= 3 AND NOT {kept('x')}))"
    return f"(({both}) + ({left}) >= 2 OR (len({tokens}) >= 8 AND {odd} >= 0.12 * len({tokens})))"


on_pages("spaced_glyph_flag", spaced_glyphs, duck_glyphs("text"))
on_pages("needs_ocr", C.needs_reading_again, f"({duck_letters('c')} < 80 OR {duck_glyphs('c')})", "stripped", STRIPPED)
_COMPACT = duck_trim("regexp_replace(c, '\\s+', ' ', 'g')")
on_pages(
    "is_cover_page", C.is_cover_page,
    f"""CASE WHEN length(k) < 40 OR ({duck_has('k', '(?i)^internal medicine cms')} AND length(k) < 80) OR ({duck_has('c', r'(?i)system:\s+')} AND {duck_has('c', r':\s*\d')} AND NOT {duck_has('c', '(?i)which of the following')}) THEN true
    WHEN (({duck_has('c', P.ITEM_HEADER)} OR {duck_has('c', P.NUMBERED_STEM)}) AND {duck_has('c', '[A-P][).]')}) OR {duck_has('c', r'(?i)correct\s*answer')} OR {duck_has('c', '(?i)educational objective')} THEN false
    ELSE length(k) < 120 AND NOT {duck_has('c', '[A-J][).]')} END""",
    "(SELECT *, " + _COMPACT + " AS k FROM stripped)", STRIPPED,
)
on_pages("needs_figure", C.needs_figure, duck_has("text", P.FIGURE))
on_pages("explanation_leak", C.explanation_leak, f"({duck_has('text', '(?i)' + P.EXPLANATION_START)} OR {duck_has('text', P.LEAK_PHRASE)})")

# --- fields
on_pages("extract_item", T.item_number, "coalesce(" + ", ".join(f"TRY_CAST({duck_first('text', p)} AS INTEGER)" for p in (P.ITEM_HEADER, P.NUMBERED_STEM, P.LOOSE_ITEM)) + ")")
on_pages("extract_key", T.key_of, "upper(coalesce(" + ", ".join(duck_first("text", p) for p in P.CORRECT) + "))")


def label_style_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("set_id", "kind", "page_number", label_votes(F.col("text")).alias("v")).select("set_id", "kind", "page_number", "v.paren", "v.dot")


QUERIES["label_style_vote"] = label_style_vote
_votes = lambda p: f"len(list_distinct(list_transform(regexp_extract_all(text, {quoted(p)}, 1), lambda x: upper(x))))"
ORACLES["label_style_vote"] = f"{PAGES_SQL} SELECT set_id, kind, page_number, {_votes(P.CHOICE_PAREN)} AS paren, {_votes(P.CHOICE_DOT)} AS dot FROM pages_qa"


# --- choices: the five of each question page, read back from its text
CHOICES_SQL = r"""regexp_extract_all(text, '\n([A-E])\) ([^\n]*)', 1) AS labels, regexp_extract_all(text, '\n([A-E])\) ([^\n]*)', 2) AS texts"""
BANK = PAGES_SQL + f", q AS (SELECT set_id, page_number, doc_id, text, {CHOICES_SQL} FROM pages_q) "


def page_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id, page_number, doc_id, stem, choices as split_choices reads them; the stem costs nothing where it is not used."""
    rows = spread(derived(spark, sf_dir, "pages_q"), "set_id", "page_number").select("set_id", "page_number", "doc_id", marked_choices(F.col("text")).alias("s"))
    return rows.select("set_id", "page_number", "doc_id", release(stem_before(F.col("s"))).alias("stem"), F.transform("s.choices", lambda c: F.struct(c["label"], release(F.split(c["text"], "\n")[0]).alias("text"))).alias("choices"))


def listed(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c: F.concat(c["label"], F.lit(") "), c["text"])), "|")


_LISTED = "array_to_string(list_transform(list_zip(labels, texts), lambda x: x[1] || ') ' || x[2]), '|')"


def split_choices_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_choices(spark, sf_dir).select("set_id", "page_number", listed(F.col("choices")).alias("choices"))


QUERIES["split_choices"] = split_choices_query
ORACLES["split_choices"] = f"{BANK} SELECT set_id, page_number, {_LISTED} AS choices FROM q"


def pad_choices_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.filter("choices", lambda c: F.ascii(c["label"]) % 5 != F.col("doc_id") % 5)
    return page_choices(spark, sf_dir).select("set_id", "page_number", listed(pad_choices(some, F.when(F.col("doc_id") % 2 == 0, "E").otherwise("F"))).alias("choices"))


QUERIES["pad_choices"] = pad_choices_query
ORACLES["pad_choices"] = (
    f"{BANK} SELECT set_id, page_number, array_to_string(list_transform(CASE WHEN doc_id % 2 = 0 THEN ['A', 'B', 'C', 'D', 'E'] ELSE ['A', 'B', 'C', 'D', 'E', 'F'] END, "
    "lambda l: l || ') ' || CASE WHEN ascii(l) % 5 = doc_id % 5 THEN '' ELSE coalesce(texts[list_position(labels, l)], '') END), '|') AS choices FROM q"
)


def choice_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_choices(spark, sf_dir)
    cut = rows.withColumn("cut", F.slice("choices", (F.col("doc_id") % 2 + 1).cast("int"), 5))
    return cut.select("set_id", "page_number", F.size(C.filled(F.col("cut"))).alias("n_filled"), C.well_formed(F.col("cut")).alias("well_formed"), C.complete_list(F.col("cut")).alias("complete"), C.choice_quality(F.col("cut")).alias("quality"))


QUERIES["choice_shape"] = choice_shape
ORACLES["choice_shape"] = (
    f"{BANK} SELECT set_id, page_number, len(list_filter(texts[1 + doc_id % 2:], lambda t: length(t) > 2)) AS n_filled, doc_id % 2 = 0 AS well_formed, doc_id % 2 = 0 AS complete, (5 - doc_id % 2) * 10 AS quality FROM q"
)


def needs_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_choices(spark, sf_dir).withColumn("choices", F.transform("choices", lambda c: F.struct(c["label"], F.when(F.col("doc_id") % 4 == 0, F.concat(c["text"], F.lit(" 120 mg"))).otherwise(c["text"]).alias("text"))))
    return rows.select("set_id", "page_number", C.needs_table(F.lit("Which of the following is next?"), F.col("choices")).alias("needs_table"))


QUERIES["needs_table"] = needs_table_query
ORACLES["needs_table"] = f"{BANK} SELECT set_id, page_number, doc_id % 4 = 0 AS needs_table FROM q"

# --- clocks, files
QUERIES["exam_clock"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select(
    "o_orderkey", T.exam_seconds(F.col("o_custkey") % 60).alias("seconds"), T.format_clock(T.exam_seconds(F.col("o_custkey") % 60)).alias("clock"), T.duration_minutes(F.col("o_custkey") % 60).alias("minutes")
)
ORACLES["exam_clock"] = """SELECT o_orderkey, s AS seconds, CASE WHEN s >= 3600 THEN (s // 3600) || ' hr ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ' min ' ELSE (s // 60) || ' min ' END || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' sec' AS clock,
 CASE WHEN n % 2 = 0 THEN CAST(n * 3 // 2 AS VARCHAR) ELSE printf('%.1f', n * 1.5::DOUBLE) END AS minutes FROM (SELECT o_orderkey, o_custkey % 60 AS n, 90 * (o_custkey % 60) AS s FROM orders)"""
_NAME = "trim(regexp_replace(regexp_replace(lower(regexp_replace(name, '(?i)\\.pdf\\z', '')), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
FILES_SQL = duck("files", "answer_files") + f", named AS (SELECT *, {_NAME} AS n FROM (SELECT *, 'q' AS side FROM files UNION ALL SELECT *, 'a' AS side FROM answer_files)) "
KEYED_SQL = FILES_SQL + f", keyed AS (SELECT *, coalesce(nullif(regexp_extract(b, '^(\\d+)', 1), ''), nullif(b, ''), n) AS pair_key FROM (SELECT *, trim({duck_sub('n', C.NAME_WORDS)}) AS b FROM named)) "


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "files").withColumn("side", F.lit("q")).unionByName(derived(spark, sf_dir, "answer_files").withColumn("side", F.lit("a")))


QUERIES["pairing_key"] = lambda spark, sf_dir: all_files(spark, sf_dir).select("file_id", "side", C.pairing_key(F.col("name")).alias("pair_key"))
ORACLES["pairing_key"] = f"{KEYED_SQL} SELECT file_id, side, pair_key FROM keyed"
QUERIES["classify_file"] = lambda spark, sf_dir: all_files(spark, sf_dir).select("file_id", "side", C.is_answer_file(F.col("name")).alias("is_answer"), C.is_question_file(F.col("name")).alias("is_question"))
_ANSWER = f"({duck_has('n', C.NAME_WORDS[0][0])} OR {duck_has('n', r'\d+\s*a\z')} OR ({duck_has('n', r'a\z')} AND NOT {duck_has('n', r'\bq\z')}))"
ORACLES["classify_file"] = f"{FILES_SQL} SELECT file_id, side, {_ANSWER} AS is_answer, NOT {_ANSWER} OR {duck_has('n', r'\bq\b')} AS is_question FROM named"

# --- laboratory lines
LAB_LINES = duck("lab_lines") + f", t AS (SELECT *, {L.duck_token('line')} AS token FROM lab_lines) "


def lab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(derived(spark, sf_dir, "lab_lines"), "panel_id", "line_no")


QUERIES["normalize_lab_token"] = lambda spark, sf_dir: lab_lines(spark, sf_dir).select("panel_id", "line_no", L.normalize_token(F.col("line")).alias("token"))
ORACLES["normalize_lab_token"] = f"{LAB_LINES} SELECT panel_id, line_no, token FROM t"
QUERIES["lab_line_class"] = lambda spark, sf_dir: lab_lines(spark, sf_dir).select("panel_id", "line_no", L.normalize_token(F.col("line")).alias("t")).select("panel_id", "line_no", L.line_class(F.col("t")).alias("kind"))
ORACLES["lab_line_class"] = f"{LAB_LINES} SELECT panel_id, line_no, {L.duck_class('token')} AS kind FROM t"
QUERIES["lab_unit_family"] = lambda spark, sf_dir: derived(spark, sf_dir, "labs").select(
    "panel_id", "pos", L.name_family(F.col("name")).alias("name_family"), L.value_family(F.col("value")).alias("value_family"), L.compatible(F.col("name"), F.col("value")).alias("compatible"), L.value_number(F.col("value")).alias("value_num")
)
_NF, _VF = L.duck_family("name", L.NAME_FAMILIES), L.duck_family("value", L.VALUE_FAMILIES)
ORACLES["lab_unit_family"] = f"{duck('labs')} SELECT panel_id, pos, {_NF} AS name_family, {_VF} AS value_family, coalesce(({_NF}) = ({_VF}), true) AS compatible, CAST(regexp_extract(value, '^[0-9]+') AS DOUBLE) AS value_num FROM labs"
