"""Lines from positioned text items, and searches over them. Items: set_id, page_number, seq, str, x, y, width, height, has_eol.

A page is ordered by lines downwards and x inside: items belong to a line as long as each lies within SAME_LINE of the one
above it (islands of y). Null strings are dropped, null places count as 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import BUBBLE
from ..functions.rules import has

SAME_LINE, LINE_GAP, COLUMN_GAP, LEAST_SPACE, TINY = 2.0, 3.5, 36.0, 0.9, 1.6
CHOICE_START = rf"^(?:[{BUBBLE}]\s*)?[A-Pa-p]\s*[).]"
KEYS = ("set_id", "page_number")


def assemble_lines(items: DataFrame) -> DataFrame:
    """set_id, page_number, line_no, line. A line ends at a jump in y, after has_eol, and before a choice marker far to the
    right; a gap wider than a fraction of letter size is a space; a digit raised behind /mm belongs to its unit."""
    down = Window.partitionBy(*KEYS).orderBy(F.desc("y"), "seq")
    page = Window.partitionBy(*KEYS).orderBy("island", "x", "seq")
    blank = has(F.col("str"), r"^\s+\z")
    rows = items.where("coalesce(str, '') <> ''").withColumns({"x": F.coalesce("x", F.lit(0.0)), "y": F.coalesce("y", F.lit(0.0))})
    below = (F.lag("y").over(down) - F.col("y") > SAME_LINE).cast("int")
    rows = rows.withColumn("below", F.coalesce(below, F.lit(0))).withColumn("island", F.sum("below").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"blank": blank, "h": F.coalesce("height", F.lit(0.0)), "w": F.coalesce("width", F.lit(0.0)), "eol": F.coalesce("has_eol", F.lit(False))})
    wide_blank = F.lag(F.col("blank") & (F.col("w") >= TINY)).over(page)
    rows = rows.withColumns({"blank_before": F.coalesce(wide_blank, F.lit(False)), "eol_before": F.coalesce(F.lag("eol").over(page), F.lit(False))}).where("not blank")
    back = lambda c: F.lag(c).over(page)
    rows = rows.withColumns({"py": back("y"), "px": back("x"), "pw": back("w"), "ph": back("h"), "ps": back("str")})
    so_far = F.concat_ws("", *[F.when(~F.coalesce(F.lag("eol", k - 1).over(page) if k > 1 else F.lit(False), F.lit(False)), F.lag("str", k).over(page)) for k in (3, 2, 1)])
    raised = F.col("py").isNotNull() & has(F.col("str"), r"^[0-9]\z") & has(so_far, r"(?i)/mm\s*\z") & (F.abs(F.col("y") - F.col("py")) < 14) & ~F.col("eol_before")
    column = (F.col("x") - F.col("px") > COLUMN_GAP) & has(F.trim(F.col("str")), CHOICE_START)
    # A raised digit does not move its line: what follows is held against the y before it.
    rows = rows.withColumn("raised", F.coalesce(raised, F.lit(False))).withColumn("line_y", F.when(F.col("raised"), F.col("py")).otherwise(F.col("y")))
    rows = rows.withColumn("py", back("line_y"))
    jump = F.abs(F.col("y") - F.col("py")) > LINE_GAP
    rows = rows.withColumn("starts", F.coalesce(F.col("py").isNull() | F.col("eol_before") | (~F.col("raised") & (jump | column)), F.lit(True)))
    letters = F.greatest(F.length(F.regexp_replace("ps", r"\s+", "")), F.lit(1))
    em = F.when(F.col("ph") > 0, F.col("ph")).when(F.col("h") > 0, F.col("h")).otherwise(12.0)
    gap = F.col("x") - (F.col("px") + F.col("pw"))
    apart = ~F.endswith(F.col("ps"), F.lit(" ")) & ~F.startswith(F.col("str"), F.lit(" ")) & (F.col("blank_before") | (gap > F.greatest(em * 0.08, F.col("pw") / letters * 0.2, F.lit(LEAST_SPACE))))
    piece = F.when(F.col("starts"), F.col("str")).when(F.col("raised"), F.when(F.col("str") == "3", "³").otherwise(F.col("str"))).when(apart, F.concat(F.lit(" "), F.col("str"))).otherwise(F.col("str"))
    rows = rows.withColumns({"line_no": F.sum(F.col("starts").cast("int")).over(page), "place": F.row_number().over(page), "piece": piece})
    return rows.groupBy(*KEYS, "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "").alias("line"))


def page_texts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def term_hits(items: DataFrame, term: str) -> DataFrame:
    """A row per item that holds the term, case aside: set_id, page_number, seq, and its box (left, baseline, width, height;
    five points a letter and ten high where the item has no size)."""
    hits = items.where(F.instr(F.lower("str"), term.strip().lower()) > 0) if term.strip() else items.where("false")
    return hits.select(*KEYS, "seq", F.col("x").alias("left"), F.col("y").alias("baseline"), F.coalesce("width", F.length("str") * 5.0).alias("width"), F.coalesce("height", F.lit(10.0)).alias("height"))


def term_search(items: DataFrame, term: str) -> DataFrame:
    """Per page the number of hits of a term, the first by seq, and its box."""
    first = F.min_by(F.struct("left", "baseline", "width", "height"), "seq")
    found = term_hits(items, term).groupBy(*KEYS).agg(F.count("*").alias("hits"), F.min("seq").alias("first_seq"), first.alias("box"))
    return found.select(*KEYS, "hits", "first_seq", "box.*")
