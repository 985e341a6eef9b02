"""Laboratory blocks: tokens, names with values, panels, series, segments of a stem.

Tokens: panel_id, pos, token (normalised). Null tokens are dropped; panels do not meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lab_blocks import COLUMN_HEAD, SERIES_NAME, column_label, cut_series, format_labs, is_panel_section, lab_tokens, pair_tokens  # noqa: F401
from ..functions.labs import NAMES, compact, is_name, is_section, is_value, line_class, normalize_token
from ..functions.rules import has, once, sub, trim

SERIES_VALUE = r"(?:\d+(?:\.\d+)?|\d{2,3}/\d{2,3})"
SERIES_LINE = rf"^\s*(\D\S*(?:\s+\D\S*)*?)\s+({SERIES_VALUE}(?:\s+{SERIES_VALUE}){{2,}})\s*$"
UNIT_NEAR = r"(?i)(?:mEq/L|mg/dL|g/dL|/mm³|/hpf|mm Hg|µm³)"
ASKS = r"(?i)which of the following|intravenous infusion of which"
QUESTION = r"(?is)^(.*?)\s+((?:intravenous infusion of )?which of the following.*)\z"
ROW = "array<struct<kind:string,name:string,cells:array<string>>>"


def canonical_names(tokens: DataFrame) -> DataFrame:
    """tokens with name: the listed spelling, blanks, hyphens and case aside, else the token as it is. The list is a fixed
    dimension and is broadcast."""
    spark = tokens.sparkSession
    first: dict[str, str] = {}
    for name in NAMES:
        first.setdefault("".join(name.split()).replace("-", "").lower(), name)
    dim = spark.createDataFrame(list(first.items()), "compact string, listed string")
    return tokens.withColumn("compact", compact(F.col("token"))).join(F.broadcast(dim), "compact", "left").withColumn("name", F.coalesce("listed", "token")).drop("compact", "listed")


def classed(tokens: DataFrame) -> DataFrame:
    return tokens.where("token is not null").withColumn("kind", line_class(F.col("token")))


def label_abg(tokens: DataFrame) -> DataFrame:
    """tokens with label: pH, Pco2, Po2 for a bare triple of a 6–8.x value and two in mm Hg, not already behind a pH."""
    by = Window.partitionBy("panel_id").orderBy("pos")
    at = lambda k: F.lead("token", k).over(by)
    starts = is_value(F.col("token")) & has(F.col("token"), r"^[6-8]\.\d+") & has(at(1), "(?i)mm Hg") & has(at(2), "(?i)mm Hg") & ~F.coalesce(has(F.lag("token").over(by), r"(?i)^pH\z"), F.lit(False))
    rows = tokens.where("token is not null").withColumn("starts", F.coalesce(starts, F.lit(False)))
    back = lambda k: F.coalesce(F.lag("starts", k).over(by), F.lit(False))
    return rows.withColumn("label", F.when(F.col("starts"), "pH").when(back(1), "Pco2").when(back(2), "Po2")).drop("starts")


def two_column_panel(tokens: DataFrame) -> DataFrame:
    """panel_id, place, kind, name, first, second of panels with two column heads ("On admission" / "Now", "Day n"): the heads
    at place 0 (kind header), then names in their order with the values of the same rank in both columns (kind row), and the
    sections between them (kind section). Names stand before the first head, the columns behind the two."""
    rows = tokens.where("token is not null").withColumn("head", has(F.col("token"), COLUMN_HEAD))
    by = Window.partitionBy("panel_id").orderBy("pos")
    past = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.least(F.sum(F.col("head").cast("int")).over(past), F.lit(2)))
    rows = rows.withColumn("section", ~F.col("head") & (F.col("part") == 0) & is_panel_section(F.col("token")))
    body = rows.where("not head").withColumn("place", F.row_number().over(Window.partitionBy("panel_id", "part").orderBy("pos")))
    ranked = body.where("not section").withColumn("rank", F.row_number().over(Window.partitionBy("panel_id", "part").orderBy("pos")))
    enough = ranked.groupBy("panel_id").agg(*[F.count_if(F.col("part") == k).alias(f"n{k}") for k in range(3)]).where("n0 >= 2 and n1 >= 2 and n2 >= 2").select("panel_id")
    column = lambda k, name: ranked.where(F.col("part") == k).select("panel_id", "rank", F.col("token").alias(name))
    named = ranked.where("part = 0").select("panel_id", "place", "rank", F.lit("row").alias("kind"), F.col("token").alias("name"))
    named = named.join(column(1, "first"), ["panel_id", "rank"], "left").join(column(2, "second"), ["panel_id", "rank"], "left").drop("rank")
    sections = body.where("section").select("panel_id", "place", F.lit("section").alias("kind"), sub(F.col("token"), [(r":\z", "")]).alias("name"))
    heads = rows.where("head").withColumn("k", F.row_number().over(by)).groupBy("panel_id").agg(*[F.max(F.when(F.col("k") == k, column_label(F.col("token")))).alias(n) for k, n in ((1, "first"), (2, "second"))])
    heads = heads.select("panel_id", F.lit(0).alias("place"), F.lit("header").alias("kind"), F.lit("").alias("name"), "first", "second")
    whole = named.unionByName(sections, allowMissingColumns=True).unionByName(heads)
    return whole.join(enough, "panel_id", "left_semi").select("panel_id", "place", "kind", "name", "first", "second")


def series_tables(lines: DataFrame) -> DataFrame:
    """lines(panel_id, line_no, line) with line formatted as cells where two or more adjacent lines hold a name and three or
    more values, in numbers that differ by one at most from the line before, one name being that of a series."""
    by = Window.partitionBy("panel_id").orderBy("line_no")
    rows = lines.withColumns({"name": F.regexp_extract("line", SERIES_LINE, 1), "vals": F.split(F.regexp_extract("line", SERIES_LINE, 2), r"\s+")})
    rows = rows.withColumn("n", F.when(F.col("name") != "", F.size("vals")))
    breaks = F.coalesce(F.abs(F.col("n") - F.lag("n").over(by)) > 1, F.lit(True))
    rows = rows.withColumn("table", F.sum(breaks.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("panel_id", "table")
    tabular = (F.count("n").over(whole) >= 2) & F.max(has(F.col("name"), SERIES_NAME).cast("int")).over(whole).cast("boolean") & F.col("n").isNotNull()
    return rows.withColumn("line", F.when(tabular, F.concat_ws("\t", F.col("name"), F.array_join("vals", "\t"))).otherwise(F.col("line"))).select("panel_id", "line_no", "line")


def is_cluster_line(line: Column) -> Column:
    tab = F.contains(line, F.lit("\t"))
    kind = once(normalize_token(line), line_class)
    inside = tab | kind.isin("section", "name", "value") | ((F.length(trim(line)) < 90) & has(line, UNIT_NEAR))
    return (trim(line) != "") & ~(has(line, ASKS) & ~tab) & inside


def table_row(line: Column) -> Column:
    """struct(kind, name, cells) of a laboratory line: header (cells without a name), section, or row."""
    bare = trim(sub(F.concat(F.lit(" "), line), [(r"(?is)[ \n]+(?:intravenous infusion of )?which of the following.*\z", "")]))
    row = lambda kind, name, cells: F.struct(F.lit(kind).alias("kind"), name.alias("name"), cells.alias("cells")).cast(ROW[6:-1])
    cells = F.transform(F.split(sub(line, [(r"(?is)\s+(?:intravenous infusion of )?which of the following.*\z", "")]), "\t"), trim)
    tabbed = once(cells, lambda c: once(F.slice(c, F.lit(2), F.size(c)), lambda rest: F.when((F.get(c, 0) == "") & F.exists(rest, lambda x: x != ""), row("header", F.lit(""), rest)).otherwise(row("row", F.get(c, 0), rest))))
    alone = once(bare, lambda b: once(normalize_token(b), lambda t: F.when(is_section(t), row("section", b, F.array())).when(is_value(t), row("row", F.lit(""), F.array(b))).otherwise(row("row", b, F.array()))))
    return F.when(F.contains(line, F.lit("\t")), tabbed).otherwise(alone)


def stem_lines(stem: Column) -> Column:
    """Lines of a stem; a question that stands on the line of a result is a line of its own."""

    def parted(line: Column) -> Column:
        result = once(trim(F.regexp_extract(line, QUESTION, 1)), lambda l: (l != "") & (F.contains(F.regexp_extract(line, QUESTION, 1), F.lit("\t")) | once(normalize_token(l), lambda t: is_name(t) | is_value(t))))
        return F.when(has(line, QUESTION) & result, F.array(trim(F.regexp_extract(line, QUESTION, 1)), trim(F.regexp_extract(line, QUESTION, 2)))).otherwise(F.array(line))

    return F.flatten(F.transform(F.split(stem, "\n"), parted))


def stem_segments(stems: DataFrame) -> DataFrame:
    """stems(item_id, stem) to item_id, seg, kind (labs or text), seg_start, text, rows: runs of laboratory lines, at least two
    or with a tab, apart from prose. Offsets are those of characters in the stem. `rows` has the lines of a laboratory segment
    as header, section and row records with their cells; null for text."""
    rows = stems.select("item_id", F.posexplode(stem_lines(F.col("stem"))).alias("at", "line")).withColumn("lab", is_cluster_line(F.col("line")))
    by = Window.partitionBy("item_id").orderBy("at")
    past = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("offset", F.sum(F.length("line") + 1).over(past) - F.length("line") - 1)
    rows = rows.withColumn("run", F.sum((F.col("lab") != F.coalesce(F.lag("lab").over(by), ~F.col("lab"))).cast("int")).over(past))
    run = Window.partitionBy("item_id", "run")
    rows = rows.withColumn("labs", F.col("lab") & ((F.count("*").over(run) >= 2) | F.max(F.contains(F.col("line"), F.lit("\t")).cast("int")).over(run).cast("boolean")))
    rows = rows.withColumn("seg", F.sum((F.col("labs") != F.coalesce(F.lag("labs").over(by), ~F.col("labs"))).cast("int")).over(past))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    out = rows.groupBy("item_id", "seg").agg(F.when(F.bool_or("labs"), "labs").otherwise("text").alias("kind"), F.min("offset").alias("seg_start"), lines.alias("lines"))
    out = out.select("item_id", "seg", "kind", "seg_start", F.array_join("lines", "\n").alias("text"), F.when(F.col("kind") == "labs", F.transform("lines", table_row)).alias("rows"))
    return out.where("kind = 'labs' or text <> ''").withColumn("seg", F.row_number().over(Window.partitionBy("item_id").orderBy("seg_start", "seg")))
