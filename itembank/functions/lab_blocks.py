"""Laboratory blocks inside a stem, as column expressions over one row: finding the block, scanning its lines, pairing names
with values, writing it as lines of cells, and keeping what is prose.

A line is scanned by one pattern whose alternatives stand in order of precedence and always consume something, so that one
regexp_extract_all reads it from left to right: section words, listed names, values, bare numbers, phrases of up to four
words that read like a name; any other word is passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labs import NAME, NAME_HINT, NAMES, SECTION, SHORT_NAME, STOP, VALUE, compact, compatible, is_section, is_value, line_class, normalize_token
from .rules import has, holds, once, per_session, settled, sub, trim

_END = r"(?=\s|\z)"
_STOPS = STOP.removeprefix("(?i)^")
_SECTION = SECTION.removeprefix("(?i)^").removesuffix(r":?\z")
_HINTS = NAME_HINT.removeprefix("(?i)")
_SHORT = "(?:" + SHORT_NAME.removeprefix("(?i)^(").removesuffix(r")\z") + ")"
_KNOWN = rf"(?>{NAME}(?=\s|\z|\d))"


def _phrase(k: int) -> str:
    """k words, none a question or a function word, one of which tells of a measurement."""
    more = rf"(?:\S+\s+){{0,{k - 1}}}"
    return rf"(?!{more}(?:is|are|of|the|and|with|for|to)\b)(?={more}?\S*?(?:{_HINTS}))(?:[^\s?]+\s+){{{k - 1}}}[^\s?]+{_END}"


_NAME_LINE = rf"(?:{_phrase(4)}|(?:{_phrase(3)}|{_phrase(2)}|{_phrase(1)}|{NAME}|{_SHORT})\s*\z)"
_AFTER_NAME = rf"(?=\s*(?:\z|{_KNOWN}|{VALUE}|{_SECTION}:?\s*\z|\d|{_NAME_LINE}))"
SCAN = (
    rf"(?i)[\s,;:/]*(?:0+{_END}|({_SECTION}(?=:?\s*\z)|{_KNOWN}{_AFTER_NAME}|(?:serum|urine|plasma|csf|complete blood count)\b(?=\s*(?:\z|{_SECTION}:?\s*\z|{VALUE}))|{VALUE}"
    rf"|\d+(?:\.\d+)?{_END}|{_phrase(4)}|{_phrase(3)}|{_phrase(2)}|{NAME}{_END}|{_phrase(1)}|{_SHORT}{_END})|\S+)"
)
# Wordings that open a block, and results that stick to choices.
_UNIT_IN_BRACKETS = (r"(?i)\s*\((?:mg/dl|g/dl|/hpf)\s*\)\s*", " ")
_ASKS = r"(?:intravenous infusion of )?which of the following"
_CUT_ASKS = r"(?is)(?:which of the following|intravenous infusion of which).*\z"
_STUDIES = (
    r"(?:(?:fasting\s+)?(?:serum|laboratory|blood|urine|plasma|csf)\s+studies\s+show|(?:results of\s+(?:serum|laboratory|blood)\s+studies(?:\s+show)?|laboratory findings(?:\s+show)?)"
    r"|(?:arterial\s+blood\s+gas.{0,90})\s+shows?|urinalysis\s+shows?|hemoglobin electrophoresis\s+shows?"
    r"|(?:cerebrospinal fluid|csf|synovial fluid|pleural fluid|peritoneal fluid)(?:\s+analysis)?\s+shows?)\s*:"
)
SHOWS = rf"(?is){_STUDIES}"
#: Any line that ends in "shows:", with the first line of text behind it.
ANY_SHOWS = r"(?i)([^\n]{2,90}shows?:)\s*(?:\n|\z)(?=\s*([^\n]*))"
NOT_A_BLOCK = r"(?i)examination shows|x-ray of|ultrasonography|gram stain|culture"
STILL_A_BLOCK = r"(?i)urinalysis|laboratory|serum|blood gas"
NAVIGATION = r"(?i)^(previous|next|help|pause|lab values)"
CHOICE_LINE = r"^(?:[O0○●□■Q]\s*)?[A-J][).]"
LAB_UNIT = r"(?i)/mm³|/hpf|mEq/L"
#: Names that a page break has glued to the end of a choice, before values or at its end.
_GLUED = r"(?:Protein|WBC|RBC|Hematocrit|Leukocyte count|Na\+|K\+|Cl-|HCO3-|Casts|Specific gravity)(?:\s+(?:Protein|WBC|RBC|Casts|Na\+|K\+|Cl-|HCO3-))*"
GLUED_NAMES = rf"(?i)\s({_GLUED})(?=\s+[\d.]|\s+[1-4]\+|\z)"
GLUED_AT_END = rf"(?i)\s({_GLUED})\z"
#: Values that a page break has glued to the end of a choice.
GLUED_VALUES = (
    r"(?is)\s((?:[\d.,]+\s*(?:mEq/L|mg/dL|g/dL|U/L|mm\s*Hg|/mm\s*3|/mm³|/hpf|/lpf|ng/mL|µm³)|(?:\d+\s*-\s*\d+\s*/(?:hpf|lpf))|(?:[1-4]\+\s+(?:[1-4]\+|trace|negative|none))"
    r"|(?:trace|none)\s+(?:trace|none|[1-4]\+)).*)\z"
)
LAST_PERCENT = r"^(.*?)\s+([\d.,]+\s*%)\z"
SALINE = r"0\.9\s*%"
COLUMN_HEAD = r"(?i)^(on admission|now|day\s*\d+)\z"
SERIES_NAME = r"(?i)months ago|weeks ago|days ago|hours ago|blood pressure|temperature|time\s*\("
_CELL = rf"(?:\(?(?:\d+(?:\.\d+)?|\d{{2,3}}/\d{{2,3}}|<?[\d.,]+(?:%|/mm³|/hpf|/lpf|/min)|[1-4]\+|1\.0\d{{2}}|negative|positive|trace|none|nonreactive|reactive)\)?{_END})"
_NO_CELL = rf"(?:(?!{_CELL})\S+\s+)"
#: One name and its values in a line of series; the first pattern goes on where the match before it ended.
SERIES_RUN = rf"(?i)\G\s*({_NO_CELL}+(?:{_CELL}\s*){{3,}})"
SERIES_ROW = rf"(?i)^\s*({_NO_CELL}+)((?:{_CELL}\s*){{3,}})\z"
ASKS_IN_NAME = r"(?i)which of the following|^[A-P][).]"

_STRINGS = "array<string>"
_ITEMS = "array<struct<kind:string,text:string>>"
_FIRST: dict[str, str] = {}
for _name in NAMES:
    _FIRST.setdefault("".join(_name.split()).replace("-", "").lower(), _name)


def none_yet() -> Column:
    return F.array().cast(_STRINGS)


def first_where(flags: Column) -> Column:
    """Index from 0 of the first true flag, null if there is none."""
    return F.nullif(F.array_position(flags, True), F.lit(0)).cast("int") - 1


def canonical_name(token: Column) -> Column:
    """The listed spelling of a name, blanks, hyphens and case aside; else the token as it is."""
    listed = F.create_map(*[F.lit(x) for pair in _FIRST.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, compact(token)), token)


def scan_line(line: Column) -> Column:
    """Tokens of one normalised line, in order: names (as listed), values, section words, bare numbers. A phrase that opens
    another part of the text ends the line."""
    rest = sub(line, [(_CUT_ASKS, ""), _UNIT_IN_BRACKETS, (rf"(?is)(?:^|(?<=[\s,;:/])){_STOPS}.*\z", "")])
    found = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(SCAN), F.lit(1)), trim), lambda t: t != "")
    return F.when(has(trim(rest), r"(?i)^[O0Q]?\z"), none_yet()).otherwise(F.transform(found, canonical_name))


def scan_text(text: Column) -> Column:
    """Tokens of all lines."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda l: once(normalize_token(l), scan_line)))


def block_lines(body: Column) -> Column:
    """array of struct(line, kind): the normalised lines of a block that are not empty, with their class (`labs.line_class`);
    `opens` for lines that are no result and open another part of the text."""
    lines = F.filter(F.transform(F.split(body, "\n"), normalize_token), lambda l: l != "")

    def read(line: Column) -> Column:
        kind = once(line_class(line), lambda k: F.when(has(line, STOP) & ~k.isin("value", "name"), "opens").otherwise(k))
        return F.struct(line.alias("line"), kind.alias("kind"))

    return F.transform(lines, read)


def tokens_of(lines: Column) -> Column:
    """Tokens of block_lines, up to the first that opens another part of the text."""
    kept = F.slice(lines, F.lit(1), F.coalesce(first_where(F.transform(lines, lambda l: (l["kind"] == "opens") & ~has(l["line"], NAVIGATION))), F.size(lines)))
    return F.flatten(F.transform(F.filter(kept, lambda l: ~has(l["line"], NAVIGATION)), lambda l: scan_line(l["line"])))


def lab_tokens(text: Column) -> Column:
    """Tokens of a block: line by line, up to its question or to a line that opens another part of the text."""
    return once(block_lines(sub(text, [(_CUT_ASKS, "")])), tokens_of)


def named_gases(tokens: Column) -> Column:
    """tokens with pH, Pco2 and Po2 before a bare triple of a 6–8.x value and two in mm Hg that no pH precedes."""

    def starts(t: Column, i: Column) -> Column:
        at = lambda k: F.coalesce(F.get(tokens, i + k), F.lit(""))
        return is_value(t) & has(t, r"^[6-8]\.\d+") & has(at(1), "(?i)mm Hg") & has(at(2), "(?i)mm Hg") & ~has(at(-1), r"(?i)^pH\z")

    def labelled(flags: Column) -> Column:
        at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
        name = lambda i: F.when(at(i), "pH").when(at(i - 1), "Pco2").when(at(i - 2), "Po2")
        return F.flatten(F.transform(tokens, lambda t, i: F.array_compact(F.array(name(i), t))))

    return F.when(F.exists(tokens, lambda t: has(t, "(?i)mm Hg")), once(F.transform(tokens, starts), labelled)).otherwise(tokens)


def _emit(pending: Column, values: Column) -> Column:
    """Headers as they are; each name takes the next compatible value after the one before."""
    kind = "struct<out:array<string>,left:array<string>>"

    def step(s: Column, item: Column) -> Column:
        def take(k: Column) -> Column:
            paired = F.struct(F.concat(s["out"], F.array(F.concat(item["text"], F.lit("\t"), F.get(s["left"], k)))).alias("out"), F.slice(s["left"], k + 2, F.size(s["left"]) + 1).alias("left")).cast(kind)
            return F.when((item["kind"] == "name") & (k >= 0), paired).otherwise(F.struct(F.concat(s["out"], F.array(item["text"])).alias("out"), s["left"].alias("left")).cast(kind))

        fits = F.transform(s["left"], lambda v: compatible(item["text"], v))
        return once((F.array_position(fits, True) - 1).cast("int"), take)

    start = F.struct(none_yet().alias("out"), values.alias("left")).cast(kind)
    return F.aggregate(pending, start, step, lambda s: s["out"])


def paired_runs(tokens: Column) -> Column:
    """`name<TAB>value` lines: runs of names meet the run of values behind them. Equal and compatible runs pair by place,
    others by the next compatible value; with one name or one value, a value takes the first compatible name, headers before
    the first waiting name are written, names that got none wait, and a value that fits none stands alone."""

    def kind_at(t: Column, i: Column) -> Column:
        heads = has(t, r"(?i)shows?:?\z") | (has(t, r"(?i)^protein\z") & has(F.coalesce(F.get(tokens, i + 1), F.lit("")), r"(?i)^(total|albumin)\z"))
        return F.struct(F.when(heads, "section").otherwise(line_class(t)).alias("kind"), t.alias("text"))

    kinds = F.transform(tokens, kind_at)
    kind = f"struct<out:array<string>,pending:{_ITEMS},values:array<string>>"
    texts = lambda items: F.transform(items, lambda p: p["text"])

    def state(out: Column, pending: Column, values: Column) -> Column:
        return F.struct(out.alias("out"), pending.alias("pending"), values.alias("values")).cast(kind)

    def singles(s: Column) -> Column:
        inner = f"struct<out:array<string>,pending:{_ITEMS}>"

        def step(t: Column, v: Column) -> Column:
            lead = F.coalesce(first_where(F.transform(t["pending"], lambda p: p["kind"] == "name")), F.size(t["pending"]))

            def after(n: Column) -> Column:
                heads, waiting = texts(F.slice(t["pending"], F.lit(1), n)), F.slice(t["pending"], n + 1, F.size(t["pending"]) + 1)

                def take(k: Column) -> Column:
                    rest = F.filter(F.transform(waiting, lambda p, i: F.when(i != k, p)), lambda p: p.isNotNull())
                    line = F.when(k >= 0, F.concat(F.get(waiting, k)["text"], F.lit("\t"), v)).otherwise(v)
                    return F.struct(F.concat(t["out"], heads, F.array(line)).alias("out"), rest.alias("pending")).cast(inner)

                return once((F.array_position(F.transform(waiting, lambda p: (p["kind"] == "name") & compatible(p["text"], v)), True) - 1).cast("int"), take)

            return once(lead, after)

        start = F.struct(s["out"].alias("out"), s["pending"].alias("pending")).cast(inner)
        return F.aggregate(s["values"], start, step, lambda t: state(t["out"], t["pending"], none_yet()))

    def settled(s: Column) -> Column:
        names = F.filter(s["pending"], lambda p: p["kind"] == "name")
        many = (F.size(names) >= 2) & (F.size(s["values"]) >= 2)
        return F.when(F.size(s["values"]) == 0, s).when(many, state(F.concat(s["out"], _emit(s["pending"], s["values"])), F.array().cast(_ITEMS), none_yet())).otherwise(singles(s))

    def step(s: Column, t: Column) -> Column:
        def add(u: Column) -> Column:
            item = F.struct(F.when(t["kind"] == "name", "name").otherwise("header").alias("kind"), trim(sub(t["text"], [(r":\z", "")])).alias("text"))
            return F.when(t["kind"].isin("name", "section"), state(u["out"], F.concat(u["pending"], F.array(item)), u["values"])).otherwise(u)

        value = state(s["out"], s["pending"], F.concat(s["values"], F.array(t["text"])))
        return F.when(t["kind"] == "value", value).otherwise(once(settled(s), add))

    start = state(none_yet(), F.array().cast(_ITEMS), none_yet())
    return F.aggregate(kinds, start, step, lambda s: once(settled(s), lambda u: F.concat(u["out"], _emit(u["pending"], none_yet()))))


def column_label(token: Column) -> Column:
    return F.when(has(token, r"(?i)^now\z"), "Now").when(has(token, "(?i)on admission"), "On Admission").otherwise(F.concat(F.lit("Day "), F.regexp_extract(token, r"(\d+)", 1)))


def is_panel_section(token: Column) -> Column:
    return is_section(token) | has(token, r"(?i)shows?:?\z")


def paired_columns(tokens: Column) -> Column:
    """Lines of a panel with two column heads: the heads, then `name<TAB>first<TAB>second`, sections on lines of their own.
    Null where the tokens are no such panel (two heads, and two names and two values in each column at least)."""
    heads = F.filter(F.transform(tokens, lambda t, i: F.when(has(t, COLUMN_HEAD), i)), lambda i: i.isNotNull())

    def lines(at: Column) -> Column:
        a, b = F.get(at, 0), F.get(at, 1)
        body = lambda part: F.filter(part, lambda t: ~has(t, COLUMN_HEAD))
        parts = F.struct(F.slice(tokens, F.lit(1), a).alias("names"), body(F.slice(tokens, a + 2, b - a - 1)).alias("first"), body(F.slice(tokens, b + 2, F.size(tokens) + 1)).alias("second"))

        def rows(p: Column) -> Column:
            named = lambda upto: F.size(F.filter(upto, lambda n: ~is_panel_section(n)))
            cell = lambda column, k: F.coalesce(F.get(column, k), F.lit(""))

            def row(n: Column, i: Column) -> Column:
                whole = once(named(F.slice(p["names"], F.lit(1), i + 1)) - 1, lambda k: F.concat_ws("\t", n, cell(p["first"], k), cell(p["second"], k)))
                return F.when(is_panel_section(n), sub(n, [(r":\z", "")])).otherwise(sub(whole, [(r"\t+\z", "")]))

            top = F.concat(F.lit("\t"), column_label(F.get(tokens, a)), F.lit("\t"), column_label(F.get(tokens, b)))
            enough = (F.size(p["first"]) >= 2) & (F.size(p["second"]) >= 2) & (named(p["names"]) >= 2)
            return F.when(enough, F.concat(F.array(top), F.transform(p["names"], row)))

        return once(parts, rows)

    return once(heads, lambda at: F.when(F.size(at) >= 2, lines(at)))


def pair_tokens(tokens: Column) -> Column:
    """Lines of cells from tokens: a panel of two columns, or runs of names and values."""
    return once(tokens, lambda ts: F.coalesce(paired_columns(ts), paired_runs(ts)))


def cut_series(line: Column) -> Column:
    """Lines of cells from a line that holds two or more series, else the line alone: each series is a name and three or more
    values; what follows the last is dropped. One name at least is that of a series."""
    runs = F.regexp_extract_all(line, F.lit(SERIES_RUN), F.lit(1))
    row = lambda r: F.concat_ws("\t", trim(F.regexp_extract(r, SERIES_ROW, 1)), sub(trim(F.regexp_extract(r, SERIES_ROW, 2)), [(r"\s+", "\t")]))
    cut = once(runs, lambda rs: F.when((F.size(rs) >= 2) & F.exists(rs, lambda r: has(r, SERIES_NAME)), F.transform(rs, row)))
    return F.when(F.contains(line, F.lit("\t")), F.array(line)).otherwise(F.coalesce(cut, F.array(line)))


def series_lines(lines: Column) -> Column:
    """lines with series written as cells: lines with several series are cut; two or more adjacent lines of one series each
    become rows, where their numbers of values differ by one at most from the first and one of the first two names is that
    of a series."""
    kind = "struct<line:string,name:string,n:int>"

    def read(line: Column) -> Column:
        name, cells = trim(F.regexp_extract(line, SERIES_ROW, 1)), trim(F.regexp_extract(line, SERIES_ROW, 2))
        row = once(F.struct(name.alias("a"), cells.alias("b")), lambda x: F.when(
            (x["a"] != "") & ~F.contains(line, F.lit("\t")) & ~has(x["a"], ASKS_IN_NAME) & (has(x["a"], SERIES_NAME) | F.contains(x["a"], F.lit(" "))), x))
        return once(row, lambda x: F.struct(line.alias("line"), x["a"].alias("name"), F.when(x.isNotNull(), F.size(F.split(x["b"], r"\s+"))).alias("n")).cast(kind))

    def tabbed(x: Column) -> Column:
        return F.concat_ws("\t", x["name"], sub(trim(F.regexp_extract(x["line"], SERIES_ROW, 2)), [(r"\s+", "\t")]))

    def joined(rows: Column) -> Column:
        whole = "struct<out:array<string>,first:int>"
        state = lambda out, first: F.struct(out.alias("out"), first.alias("first")).cast(whole)

        def step(s: Column, i: Column) -> Column:
            x, y = F.get(rows, i), F.get(rows, i + 1)
            goes_on = F.coalesce(F.abs(x["n"] - s["first"]) <= 1, F.lit(False))
            opens = F.coalesce((F.abs(x["n"] - y["n"]) <= 1) & (has(x["name"], SERIES_NAME) | has(y["name"], SERIES_NAME)), F.lit(False))
            written = lambda line: F.concat(s["out"], F.array(line))
            return F.when(goes_on, state(written(tabbed(x)), s["first"])).when(opens, state(written(tabbed(x)), x["n"])).otherwise(state(written(x["line"]), F.lit(None).cast("int")))

        start = state(none_yet(), F.lit(None).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), start, step, lambda s: s["out"])

    return once(F.transform(F.flatten(F.transform(lines, cut_series)), read), joined)


def format_series(text: Column) -> Column:
    """A text whose lines of series are written as cells. Only texts that name a series are looked at line by line."""
    named = holds(text, " ago", "blood pressure", "temperature", "time") & has(text, SERIES_NAME)
    return F.when(named & has(text, r"\d\S*\s+\S*\d\S*\s+\S*\d"), F.array_join(series_lines(F.split(text, "\n")), "\n")).otherwise(text)


def peel_tail(text: Column) -> Column:
    """struct(text, tokens): a choice, and the laboratory names and values that a page break has glued to it. A choice whose
    tail holds no value and no name stays whole."""
    names = F.regexp_extract(text, GLUED_NAMES, 1)
    working = once(F.regexp_replace(text, GLUED_NAMES, ""), trim)
    named = F.filter(F.transform(F.split(names, r"\s+"), normalize_token), lambda t: t != "")
    split_units = lambda t: F.flatten(F.transform(F.split(t, rf"(?i)(?<=(?:mEq/L|mg/dL|g/dL|U/L|mm Hg|/mm³|/hpf|/lpf|ng/mL|µm³|%))\s+"), lambda p: F.split(p, r"\s+(?=\d)")))

    def cut(w: Column) -> Column:
        blob = F.regexp_extract(w, GLUED_VALUES, 1)
        tokens = F.filter(F.flatten(F.transform(scan_text(blob), split_units)), lambda t: line_class(t).isin("value", "name", "section"))
        head = trim(F.regexp_replace(w, GLUED_VALUES, ""))

        def decided(ts: Column) -> Column:
            none = ~F.exists(ts, is_value) & (F.size(named) == 0)
            return F.when(blob == "", F.struct(w.alias("text"), named.alias("tokens"))).when(none, F.struct(trim(text).alias("text"), none_yet().alias("tokens"))).otherwise(F.struct(head.alias("text"), F.concat(named, ts).alias("tokens")))

        return once(tokens, decided)

    glued = has(text, GLUED_NAMES) | has(text, GLUED_VALUES)
    return F.when(glued, once(working, cut)).otherwise(F.struct(trim(text).alias("text"), none_yet().alias("tokens")))


def block_start(text: Column) -> Column:
    """Place (from 1) where the laboratory block opens, 0 if there is none: at the first named kind of study, else at a line
    ending in "shows:" before a laboratory line."""
    heads, nexts = F.regexp_extract_all(text, F.lit(ANY_SHOWS), F.lit(1)), F.regexp_extract_all(text, F.lit(ANY_SHOWS), F.lit(2))

    def opens(pair: Column) -> Column:
        head = pair["heads"]
        return ~(has(head, NOT_A_BLOCK) & ~has(head, STILL_A_BLOCK)) & once(normalize_token(pair["nexts"]), lambda l: line_class(l).isin("value", "name", "section"))

    head = F.get(F.filter(F.arrays_zip(heads.alias("heads"), nexts.alias("nexts")), opens), 0)["heads"]
    generic = F.when(has(text, ANY_SHOWS), F.coalesce(F.position(head, text), F.lit(0))).otherwise(0)
    low = F.lower(text)
    may = F.contains(text, F.lit(":")) & (F.contains(low, F.lit("show")) | F.contains(low, F.lit("studies")) | F.contains(low, F.lit("findings")))
    return F.when(may, once(F.regexp_instr(text, F.lit(SHOWS)), lambda at: F.when(at > 0, at).otherwise(generic))).otherwise(0)


def leftover_prose(lines: Column) -> Column:
    """The prose of block_lines: all from the first that opens another part of the text, or is too long for a result."""
    opens = lambda l: (l["kind"] == "opens") | ((F.length(l["line"]) > 90) & ~l["kind"].isin("value", "name", "section"))
    prose = once(first_where(F.transform(lines, opens)), lambda k: F.when(k.isNull(), "").otherwise(F.array_join(F.transform(F.slice(lines, k + 1, F.size(lines)), lambda l: l["line"]), " ")))
    tidy = trim(sub(prose, [(r"\s+", " "), (r"(?i)\s*(immediate discontinuation of|supplementation with)\z", "")]))
    dangling = lambda t: (F.length(t) < 90) & ~has(t, "[.!]") & has(t, r"(?i)with\z|of\z|shown\.?\z")
    return once(tidy, lambda t: F.when(dangling(t), "").otherwise(t))


def tokens_behind_question(after: Column) -> Column:
    """struct(tokens, percent): results that stand behind the question or on its choices, and the last percentage that ends
    a choice (never that of saline)."""
    lines = F.filter(F.transform(F.split(after, "\n"), trim), lambda l: ~has(l, r"(?i)^which of the following|intravenous infusion of which") & (l != ""))
    bare = lambda l: trim(sub(l, [(CHOICE_LINE + r"\s*", "")]))

    def of_line(line: Column) -> Column:
        at_end = once(F.regexp_extract(bare(line), GLUED_AT_END, 1), lambda n: F.filter(F.transform(F.split(n, r"\s+"), normalize_token), lambda t: t != ""))
        on_choice = F.concat(peel_tail(bare(line))["tokens"], at_end)
        short = lambda t: once(line_class(t), lambda k: k.isin("value", "section") | ((k == "name") & (F.size(F.split(t, " ")) <= 5)))
        return F.when(has(line, CHOICE_LINE), on_choice).otherwise(F.filter(once(normalize_token(line), scan_line), short))

    percents = lambda ls: F.filter(F.transform(F.filter(ls, lambda l: has(l, CHOICE_LINE)), lambda l: F.regexp_extract(bare(l), LAST_PERCENT, 2)), lambda p: (p != "") & ~has(p, SALINE))
    return once(lines, lambda ls: F.struct(F.flatten(F.transform(ls, of_line)).alias("tokens"), F.try_element_at(percents(ls), F.lit(-1)).alias("percent")))


def with_percent(tokens: Column, percent: Column) -> Column:
    """tokens with a percentage before their first value, where they hold counts or electrolytes."""
    put = once(F.coalesce(first_where(F.transform(tokens, is_value)), F.size(tokens)), lambda n: F.concat(F.slice(tokens, F.lit(1), n), F.array(percent), F.slice(tokens, n + 1, F.size(tokens) + 1)))
    return F.when(percent.isNotNull() & F.exists(tokens, lambda t: has(t, LAB_UNIT)), put).otherwise(tokens)


@per_session
def _format_steps(column: str, extra: str | None) -> tuple[Column, ...]:
    stem, none = F.col(column), none_yet()
    named, any_ = F.regexp_extract("_rest", rf"(?is)\A{_STUDIES}", 0), F.regexp_extract("_rest", r"(?is)\A.*?shows?:\s*", 0)
    tail = F.substr(F.col("_rest"), F.length("_head") + 1, F.length("_rest"))
    more = F.flatten(F.transform(F.col(extra), lambda t: once(normalize_token(t), scan_line))) if extra else none
    nothing = F.struct(none.alias("tokens"), F.lit(None).cast("string").alias("percent"))
    found = F.concat(tokens_of(F.col("_lines")), "_more", F.col("_behind")["tokens"])
    prefix = sub(F.substring(stem, F.lit(1), F.col("_at") - 1), [(r"\s+\z", "")])
    parts = F.concat(F.array(prefix, trim(sub(F.col("_head"), [(r"\s+", " ")]))), "_cells", F.array(leftover_prose(F.col("_lines"))))
    question = trim(sub(F.regexp_extract("_after", rf"(?is)({_ASKS}.*?\?)", 1), [(r"\s+", " "), ("^which", "Which")]))
    written = format_series(F.col("_whole"))
    return (
        block_start(stem),
        F.when(F.col("_at") > 0, F.substr(stem, F.col("_at"), F.length(stem))),
        F.when(F.col("_rest").isNotNull(), F.coalesce(F.nullif(named, F.lit("")), F.nullif(any_, F.lit("")), F.col("_rest"))),
        sub(tail, [(rf"(?is){_ASKS}.*\z", "")]),
        F.substr(tail, F.length("_body") + 1, F.length("_rest")),
        block_lines(F.col("_body")),
        F.when(F.col("_body").isNotNull(), more),
        F.when(F.col("_after") != "", tokens_behind_question(F.col("_after"))).otherwise(nothing),
        with_percent(found, F.col("_behind")["percent"]),
        named_gases(F.col("_tokens")),
        F.coalesce(paired_columns(F.col("_tokens")), paired_runs(F.col("_tokens"))),
        F.when(F.col("_at") > 0, F.array_join(F.filter(parts, lambda l: l != ""), "\n")).otherwise(stem),
        F.when(F.col("_at") > 0, F.concat_ws("\n\n", sub(written, [(r"\s+\z", "")]), F.nullif(question, F.lit("")))).otherwise(written),
    )


def format_labs(rows: DataFrame, column: str = "stem", extra: str | None = None) -> DataFrame:
    """rows whose stems have their laboratory block as lines of cells, its prose behind it, its question as a paragraph of its
    own. extra: an array column of tokens from elsewhere on the page (its choices) that belong to the block. Without a block,
    series are written as cells. A row in, a row out, no shuffle; null stays null."""
    at, rest, head, body, after, lines, more, behind, tokens, gases, cells, whole, written = _format_steps(column, extra)
    out = rows.withColumn("_at", at).withColumn("_rest", rest).withColumn("_head", head).withColumn("_body", body).withColumn("_after", after)
    out = settled(out, "_at", "_head", "_body", "_after").withColumns({"_lines": lines, "_more": more, "_behind": behind})
    out = settled(out, "_lines", "_more", "_behind").withColumn("_tokens", tokens)
    out = settled(out.withColumn("_tokens", gases), "_tokens")
    out = settled(out.withColumn("_cells", cells), "_cells")
    return settled(out.withColumn("_whole", whole).withColumn(column, written).select(*rows.columns), column)
