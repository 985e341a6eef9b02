"""Laboratory lines: spelling, line classes, unit families. Classifiers take a normalised line (`normalize_token`)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import duck_has, duck_sub, has, has_gap, once, sub, trim

# Names, units and spellings of laboratory results.
NAMES = [
    "Fractional excretion of Na+", "Fingerstick blood glucose", "Partial thromboplastin time", "Prothrombin time", "Mean corpuscular volume", "Erythrocyte sedimentation rate",
    "Parathyroid hormone-related protein", "Parathyroid hormone, intact", "Transferrin saturation", "Hemoglobin electrophoresis", "Lactate dehydrogenase", "Alkaline phosphatase",
    "Cholesterol, total", "HDL-cholesterol", "LDL-cholesterol", "HDL cholesterol", "LDL cholesterol", "Triglycerides", "Total cholesterol", "Bilirubin (total)", "Bilirubin, total",
    "Total bilirubin", "Serum creatinine", "Serum amylase", "Serum glucose", "Leukocyte count", "Platelet count", "Reticulocyte count", "Red cell distribution width",
    "CD4+ T-lymphocyte count", "Thyroid-stimulating hormone", "Thyroxine (T4)", "Free T4", "γ-Glutamyltransferase", "y-Glutamyltransferase", "Serum creatine kinase",
    "Segmented neutrophils", "RBC casts", "Pigmented granular casts", "Specific gravity", "Urea nitrogen", "Blood alcohol", "Creatine kinase", "Urine protein", "Urine pH",
    "O2 saturation", "Opening pressure", "Erythrocyte count", "Hemoglobin A1c", "Hemoglobin A2", "Hemoglobin F", "Hemoglobin S", "Hemoglobin C", "Hemoglobin A", "Gram stain",
    "Organisms", "Nitrites", "Nitrite", "Glucose, fasting", "Total protein", "Uric acid", "Hemoglobin", "Hematocrit", "Lymphocytes", "Monocytes", "Eosinophils", "Basophils",
    "Creatinine", "Albumin", "Globulin", "Phosphorus", "Total iron-binding capacity", "Iron-binding capacity", "TIBC", "Postvoid residual volume", "Leukocyte esterase", "Ferritin",
    "Amylase", "Lipase", "Neutrophils", "Thyroxine", "Cholesterol", "IgA", "IgG", "IgM", "GGT", "RDW", "TSH", "Glucose", "Protein", "Ketones", "Direct", "Total", "Bands", "Casts",
    "HBsAg", "Anti-HBs", "Anti-HBc", "Anti-HCV", "ALT", "AST", "Pco2", "Po2", "RBC", "WBC", "HCO3-", "Na+", "K+", "Cl-", "Ca2+", "pH", "Iron", "Blood",
]
UNITS = (
    r"(?:mEq/L|mg/dL|g/dL|U/L|mm\s*Hg|mm\s*(?:H2O|H20|Hp)|mm\s*/\s*h|mmol/L|sec(?:\s*\(INR\s*=\s*[\d.\s]+\))?|%|/mm\s*3|/mm³|million\s*/mm\s*3|million\s*/mm³|/hpf|/lpf|/min|ng/mL"
    r"|µg/dL|μg/dL|µU/mL|μU/mL|pg/mL|pmol/L|µm³|μm³|µm\s*3|mg/24\s*h)"
)
VALUE = (
    rf"(?:<?[\d.,]+\s*{UNITS}(?:\s*\(N\s*=\s*[^)]+\))?(?:\s+with a normal differential)?|\d+(?:\.\d+)?\s*million\s*/mm(?:\s*3|³)|\d+\s*-\s*\d+\s*/(?:hpf|lpf)|\d+\s*/(?:hpf|lpf)"
    r"|[1-4]\s*\+|wbc\s*[1-4]\s*\+|[5-8]\.\d{1,3}|1\.0\d{2}|negative|positive|trace|none|nonreactive|reactive|few granular|coarse granular)"
)
VALUE_LINES = [rf"(?i)^{VALUE}\z", r"(?i)^\d+\s*sec(?:\s*\(INR\s*=\s*[\d.]+\))?\z", r"(?i)^(?:few|coarse)\s+granular\z", r"(?i)^[\d.,]+\s*million/mm³\z", r"(?i)^[\d.,]+\s*mm H2O\z"]
SECTION = (
    r"(?i)^(serum|urine|plasma|csf|cerebrospinal fluid|complete blood count|pleural fluid|synovial fluid|peritoneal fluid|urinalysis"
    r"|arterial blood gas analysis(?: on room air)?(?: shows?:?)?|hemoglobin electrophoresis(?: shows?:?)?|on admission|now):?\z"
)
STOP = (
    r"(?i)^(which of the following|intravenous (?:infusion|administration)|an x-ray|a ct|an ecg|echocardiography|ultrasonography|venous duplex|microscopic examination"
    r"|abdominal ultrasonography|examination shows|the remainder|the patient asks|supplementation with|blood cultures|a gram stain of|a blood smear|toxicology screening|0\s*[A-JQ]\)|[A-J]\))"
)
NAME_HINT = (
    r"(?i)count|time|rate|saturation|gravity|nitrogen|kinase|phosphatase|bilirubin|cholesterol|triglyceride|globulin|albumin|creatinine|hemoglobin|hematocrit|neutrophils|lymphocytes"
    r"|platelet|ferritin|amylase|lipase|cast|excretion|nitrite|opening pressure|erythrocyte|thyroxine|thyroid|glutamyl|distribution width"
)
SHORT_NAME = r"(?i)^(Na\+|K\+|Cl-|HCO3-|Ca2\+|pH|RBC|WBC|ALT|AST|Po2|Pco2|Bands|Ketones|Direct|Total|Iron|Blood)\z"
NOT_IN_NAME = r"(?i)\b(is|are|of|the|and|with|for|to)\b"
SPELLING = [
    ("\u00a0", " "), (r"\bRSC\b", "RBC"), (r"(?i)\bNa\*", "Na+"), (r"\bK(?:[+•·*]|[|])I?\b", "K+"), (r"\bK•I\b", "K+"), (r"(?i)\bcI\s*-", "Cl-"), (r"(?i)\bc\s*1\s*-", "Cl-"),
    (r"\bCl\s*[·•]\s*", "Cl-"), (r"\bCl\s+-", "Cl-"), (r"(?i)\bHCO\s*[,\s]*-+(\s|\z)", r"HCO3-$1"), (r"(?i)\bHCO\s*-?\s*3\s*-?", "HCO3-"), (r"(?i)\bHco\s*-", "HCO3-"),
    (r"(?i)\bHC0?3-", "HCO3-"), (r"(?i)\bPco\s*2", "Pco2"), (r"(?i)\bPo\s*2", "Po2"), (r"(?i)\b0\s*2 saturation", "O2 saturation"), (r"(?i)\bCa\s*2\+", "Ca2+"),
    (r"(?i)\bHemoglobin A\s*1c\b", "Hemoglobin A1c"), (r"(?i)\bHemoglobin A\s*2\b", "Hemoglobin A2"), (r"(?i)\bThyroxine\s*\(\s*T\s*4\s*\)", "Thyroxine (T4)"),
    (r"(?i)\bDay(\d+)\b", r"Day $1"), (r"\blg([AGM])\b", r"Ig$1"), (r"(?i)\by-Glutamyltransferase", "γ-Glutamyltransferase"), (r"(?i)\bF102\b", "FiO2"), (r"(?i)\bcm\s*Hp\b", "cm H2O"),
    (r"\bmm\s*H[pP]\b", "mm H2O"), (r"\bmm\s*H20\b", "mm H2O"), (r"(?i)\bmEa/LI?\b", "mEq/L"), (r"(?i)(\d),(\s*(?:mEq|mg|g|U|mm|ng|µg|μg))", r"$1$2"), (r"\|", " "),
    (r"(?i)\bHDL\s*-?\s*cholesterol\b", "HDL-cholesterol"), (r"(?i)\bLDL\s*-?\s*cholesterol\b", "LDL-cholesterol"), (r"(?i)\bCholesterol,\s*total\b", "Cholesterol, total"),
    (r"(?i)/mm\s*3\b", "/mm³"), (r"(?i)(\d(?:\.\d+)?)\s*million\s*/mm(?:\s*3|³)?", r"$1 million/mm³"), (r"µm\s*3\b", "µm³"), (r"μm\s*3\b", "µm³"), (r"(?i)N=0o/o", "N=0%"), (r"\s+", " "),
]
#: What a line holds, in small letters, that a spelling changes, runs of blanks aside: one of these strings, or one of those with
#: a match of the pattern.
SPELT = ("\u00a0", "|", "*", "•", "·", "µ", "μ", "+", "rsc", "lga", "lgg", "lgm", "mm", "hco", "hc0", "hc3", "pco", "po", "saturation", "hemoglobin a", "thyroxine", "f102", "y-glut", "hp", "mea/", "cholesterol", "n=0")
SPELT_IF = [("-", r"c\s*[1il]\s*-"), (",", r"\d,"), ("day", r"day\d")]
#: How every value begins.
VALUE_BEGINS = r"(?i)^(?:[<\d.,]|wbc|negative|positive|trace|none|nonreactive|reactive|few|coarse)"
BROKEN_UNITS = [(r"(?i)/mm\s*\n\s*3\b", "/mm³"), (r"[µμ]m\s*\n\s*3\b", "µm³")]
#: Pattern, family, and for some a pattern that must not be found.
VALUE_FAMILIES: list[tuple[str, ...]] = [
    ("%", "percent", "mm"), (r"(?i)µm³|um\s*3|μm³|fL\b", "volume"), (r"(?i)ng/m[lL]", "ferritin"), (r"(?i)pg/(?:m[lL]|d[lL])", "pg"), (r"(?i)µg/d[lL]|mcg/d[lL]|μg/d[lL]", "iron"),
    (r"(?i)mm\s*/\s*h", "esr"), (r"(?i)mEq/L|mmol/L", "electrolyte"), (r"(?i)mg/d[lL]|mg/24\s*h", "chem"), (r"(?i)g/d[lL]", "protein"), (r"(?i)U/L", "enzyme"),
    (r"(?i)/mm³|/mm3|million/mm", "count"), (r"(?i)µU/m[lL]|μU/m[lL]", "tsh"), (r"(?i)mm\s*H2O|cm\s*H2O", "pressure"), (r"(?i)mm Hg", "gas"), (r"^1\.\d{3}", "sg"),
]
NAME_FAMILIES: list[tuple[str, ...]] = [
    (r"(?i)mean corpuscular volume|^mcv\z", "volume"),
    (r"(?i)hematocrit|hemoglobin\s*a1c|hba1c|hemoglobin\s*a2|hemoglobin\s*[afsc]|reticulocyte|transferrin saturation|fractional excretion", "percent"),
    (r"(?i)hemoglobin(?:[^ ]| [^e]|\z)", "protein"), (r"(?i)ferritin", "ferritin"), (r"(?i)iron-binding|^tibc\z|^(?:serum )?iron\z", "iron"), (r"(?i)sedimentation", "esr"),
    (r"(?i)residual volume", "volume"), (r"(?i)opening pressure", "pressure"), (r"(?i)thyroid-stimulating|^tsh\z", "tsh"), (r"(?i)leukocyte count|erythrocyte count|platelet count|cd4", "count"),
    (r"(?i)urea nitrogen|creatinine|bilirubin|cholesterol|triglyceride|calcium|urine protein|^(?:serum )?glucose\z", "chem"), (r"(?i)^(?:na\+|k\+|cl-|hco3-|bicarbonate)\z", "electrolyte"),
    (r"(?i)specific gravity", "sg"), (r"(?i)albumin|total protein", "protein"), (r"(?i)alkaline phosphatase|\bast\b|\balt\b", "enzyme"), (r"(?i)hbsag|anti-hbs|anti-hbc|anti-hcv", "sero"),
]


def escaped(name: str) -> str:
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in name)


NAME = r"(?:" + "|".join(map(escaped, NAMES)) + ")"
WHOLE_NAME = rf"(?i)^{NAME}\z"


def is_misspelt(line: Column) -> Column:
    """A spelling, runs of blanks aside, may change the line."""
    holds = lambda low: reduce(or_, [F.contains(low, F.lit(part)) for part in SPELT] + [F.contains(low, F.lit(part)) & has(low, pattern) for part, pattern in SPELT_IF])
    return once(F.lower(line), holds)


def normalize_token(line: Column) -> Column:
    """line as it is spelt here. Most lines need at most that their blanks are made even."""
    even = F.when(has_gap(line), sub(line, SPELLING[-1:])).otherwise(line)
    return trim(F.when(is_misspelt(line), sub(line, SPELLING)).otherwise(even))


def join_broken_units(text: Column) -> Column:
    return sub(text, BROKEN_UNITS)


def is_value(t: Column) -> Column:
    out = F.lit(False)
    for pattern in VALUE_LINES:
        out = out | has(t, pattern)
    return has(t, VALUE_BEGINS) & ~has(t, STOP) & ~has(t, "(?i)which of the following") & out


def is_section(t: Column) -> Column:
    return has(t, SECTION)


def is_name(t: Column) -> Column:
    hinted = ~has(t, NOT_IN_NAME) & ((has(t, NAME_HINT) & (F.size(F.split(t, " ")) <= 6)) | has(t, SHORT_NAME))
    barred = (F.length(t) > 56) | F.contains(t, F.lit("?")) | has(t, STOP) | has(t, r"(?i)^[O0Q]\z")
    return (t != "") & ~barred & (has(t, WHOLE_NAME) | hinted)


def line_class(t: Column) -> Column:
    """section, value, name, stop or other."""
    return F.when(is_section(t), "section").when(is_value(t), "value").when(is_name(t), "name").when(has(t, STOP), "stop").otherwise("other")


def compact(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[\s-]+", ""))


def family(text: Column, families: list[tuple[str, ...]]) -> Column:
    """The first family whose pattern is found, and whose third part, if it has one, is not; null if none."""
    out = F
    for pattern, name, *bar in families:
        found = has(text, pattern)
        for p in bar:
            found = found & ~has(text, p)
        out = out.when(found, name)
    return out


def value_family(value: Column) -> Column:
    return family(value, VALUE_FAMILIES)


def name_family(name: Column) -> Column:
    return family(name, NAME_FAMILIES)


def compatible(name: Column, value: Column) -> Column:
    """A name may take a value: the unit families agree where both are known, and pH is not a specific gravity."""
    clash = (has(name, r"(?i)^pH\z") & has(value, r"^1\.0")) | (has(name, "(?i)specific gravity") & has(value, r"^[6-8]\.\d"))
    return ~clash & F.coalesce(name_family(name) == value_family(value), F.lit(True))


def value_number(value: Column) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(value, r"^<?([\d.,]+)", 1), F.lit("")), ",", "").try_cast("double")


def duck_family(expr: str, families: list[tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {duck_has(expr, p)} {' '.join(f'AND NOT {duck_has(expr, b)}' for b in bar)} THEN '{n}'" for p, n, *bar in families) + " END"


def duck_token(expr: str) -> str:
    return f"regexp_replace({duck_sub(expr, SPELLING)}, '^\\s+|\\s+\\z', '', 'g')"


def duck_value(t: str) -> str:
    return f"({t} <> '' AND NOT {duck_has(t, STOP)} AND NOT {duck_has(t, '(?i)which of the following')} AND ({' OR '.join(duck_has(t, p) for p in VALUE_LINES)}))"


def duck_name(t: str) -> str:
    hinted = f"(NOT {duck_has(t, NOT_IN_NAME)} AND (({duck_has(t, NAME_HINT)} AND len(string_split({t}, ' ')) <= 6) OR {duck_has(t, SHORT_NAME)}))"
    return f"({t} <> '' AND NOT ({duck_has(t, STOP)} OR {duck_has(t, '(?i)^[O0Q]' + chr(92) + 'z')} OR contains({t}, '?') OR length({t}) > 56) AND ({duck_has(t, WHOLE_NAME)} OR {hinted}))"


def duck_class(t: str) -> str:
    return f"CASE WHEN {duck_has(t, SECTION)} THEN 'section' WHEN {duck_value(t)} THEN 'value' WHEN {duck_name(t)} THEN 'name' WHEN {duck_has(t, STOP)} THEN 'stop' ELSE 'other' END"
