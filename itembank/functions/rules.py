"""Ordered regular-expression rules, as Spark columns and as DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import LOWER, NEEDS, TRIM, java

Rules = Iterable[tuple[str, str]]


def _replaced(text: Column, rules: Rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, java(pattern), replacement)
    return text


def _where_needed(rules: list[tuple[str, str]]) -> Callable[[Column], Column]:
    needs = [NEEDS[pattern] for pattern, _ in rules]
    parts = dict.fromkeys(part for need in needs if not isinstance(need, str) for part in need)
    shorter = dict.fromkeys(need for need in needs if isinstance(need, str))

    def applied(t: Column) -> Column:
        holds = [F.contains(t, F.lit(part)) for part in parts] + [has(t, pattern) for pattern in shorter]
        return F.when(reduce(or_, holds), _replaced(t, rules)).otherwise(t)

    return applied


def sub(text: Column, rules: Rules) -> Column:
    """text with the rules applied in order, each everywhere. Rules that need something (`NEEDS`) run only on texts that hold it,
    six under one test: more tests would nest deeper than the planner resolves."""
    for needed, group in groupby(rules, lambda rule: NEEDS.get(rule[0]) is not None):
        some = list(group)
        if not needed:
            text = _replaced(text, some)
        else:
            for k in range(0, len(some), 6):
                text = once(text, _where_needed(some[k : k + 6]))
    return text


def trim(text: Column) -> Column:
    """TRIM, from both ends: its pattern would look at every blank of the text."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def holds(text: Column, *parts: str) -> Column:
    """text in lower case holds one of the strings."""
    return once(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(part)) for part in parts]))


def has(text: Column, pattern: str) -> Column:
    if pattern in LOWER:
        return holds(text, *LOWER[pattern]) & text.rlike(java(pattern))
    return text.rlike(java(pattern))


def has_gap(text: Column) -> Column:
    """Two blanks in a row, or a blank that is no space."""
    return reduce(or_, [F.contains(text, F.lit(gap)) for gap in ("  ", "\t", "\n", "\x0b", "\f", "\r")])


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    return F.when(has(text, pattern), F.regexp_extract(text, java(pattern), group))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns behind one generated row each: filters and projections above it name them, and the planner
    never copies their long expressions."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*names)))).select(*df.columns)


def per_session(build: Callable[..., tuple[Column, ...]]) -> Callable[..., tuple[Column, ...]]:
    """build(*names) kept for the running application: columns over named columns serve every frame that has these, and
    making the long ones takes seconds."""
    kept: dict[tuple, tuple[Column, ...]] = {}

    def built(*names: str | None) -> tuple[Column, ...]:
        key = (SparkSession.active().sparkContext.applicationId, *names)
        if key not in kept:
            kept.clear() if any(k[0] != key[0] for k in kept) else None
            kept[key] = build(*names)
        return kept[key]

    return built


def until_same(text: Column, step: Callable[[Column], Column], rounds: int) -> Column:
    """step applied again and again, until it changes nothing or the rounds are over. Null stays null."""
    kind = "struct<text:string,done:boolean>"

    def one(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(once(step(s["text"]), lambda new: F.struct(new.alias("text"), (new == s["text"]).alias("done")).cast(kind)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(text.alias("text"), F.lit(False).alias("done")).cast(kind), one, lambda s: s["text"])


def words_of(text: Column, keep: Callable[[Column], Column]) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.filter(F.split(plain, " "), keep)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def duck_sub(expr: str, rules: Rules) -> str:
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(re.sub(r'[$](\d)', r'\\\1', replacement))}, 'g')"
    return expr


def duck_trim(expr: str) -> str:
    return duck_sub(expr, TRIM)


def duck_has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quoted(pattern)})"


def duck_first(expr: str, pattern: str, group: int = 1) -> str:
    return f"CASE WHEN {duck_has(expr, pattern)} THEN regexp_extract({expr}, {quoted(pattern)}, {group}) END"


def duck_letters(expr: str) -> str:
    return f"length(regexp_replace({expr}, '[^A-Za-z]', '', 'g'))"
