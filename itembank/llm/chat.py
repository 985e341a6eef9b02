"""Chat formatting by incremental black-box rendering.

A template is any function from messages to a string. Successive turn prefixes are rendered and each output is compared
with the one before: what was appended is the turn's span. Rendering the turn once more with a probe as its text shows
which part of the span is the text. A template whose longer output does not start with the shorter one rewrites
history, and is reported.

Defined cases: null text and null role are empty strings; turns are ordered by turn (null first), then role and text;
rows with a null conversation id form one conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

#: The strings by which the template marks turns.
CONTROL = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>"]
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_TURN = re.compile(r"<<SYS>>(.*?)<</SYS>>|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\[/ROLE\]<s>(.*?)</s>", re.S)


def escaped(text: str) -> str:
    """text with a backslash inside each control string (after its first letter) and each backslash doubled."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else m[1], text, flags=re.S)


def inst_template(messages: list[Message]) -> str:
    out = []
    for role, text in messages:
        if role in _MARKS:
            out.append(_MARKS[role][0] + escaped(text) + _MARKS[role][1])
        else:
            out.append("[ROLE]" + escaped(role) + "[/ROLE]<s>" + escaped(text) + "</s>")
    return "".join(out)


def parsed(formatted: str) -> list[Message]:
    """The turns that a formatted conversation holds, read back from its marks alone."""
    turns = []
    end = 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError(f"text between turns at {end}")
        end = m.end()
        k = m.lastindex
        turns.append((unescaped(m[4]), unescaped(m[5])) if k == 5 else (("system", "user", "assistant")[k - 1], unescaped(m[k])))
    if end != len(formatted):
        raise ValueError(f"text after the last turn at {end}")
    return turns


def shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: Probes share no letter at either end, so what both renderings have in common is not text.
PROBES = ("A-probe-a", "Z+probe+z")


def rendered(messages: list[Message], template: Template = inst_template, learned: tuple[str, ...] = ("assistant",)) -> dict:
    """formatted, spans (start, end of each turn), texts (start, end of each turn's text), loss (those of the roles to
    learn), rewrites (the first turn whose rendering changed what stood before it, or None)."""
    before, spans, texts, rewrites = template([]), [], [], None
    for k in range(1, len(messages) + 1):
        now = template(messages[:k])
        start = len(before)
        if not now.startswith(before):
            rewrites = k - 1 if rewrites is None else rewrites
            start = shared_prefix(before, now)
        a, b = (template([*messages[: k - 1], (messages[k - 1][0], p)]) for p in PROBES)
        head = shared_prefix(a, b)
        tail = shared_prefix(a[::-1], b[::-1])
        spans.append((start, len(now)))
        texts.append((head, len(now) - tail))
        before = now
    loss = [t for t, (role, _) in zip(texts, messages, strict=True) if role in learned]
    return {"formatted": before, "spans": spans, "texts": texts, "loss": loss, "rewrites": rewrites}


SCHEMA = "conv_id {kind}, formatted string, span_start array<long>, span_end array<long>, loss_start array<long>, loss_end array<long>, rewrites_at int"


def conversations_rows(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(conversations: DataFrame, template: Template = inst_template) -> DataFrame:
    """One row per conversation: the formatted text, turn spans, loss spans (code points) and where history was rewritten."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [rendered([(t["role"], t["text"]) for t in turns], template) for turns in part.column(1).to_pylist()]
                longs = lambda k, i: pa.array([[s[i] for s in d[k]] for d in done], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d["formatted"] for d in done], pa.string()), longs("spans", 0), longs("spans", 1), longs("loss", 0), longs("loss", 1), pa.array([d["rewrites"] for d in done], pa.int32())],
                    names=["conv_id", "formatted", "span_start", "span_end", "loss_start", "loss_end", "rewrites_at"],
                )

    rows = conversations_rows(conversations)
    return rows.mapInArrow(run, SCHEMA.format(kind=rows.schema["conv_id"].dataType.simpleString()))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them: turns by their marks, learned text by the loss spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turns = parsed(text)
                loss = [unescaped(text[s:e]) for s, e in zip(starts, ends, strict=True)]
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, loss)), sha("".join(loss)), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CHAT_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
      + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|<s>|</s>'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS shown
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
