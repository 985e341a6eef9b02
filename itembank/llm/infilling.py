"""Fill-in-the-middle: documents cut in three by an indexable skip list, and reordered.

A text is a list of units (code points, or the matches of a pattern). The lowest lane of the list links each unit to the
next; every express lane above it links some of the units of the lane below, and each link carries its width in units and
in code points. Descending from the top lane, a rank is reached by adding up widths, so both cuts fall on unit borders
exactly, whatever the widths of the units.

Cuts and forms depend on the record's key alone, so reruns agree. Marks stand only where the text has none: a text that
holds a mark stays plain, as do empty texts and PLAIN_SHARE percent of all.

Defined cases: a null text is the empty text; a null key counts as the empty string; repeated rows are cut alike; very long
texts are whole, one at a time in memory, at some six bytes a unit beside the text; an empty table gives no rows; columns
other than key and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of 100 documents, those from this one on stay plain.
REORDERED = 90
#: Of 100 reordered documents, those below this one put the suffix first.
SUFFIX_FIRST = 20
#: One unit in 2 ** LIFT of a lane stands in the lane above.
LIFT = 3
_MIX = np.uint32(0x9E3779B1)


class SkipList:
    """Units in order. `widths` are their code points; None means one each."""

    def __init__(self, n: int, widths: np.ndarray | None = None):
        self.n = n
        chars = np.broadcast_to(np.int32(1), n) if widths is None else widths
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = [(np.broadcast_to(np.int32(1), n), chars)]
        self.down: list[np.ndarray | None] = [None]
        coin = (np.arange(n, dtype=np.uint32) + np.uint32(1)) * _MIX if n > 1 else np.zeros(n, np.uint32)
        coin ^= coin >> np.uint32(15)
        while len(coin) > 1:
            up = coin & np.uint32((1 << LIFT) - 1) == 0
            up[0] = True  # the head stands in every lane
            at = np.flatnonzero(up)
            if len(at) == len(coin):
                break
            units, chars = self.lanes[-1]
            self.lanes.append((np.add.reduceat(units, at, dtype=np.int64), np.add.reduceat(chars, at, dtype=np.int64)))
            self.down.append(at)
            coin = coin[at] >> np.uint32(LIFT)

    def reach(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to n)."""
        at = units = chars = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            wide, long = self.lanes[level]
            while at < len(wide) and units + wide[at] <= rank:
                units += int(wide[at])
                chars += int(long[at])
                at += 1
            if units == rank:
                break
            if level:
                at = int(self.down[level][at])
        return chars


def units_of(text: str, unit: regex.Pattern | None) -> SkipList:
    if unit is None:
        return SkipList(len(text))
    widths = np.fromiter((m.end() - m.start() for m in unit.finditer(text)), np.int32)
    if widths.sum() != len(text) or (widths == 0).any():
        raise ValueError("the unit pattern must match every text from end to end, without empty matches")
    return SkipList(len(widths), widths)


def draws(key: str) -> list[int]:
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def infill(text: str, key: str, unit: regex.Pattern | None = None) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and of middle, and the reordered text."""
    h = draws(key)
    list_ = units_of(text, unit)
    n = list_.n
    if not text or h[2] % 100 >= REORDERED or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = list_.reach(first), list_.reach(last)
    if h[3] % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str | None = None) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output. unit: a pattern whose matches tile every text; None for code points."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(unit) if unit else None
        for batch in sliced(batches, "text", 4 << 20):
            keys = batch.column(1).to_pylist()
            made = [infill(t or "", k, pattern) for t, k in zip(batch.column(2).to_pylist(), keys, strict=True)]
            n, form, before, middle, out = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    slim = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    made = slim.mapInArrow(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("doc_id", key)


def restored(output: Column, form: Column) -> Column:
    """The text from its reordered form: the marks are the only ones, so the parts between them are exact."""
    parts = F.split(output, "|".join(MARKS), -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def infill_digest(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


INFILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""
