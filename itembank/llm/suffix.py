"""Removal of long repeated strings by induced suffix sorting.

A string of LENGTH bytes that starts at two places of the corpus is removed at both. Suffixes are sorted only where it
can matter:

1. Sampling. Of the grams of GRAM bytes inside every string of LENGTH bytes, the one with the least hash (leftmost
   on ties) is an anchor. The choice depends on the string alone, so equal strings have an anchor at the same offset, and
   anchors whose gram occurs once in the corpus lead to no repeat.
2. Sorting. Spark's external sort, which spills to disk, brings together the anchors of a gram from the whole corpus.
   The suffixes that start at these anchors are sorted, and each keeps its common prefix with the one before.
3. Induction. The order of the suffixes one byte further left is induced from this order by a stable deal on the
   preceding byte, and common prefixes are carried along as minima over the ranges that the deal skips; so on for as
   many bytes as a string can start before its anchor. A suffix is repeated where the carried prefix reaches LENGTH.

Anchors whose whole surroundings are equal are settled by counting, before any text moves.

This is not external induced sorting of the whole corpus: there is no recursion and no disk-backed queue of suffix
tuples. Each group is dealt in memory, so no group is gathered beyond SORTED_AT_ONCE: `split_hot` first splits those of
very common grams by the longer context that their strings must share.

Defined cases: null is the empty text; equal texts of LENGTH bytes or more, repeated rows included, are removed whole;
shorter texts never change; very long texts are hashed in overlapping parts, with the same result; an empty table gives no
rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored

LENGTH = 400
GRAM = 50
#: Surroundings of one group that are sorted at once at most. Larger groups are split before they are gathered.
SORTED_AT_ONCE = 40_000
#: Parts into which the surroundings of a gram are dealt while its totals are joined to them: one bit of a long each.
PARTS = 64
_POSITION = np.uint64((1 << 24) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
PAD = 0xFF  # never a byte of UTF-8


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram at each place, by doubling: the hash of m + n bytes comes from those of m and of n."""
    step = {1: _STEP}
    parts = {1: _BYTE[raw]}
    size = 1
    while 2 * size <= gram:
        step[2 * size] = np.uint64(int(step[size]) ** 2 % (1 << 64))
        h = parts[size]
        parts[2 * size] = h[: len(h) - size] * step[size] + h[size:]
        size *= 2
    out, have = None, 0
    for m in sorted(parts, reverse=True):
        if gram - have >= m:
            out, have = (parts[m], m) if out is None else (out[: len(raw) - have - m + 1] * step[m] + parts[m][have:], have + m)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its anchors' places and gram hashes."""
    out = []
    for raw in texts:
        if len(raw) < length:
            out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            continue
        found = []
        part = 1 << 22  # a long text in overlapping parts: the same windows, bounded memory
        for at in range(0, len(raw) - length + 1, part):
            h = gram_hashes(np.frombuffer(raw, np.uint8, min(part + length - 1, len(raw) - at), at), gram)
            packed = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
            place = np.unique(least_in_window(packed, length - gram + 1) & _POSITION).astype(np.int64)
            found.append((place + at, h[place].view(np.int64)))
        place, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
        out.append((place, np.concatenate([h for _, h in found])[first]))
    return out


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key (digest of the text), n_bytes, place, hash, around (digest of all bytes that strings with this anchor can have)."""
    reach = length - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            keys, sizes, places, hashes, around = [], [], [], [], []
            for raw, (place, h) in zip(texts, anchors(texts, length, gram)):
                if not len(place):
                    continue
                key = hashlib.sha256(raw).digest()[:16]
                keys += [key] * len(place)
                sizes.append(np.full(len(place), len(raw)))
                places.append(place)
                hashes.append(h)
                for p in place.tolist():
                    left = max(p - reach, 0)
                    seen = hashlib.blake2b(raw[left : p + length], digest_size=8, salt=(p - left).to_bytes(8, "little"))
                    around.append(int.from_bytes(seen.digest(), "little", signed=True))
            if keys:
                flat = [pa.array(np.concatenate(x)) for x in (sizes, places, hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *flat, pa.array(around, pa.int64())], names=["key", "n_bytes", "place", "hash", "around"])

    return docs.select("text").where(F.octet_length("text") >= length).mapInArrow(run, "key binary, n_bytes long, place long, hash long, around long")


def surroundings(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """hash, key, place, single, left, right for each wanted anchor of a text (key, list of hash, place, single)."""
    reach = length - gram
    keyed = docs.where(F.octet_length("text") >= length).select(F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("key"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in sliced(batches, "text", 1 << 20, 500):
            rows = []
            for key, text, list_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key == last:  # another row with the same text
                    continue
                last = key
                raw = text.encode()
                for a in list_:
                    p = a["place"]
                    rows.append((a["hash"], key, p, a["single"], raw[max(p - reach, 0) : p], raw[p : p + length]))
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["hash", "key", "place", "single", "left", "right"])

    joined = keyed.join(wanted, "key").select("key", "text", "anchors")
    return joined.mapInArrow(run, "hash long, key binary, place long, single boolean, left binary, right binary")


def padded(parts: list[bytes], width: int) -> np.ndarray:
    pad = bytes([PAD]) * width
    return np.frombuffer(b"".join((p + pad)[:width] for p in parts), np.uint8).reshape(len(parts), width)


def induced(group: np.ndarray, left: list[bytes], right: list[bytes], single: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """hits[i, l]: the string of `length` bytes that starts l bytes before anchor i also occurs at another anchor of its
    group. Rows that are not single serve as partners only."""
    reach = length - gram
    hits = np.zeros((len(group), reach + 1), bool)
    right_size = np.fromiter(map(len, right), np.int64, len(right))
    left_size = np.fromiter(map(len, left), np.int64, len(left))
    r = padded(right, length)
    back = padded([x[::-1] for x in left], reach) if reach else np.empty((len(left), 0), np.uint8)
    at = np.lexsort((np.ascontiguousarray(r).view(f"S{length}").reshape(-1), group))
    lcp = np.zeros(len(at), np.int64)
    for s in range(0, len(at), 4096):
        a, b = at[max(s - 1, 0) : s + 4095], at[max(s, 1) : s + 4096]
        n = min(len(a), len(b))
        differ = r[a[:n]] != r[b[:n]]
        common = np.where(differ.any(1), differ.argmax(1), length)
        lcp[max(s, 1) : max(s, 1) + n] = np.minimum(common, np.minimum(right_size[a[:n]], right_size[b[:n]]))
    kind = group[at]
    for l in range(reach + 1):
        same = np.r_[False, kind[1:] == kind[:-1]] if len(kind) else np.zeros(0, bool)
        live = same | np.r_[same[1:], False] if len(kind) else same
        if not live.any():
            break
        # a suffix alone in its class stays alone
        lcp = np.where(same, lcp, 0)
        at, lcp, kind, same = at[live], lcp[live], kind[live], same[live]
        enough = same & (lcp >= length - l)
        hit = enough | np.r_[enough[1:], False]
        hits[at[hit & single[at]], l] = True
        if l == reach:
            break
        going = np.flatnonzero(left_size[at] > l)
        if not len(going):
            break
        deal = kind[going].astype(np.int64) * 256 + back[at[going], l]
        order = np.argsort(deal, kind="stable")
        going, deal = going[order], deal[order]
        fresh = np.r_[True, deal[1:] != deal[:-1]]
        carried = np.zeros(len(going), np.int64)
        inside = np.flatnonzero(~fresh)
        if len(inside):  # the least common prefix between new neighbours: over all that stood between them
            a, b = going[inside - 1], going[inside]
            step = b - a
            carried[inside] = lcp[b]
            far = np.flatnonzero(step > 1)
            if len(far):
                spans = np.stack([a[far] + 1, b[far] + 1], 1).reshape(-1)
                carried[inside[far]] = np.minimum.reduceat(np.r_[lcp, 0], spans)[::2]
        at, lcp, kind = at[going], carried, np.cumsum(fresh)
    return hits


def runs(hits: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that each row's hits cover."""
    edge = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, place[row] - (after - 1), place[row] - first + length


def repeats_of_groups(length: int, gram: int):
    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, index = np.unique(np.array([f"{r[0]}|{r[2]}|" + r[1].hex() for r in rows]), return_index=True)  # an anchor counts once
        rows = [rows[i] for i in index.tolist()]
        group = np.array([r[0] for r in rows])
        single = np.array([r[3] for r in rows])
        place = np.array([r[2] for r in rows])
        hits = induced(group, [r[4] for r in rows], [r[5] for r in rows], single, length, gram)
        row, start, end = runs(hits, place, length)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in row], pa.binary()), pa.array(start), pa.array(end)], names=["key", "start", "end"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        begun = 0  # where the last group of held begins
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and row[0] != held[-1][0]:
                    begun = len(held)
                held.append(row)
                if len(held) >= SORTED_AT_ONCE // 2 and begun:
                    yield from settle(held[:begun])
                    held, begun = held[begun:], 0
        if begun:
            yield from settle(held[:begun])
        if held[begun:]:
            yield from settle(held[begun:])

    return run


def split_hot(rows: DataFrame, length: int, gram: int, at_once: int) -> tuple[DataFrame, DataFrame]:
    """Surroundings of hot grams to (groups of at most at_once surroundings, with a hash for each; spans already known).

    The strings that start lo to hi bytes before an anchor all hold the bytes from lo before it to length - hi behind it.
    So anchors are grouped by these bytes, for either half of the range, and again where a group is still too large.
    Anchors that share all bytes that strings of the range can have are settled by counting; one of them stays as a
    partner. With a range of one start all of a group do, so the rounds end after log2(length - gram) at most."""
    cols = rows.columns
    ready, counted = [], []
    lo, hi = F.col("lo"), F.col("hi")
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    around = lambda before, behind: F.concat(F.substring("left", -before, before), F.substring("right", F.lit(1), behind))
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    while True:
        middle = F.floor((lo + hi) / 2).cast("int")
        half = F.explode(F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), hi.alias("hi"))))
        halves = rows.withColumn("half", half).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half")
        halves = halves.where((lo <= hi) & (n_left >= lo) & (n_right >= length - hi))
        whole = F.unhex(F.md5(F.concat(F.encode(F.format_string("%d|", F.least(hi, n_left)), "utf-8"), around(hi, length - lo))))
        halves = stored(halves.withColumns({"hash": F.xxhash64("hash", "lo", around(lo, length - hi)), "whole": whole}), "halves")
        same = halves.groupBy("hash", "lo", "hi", "whole").agg(F.count("*").alias("equal"), F.min(F.struct("key", "place", "single", "left", "right")).alias("a"))
        several = same.where("equal > 1").select("hash", "whole")
        counted.append(halves.join(several, ["hash", "whole"], "left_semi").select("key", (F.col("place") - F.least(hi, n_left)).alias("start"), (F.col("place") + F.least(length - lo, n_right)).alias("end")))
        one = stored(same.select("hash", "lo", "hi", "a.key", "a.place", (F.col("a.single") & (F.col("equal") == 1)).alias("single"), "a.left", "a.right"), "split")
        sized = one.join(one.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "hash")
        ready.append(sized.where(F.col("n") <= at_once).select(cols))
        rows = sized.where(F.col("n") > at_once).select(*cols, "lo", "hi")
        if not rows.limit(1).count():
            return reduce(DataFrame.unionAll, ready), reduce(DataFrame.unionAll, counted)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """key, start, end: bytes of distinct texts that a repeated string covers, in pieces that may overlap."""
    reach = length - gram
    rows = stored(anchor_rows(docs, length, gram).distinct(), "anchors")
    kinds = rows.groupBy("hash", "around").agg(F.count("*").alias("equal")).withColumn("part", F.expr(f"cast(pmod(around, {PARTS}) as int)"))
    # A common gram has very many surroundings. They are dealt into PARTS, and the totals of a gram go to the parts that it has.
    shared = kinds.groupBy("hash").agg(F.sum("equal").alias("total"), F.count("*").alias("kinds"), F.expr("bit_or(shiftleft(1L, part))").alias("parts")).where("total > 1")
    shared = shared.select("hash", "kinds", F.explode(F.expr(f"filter(sequence(0, {PARTS - 1}), p -> getbit(parts, p) = 1)")).alias("part"))
    told = kinds.join(shared.hint("merge"), ["hash", "part"]).drop("part")
    members = stored(rows.join(told.hint("merge"), ["hash", "around"]), "shared_anchors")
    start, end = F.greatest(F.col("place") - reach, F.lit(0)), F.least(F.col("place") + length, F.col("n_bytes"))
    counted = members.where("equal > 1").select("key", start.alias("start"), end.alias("end"))

    def several(which: Column) -> DataFrame:
        one = members.where(which).groupBy("hash", "around").agg(F.min(F.struct("key", "place", (F.col("equal") == 1).alias("single"))).alias("a"))
        wanted = one.groupBy(F.col("a.key").alias("key")).agg(F.collect_list(F.struct("hash", F.col("a.place").alias("place"), F.col("a.single").alias("single"))).alias("anchors"))
        return surroundings(docs, wanted, length, gram)

    around = several((F.col("kinds") > 1) & (F.col("kinds") <= at_once))
    hot = F.col("kinds") > at_once
    if members.where(hot).limit(1).count():
        ready, known = split_hot(several(hot), length, gram, at_once)
        around, counted = around.unionAll(ready), counted.unionAll(known)
    sorted_ = around.repartition("hash").sortWithinPartitions("hash")
    return counted.unionAll(sorted_.mapInArrow(repeats_of_groups(length, gram), "key binary, start long, end long"))


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end of each maximal removed run)."""
    pieces = stored(repeated_spans(docs, length, gram, at_once).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("pieces")), "pieces")
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    slim = slim.withColumn("key", F.unhex(F.substring("digest", 1, 32)))
    copies = slim.where(F.octet_length("text") >= length).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    marks = pieces.join(copies, "key", "full_outer").select("key", "pieces", F.col("rows").isNotNull().alias("whole"))
    marked = slim.join(marks, "key", "left").select("doc_id", "text", "digest", "pieces", F.coalesce("whole", F.lit(False)).alias("whole"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            out = []
            for text, digest, pieces, whole in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                raw = text.encode()
                spans: list[list[int]] = [[0, len(raw)]] if whole else []
                for piece in [] if whole else pieces or []:
                    if spans and piece["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], piece["end"])
                    else:
                        spans.append([piece["start"], piece["end"]])
                if spans:
                    kept = hashlib.sha256()
                    for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)]):
                        kept.update(raw[a:b])
                    digest = kept.hexdigest()
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), digest, [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
