"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items are compared as lower-case tokens. An item is tried on a document only where
both share a run of five tokens. Then the longest unmarked common run is marked again and again, down to runs of five;
runs are found by Karp-Rabin hashes over unmarked tokens and compared. Tiles may come in any order, so passages whose parts
were moved about are still found. A document is contaminated if tiles cover at least the given share of an item.

The benchmark is a stated query set: it is taken in blocks of bounded size, and every block is held against all
documents in one pass without a shuffle.

Defined cases: null and empty texts match nothing; an item of fewer than five tokens is never matched; items without
an id are held against all documents too and reported with a null item_id; repeated items are reported once, repeated
documents each; runs of equal length are tiled in order of their place in the item, then in the document; very long
texts are tiled whole; an empty benchmark leaves all documents clean, an empty table gives no rows; other columns are not
read, and `decontaminated` returns them as they are. A block holds about BLOCK_BYTES of benchmark text, so a benchmark of
n times as much costs n looks at each document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import n_bytes, sliced

LEAST_MATCH = 5
COVERAGE = 0.5
#: Text of the benchmark that one pass holds, about.
BLOCK_BYTES = 4 << 20
TOKEN = re.compile(r"\w+")
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def prefixes(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all beginnings of ids, modulo 2 ** 64."""
    h = 0
    out = [0]
    for token in ids.tolist():
        h = (h * _BASE + token + 2) & _MASK
        out.append(h)
    return np.array(out, np.uint64)


class Side:
    """One side of a tiling: its tokens, which of them are taken, and the hashes of its runs."""

    def __init__(self, ids: Sequence[int], powers: np.ndarray):
        self.ids = np.asarray(ids, np.int64)
        self.taken = self.ids < 0
        self.prefix, self.powers = prefixes(self.ids), powers

    def free(self) -> int:
        """Tokens of the longest free run."""
        return int(np.diff(np.flatnonzero(np.concatenate([[True], self.taken, [True]]))).max()) - 1

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of `size` free tokens, and their hashes."""
        marked = np.concatenate([[0], np.cumsum(self.taken)])
        at = np.flatnonzero(marked[size:] == marked[:-size])
        return at, self.prefix[at + size] - self.prefix[at] * self.powers[size]


def shared(a: Side, b: Side, size: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Starts in a, in order, of free runs of `size` tokens that b has free as well, and by start their places in b. Hashes
    find them, tokens decide; equal runs of a share one list."""
    (at_a, hash_a), (at_b, hash_b) = a.runs(size), b.runs(size)
    at_a, hash_a = at_a[(hit := np.isin(hash_a, hash_b))], hash_a[hit]
    at_b, hash_b = at_b[(hit := np.isin(hash_b, hash_a))], hash_b[hit]
    order = np.argsort(hash_b, kind="stable")
    at_b, hash_b = at_b[order], hash_b[order]
    by_text: dict[bytes, list[int]] = {}
    places = {}
    for i, lo, hi in zip(at_a.tolist(), np.searchsorted(hash_b, hash_a).tolist(), np.searchsorted(hash_b, hash_a, "right").tolist()):
        text = a.ids[i : i + size].tobytes()
        if text not in by_text:
            by_text[text] = [j for j in at_b[lo:hi].tolist() if b.ids[j : j + size].tobytes() == text]
        if by_text[text]:
            places[i] = by_text[text]
    return at_a, places


def tiles(a: Sequence[int], b: Sequence[int], least: int = LEAST_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of a by runs of b: (length, start in a, start in b), longest first, never overlapping. Negative
    tokens match nothing.

    The longest common free length is found by halving, as a run of n tokens holds one of n - 1; then all tiles of that
    length are marked, by place in a, then in b. A length is looked at once, and tiles of different lengths are few (their
    sum is at most the shorter text), so texts that repeat one word cost no more than others."""
    longest = min(len(a), len(b))
    powers = np.ones(longest + 1, np.uint64)
    if longest:
        powers[1:] = np.uint64(_BASE)
        powers = np.multiply.accumulate(powers)
    left, right = Side(a, powers), Side(b, powers)
    out = []
    while (longest := min(longest, left.free(), right.free())) >= least:
        low, high = least - 1, longest  # low tokens are shared (or fewer than least), more than high are not
        while low < high:
            size = high if high == longest else (low + high + 1) // 2  # whole passages are common: try them first
            if common(left, right, size):
                low = size
            else:
                high = size - 1
        if low < least:
            break
        starts, places = shared(left, right, low)
        used: dict[int, int] = {}  # by list of places, how many are spent
        for i in starts.tolist():
            found = places.get(i, ())
            if left.taken[i : i + low].any():
                continue
            k = used.get(id(found), 0)
            while k < len(found) and right.taken[found[k] : found[k] + low].any():
                k += 1
            used[id(found)] = k
            if k < len(found):
                out.append((low, i, found[k]))
                left.taken[i : i + low] = True
                right.taken[found[k] : found[k] + low] = True
        longest = low - 1
    return out


def common(a: Side, b: Side, size: int) -> bool:
    """Whether both sides have a free run of `size` tokens in common."""
    (at_a, hash_a), (at_b, hash_b) = a.runs(size), b.runs(size)
    both, first_a, first_b = np.intersect1d(hash_a, hash_b, return_indices=True)
    if any(a.ids[i : i + size].tobytes() == b.ids[j : j + size].tobytes() for i, j in zip(at_a[first_a].tolist(), at_b[first_b].tolist())):
        return True
    return bool(len(both)) and bool(shared(a, b, size)[1])  # different runs of one hash: look at all of them


class Block:
    """A block of items, ready for lookups: the ids of its words, and where its runs of LEAST_MATCH tokens stand."""

    def __init__(self, items: Sequence[tuple[object, str]]):
        self.word: dict[str, int] = {}
        self.items = [(key, [self.word.setdefault(w, len(self.word)) for w in ws]) for key, text in items if len(ws := tokens(text)) >= LEAST_MATCH]
        self.seeds: dict[tuple[int, ...], dict[int, list[int]]] = {}
        for at, (_, ids) in enumerate(self.items):
            for i in range(len(ids) - LEAST_MATCH + 1):
                self.seeds.setdefault(tuple(ids[i : i + LEAST_MATCH]), {}).setdefault(at, []).append(i)

    def matches(self, text: str | None, coverage: float) -> list[tuple[object, int, int, int]]:
        """(item, its words, words tiled, tiles) of each item that is covered well enough."""
        if not self.items:
            return []
        known = self.word.get
        words = tokens(text)
        ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        inside = ids >= 0
        if inside.sum() < LEAST_MATCH:
            return []
        run = inside[: len(ids) - LEAST_MATCH + 1].copy()
        for k in range(1, LEAST_MATCH):
            run &= inside[k : len(ids) - LEAST_MATCH + 1 + k]
        grams = defaultdict(list)  # the document's seeds, each with its places
        for j in np.flatnonzero(run).tolist():
            if (gram := tuple(ids[j : j + LEAST_MATCH].tolist())) in self.seeds:
                grams[gram].append(j)
        in_item, having = defaultdict(set), defaultdict(list)
        for gram in grams:
            for at, places in self.seeds[gram].items():
                having[at].append(gram)
                for i in places:
                    in_item[at].update(range(i, i + LEAST_MATCH))
        out = []
        for at, covered in in_item.items():
            key, item = self.items[at]
            if len(covered) < coverage * len(item):  # tiles lie inside the seeds' runs
                continue
            starts = np.concatenate([np.array(grams[gram]) for gram in having[at]])
            inside = np.unique(starts[:, None] + np.arange(LEAST_MATCH))
            gap = np.flatnonzero(np.diff(inside) > 1) + 1
            part = np.insert(ids[inside], gap, -1)
            found = tiles(item, part)
            n = sum(m[0] for m in found)
            if n >= coverage * len(item):
                out.append((key, len(item), n, len(found)))
        return out


def blocks(benchmark: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The distinct items in blocks of about most_bytes; one block at a time passes through the driver."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(n_bytes(F.col("text")))).first()[0] or 0
    n = total // most_bytes + 1
    for k in range(n if total else 0):
        yield sorted(((r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()), key=lambda r: (r[0] is not None, r[0], r[1]))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, item_words, tiled_words, n_tiles, coverage: a row for each document and item at or above coverage."""
    kinds = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, item_words long, tiled_words long, n_tiles long, coverage double"
    slim = docs.select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for rows in blocks(benchmark):
        out = out.unionAll(slim.mapInArrow(_pairs(docs.sparkSession.sparkContext.broadcast(rows), coverage, benchmark), schema))
    return out


def _pairs(items, coverage: float, benchmark: DataFrame):
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items.value)
        for batch in sliced(batches, "text"):
            rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in block.matches(t, coverage)]
            if rows:
                at, item, words, n, many = zip(*rows)
                share = [x / y for x, y in zip(n, words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(item, item_kind), *(pa.array(x, pa.int64()) for x in (words, n, many)), pa.array(share, pa.float64())],
                    names=["doc_id", "item_id", "item_words", "tiled_words", "n_tiles", "coverage"],
                )

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, with their columns as they were."""
    at_text = docs.columns.index("text")

    def keeps(items):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(items.value)
            for batch in sliced(batches, "text"):
                yield batch.filter(pa.array([not block.matches(t, coverage) for t in batch.column(at_text).to_pylist()], pa.bool_()))

        return run

    for rows in blocks(benchmark):
        docs = docs.mapInArrow(keeps(docs.sparkSession.sparkContext.broadcast(rows)), docs.schema)
    return docs
