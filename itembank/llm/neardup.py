"""Near-duplicate classes by DartMinHash.

A text is a multiset of five-word shingles (all its words if it has fewer), weighted by how often each occurs. Darts are
thrown by hash into regions of each element: a region spans a range of weights and a range of ranks and gets a
Poisson-distributed number of darts, each with a weight, a rank and one of K coordinates. A text sees the darts below
its weights and keeps the earliest of each coordinate. Two signatures agree in a coordinate with probability equal to
the weighted Jaccard similarity. Agreeing bands of coordinates put texts into buckets; texts of a bucket whose exact
similarity reaches the threshold are linked, and linked texts form classes.

Pairs of a bucket are not listed. First each text is held against its bucket's leader, the member that meets most texts
over all its buckets, which joins a group of copies around their origin: one pair per text and leader. Then, only where a
bucket still holds several classes, the texts outside its largest class are held against its members, block by block
inside a task: sketches of one byte a coordinate sort out what cannot be similar, and only links leave the task. Blocks
hold BLOCK members at most on average, so a bucket of any size spreads over tasks. Every two texts that share a bucket are
so either in one class or compared: no link is lost.

Words are named by 64-bit digests and shingles by 64-bit mixes of these; links are checked on these names.

Defined cases: null is the empty text; equal texts share a class; texts without words are linked to equal texts only;
repeated rows are members each; class ids are the least doc_id of a class (null if it has none); texts as likely to
lead are taken by the lower number; very long texts count whole; an empty table gives no rows; extra columns are not
read, and `deduplicated` returns them as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, sliced, stored

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
K = BANDS * ROWS
#: Texts that get their darts at once: some two thousand darts fall to a text however short it is.
SIGNED = 256
#: Members of a bucket that are compared in one task, on average, with as many others.
BLOCK = 512
#: Sketches that agree in a smaller share of coordinates are not compared further. At a similarity of 0.8 the share's
#: standard deviation is 0.026, so 0.66 lies more than five of them below.
SKETCH_LEAST = 0.66
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
#: P(at most m darts) in a region with one expected.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, m + 1), dtype=float) for m in range(18)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def word_codes(words: list[bytes]) -> np.ndarray:
    codes = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in set(words)}
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, weight) of each distinct shingle of each text, by text and code."""
    words = [t.encode().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    code = word_codes([w for ws in words for w in ws])
    text = np.repeat(np.arange(len(n)), n)
    if not len(code):
        return text, code, code.astype(np.int64)
    place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    width = np.minimum(n, WIDTH)[text]
    start = place <= n[text] - width
    h = np.zeros(len(code), np.uint64)
    for j in range(WIDTH):
        use = width > j
        shifted = np.zeros_like(code)
        shifted[: max(len(code) - j, 0)] = code[j:]
        h = np.where(use, mixed(h * _MIX + shifted + np.uint64(1)), h)
    text, h = text[start], h[start]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])])
    return text[new], h[new], np.diff(np.r_[new, len(h)])


def signatures(text: np.ndarray, code: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """n_texts x K: the earliest dart of each coordinate, as the bits of its rank above bits that name it. Any real weights do.
    Texts come in order; SIGNED of them are held at once."""
    starts = np.arange(0, n_texts, SIGNED)
    cuts = np.searchsorted(text, np.r_[starts, n_texts])
    parts = [thrown(text[a:b] - k, code[a:b], weight[a:b], min(SIGNED, n_texts - k)) for k, a, b in zip(starts, cuts, cuts[1:])]
    return np.concatenate(parts) if parts else np.empty((0, K), np.uint64)


def thrown(text: np.ndarray, code: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    out = np.full(n_texts * K, np.iinfo(np.uint64).max, np.uint64)
    norm = np.bincount(text, weight, n_texts)
    live = norm > 0
    low, high = np.zeros(n_texts), np.where(live, K * (np.log(K) + 3) / np.maximum(norm, 1e-300), 0.0)
    while live.any():
        level = 0
        below, span = 0.0, 1.0  # weights [below, below + span)
        chosen = np.flatnonzero(live[text])
        while len(chosen := chosen[weight[chosen] > below]):
            t, c, w = text[chosen], code[chosen], weight[chosen]
            first = np.floor(low[t] * span).astype(np.int64)
            cells = np.ceil(high[t] * span).astype(np.int64) - first
            which = np.repeat(np.arange(len(t)), cells)
            cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells) + first[which]
            region = mixed(c[which] + mixed(cell.astype(np.uint64) * _MIX + np.uint64(level + 1)))
            darts = np.searchsorted(_POISSON, unit(region), side="right")
            m = 1
            while len(have := np.flatnonzero(darts >= m)):
                which, cell, region, darts = which[have], cell[have], region[have], darts[have]
                dart = mixed(region ^ np.uint64(m * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
                rank = (cell + unit(dart)) / span
                other = mixed(dart)
                seen = (rank >= low[t[which]]) & (rank < high[t[which]]) & (below + unit(other) * span < w[which])
                name = mixed(other)
                place = t[which] * K + (name % np.uint64(K)).astype(np.int64)
                value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name >> np.uint64(32))
                np.minimum.at(out, place[seen], value[seen])
                m += 1
            below, span = (1.0, 1.0) if level == 0 else (below * 2, span * 2)
            level += 1
        live &= (out.reshape(n_texts, K) == np.iinfo(np.uint64).max).any(1)  # some coordinate has no dart yet
        low, high = np.where(live, high, low), np.where(live, 2 * high, high)
    return out.reshape(n_texts, K)


def band_codes(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, parts.shape[:2])
    for r in range(ROWS):
        h = mixed(h * _MIX2 + parts[:, :, r])
    return h.view(np.int64)


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def id_text(doc_id: Column) -> Column:
    """doc_id as a string that is never null, so that rows of one text spread over tasks by it."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a digest of the text), bands and sketch (null for texts without words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at, code, weight = shingles(texts)
            signature = signatures(at, code, weight, len(texts))
            codes, sketch = band_codes(signature), (signature & np.uint64(255)).astype(np.uint8)
            has = np.bincount(at, minlength=len(texts)) > 0
            flat = pa.array(codes[has].reshape(-1))
            offsets = np.r_[0, np.cumsum(np.where(has, BANDS, 0))].astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~has))
            keys = pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in texts], pa.binary())
            sketches = pa.array([x.tobytes() if h else None for x, h in zip(sketch, has)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, bands, sketches], names=["doc_id", "key", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, bands array<long>, sketch binary")


def bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, bag: the codes of a text's shingles, 8 bytes each, then their weights, 4 bytes each. wanted: key, first_id, node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            at, code, weight = shingles([t or "" for t in batch.column(1).to_pylist()])
            ends = np.searchsorted(at, np.arange(batch.num_rows + 1))
            packed = [code[x:y].tobytes() + weight[x:y].astype(np.uint32).tobytes() for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "bag"])

    one = docs.select(text_key(F.col("text")).alias("key"), id_text(F.col("doc_id")).alias("id"), "text")
    rows = one.join(wanted.select("key", id_text(F.col("first_id")).alias("id"), "node"), ["key", "id"]).select("node", "text")
    return rows.mapInArrow(run, "node long, bag binary").dropDuplicates(["node"])


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, np.uint64, n), np.frombuffer(bag, np.uint32, n, 8 * n)


def is_similar(x: bytes, y: bytes, similarity: float) -> bool:
    (a, v), (b, w) = unpacked(x), unpacked(y)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(v[i], w[j]).sum())
    return both >= similarity * (int(v.sum()) + int(w.sum()) - both)


def leader_pairs(members: DataFrame) -> DataFrame:
    """a, b: each member and the leaders of its buckets. members: bucket, node, many (members of the bucket)."""
    met = members.groupBy("node").agg(F.sum("many").alias("met"))
    leaders = members.join(met, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("b"))
    return members.select("bucket", F.col("node").alias("a")).join(leaders, "bucket").where("a <> b").select("a", "b").distinct()


def checked(pairs: DataFrame, texts: DataFrame, similarity: float, most: int = 1000) -> DataFrame:
    """Those of pairs (a, b) whose weighted Jaccard similarity over shingles is at least similarity. texts: node, bag. A b
    that many pairs name is dealt over tasks by parts of `most` pairs."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    right = parts.join(texts.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("bag").alias("bag_b"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = dealt.join(texts.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    both = left.join(right, ["b", "part"]).select("a", "b", "bag_a", "bag_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "bag_a", 4 << 20):
            keep = [is_similar(x.as_py(), y.as_py(), similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def block_links(rows: list[dict], similarity: float) -> Iterator[tuple[int, int]]:
    """Links between texts of different classes in one block: rows of role 1 against rows of role 0. Two texts outside the
    largest class (`rest`) meet in both roles, and the lower number reports."""
    left, right = [r for r in rows if r["role"]], [r for r in rows if not r["role"]]
    if not left or not right:
        return
    bucket = rows[0]["bucket"]
    sketch = np.frombuffer(b"".join(r["sketch"] for r in right), np.uint8).reshape(len(right), K)
    bands = np.array([r["bands"] for r in right], np.int64)
    label = np.array([r["label"] for r in right])
    for x in left:
        near = np.flatnonzero((label != x["label"]) & ((sketch == np.frombuffer(x["sketch"], np.uint8)).mean(1) >= SKETCH_LEAST))
        if not len(near):
            continue
        shared = bands[near] == np.array(x["bands"], np.int64)
        first = bands[near, shared.argmax(1)]  # a pair is compared in the first bucket that it shares
        for j in near[first == bucket].tolist():
            y = right[j]
            if (not y["rest"] or x["node"] < y["node"]) and is_similar(x["bag"], y["bag"], similarity):
                yield x["node"], y["node"]


def links_between_classes(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b: links between texts that share a bucket but not a class. members: bucket, node; labels: node, label of each
    member; nodes: node, bands, sketch; texts: node, bag."""
    placed = members.select("bucket", "node").join(labels, "node")
    kinds = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    several = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("n")).where("kinds > 1")
    open_ = placed.join(several, "bucket").withColumns({
        "rows": F.ceil(F.col("n") / block).cast("int"), "others": F.ceil((F.col("n") - F.col("main_n")) / block).cast("int"), "h": F.xxhash64("node"),
        "rest": F.col("label") != F.col("main"),
    })
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    as_row = open_.select("bucket", own("rows").alias("i"), every("others").alias("j"), F.lit(0).alias("role"), "node", "label", "rest")
    as_other = open_.where("rest").select("bucket", every("rows").alias("i"), own("others").alias("j"), F.lit(1).alias("role"), "node", "label", "rest")
    units = as_row.unionAll(as_other).join(nodes.select("node", "bands", "sketch"), "node").join(texts, "node")
    units = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "role", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and (row["bucket"], row["i"], row["j"]) != (held[0]["bucket"], held[0]["i"], held[0]["j"]):
                        yield from block_links(held, similarity)
                        held = []
                    held.append(row)
            if held:
                yield from block_links(held, similarity)

        found = list(links())
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.select("bucket", "i", "j", "role", "node", "label", "rest", "bands", "sketch", "bag").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) lead to. Labels spread to neighbours and jump to their own label's label."""
    both = stored(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        labels_ = labels.select("node", "label")
        near = both.join(labels_.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels_.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels_.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(spread.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        discard(labels)
        labels = new
        if new.where("was <> label").isEmpty():
            discard(both)
            return new.select("node", "label")


def linked_nodes(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key) of every row; nodes (key, node, first_id, n), one per distinct text; labels (node, label) of linked nodes."""
    rows = stored(signed(docs), "signed")
    grouped = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    members = stored(placed.join(shared, "bucket"), "members")
    every = members.select("node").distinct()
    texts = stored(bags(docs, nodes.select("key", "first_id", "node").join(every, "node", "left_semi")), "bags")
    edges = stored(checked(leader_pairs(members), texts, similarity), "links")

    def labelled(edges: DataFrame) -> DataFrame:
        return stored(every.join(components(edges), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")

    labels = labelled(edges)
    more = stored(links_between_classes(members, labels, nodes, texts, similarity, block), "links")
    if not more.isEmpty():
        labels = labelled(edges.unionAll(more))
    discard(members, texts, edges, more)
    return rows.select("doc_id", "key"), nodes.select("key", "node", "first_id", "n"), labels


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, class_size: one row per document."""
    rows, nodes, labels = linked_nodes(docs, similarity, block)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    return rows.join(named.join(classes, "label").select("key", "class_id", "class_size"), "key").select("doc_id", "class_id", "class_size")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with its least doc_id; columns as they were."""
    _, nodes, labels = linked_nodes(docs, similarity)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("best"))
    chosen = named.join(first.select(F.col("best.node").alias("node")), "node").select("key", id_text(F.col("first_id")).alias("id"))
    packed = docs.select(text_key(F.col("text")).alias("key"), id_text(F.col("doc_id")).alias("id"), F.struct(*docs.columns).alias("row"))
    return packed.join(chosen, ["key", "id"]).dropDuplicates(["key", "id"]).select("row.*")
