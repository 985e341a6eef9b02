"""Quality rules: word counts and a hashed n-gram logistic regression.

Base counts are exact. The verdict on what passes them is a logistic regression over hashed word 1- and 2-grams and
character 2- and 3-grams, trained on rows labelled for quality, calibrated on labelled rows left out of training, and
applied in Arrow batches against a fixed probability. Features are relative frequencies, so a document's score is the
mean weight of its n-grams, and length does not matter.

Defined cases: a null or blank text has no words and fails the base rules; labels that are null, or whose document is
missing, are not used; an id labelled several times takes its lowest label; of different texts under one labelled id
the model learns the one whose frequencies come first as bytes; repeated rows and ties are scored each by itself, so
alike; very long texts are counted and scored whole; without labels of both kinds every document
that passes the base rules is kept; an empty table gives no rows; other columns are kept by the filter and not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

BITS = 16
FAMILIES = 4  # word 1-grams, word 2-grams, character 2-grams, character 3-grams
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Labelled rows of each kind that training uses at most, first by a hash of their id.
MAX_LABELLED = 1500
#: A document is kept if its calibrated probability of good quality, with both kinds equally likely, is at least this.
KEEP_AT = 0.5
#: Bytes of text whose n-grams are held at once; they take some sixty times as much.
AT_ONCE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # float32, FAMILIES * 2**BITS
    bias: float
    slope: float
    shift: float
    keep_at: float = KEEP_AT

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw + self.bias) + self.shift, -50, 50)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def bucket(code: np.ndarray, family: int) -> np.ndarray:
    return ((code * _MIX) >> np.uint64(64 - BITS)).astype(np.int32) + np.int32(family << BITS)


def ngrams(texts: list[str], words: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: the buckets of all n-grams in order, and how many each text has."""
    count = np.fromiter(map(len, words), np.int64, len(words))
    h = word_hashes([w for ws in words for w in ws])
    yield bucket(h, 0), count
    last = np.cumsum(count)
    whole = np.ones(len(h), bool)
    whole[last[count > 0] - 1] = False
    at = np.flatnonzero(whole)
    yield bucket(h[at] * np.uint64(0x100000001B3) + h[at + 1 if len(at) else at], 1), np.maximum(count - 1, 0)
    count = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    for n in (2, 3):
        code = c[: max(len(c) - n + 1, 0)]
        for j in range(1, n):
            code = code * np.uint64(0x110000) + c[j : len(c) - n + 1 + j]
        whole = np.ones(len(code), bool)
        ends = np.cumsum(count)
        for j in range(1, n):
            cut = ends - j
            whole[cut[(cut >= 0) & (cut < len(code))]] = False
        yield bucket(code[whole], n), np.maximum(count - n + 1, 0)


def per_text(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    ends = np.cumsum(count)
    return (total[ends] - total[ends - count]) / np.maximum(count, 1)


def raw_scores(texts: list[str], words: list[list[bytes]], weights: np.ndarray) -> np.ndarray:
    return sum(per_text(weights[b], n) for b, n in ngrams(texts, words))


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text and their relative frequencies within their family."""
    index, value = [], []
    for b, _ in ngrams([text], [text.encode().split()]):
        at, n = np.unique(b, return_counts=True)
        index.append(at)
        value.append(n / max(len(b), 1))
    return np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)


def repeated_words(words: list[list[bytes]], width: int = 5) -> np.ndarray:
    """Per text, the words inside windows of `width` words that the text has twice or more."""
    out = np.zeros(len(words), np.int64)
    long = [i for i, ws in enumerate(words) if len(ws) > width]
    if not long:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for i in long for w in words[i]), np.int64)
    size = np.array([len(words[i]) for i in long])
    doc = np.repeat(np.arange(len(long)), size)
    n = len(ids) - width + 1
    code = doc[:n].astype(np.uint64)
    for j in range(width):
        code = (code ^ (code >> np.uint64(29))) * _MIX + ids[j : n + j].astype(np.uint64)
    order = np.argsort(code, kind="stable")
    order = order[doc[order] == doc[order + width - 1]]
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((code[a] == code[b]) & (doc[a] == doc[b]))
    a, b = a[near], b[near]
    equal = np.ones(len(a), bool)
    for j in range(width):
        equal &= ids[a + j] == ids[b + j]
    cover = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    out[long] = np.bincount(doc, np.cumsum(cover[:-1]) > 0, len(long)).astype(np.int64)
    return out


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """text and quality of at most `most` labelled documents of each kind. The sample of ids is bounded, so it is broadcast."""
    kinds = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    first = [kinds.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(first[0].unionAll(first[1])), "doc_id")


def calibrated(raw: np.ndarray, target: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift: smoothed targets, and Newton's steps halved until the loss falls."""
    good, bad = target.sum(), (1 - target).sum()
    goal = np.where(target == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = raw.std() or 1.0
    x = np.stack([raw / spread, np.ones_like(raw)])

    def loss(c: np.ndarray) -> float:
        z = c @ x
        return float((share * (np.logaddexp(0, z) - goal * z)).sum())

    c, now = np.zeros(2), loss(np.zeros(2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(c @ x, -50, 50)))
        step = np.linalg.solve((x * (share * p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (share * (p - goal)))
        while (after := loss(c - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - after < 1e-12:
            break
        c, now = c - step, after
    return float(c[0] / spread), float(c[1])


def train(sample: DataFrame, rounds: int = 60, penalty: float = 1e-4) -> QualityModel | None:
    """Fit on four fifths of the sample, calibrate (by a line through the logit) on the rest. Texts become frequencies
    in tasks; the driver holds the frequencies of the bounded sample."""

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                index, value = frequencies(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([index.tobytes()]), pa.array([value.tobytes()]), batch.column(2).slice(i, 1)], names=["doc_id", "index", "value", "quality"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    label = sample.schema["quality"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "quality").mapInArrow(features, f"doc_id {kind}, index binary, value binary, quality {label}")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("index", "value", "quality")).alias("r")).select("doc_id", "r.*")
    got = sorted(one.toLocalIterator(), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))
    y = np.array([r[3] for r in got], np.float64)
    held = np.arange(len(y)) % 5 == 4
    if any(len(set(y[part])) < 2 for part in (held, ~held)):
        return None
    index = [np.frombuffer(r[1], np.int32) for r in got]
    value = [np.frombuffer(r[2], np.float32) for r in got]
    del got

    def joined(part: np.ndarray) -> tuple[np.ndarray, ...]:
        rows = np.flatnonzero(part)
        size = np.array([len(index[i]) for i in rows])
        return np.concatenate([index[i] for i in rows]), np.concatenate([value[i] for i in rows]), np.repeat(np.arange(len(rows)), size), y[part]

    scale = 100.0
    at, v, row, target = joined(~held)
    v = v * np.float32(scale)
    share = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
    w, bias = np.zeros(FAMILIES << BITS, np.float64), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam over all rows of the sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v * w[at], len(target)) + bias, -50, 50)))
        miss = share * (p - target)
        g = np.bincount(at, v * miss[row], len(w)) + penalty * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * miss.sum(), 0.99 * sb + 0.01 * miss.sum() ** 2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
        bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-6)
    w *= scale
    at, v, row, target = joined(held)
    raw = np.bincount(row, v * w[at], len(target)) + bias
    share = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
    a, b = calibrated(raw, target, share)
    return QualityModel(w.astype(np.float32), float(bias), float(a), float(b))


def quality_rows(docs: DataFrame, model: QualityModel | None, kept_only: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, probability, kept; or, with kept_only, the documents kept, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped.value
        for batch in sliced(batches, "text", AT_ONCE):
            texts = [t or "" for t in batch.column(at_text).to_pylist()]
            words = [t.encode().split() for t in texts]
            n = np.fromiter(map(len, words), np.int64, len(words))
            repeats = repeated_words(words)
            failed = (n < 10) | (100 * repeats > 20 * n)
            p = fitted.probability(raw_scores(texts, words, fitted.weights)) if fitted else np.ones(len(n))
            kept = ~failed & (p >= fitted.keep_at if fitted else True)
            if kept_only:
                yield batch.filter(pa.array(kept))
                continue
            longs = [n, [len(t) - sum(map(t.count, SPACE)) for t in texts], [sum(map(t.count, SYMBOLS)) for t in texts], list(map(duplicate_lines, texts)), repeats]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at_id), *(pa.array(x, pa.int64()) for x in longs), pa.array(failed), pa.array(kept), pa.array(p, pa.float64())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, docs.schema if kept_only else f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the classifier, with their columns as they were."""
    return quality_rows(docs, train(labelled_sample(docs, labels)), kept_only=True)
