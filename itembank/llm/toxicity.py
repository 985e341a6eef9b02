"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon of word beginnings is learned from labelled rows: those that far more toxic than clean documents hold. Features
are densities of lexicon words, as written and after undoing obfuscation (digits and signs for letters, letters set apart,
stretched letters), how near they stand to a second-person pronoun, and rates of capitals, punctuation and obfuscation.
Trees are boosted on these; the score is a probability, from an isotonic fit of scores that a row's own label did not
shape: lexicon, trees and scores of each training row come from the other folds.

Every feature is a sum over the tokens of a text (runs between white space), so texts of any length are whole, and a
batch is scored by array operations. Rows whose crc32(id) mod 4 is HELD_OUT are never learned from.

Defined cases: a null or blank text has no tokens and gets a score as any other; null labels, and labels without a
document, are not used; an id labelled several times takes its highest label; a repeated id or text may stand in the
sample once or more, by its rows; without labels of both kinds every score is 0; an empty table gives no rows; columns
other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

HELD_OUT = 2
#: Labelled rows of each kind that learning uses at most, first by a hash of their id.
MAX_LABELLED = 2500
#: Entries of the lexicon at most, the surest first.
MAX_ENTRIES = 5000
FOLDS = 4
PREDICT_AT = 0.3
SHORTEST, LONGEST = 4, 10
#: A token is split for features up to this length; of longer ones (no words) only rates are taken.
LONG_TOKEN = 60
REMEMBERED = 500_000
NEAR = 6

# Second-person pronouns of the languages met, and letters that signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves ya u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros os vuestro vuestra".split()
)
SIGNS = str.maketrans("013457@$€", "oieastase")
WORD = regex.compile(r"\p{L}+")
INSIDE = regex.compile(r"(?<=\p{L})[^\p{L}\s'’-]+(?=\p{L})")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
EDGE = "\"'.,;:()[]{}<>…“”‘’«»!?¡¿"

FEATURES = (
    "hits", "weight", "strong", "disguised", "disguised_weight", "second_person", "near_second_person", "capitals", "shouted", "exclaimed", "asked", "punctuation", "mixed", "stretched", "starred", "spaced",
    "log_hits", "log_strong", "log_near", "most", "log_tokens", "mean_length",
)
_PER_TOKEN = 16  # of these, the first are sums over tokens


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)]


def plain_forms(token: str) -> tuple[str, str]:
    """A token in lower case without marks at its edges, and with obfuscation undone."""
    low = token.strip(EDGE).lower()
    undone = STRETCHED.sub(r"\1", INSIDE.sub("", low.translate(SIGNS)))
    return low, undone


class TokenTable:
    """Properties of tokens, each worked out once: a growing array with a row a token."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.at = lexicon, {}
        self.openings = {b[:SHORTEST] for b in lexicon}
        self.rows = np.zeros((1 << 12, _PER_TOKEN + 1), np.float32)

    def weight(self, word: str) -> float:
        known, openings = self.lexicon, self.openings
        return max((known.get(b, 0.0) for piece in WORD.findall(word) if piece[:SHORTEST] in openings for b in beginnings(piece)), default=0.0)

    def describe_word(self, token: str, body: str) -> list[float]:
        """As describe, for a token that is letters between marks, none of them stretched."""
        low = body.lower()
        own = max((self.lexicon.get(b, 0.0) for b in beginnings(low)), default=0.0) if low[:SHORTEST] in self.openings else 0.0
        n, size = len(body), len(token)
        upper = 0 if low == body else sum(map(str.isupper, body))
        exclaimed, asked = (token.count("!"), token.count("?")) if size > n else (0, 0)
        return [own > 0, own, own >= 3, 0, 0, low in SECOND_PERSON, 0, upper / n, upper >= 2 and upper == n, exclaimed, asked, (size - n) / size, 0, 0, 0, 0, size]

    def describe(self, token: str) -> list[float]:
        body = token.strip(EDGE)
        if body.isalpha() and len(token) <= LONG_TOKEN and not STRETCHED.search(body.lower()):
            return self.describe_word(token, body)
        letters = [c for c in token if c.isalpha()]
        upper = sum(map(str.isupper, letters))
        signs = len(token) - len(letters) - sum(map(str.isdigit, token))
        own = again = 0.0
        low = token
        if len(token) <= LONG_TOKEN:
            low, undone = plain_forms(token)
            own = self.weight(low)
            again = self.weight(undone) if undone != low and not own else 0.0
        starred = "*" in body and bool(letters)
        mixed = bool(letters) and (any(map(str.isdigit, body)) or any(c in body for c in "@$€"))
        weight = max(own, again)
        return [
            weight > 0, weight, weight >= 3, again > 0, again, low in SECOND_PERSON, 0.0, upper / max(len(letters), 1), upper >= 2 and upper == len(letters), token.count("!"), token.count("?"), signs / max(len(token), 1),
            mixed, bool(STRETCHED.search(low)) if len(token) <= LONG_TOKEN else False, starred, 0.0, len(token),
        ]

    def index(self, tokens: list[str]) -> np.ndarray:
        at = self.at
        if fresh := set(tokens).difference(at):
            if len(at) + len(fresh) > REMEMBERED:
                at.clear()
                fresh = set(tokens)
            need = len(at) + len(fresh)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), _PER_TOKEN + 1), np.float32)
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            self.rows[len(at) : need] = [self.describe(t) for t in fresh]
            at.update(zip(fresh, range(len(at), need), strict=True))
        return np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))


def joined_letters(tokens: list[str]) -> list[str]:
    """Words from runs of three and more tokens of one letter each."""
    out, run = [], []
    for t in [*tokens, "  "]:
        if len(t) == 1 and t.isalpha():
            run.append(t)
        elif run:
            if len(run) >= 3:
                out.append("".join(run).lower())
            run = []
    return out


def text_features(texts: list[str], table: TokenTable) -> np.ndarray:
    """A row of FEATURES for each text."""
    tokens = [t.split() for t in texts]
    count = np.fromiter(map(len, tokens), np.int64, len(texts))
    out = np.zeros((len(texts), len(FEATURES)))
    if not count.sum():
        return out
    flat = [t for ts in tokens for t in ts]
    if len(set(flat)) <= REMEMBERED:
        at = table.index(flat)  # may move the table's rows
        of = table.rows[at].astype(np.float64)
    else:
        of = np.array([table.describe(t) for t in flat], np.float64)
    text = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(flat), dtype=np.int64)
    hit, second = of[:, 0] > 0, of[:, 5] > 0
    if hit.any() and second.any():
        at = place[second]
        after = np.searchsorted(at, place[hit])
        gap = np.full(hit.sum(), NEAR + 1)
        for neighbour in (np.maximum(after - 1, 0), np.minimum(after, len(at) - 1)):
            same = text[at[neighbour]] == text[place[hit]]
            gap = np.where(same, np.minimum(gap, np.abs(at[neighbour] - place[hit])), gap)
        of[hit, 6] = gap <= NEAR
    sums = np.stack([np.bincount(text, of[:, k], len(texts)) for k in range(_PER_TOKEN + 1)], 1)
    if ((of[:, _PER_TOKEN] == 1) & (of[:, 11] == 0)).sum() >= 3:
        for i, ts in enumerate(tokens):
            for word in joined_letters(ts):
                if w := table.weight(word):
                    sums[i, [0, 1, 3, 4, 15]] += [1, w, 1, w, 1]
    some = np.maximum(count, 1)[:, None]
    out[:, :_PER_TOKEN] = sums[:, :_PER_TOKEN] / some
    out[:, 16:19] = np.log1p(sums[:, [0, 2, 6]])
    most = np.zeros(len(texts))
    np.maximum.at(most, text, of[:, 1])
    out[:, 19], out[:, 20], out[:, 21] = most, np.log1p(count), sums[:, _PER_TOKEN] / some[:, 0]
    return out


@dataclass(frozen=True)
class Tree:
    """Complete binary tree: features and thresholds of its inner nodes by level, then the values of its leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.value).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - len(self.feature)]


def grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, penalty: float = 1.0) -> Tree:
    """One tree on binned features: at each node the split of the largest gain in g²/h. A node without one keeps its rows left."""
    inner = (1 << depth) - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node, width = np.zeros(len(g), np.int64), max(len(e) for e in edges) + 1
    for level in range(depth):
        first, n = (1 << level) - 1, 1 << level
        best, split = np.full(n, 1e-6), np.full(n, -1)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            cell = (node - first) * width + bins[:, f]
            gl = np.bincount(cell, g, n * width).reshape(n, width).cumsum(1)
            hl = np.bincount(cell, h, n * width).reshape(n, width).cumsum(1)
            gt, ht = gl[:, -1:], hl[:, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            at = gain[:, : len(e)].argmax(1)
            top = gain[np.arange(n), at]
            wins = top > best
            best[wins], split[wins] = top[wins], at[wins]
            feature[first : first + n][wins], threshold[first : first + n][wins] = f, e[at[wins]]
        cut = split[node - first]
        node = 2 * node + 1 + ((cut >= 0) & (bins[np.arange(len(g)), feature[node]] > cut))
    leaf = node - inner
    value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
    return Tree(feature, threshold, value)


def boosted(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, n_bins: int = 32) -> tuple[float, list[Tree]]:
    """Start value and trees of a logistic boosting by Newton steps; `share` weighs rows."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    p = (share * y).sum() / share.sum()
    start = float(np.log(p / (1 - p)))
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(bins, edges, share * (p - y), share * p * (1 - p), depth)
        tree = Tree(tree.feature, tree.threshold, rate * tree.value)
        trees.append(tree)
        score = score + tree(x)
    return start, trees


def isotonic(score: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores in order and their rising probabilities, one per block (its mean score)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, positives, weighted score
    for i in order:
        blocks.append([share[i], share[i] * y[i], share[i] * score[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    w, pos, at = np.array(blocks).T
    return at / w, pos / w


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    start: float
    trees: list[Tree] = field(repr=False)
    at: np.ndarray
    probability: np.ndarray
    flat: float = 0.02

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(t(x) for t in self.trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The isotonic probability, straight between blocks; a small share of the logistic one orders rows inside a block."""
        raw = self.raw(x)
        return (1 - self.flat) * np.interp(raw, self.at, self.probability) + self.flat / (1 + np.exp(-np.clip(raw, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """text, toxic, share (rows that each stands for) and fold of at most `most` labelled documents of each kind, none held out."""
    kinds = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("toxic"))
    first = [kinds.where(F.col("toxic") == q).orderBy(F.xxhash64(key), key).limit(most) for q in (0, 1)]
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(FOLDS)).cast("int")
    return docs.select(key, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(first[0].unionAll(first[1])), key).select("text", "toxic", fold.alias("fold"))


def counted_beginnings(sample: DataFrame) -> DataFrame:
    """beginning, and per fold how many clean and toxic documents hold it; only such as five toxic documents hold."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {w for t in set(text.split()) if len(t) <= LONG_TOKEN for w in WORD.findall(t.lower())}
                for b in {b for w in words for b in beginnings(w)}:
                    seen.setdefault(b, [0] * 2 * FOLDS)[2 * fold + toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(2 * FOLDS))], names=["beginning", *(f"n{k}" for k in range(2 * FOLDS))])

    names = [f"n{k}" for k in range(2 * FOLDS)]
    rows = sample.mapInArrow(count, "beginning string, " + ", ".join(f"{n} long" for n in names))
    total = rows.groupBy("beginning").agg(*(F.sum(n).alias(n) for n in names))
    return total.where(sum(F.col(n) for n in names[1::2]) >= 5)


def lexicon_of(beginnings_: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of the beginnings that are surely (by three standard errors) and clearly (three times) the more frequent in toxic documents."""
    odds = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (n_clean - clean + 0.5))
    sure = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    good = np.flatnonzero((sure >= 3) & (odds >= np.log(3)) & (toxic >= 4))
    good = good[np.lexsort((good, -sure[good]))][:MAX_ENTRIES]
    return {beginnings_[i]: float(odds[i]) for i in good}


def train(sample: DataFrame, totals: tuple[int, int]) -> ToxicityModel | None:
    """Learn from labelled_sample(...). totals: clean and toxic labelled rows, of which the sample may hold fewer."""
    # Beginnings in the order of their text, so that ties in certainty fall alike in each run.
    counts = sorted(map(tuple, counted_beginnings(sample).toLocalIterator()))
    words = [c[0] for c in counts]
    by_fold = np.array([c[1:] for c in counts], np.int64).reshape(len(counts), FOLDS, 2)
    size = np.zeros((FOLDS, 2), np.int64)
    for fold, toxic, n in sample.groupBy("fold", "toxic").count().collect():
        size[fold, toxic] = n
    if (size.sum(0) < 10).any():
        return None
    others = [lexicon_of(words, *(by_fold.sum(1) - by_fold[:, k]).T[::-1], *(size.sum(0) - size[k])[::-1]) for k in range(FOLDS)]
    shipped = sample.sparkSession.sparkContext.broadcast(others)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [TokenTable(lexicon) for lexicon in shipped.value]
        for batch in sliced(batches, "text", 4 << 20):
            texts, toxic, fold = (c.to_pylist() for c in batch.columns)
            x = np.zeros((len(texts), len(FEATURES)))
            for k in set(fold):
                mine = [i for i, f in enumerate(fold) if f == k]
                x[mine] = text_features([texts[i] for i in mine], tables[k])
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(list(map(np.ndarray.tobytes, x)))], names=["toxic", "fold", "x"])

    got = sorted(map(tuple, sample.mapInArrow(features, "toxic int, fold int, x binary").toLocalIterator()))
    y, fold = np.array([g[0] for g in got], np.float64), np.array([g[1] for g in got])
    x = np.stack([np.frombuffer(g[2]) for g in got])
    share = np.where(y == 1, totals[1] / max(y.sum(), 1), totals[0] / max((1 - y).sum(), 1))
    share /= share.mean()
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        part = fold == k
        if part.any():
            start, trees = boosted(x[~part], y[~part], share[~part])
            unseen[part] = start + sum(t(x[part]) for t in trees)
    at, probability = isotonic(unseen, y, share)
    start, trees = boosted(x, y, share)
    return ToxicityModel(lexicon_of(words, *by_fold.sum(1).T[::-1], *size.sum(0)[::-1]), start, trees, at, probability)


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> ToxicityModel | None:
    known = labels.where(F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(label).alias("kind")).count()
    totals = {row.kind: row["count"] for row in known.where("kind in (0, 1)").collect()}
    return train(labelled_sample(docs, labels, key, label), (totals.get(0, 0), totals.get(1, 0)))


def toxicity_scores(docs: DataFrame, model: ToxicityModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted, and lexicon_words (tokens that the lexicon knows)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        table = TokenTable(known.lexicon if known else {})
        for batch in sliced(batches, "text", 4 << 20):
            x = text_features([t or "" for t in batch.column(2).to_pylist()], table)
            score = known.score(x) if known else np.zeros(len(x))
            words = np.rint(np.expm1(x[:, FEATURES.index("log_hits")])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= PREDICT_AT).astype(np.int32)), pa.array(words)], names=["doc_id", "held_out", "score", "predicted", "lexicon_words"]
            )

    slim = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(rows, f"doc_id {kind}, held_out boolean, score double, predicted int, lexicon_words long").withColumnRenamed("doc_id", key)
