"""Token counts by rank-synchronous merging.

The pre-tokens of a batch are held as one ragged numpy array of symbols. In each round every pre-token applies its own
lowest-ranked pair, at all its places at once, until none has a pair with a rank; the symbols that survive are its
tokens. A pair made by a merge always ranks after that merge, so the order is that of one merge at a time.

Defined cases: a null text counts as the empty text, with no token; a special string inside a text is one token, as in
the library's default; only the key and the text are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Pre-tokens whose counts a worker remembers; when so many are held it starts anew.
REMEMBERED = 400_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A byte-level BPE vocabulary as arrays: the symbol of each byte, and ranked pairs in order of their key."""

    def __init__(self, spec: str, pattern: str):
        raw = json.loads(spec)
        vocab = raw["model"]["vocab"]
        self.width = max(vocab.values()) + 1
        self.symbol = np.zeros(256, np.int32)
        for letter, byte in byte_letters().items():
            self.symbol[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.first = self.pair_rank(np.repeat(self.symbol, 256), np.tile(self.symbol, 256))
        special = sorted((t["content"] for t in raw["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE).astype(np.int32)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token; none may be empty."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = size.copy()
        word = np.repeat(np.arange(len(words)), size)
        symbol = self.symbol[raw]
        rank = np.full(len(raw), NONE, np.int32)
        same = word[:-1] == word[1:]
        rank[:-1][same] = self.first[raw[:-1][same].astype(np.int32) * 256 + raw[1:][same]]
        while len(word):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[start, len(word)])
            low = np.minimum.reduceat(rank, start)
            if (done := low == NONE).any():  # these pre-tokens are finished
                out[word[start[done]]] = length[done]
                stay = np.repeat(~done, length)
                word, symbol, rank = word[stay], symbol[stay], rank[stay]
                low, length = low[~done], length[~done]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            if len(hit) > 1 and (hit[1:] - hit[:-1] == 1).any():  # in a run such as aaa, every second pair from its left
                head = np.r_[True, hit[1:] - hit[:-1] != 1]
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(word), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1  # where the merged symbols come to stand
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            touched = np.concatenate([new, new[new > 0] - 1])
            touched = touched[touched < len(word) - 1]
            joined = word[touched] == word[touched + 1]
            rank[touched[~joined]] = NONE
            rank[touched[joined]] = self.pair_rank(symbol[touched[joined]], symbol[touched[joined] + 1])
            rank[-1] = NONE
        return out

    def count_texts(self, texts: list[str]) -> np.ndarray:
        pieces: list[str] = []
        ends, extra = [], []
        for text in texts:
            n_special = 0
            if self.special is not None and (found := self.special.findall(text)):
                n_special = len(found)
                for part in self.special.split(text):
                    pieces += self.pattern.findall(part)
            else:
                pieces += self.pattern.findall(text)
            ends.append(len(pieces))
            extra.append(n_special)
        known = self.known
        if fresh := list(set(pieces).difference(known)):
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = list(set(pieces))
            known.update(zip(fresh, self.counts([w.encode() for w in fresh]).tolist(), strict=True))
        each = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        total = np.r_[0, np.cumsum(each)][np.r_[0, ends]]
        return np.diff(total) + extra


@lru_cache(2)
def merges(spec: str, pattern: str) -> Merges:
    return Merges(spec, pattern)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit. vocabulary: path on the driver of a byte-level BPE file; its content (the size
    of one vocabulary) is broadcast, so executors need no such file."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(spec.value, pattern)
        for batch in sliced(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = bpe.count_texts(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", key)
