"""Spelling variants of words, by PartEnum signatures.

A word's letters are a multiset, that is a binary vector with one place for the first, second, ... copy of each letter.
Words that differ by one inserted, deleted or replaced letter have vectors at a Hamming distance of two at most. The
places are partitioned into PARTS by their letter; at a distance of two, all parts but two agree, so two such words share
the vector's projection on some PARTS - 2 parts. Every choice of these parts is enumerated as one signature.

Anagrams have equal vectors, so each signature also holds what the edit leaves alone of the order: the edit falls into one
half of the word, and the other half stands in both words as it is. Halves are cut by the length of the shorter word, so
a word signs once for its own length (it is the shorter, or both are as long) and once for one letter less (it is the
longer). Signatures are equi-joined, and every candidate is verified by its edit distance inside the join, so that a
bucket's pairs are never written out, and no pair within reach is missed.

Defined cases: null texts have no words; a null id counts as the empty string; repeated rows count as often as they
stand there; words of any length are whole; ties between near words of equal frequency go to the smallest in code-point
order; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RUN = r"[A-Za-zÀ-ÿ]"
MIN_LETTERS = 7
MIN_COUNT = 2
#: A near word is a word's form if it occurs at least so many times as often.
TIMES = 10
#: One run in so many loses a letter, by a digest of document and run.
LOSES = 31
PARTS = 4
DISTANCE = 2
#: Letters in the order in which they are dealt to the parts, so that parts of common words are near in size; all other
#: letters go by their code point.
DEALT = "etaoinsrhldcumfpgwybvkxjqz"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy(doc_id: Column, run: Column) -> Column:
    """The run in lower case; in one of LOSES cases without one letter, both chosen by the crc32 of document and run."""
    word = F.translate(run, _UPPER, _LOWER)
    digest = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(digest, F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(digest % LOSES == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of at least MIN_LETTERS letters that occur at least MIN_COUNT times over all texts."""
    runs = docs.select(F.col(key).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{MIN_LETTERS},}}"), F.lit(0))).alias("run"))
    words = runs.select(noisy(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def part_letters() -> list[str]:
    """For each part, a pattern of the letters that do not belong to it."""
    dealt = [DEALT[k::PARTS] for k in range(PARTS)]
    other = [chr(c) for c in range(0xC0, 0x100)]
    return ["[^" + dealt[k] + "".join(c for c in other if ord(c) % PARTS == k) + "]" for k in range(PARTS)]


def signatures(words: DataFrame) -> DataFrame:
    """words with signature and longer: whether the word stands there as the longer of two."""
    others = part_letters()
    rest = F.regexp_replace("word", "[" + DEALT + r"À-ÿ]", "")
    parts = [F.array_join(F.sort_array(F.split(F.concat(F.regexp_replace("word", others[k], ""), rest if k == 0 else F.lit("")), "")), "") for k in range(PARTS)]
    rows = words.select("word", "n", F.array(*parts).alias("parts"), F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    rows = rows.withColumn("length", F.length("word") - F.col("longer").cast("int"))
    half = F.floor(F.col("length") / 2).cast("int")
    intact = [F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.length("word") - (F.col("length") - half) + 1, F.col("length") - half)]
    signed = [
        F.xxhash64(F.col("length"), F.lit(side), intact[side], F.lit(k), *[F.get("parts", F.lit(p)) for p in kept])
        for side in (0, 1) for k, kept in enumerate(combinations(range(PARTS), PARTS - DISTANCE))
    ]
    return rows.select("word", "n", "longer", F.explode(F.array(*signed)).alias("signature"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words that differ by exactly one inserted, deleted or replaced letter."""
    signed = signatures(words)
    a, b = signed.where("not longer").alias("a"), signed.alias("b")
    one_apart = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    met = a.join(b, (F.col("a.signature") == F.col("b.signature")) & (F.col("b.longer") | (F.col("a.word") < F.col("b.word"))) & one_apart)
    pairs = met.groupBy(F.col("a.word").alias("x"), F.col("b.word").alias("y")).agg(F.first("a.n").alias("x_n"), F.first("b.n").alias("y_n"))
    turned = lambda w, n, v, m: F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.col(v).alias("near"), F.col(m).alias("near_n"))
    return pairs.select(F.inline(F.array(turned("x", "x_n", "y", "y_n"), turned("y", "y_n", "x", "x_n"))))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """forms(word, form) with root: forms followed to the last. Each form occurs TIMES as often as its word, so a chain has at
    most log(most) hops, and each round of the join doubles the hops behind it."""
    hops, n = 0, MIN_COUNT
    while n * TIMES <= most:
        hops, n = hops + 1, n * TIMES
    links = forms.withColumn("root", F.col("form"))
    for _ in range(max(hops - 1, 0).bit_length()):
        kept = stored(links, "roots")
        ahead = kept.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = kept.join(ahead, "root", "left").select("word", "form", F.coalesce("beyond", "root").alias("root"))
    return links


def spelling_groups(words: DataFrame) -> DataFrame:
    """words(word, n) with n_near, form, form_n and root. `form` is the near word of largest n, if that is at least TIMES n."""
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"), F.first("n").alias("own"))
    best = best.select("word", "n_near", F.when(-F.col("best")["col1"] >= TIMES * F.col("own"), F.struct(F.col("best")["near"].alias("form"), (-F.col("best")["col1"]).alias("form_n"))).alias("f"))
    best = stored(best.select("word", "n_near", "f.form", "f.form_n"), "near_words")
    forms = best.where("form is not null").select("word", "form")
    most = words.agg(F.max("n")).first()[0] or 0
    rooted = roots(forms, most).select("word", "root")
    rows = words.join(best, "word", "left").join(rooted, "word", "left")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.col("form_n").cast("long").alias("form_n"), F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return spelling_groups(stored(word_counts(docs, key, text), "words"))
