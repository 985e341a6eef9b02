"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions and Spark ML only.

A candidate is a run of 16 or more token characters with a digit in it, or any value of four characters or more that is
assigned to a word like `token` or `password`. Its features are length, counts of character classes, transitions between
them, the share of it that dictionary words cover (words that the corpus uses often), the path of its document (here the
source), and hashes of the neighbouring words.

The forest is trained on labelled findings (path, before, candidate, after, label). The tables at hand hold none, so the
default is `labelled_findings`: written-out forms of secrets and of what is taken for one, each with values drawn from
digests. No label is derived from a document, and each context stands with both labels: `token = "` with a digest and
with a placeholder, forty hexadecimal digits behind `token = "` and behind `commit`. Whoever has labels of their own
passes them instead.

Work is linear in the texts and all but linear in the candidates of a text: places are sums over blocks of the square root
of their number, and no candidate carries the text.

Defined cases: null and empty texts have no candidates; very long texts are read whole; a null source is the path '';
repeated documents and repeated findings are reported each; findings with equal features have equal probability; with
labels of one kind only, each finding has that kind's probability; an empty table gives no rows; only doc_id, text and
source are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import once, settled
from .common import stored

#: Words that are assigned a secret.
ASSIGNED = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "accesskey", "access_key", "auth")
ASSIGNS = rf"(?i)(?:{'|'.join(ASSIGNED)})[ ]{{0,2}}[=:]"
TOKEN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{16,}={0,2}"
#: Either kind. Two short looks back spare the long one at nearly every place.
CANDIDATE = rf"(?<=[=:\"' ])(?<=[=:][ ]{{0,2}}[\"']?)(?<=(?i:{'|'.join(ASSIGNED)})[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?)[^\s\"',;]{{4,}}|{TOKEN}"
#: Labelled findings of each kind that training uses at most, first by a hash.
MAX_LABELLED = 4000
#: A word belongs to the dictionary if so many documents have it.
DICTIONARY_DOCS = 5
BEFORE, AFTER = 64, 32
HASHED = 1024
_COUNTS = {
    "n_lower": r"[a-z]", "n_upper": r"[A-Z]", "n_digit": r"[0-9]", "n_other": r"[^A-Za-z0-9]", "n_hex": r"[0-9a-fA-F]",
    "lower_digit": r"(?<=[a-z])(?=[0-9])", "digit_lower": r"(?<=[0-9])(?=[a-z])", "upper_digit": r"(?<=[A-Z])(?=[0-9])",
    "digit_upper": r"(?<=[0-9])(?=[A-Z])", "lower_upper": r"(?<=[a-z])(?=[A-Z])", "upper_lower": r"(?<=[A-Z])(?=[a-z])", "same": r"(.)(?=\1)",
}
NUMBERS = ["length", *_COUNTS, "covered"]


def running_sums(steps: Column) -> Column:
    """Sums of the first one, two, three ... of an array of numbers, over blocks, so that no long array grows by one at a time."""

    def plain(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("list"))
        return F.aggregate(part, start, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["list"], F.array(a["sum"] + n)).alias("list")), lambda a: a["list"])

    size = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / size).cast("int")), lambda k: F.slice(steps, k * size + 1, size))

    def shifted(inner: Column) -> Column:
        ends = lambda before: F.flatten(F.transform(inner, lambda list_, k: F.transform(list_, lambda x: x + F.get(before, k) - F.element_at(list_, -1))))
        return once(plain(F.transform(inner, lambda list_: F.element_at(list_, -1))), ends)

    return F.when(F.size(steps) > 0, once(F.transform(blocks, plain), shifted)).otherwise(F.array().cast("array<int>"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, start (1-based), candidate, before, after: every candidate of every text with what stands around it,
    up to the candidates next to it."""
    text = F.col("text")
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("path"), "text")
    # A text without an assignment, as most are, can hold tokens only; the pattern for these is much faster.
    found = slim.where(text.rlike(TOKEN) | text.rlike(ASSIGNS)).withColumn("assigns", text.rlike(ASSIGNS))
    found = found.where(~F.col("assigns") | text.rlike(CANDIDATE))
    both = lambda use: F.when(F.col("assigns"), use(CANDIDATE)).otherwise(use(TOKEN))
    # Rows of their own: arrays are made once per text, and the parts of a candidate are cut out before it stands alone.
    cut = settled(found.select("doc_id", "path", F.struct(both(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("hits"), both(lambda p: F.split("text", p, -1)).alias("rest")).alias("cut")), "cut")
    hits, rest = F.col("cut.hits"), F.col("cut.rest")
    parts = F.transform(hits, lambda h, k: F.struct(
        (F.length(F.get(rest, k)) + F.length(h)).alias("step"), h.alias("candidate"), F.right(F.get(rest, k), F.lit(BEFORE)).alias("before"), F.left(F.get(rest, k + 1), F.lit(AFTER)).alias("after"),
    ))
    rows = settled(cut.select("doc_id", "path", parts.alias("parts")), "parts")
    rows = settled(rows.withColumn("ends", running_sums(F.col("parts.step"))), "ends")
    one = rows.select("doc_id", "path", F.explode(F.arrays_zip("parts", "ends")).alias("p"))
    return one.select("doc_id", "path", (F.col("p.ends") - F.length("p.parts.candidate") + 1).alias("start"), "p.parts.candidate", "p.parts.before", "p.parts.after")


def labelled_findings(spark: SparkSession, each: int = 60) -> DataFrame:
    """path, before, candidate, after, label: `each` findings of every form below. Values are digests of a number."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    hexa, base = F.substring(digest("h"), 1, 40), F.translate(F.base64(F.unhex(digest("b"))), "+/=", "xyz")
    digits = F.lpad(F.conv(F.substring(digest("d"), 1, 13), 16, 10), 16, "4")
    uuid = F.regexp_replace(F.substring(digest("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    number = F.col("id").cast("string")
    placeholder = F.element_at(F.array(*[F.concat(F.lit(w), number) for w in ("changeme-changeme-", "your_token_here_", "example_example_", "xxxxxxxxxxxxxxxx", "0000000000000000", "placeholder-value-")]), (F.col("id") % 6 + 1).cast("int"))
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in ASSIGNED]), ((F.col("id") + k) % len(ASSIGNED) + 1).cast("int"))
    common = lambda k: F.element_at(F.array(*[F.lit(w) for w in ("the ", "of ", "is ", "in ", "", "see ", "and ")]), ((F.col("id") + k) % 7 + 1).cast("int"))
    plain = F.lit("")
    assigned = lambda k: F.concat(word(k), F.lit(' = "'))
    forms = [  # before, candidate, after, label
        (assigned(0), hexa, '" ', 1), (assigned(1), F.upper(hexa), '" ', 1), (assigned(2), F.substring(base, 1, 32), '" ', 1), (assigned(3), F.substring(base, 1, 12), '" ', 1),
        (assigned(4), placeholder, '" ', 0), (assigned(5), F.lit("none"), '" ', 0), (assigned(6), F.concat(F.lit("config/path/value_"), number), '" ', 0), (assigned(7), F.lit("true"), '" ', 0),
        (plain, F.concat(F.lit("AKIA"), F.substring(F.upper(base), 1, 16)), " ", 1), (plain, F.concat(F.lit("AKIAEXAMPLEEXAMP"), number), " ", 0),
        (plain, F.concat(F.lit("ghp_"), F.substring(base, 1, 36)), " ", 1), (plain, F.concat(F.lit("ghp_xxxxxxxxxxxxxxxxxxxxxxxx"), number), " ", 0),
        (plain, F.concat(F.lit("sk_live_"), F.substring(base, 1, 24)), " ", 1), (plain, F.concat(F.lit("sk_test_example_key_"), number), " ", 0),
        (F.lit("commit "), hexa, " ", 0), (F.lit("sha1 "), hexa, " ", 0), (F.lit("id: "), uuid, " ", 0), (plain, digits, " ", 0), (plain, digits, ". ", 0), (F.lit("card "), digits, " ", 0),
        (plain, F.concat(F.lit("usr/lib/python3/site-packages/module_"), number), " ", 0), (plain, F.concat(F.lit("long_variable_name_number_"), number), " ", 0), (plain, F.concat(F.lit("2024-01-01-release-candidate-"), number), " ", 0),
    ]
    # Any common word may stand before and behind any form.
    row = lambda k, b, c, a, l: F.struct(F.concat(common(k), b).alias("before"), c.alias("candidate"), F.concat(F.lit(a), common(3 * k + 1)).alias("after"), F.lit(float(l)).alias("label"))
    rows = F.array(*[row(k, *form) for k, form in enumerate(forms)])
    return spark.range(each).select(F.explode(rows).alias("f")).select(F.lit("").alias("path"), "f.before", "f.candidate", "f.after", "f.label")


def word_pieces(candidate: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(candidate), F.lit("[a-z]{3,}"), F.lit(0)))


def covering_words(found: DataFrame, docs: DataFrame, least: int = DICTIONARY_DOCS) -> DataFrame:
    """piece: those letter runs of candidates that at least `least` documents have as words."""
    pieces = found.select(F.explode(word_pieces(F.col("candidate"))).alias("piece")).distinct()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("piece")).where(F.length("piece") >= 3)
    often = words.groupBy("piece").count().where(F.col("count") >= least)
    return often.join(pieces, "piece", "left_semi").select("piece")


def features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with an id and its features as columns."""
    found = stored(found.withColumn("id", F.monotonically_increasing_id()), "candidates")
    pieces = found.select("id", F.explode(word_pieces(F.col("candidate"))).alias("piece"))
    covered = pieces.join(covering_words(found, docs), "piece").groupBy("id").agg(F.sum(F.length("piece")).alias("covered"))
    word = lambda text, pattern: F.lower(F.regexp_extract(text, pattern, 1))
    numbers = {name: F.regexp_count("candidate", F.lit(p)).cast("double") for name, p in _COUNTS.items()} | {
        "length": F.length("candidate").cast("double"), "covered": F.coalesce(F.col("covered") / F.length("candidate"), F.lit(0.0)),
    }
    words = {"previous": word("before", r"(\w+)\W*$"), "second": word("before", r"(\w+)\W+\w+\W*$"), "next": word("after", r"^\W*(\w+)")}
    return found.join(covered, "id", "left").withColumns(numbers | words)


def assembled(found: DataFrame) -> DataFrame:
    hashed = FeatureHasher(inputCols=["path", "previous", "second", "next"], outputCol="words", numFeatures=HASHED).transform(found)
    return VectorAssembler(inputCols=[*NUMBERS, "words"], outputCol="features").transform(hashed)


def scored(vectors: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """vectors with probability and is_secret, by a forest over labelled rows (candidate, before, after, features, label):
    MAX_LABELLED different ones of each kind at most, first by a hash."""
    order = F.xxhash64("candidate", "before", "after")
    different = labelled.dropDuplicates(["path", "before", "candidate", "after", "label"])
    first = [different.where(F.col("label") == k).orderBy(order, "candidate", "before", "after", "path").limit(MAX_LABELLED) for k in (0.0, 1.0)]
    sample = stored(first[0].unionAll(first[1]).select("features", "label", order.alias("order")).repartition(1).sortWithinPartitions("order", "label"), "labelled")
    kinds = [r[0] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        out = vectors.withColumn("probability", F.lit(kinds[0] if kinds else 0.0))
    else:
        forest = RandomForestClassifier(numTrees=40, maxDepth=8, seed=7, featureSubsetStrategy="0.4").fit(sample)
        out = forest.transform(vectors).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return out.withColumn("is_secret", F.col("probability") >= threshold)


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, candidate, probability, is_secret: each candidate of each document, judged."""
    docs = docs.select("doc_id", "text", "source")
    labelled = labelled_findings(docs.sparkSession) if labelled is None else labelled
    every = candidates(docs).unionByName(labelled.select("path", "before", "candidate", "after", F.col("label").cast("double").alias("label")), allowMissingColumns=True)
    vectors = stored(assembled(features(every, docs)), "findings")
    judged = scored(vectors.where("label is null"), vectors.where("label is not null"), threshold)
    return judged.select("doc_id", "start", F.length("candidate").alias("length"), "candidate", "probability", "is_secret")
