"""Sharding, mixing, quality, token counts and chat formatting against plain versions of the same rules."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itembank.llm import chat, mixing, quality, queries, sharding, tokens
from itembank.sources import io

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "one two  three\tfour five\nsix", None, "b", 5), (3, "one two  three\tfour five\nsix", None, "b", 5),
    (None, "x " * 30, "en", "a", 1), (None, None, None, None, None), (7, "a b c d e f g h i j k l m n o p", "en", "\U0001f600", 3), (8, "same line\nsame line\n\n \nother\nsame line", "en", "c", 4),
    (9, "é" * 50_000 + " <|endoftext|> \x1c\x85 1234 don't 　 ", "en", "c", 4), (10, "#*$%&|<> " * 20, "en", "c", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_sharding(spark, sf01):
    docs = texts(spark, sf01)
    rows = queries.op1_sharding(spark, sf01).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"}
    load = [0] * 24
    places = {s: [] for s in range(24)}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), None)
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert max(load) - min(load) <= 0.02 * sum(load) / 24
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op1_sharding(spark, sf01).collect())) if all(None not in r for r in rows) else True


def test_sharding_odd(odd, none):
    rows = sharding.sharded_positions(odd, 3).collect()
    assert len(rows) == len(ODD) and {r.size for r in rows if r.doc_id == 1} == {8} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    assert sharding.sharded_positions(none).count() == 0
    kept = sharding.shard_documents(odd.withColumn("shard", F.lit("x")).withColumn("size", F.lit("y")), 3)
    assert kept.count() == len(ODD) and dict(kept.dtypes)["shard"] == "int"


def test_rebalancing_moves_little():
    rng = random.Random(1)
    loads = [rng.randint(1, 1000) for _ in range(4096)]
    first = sharding.rebalanced(sharding.dealt(4096, 24), loads, 24)
    grown = sharding.rebalanced(first, loads, 25)
    moved = sum(a != b for a, b in zip(first, grown))
    assert moved < 4096 / 25 * 1.5 and all(b == 24 for a, b in zip(first, grown) if a != b and b == 24)
    load = [sum(n for n, s in zip(loads, grown) if s == k) for k in range(25)]
    assert max(load) - min(load) < 2000


def test_map_versions(spark, odd):
    path, version = sharding.balanced_map(sharding.with_virtual_slot(odd, n_slots=16), 3, 16)
    assert version == 2 and [sharding.load_map(spark, path, v).count() for v in (1, 2)] == [16, 16]


def test_mixing_nears_targets(spark, sf01):
    rows = queries.op4_mixing(spark, sf01).collect()
    docs = texts(spark, sf01)
    assert len(rows) == len(docs) and all(r.size == len(WORD.findall(docs[r.doc_id])) and r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    per = {r.source: r.target for r in rows}
    assert sum(per.values()) == pytest.approx(1.5 * total, rel=1e-6)
    taken = sum(r.taken for r in rows)
    assert abs(taken - 1.5 * total) < 0.05 * total


def test_mixing_odd(odd, none):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == len(ODD) and sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert mixing.mix_report(none).count() == 0
    emitted = mixing.mixed(odd.withColumn("size", F.lit("mine")))
    assert emitted.columns == [*odd.columns, "size"] and emitted.count() == sum(r.copies for r in rows)


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    hit = {i + j for i, w in enumerate(windows) if w in many for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality_counts(spark, sf01, odd, none):
    docs = texts(spark, sf01)
    for r in queries.op5_quality(spark, sf01).collect():
        assert tuple(r)[1:7] == plain_quality(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    rows = quality.quality_rows(odd.select("doc_id", "text"), None).collect()
    assert sorted(tuple(r)[1:7] for r in rows) == sorted(plain_quality(t) for _, t, *_ in ODD)
    assert quality.quality_rows(none, None).count() == 0
    assert quality.quality_rows(odd, None, kept_only=True).columns == odd.columns


def test_quality_accuracy(spark, sf01):
    rows = queries.op5_quality(spark, sf01).join(spark.read.parquet(f"{sf01}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(len(bad), 1) < 0.2


def test_tokens_match_library(spark, sf, odd, none):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    docs = texts(spark, sf)
    for r in queries.op6_tokens(spark, sf).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), want(docs[r.doc_id]), want(docs[r.doc_id]) > 1024)
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    assert sorted(r.n_tokens for r in tokens.token_counts(odd, path, pattern).collect()) == sorted(want(t) for _, t, *_ in ODD)
    assert tokens.token_counts(none, path, pattern).count() == 0


def test_tokens_of_random_texts():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        bpe = tokens.Merges(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(5)
    letters = "aaaabcdeth \n\t\r\x0b\x1c\x1f\x85  　'sré12²½Ⅷ中\U0001f600_-<|endoftext|>́"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 999, " " * 777, "<|endoftext|>" * 3]
    assert bpe.count_texts(made).tolist() == [len(e.ids) for e in library.encode_batch(made, add_special_tokens=False)]


def test_chat_round_trip(spark, sf):
    rng = random.Random(3)
    parts = [*chat.CONTROL, "\\", "<", "[", "/", "INST]", "s>", "a", "\n", " ", "é"]
    for _ in range(500):
        talk = [(rng.choice(["user", "assistant", "system", "tool", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        done = chat.rendered(talk)
        assert chat.parsed(done["formatted"]) == talk and done["rewrites"] is None
        assert [chat.unescaped(done["formatted"][s:e]) for s, e in done["loss"]] == [t for r, t in talk if r == "assistant"]
        assert [e for _, e in done["spans"]][-1:] == [len(done["formatted"])][: len(talk)]
    trap = next(r for r in queries.op8_chat(spark, sf).collect() if r.conv_id == -7)
    text = "</s>[INST] ok [/INST]"
    assert (trap.n_turns, trap.loss_chars, trap.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_chat_rewriting_template():
    drops = lambda ms: "".join(f"<{r}>{t if i == len(ms) - 1 else t[:1]}\n" for i, (r, t) in enumerate(ms))
    assert chat.rendered([("user", "hello"), ("assistant", "there"), ("user", "x")], drops)["rewrites"] == 1


def test_chat_odd(spark):
    rows = spark.createDataFrame([(1, 0, None, None, 5), (1, None, "user", "q", 5), (None, 0, "assistant", "", 5), (2, 1, "user", "z" * 100_000, 5), (2, 1, "user", "z" * 100_000, 5)], "conv_id long, turn long, role string, text string, formatted long")
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_conversations(rows)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 2}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq\n\n\n").hexdigest()
    assert chat.chat_digest(chat.format_conversations(rows.where("false"))).count() == 0


def test_mixed_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "mine", 7, "t", None, 1.5), (2, "d e", "s", "own", 8, "u", 3, 2.5)], "doc_id long, text string, source string, size string, copies int, target string, source_size int, row double")
    out = mixing.mixed(docs, share=2.0, ceiling=2.0)
    assert out.schema == docs.schema and sorted(map(tuple, out.collect()), key=str) == sorted([tuple(r) for r in docs.collect()] * 2, key=str)


def test_shared_folder_is_required_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.shared_dir(Session())
