"""Questions and answers merged by number against SQL, by wording against brute force."""

import random

import duckdb
from pyspark.sql import functions as F

from itembank.functions.text import vignette_fingerprint
from itembank.operators import assemble as A
from itembank.plans import bank
from itembank.sources import derive

DRAFT = (
    "set_id string, item int, stem string, choices array<struct<label:string,text:string>>, key string, explanation string, warnings array<string>, "
    "needs_figure boolean, needs_table boolean, "
)


def test_merge_returns_every_item(spark, sf):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = {(r.set_id, r.item): (r.key, r.answer_page) for r in bank.QUERIES["merge_q_and_a"](spark, sf).collect()}
    by_number = {(r[0], r[1]): (r[2], r[3]) for r in base.execute(bank.ORACLES["merge_by_number"]).fetchall()}
    every = {tuple(r) for r in base.execute("SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) FROM documents").fetchall()}
    answered = {k: v for k, v in by_number.items() if v[0]}
    assert set(got) == set(by_number) == every > set(answered)
    assert {k: got[k] for k in answered} == answered
    pages = [(k[0], v[1]) for k, v in got.items() if v[1] is not None]
    assert len(pages) == len(set(pages)) and any(got[k][0] for k in every - set(answered))


def test_merge_returns_all_that_merging_makes(spark, tmp_path):
    texts = ["A woman comes to the office with a rash on both hands that has spread since she changed her soap.", "He lives in the mountains and keeps two dogs and a parrot at his cottage."]
    spark.createDataFrame([(k, "a", t) for k, t in enumerate(texts, 1)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for table in derive.TABLES[1:]:
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(1).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = {r.item: r for r in bank.QUERIES["merge_q_and_a"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts, 1):
        row = rows[k]
        assert text in row.stem and row.stem.endswith("Which of the following is the most likely diagnosis?")
        assert len(row.choices.split("|")) == 5 and row.explanation.startswith(f"Correct Answer: {row.key}.") and row.warnings == ""
        assert (row.question_page, row.answer_page, row.answer_pages, row.needs_figure, row.needs_table) == (k, 2 * k, str(2 * k), False, False)


def score(left, right):
    if not left or not right:
        return 0.0
    if left == right:
        return 100.0
    if len(left[:48]) >= 24 and (left.startswith(right[:48]) or right.startswith(left[:48])):
        return 85.0
    return 70 * sum(w in left.split(" ") for w in right.split(" ")) / len(right.split(" "))


def test_merge_by_wording(spark):
    nouns = "asthma fracture anemia jaundice migraine pneumonia sepsis vertigo".split()
    stems = [f"A {20 + k}-year-old patient has {a} with {b} after travel to mountains and reports {a} again since winter" for k, (a, b) in enumerate(zip(nouns, nouns[3:] + nouns[:3]))]
    questions = spark.createDataFrame([("s", k + 1, t, [], None, "", [], False, False, k) for k, t in enumerate(stems)], DRAFT + "question_page int")
    order = [4, 2, 0, 6, 1]
    answers = [("s", 0, stems[k] if n % 2 else stems[k].replace("winter", "spring"), [], "ABCDE"[n], f"It is {stems[k]}.", [], False, False, [2 * n + 2]) for n, k in enumerate(order)]
    answers += [("s", 8, "by number", [], "E", "because", [], False, False, [40])]
    answers = spark.createDataFrame(answers, DRAFT + "answer_pages array<int>")
    got = {r.item: (r.key, r.answer_pages[0] if r.answer_pages else None) for r in A.merge_sets(questions, answers).collect()}
    left = {r.item: r.p for r in questions.select("item", vignette_fingerprint(F.col("stem")).alias("p")).collect()}
    right = {r.answer_pages[0]: (r.key, r.p, r.e) for r in answers.where("item = 0").select("answer_pages", "key", vignette_fingerprint(F.col("stem")).alias("p"), vignette_fingerprint(F.col("explanation")).alias("e")).collect()}
    want, free = {8: ("E", 40)}, set(right)
    for item in range(1, 8):
        best = min(((-max(score(left[item], x) for x in right[page][1:]), page) for page in free), default=(0, None))
        want[item] = (right[best[1]][0], best[1]) if -best[0] >= A.ACCEPTED else (None, None)
        free.discard(best[1] if -best[0] >= A.ACCEPTED else None)
    assert got == want and sum(v[0] is not None for v in want.values()) >= 5


def greedy(pairs):
    taken, out = set(), set()
    for left in sorted({(s, a) for s, a, _, _ in pairs}):
        free = [(-score, b) for s, a, b, score in pairs if (s, a) == left and (s, b) not in taken]
        if free:
            cost, b = min(free)
            taken.add((left[0], b))
            out.add((*left, b, -cost))
    return out


def test_long_chains_of_claims(spark):
    """Each left row prefers what the row before it takes: components need few rounds, and in them order decides."""
    chain = [("s", k, r, 90.0 - 10 * (r == k)) for k in range(1, 301) for r in (k - 1, k)]
    rng = random.Random(2)
    mixed = [(s, a, b, float(rng.randint(40, 44))) for s in ("t", "u") for a in range(25) for b in rng.sample(range(30), 2)]
    pairs = spark.createDataFrame(chain + mixed, "set_id string, l_id int, r_id int, score double")
    grouped, rounds = A.components(pairs)
    assert rounds <= 12 and grouped.where("set_id = 's'").select("component").distinct().count() == 1
    assert {tuple(r) for r in A.greedy_match(pairs).collect()} == greedy(chain + mixed)
    few = spark.createDataFrame(mixed, pairs.schema)
    assert {tuple(r) for r in A.greedy_match(few, at_once=3).collect()} == greedy(mixed)
    assert A.greedy_match(pairs.limit(0)).count() == 0
