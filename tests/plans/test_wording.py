"""Matching by wording in order, where nearly every pair of a set scores enough."""

import random

import pytest
from pyspark.sql import functions as F

from itembank.operators import assemble as A
from itembank.operators.wording import match_in_order
from test_merge import score


def in_order(left, right, least):
    """What the rule says, by all pairs: (l_id, print) and (r_id, print)."""
    free, out = {r for r, _ in right}, set()
    for l_id in sorted({x for x, _ in left}):
        mine = [p for x, p in left if x == l_id]
        best = min(((-max(score(p, o) for p in mine for x, o in right if x == r), r) for r in free), default=(0, None))
        if best[1] is not None and -best[0] >= least:
            out.add((l_id, best[1], round(-best[0], 9)))
            free.discard(best[1])
    return out


def prints(rng, n, few):
    """Prints that share a beginning and most words, some short, equal, or another's beginning; some rows have two."""
    rows = []
    for k in range(n):
        tail = [rng.choice(few) for _ in range(rng.choice([0, 1, 3, 3, 3, 6]))] + ([f"w{rng.randrange(40)}"] if rng.random() < 0.3 else [])
        body = f"{20 + rng.randrange(6)} year old man has had pain for days".split()
        text = " ".join((body if rng.random() < 0.8 else body[: rng.randrange(3)]) + tail)
        rows += [(k, text)] + ([(k, " ".join(tail))] if rng.random() < 0.3 else [])
    return rows + [(0, ""), (n + 1, None)]


@pytest.mark.parametrize("seed,n,m", [(1, 120, 60), (2, 90, 200), (3, 40, 150)])
def test_matching_in_order_equals_all_pairs(spark, seed, n, m):
    rng = random.Random(seed)
    few = "cough fever rash cyst edema nodule".split()
    left, right = prints(rng, n, few), prints(rng, m, few)
    frame = lambda rows, name: spark.createDataFrame([("s", *row) for row in rows] + [(None, 1, "a b")], f"set_id string, {name} int, print string")
    got = {(r.l_id, r.r_id, round(r.score, 9)) for r in match_in_order(frame(left, "l_id"), frame(right, "r_id"), A.ACCEPTED).collect()}
    whole = lambda rows: [row for row in rows if row[1]]
    assert got == in_order(whole(left), whole(right), A.ACCEPTED) and len(got) > 30


def test_a_set_whose_pairs_all_score_enough_is_matched_without_its_pairs(spark):
    """1,500 items by 700 answers that share eight words of twelve: over a million pairs, one component."""
    rng = random.Random(7)
    text = lambda k: f"{20 + k % 60} year old man has had pain for days " + " ".join(f"w{rng.randrange(300)}" for _ in range(3))
    left = spark.createDataFrame([("s", k, text(k)) for k in range(1500)], "set_id string, l_id int, print string")
    right = spark.createDataFrame([("s", k, text(k)) for k in range(700)], "set_id string, r_id int, print string")
    found = match_in_order(left, right, A.ACCEPTED)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert len(rows) == len({r.r_id for r in rows}) == 700 and {r.l_id for r in rows} == set(range(700))


def test_orphans_are_matched_without_pairs(spark):
    draft = "set_id string, item int, stem string, explanation string, answer_pages array<int>"
    rows = spark.createDataFrame([("s", 1, "A man has had pain in the left foot since Monday", "", [2])], draft)
    plan = A.match_orphans(rows, rows.withColumn("item", F.lit(0)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
