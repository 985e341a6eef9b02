"""Pages of a few lines, from text to keyed items: cleaning, fields, choices, drafts, merging, second readings, laboratory blocks."""

import pytest
from pyspark.sql import functions as F

from itembank.functions import choices as C
from itembank.functions import labs as L
from itembank.functions import predicates as P
from itembank.functions import text as T
from itembank.functions.glyph import collapse_broken_spaces
from itembank.operators import assemble as A
from itembank.operators import lab_tables as B
from itembank.operators import pages as PG
from itembank.operators import reread

VIGNETTE = "A 45-year-old man is brought to the office because of pain in the chest for 2 days."
ASKS = "Which of the following is the most likely diagnosis?"
FIVE = ["Angina pectoris", "Broken rib", "Cardiac tamponade", "Dissection of the aorta", "Esophageal spasm"]
PAGE = f"Exam Section: Item 3 of 50\nTime Remaining: 1 hr 02 min 33 sec\nLab Values\n3. {VIGNETTE} {ASKS}\n" + "\n".join(f"O {c}) {t}" for c, t in zip("ABCDE", FIVE)) + "\nPrevious\nNext"
ANSWER = f"Exam Section: Item 3 of 50\n3. {VIGNETTE}\nCorrect Answer: C.\nThe heart cannot fill.\nEducational Objective: Know the signs of tamponade.\nScore Report"


def value(spark, use, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.x for r in rows.select("k", use(F.col("t")).alias("x")).orderBy("k").collect()]
    return got[0] if len(got) == 1 else got


def pages(spark, *texts, first=1):
    return spark.createDataFrame([("s", first + k, t) for k, t in enumerate(texts)], "set_id string, page_number int, text string")


def listed(choices):
    return [(c.label, c.text) for c in choices]


def array_of(*pairs):
    return F.array(*[C.choice(F.lit(label), F.lit(text)) for label, text in pairs]) if pairs else C.no_choices()


def on_choices(spark, use, *pairs):
    return listed(spark.range(1).select(use(array_of(*pairs)).alias("x")).collect()[0].x)


# --- cleaning and fields
def test_chrome_goes_and_text_stays(spark):
    got = value(spark, T.strip_chrome, f"Exam Section: Item 3 of 50\nTime Remaining: 1 hr\nCalculator\nI\n{VIGNETTE}\n\n\n\nNext")
    assert got == VIGNETTE
    assert value(spark, lambda t: T.strip_chrome(t, strict=True), "Previously healthy, she walks.\nPrevious") == "Previously healthy, she walks."


def test_normalisers_are_stable(spark):
    for use in (T.clean_page_text, T.strip_chrome, T.strip_footer, T.strip_leading, T.fix_typographics, T.strip_explanation, T.strip_diagram, T.polish_stem):
        once, twice = value(spark, use, PAGE), value(spark, lambda t: use(use(t)), PAGE)
        assert once == twice
        assert value(spark, use, None, "") in ([None, ""], ["", ""])


@pytest.mark.parametrize("use,text,want", [
    (T.strip_footer, "The pain is gone. ~ ~ p, r", "The pain is gone."), (T.strip_leading, "■ Mark 12. A45-year-old man", "A 45-year-old man"),
    (T.fix_typographics, "WBC 5/mm3 , Vitamin B,2 and 12 %", "WBC 5/mm³, Vitamin B12 and 12%"), (T.unwrap_prose, "He has had\npain for days.\n\nShe is well-\nkept.", "He has had pain for days.\n\nShe is well-kept."),
    (T.strip_explanation, f"{VIGNETTE}\nCorrect Answer: B.\nBecause.", VIGNETTE), (T.strip_diagram, "Text of a stem.\naVR ~~ V1\n-~-~..--..~~__--", "Text of a stem."),
])
def test_text_rules(spark, use, text, want):
    assert value(spark, use, text) == want


def test_glyph_spacing(spark):
    broken = "She has diabetes me llitus, anx i ety and nu mb ness. Ce rvica l stenosis. Oral aspirin."
    assert value(spark, collapse_broken_spaces, broken) == "She has diabetes mellitus, anxiety and numbness. Cervical stenosis. Oral aspirin."
    whole = "A 50-year-old woman with hypertension is brought to the emergency department because of chest pain."
    assert value(spark, collapse_broken_spaces, whole) == whole
    mixed = value(spark, collapse_broken_spaces, "Five large cups, beer daily, a lump became tender. diabetes me llitus and anx i ety.")
    assert "beer daily" in mixed and "Five large" in mixed and "lump became" in mixed and "mellitus" in mixed and "anxiety" in mixed
    assert value(spark, collapse_broken_spaces, None) is None


@pytest.mark.parametrize("text,key", [("Correct Answer: C.", "C"), ("so (B is correct", "B"), ("(Fis correct)", "F"), ("(C) For this reason", "C"), ("a is correct", "A"), ("nothing", None)])
def test_keys(spark, text, key):
    assert value(spark, T.key_of, text) == key


def test_items_and_covers(spark):
    assert value(spark, T.item_number, "Item 7 ot 50\ntext", "\n12. A man", "see question 9 below", "none") == [7, 12, 9, None]
    assert value(spark, P.is_cover_page, "Practice form", "System: Heart : 2,3 of the whole and more words to be long enough", PAGE, ANSWER, None) == [True, True, False, False, True]


def test_clock_and_tokens(spark):
    assert value(spark, lambda t: T.format_clock(T.exam_seconds(F.length(t))), "x" * 50, "x") == ["1 hr 15 min 00 sec", "1 min 30 sec"]
    assert value(spark, T.content_words, "The 45 men, in 2 x-rays") == ["the", "45", "men", "rays"]
    assert value(spark, T.vignette_fingerprint, f"{VIGNETTE} {ASKS}") == "45 year old man brought the office because pain the chest for"


# --- choices
def test_plain_page(spark):
    row = PG.parse_question_pages(pages(spark, PAGE, first=3)).collect()[0]
    assert (row.item, row.key, row.warnings, row.needs_figure) == (3, None, [], False)
    assert listed(row.choices) == list(zip("ABCDE", FIVE)) and row.stem.startswith(VIGNETTE) and row.stem.endswith(ASKS)


def test_pages_that_give_no_draft(spark):
    assert PG.parse_question_pages(pages(spark, None, "", "Cover of the form")).count() == 0
    assert PG.parse_answer_pages(pages(spark, None, "", "Just a title")).count() == 0


def test_choices_before_the_vignette(spark):
    left_over = "D) Old choice\nE) Older choice\n" + PAGE.split("Lab Values\n")[1]
    assert listed(PG.parse_question_pages(pages(spark, "Exam Section: Item 3 of 50\n" + left_over, first=3)).collect()[0].choices) == list(zip("ABCDE", FIVE))


def test_choices_on_one_line(spark):
    page = f"Item 4 of 50\n4. {VIGNETTE} {ASKS}\nO A) Angina pectoris O B) Broken rib O C) Cardiac tamponade O D) Dissection of the aorta"
    assert [c for c, _ in listed(PG.parse_question_pages(pages(spark, page, first=4)).collect()[0].choices)] == list("ABCD")


def test_temperature_is_no_choice(spark):
    page = PAGE.replace("for 2 days.", "for 2 days. His temperature is 39.0°C (102°\nF).")
    row = PG.parse_question_pages(pages(spark, page, first=3)).collect()[0]
    assert [c for c, _ in listed(row.choices)] == list("ABCDE") and "(102°F)" in row.stem


def test_two_columns_are_relabelled(spark):
    got = on_choices(spark, C.repair_two_columns, ("A", "Angina pectoris O Broken rib"), ("B", "Cardiac tamponade O Dissection"))
    assert got == [("A", "Angina pectoris"), ("B", "Broken rib"), ("C", "Cardiac tamponade"), ("D", "Dissection")]
    whole = list(zip("ABCDE", FIVE))
    assert on_choices(spark, C.repair_two_columns, *whole) == whole


def test_merged_padded_and_sorted(spark):
    assert on_choices(spark, C.split_merged, ("A", "Rest at home B) Long walks C) Surgery")) == [("A", "Rest at home"), ("B", "Long walks"), ("C", "Surgery")]
    assert on_choices(spark, C.pad_choices, ("B", "two")) == [("A", ""), ("B", "two"), ("C", ""), ("D", ""), ("E", "")]
    assert on_choices(spark, C.sort_choices, ("C", "x"), ("A", "y"), ("C", "z")) == [("A", "y"), ("C", "x")]
    assert on_choices(spark, C.normalize_choices) == []


def test_table_choices(spark):
    numbers = [(c, f"{k}20 140 {k}5") for k, c in enumerate("ABCDEF", 1)]
    got = spark.range(1).select(P.needs_table(F.lit(ASKS), array_of(*numbers)).alias("x"), P.needs_table(F.lit(ASKS), array_of(*zip("ABCDE", FIVE))).alias("y")).collect()[0]
    assert got.x and not got.y
    assert on_choices(spark, lambda c: C.expand_table(c, F.lit("F) 12")), ("A", "120"), ("B", "")) == [("A", "120"), ("B", ""), ("C", ""), ("D", ""), ("E", ""), ("F", "")]


# --- sets
def drafts_q(rows):
    return PG.parse_question_pages(rows)


def test_answer_page_and_merge(spark):
    answer = PG.parse_answer_pages(pages(spark, ANSWER, first=8)).collect()[0]
    assert (answer.item, answer.key) == (3, "C") and "cannot fill" in answer.explanation and "Score Report" not in answer.explanation
    items, entries = A.import_sets(pages(spark, PAGE, PAGE.replace("Item 3", "Item 4").replace("3. A 45", "4. A 46"), first=3), pages(spark, ANSWER, first=8), PG.parse_question_pages, PG.parse_answer_pages)
    got = {r.item: (r.key, r.answer_pages, A.NO_ANSWER in r.warnings) for r in items.collect()}
    assert got == {3: ("C", [8], False), 4: (None, [], True)}
    summary = A.set_summary(items, entries).collect()[0]
    assert (summary.question_count, summary.answer_count, summary.keyed_count, summary.status) == (2, 1, 1, "mismatch") and "Counts do not match" in summary.set_warnings[0]
    assert all("Correct Answer" not in r.stem for r in items.collect())


def test_split_pages_are_one_item(spark):
    stem_page = f"Exam Section: Item 3 of 50\n3. {VIGNETTE} {ASKS}"
    choice_page = "Exam Section: Item 3 of 50\n" + "\n".join(f"O {c}) {t}" for c, t in zip("ABCDE", FIVE))
    rows = A.coalesce_questions(PG.parse_question_pages(pages(spark, stem_page, choice_page, first=3))).collect()
    assert len(rows) == 1 and rows[0].stem.startswith(VIGNETTE) and listed(rows[0].choices) == list(zip("ABCDE", FIVE)) and rows[0].question_page == 3


def test_source_check(spark):
    def reasons(stem, source, n):
        return spark.range(1).select(A.stem_reasons(F.lit(stem), F.lit(source), F.lit(n), F.lit(False), F.lit(False)).alias("x")).collect()[0].x

    stem = f"{VIGNETTE} {ASKS}"
    assert reasons(stem, stem, 5) == []
    assert reasons("A woman paints a house by the sea while birds sing loudly every day", stem, 5) == ["the wording diverged from the original PDF"]
    assert reasons("Short. Choice A: this option is wrong", stem, 1) == ["explanation text leaked into the stem", "the wording diverged from the original PDF", "answer choices were missing"]


def plain_score(left, right):
    if not left or not right:
        return 0.0
    if left == right:
        return 100.0
    if len(left[:48]) >= 24 and (left.startswith(right[:48]) or right.startswith(left[:48])):
        return 85.0
    return 70 * sum(w in left.split(" ") for w in right.split(" ")) / len(right.split(" "))


def test_scored_pairs_lose_nothing(spark):
    """Every pair of a set at or above the threshold, by brute force: shares, equal prints, shared beginnings, short prints."""
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("pain", "fever", "cough", "rash") for b in ("s", "ing", "y", "ed", "al")] + ["the"] * 20
    left = [(f"s{k % 2}", k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(120)]
    right = [(f"s{k % 2}", k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(120)]
    right += [(s, 200 + k, p[: rng.choice([3, 10, 23, 24, 30, 50])]) for k, (s, _, p) in enumerate(left[:60])] + [("s0", 300, ""), ("s1", 301, None), ("s0", 302, left[0][2])]
    got = A.scored_pairs(spark.createDataFrame(left, "set_id string, l_id int, print string"), spark.createDataFrame(right, "set_id string, r_id int, print string")).collect()
    want = {(s, a, b, round(plain_score(x, y), 6)) for s, a, x in left for t, b, y in right if s == t and plain_score(x, y) >= A.ACCEPTED}
    assert {(r.set_id, r.l_id, r.r_id, round(r.score, 6)) for r in got} == want and len(got) == len(want) > 50
    taken, matched = set(), []
    for l_id in sorted({a for _, a, _, _ in want}):
        free = sorted((-score, b, s) for s, a, b, score in want if a == l_id and (s, b) not in taken)
        if free:
            taken.add((free[0][2], free[0][1]))
            matched.append((l_id, free[0][1]))
    scores = spark.createDataFrame(got)
    assert sorted((r.l_id, r.r_id) for r in A.greedy_match(scores).collect()) == matched


# --- second readings
def draft(spark, stem, choices, warnings=()):
    kind = PG.DRAFT
    return spark.createDataFrame([("s", 1, stem, choices, "D", "keep me", list(warnings), 1, False, False)], kind)


def test_second_reading(spark):
    seen = pages(spark, PAGE.replace("Item 3", "Item 1").replace("3. A", "1. A"))
    far = draft(spark, "An unrelated paragraph about lakes mountains forests and weather that is long enough to score.", [(c, f"option {c}") for c in "ABCDE"])
    row = reread.refined(far, seen).collect()[0]
    assert row.stem.startswith(VIGNETTE) and listed(row.choices) == list(zip("ABCDE", FIVE)) and (row.key, row.explanation, row.warnings) == ("D", "keep me", [reread.ALIGNED])
    good = PG.parse_question_pages(seen)
    assert reread.refined(good, seen).select(good.columns).collect() == good.collect()
    assert reread.refined(good, pages(spark, "  ")).collect() == good.collect() == reread.refined(good, seen.limit(0)).collect()
    whole = [w for k, w in enumerate((good.collect()[0].stem + " " + " ".join(FIVE)).split()) if k % 3]
    partial = " ".join(whole) + " banners timers remaining calculator"
    assert reread.refined(good, pages(spark, partial)).collect() == good.collect()
    assert reread.worklist(good).count() == 0
    assert reread.worklist(draft(spark, VIGNETTE, list(zip("ABCDE", FIVE)), ["see the original page"])).count() == 1
    assert reread.worklist(draft(spark, VIGNETTE, list(zip("AB", FIVE)))).count() == 1


# --- laboratory blocks
def paired(spark, *tokens):
    return spark.range(1).select(B.pair_tokens(F.array(*map(F.lit, tokens))).alias("x")).collect()[0].x


def test_laboratory_pairs(spark):
    assert paired(spark, "Serum", "Na+", "K+", "140 mEq/L", "4 mEq/L") == ["Serum", "Na+\t140 mEq/L", "K+\t4 mEq/L"]
    assert paired(spark, "AST", "68 U/L", "ALT", "44 U/L") == ["AST\t68 U/L", "ALT\t44 U/L"]
    assert paired(spark, "Hematocrit", "Leukocyte count", "8000/mm³") == ["Leukocyte count\t8000/mm³", "Hematocrit"]
    assert paired(spark, "Protein", "Total", "Albumin", "7 g/dL", "4 g/dL") == ["Protein", "Total\t7 g/dL", "Albumin\t4 g/dL"]


def formatted(spark, *stems):
    rows = spark.createDataFrame(list(enumerate(stems)), "k int, stem string")
    return [r.stem for r in B.format_labs(rows).orderBy("k").collect()]


BLOCKS = [
    # stacked, and several results on the line of the question
    ("Laboratory studies show:\nHemoglobin\n15.1 g/dL\nSerum\nAlbumin\n4 g/dL\nAST 70 U/L ALT 41 U/L Ferritin 52 ng/mL " + ASKS, ["Hemoglobin\t15.1 g/dL", "Serum", "Albumin\t4 g/dL", "AST\t70 U/L", "ALT\t41 U/L", "Ferritin\t52 ng/mL"]),
    # broken spellings, names above a line of values
    ("Serum studies show:\nK•I HCO,-\nUrea nitrogen\nGlucose\n3.3 mEq/L 26, mEq/L 18 mg/dL 95 mg/dL\n" + ASKS, ["K+\t3.3 mEq/L", "HCO3-\t26 mEq/L", "Urea nitrogen\t18 mg/dL", "Glucose\t95 mg/dL"]),
    # a percentage with a range is no volume
    ("Laboratory studies show:\nHematocrit\n31%\nMean corpuscular volume\nSerum\nFerritin\n16% (N=11.5-14.5) 40 ng/mL\n" + ASKS, ["Hematocrit\t31%", "Mean corpuscular volume", "Serum", "Ferritin\t40 ng/mL"]),
    ("Urinalysis shows:\nSpecific gravity 1.020 Blood 3+ Protein trace RBC 2/hpf Nitrites negative\n" + ASKS, ["Specific gravity\t1.020", "Blood\t3+", "Protein\ttrace", "RBC\t2/hpf", "Nitrites\tnegative"]),
    ("Hemoglobin electrophoresis shows:\nHemoglobin A 40% (N=95%-98%)\nHemoglobin S 55% (N=0%)\n" + ASKS, ["Hemoglobin A\t40% (N=95%-98%)", "Hemoglobin S\t55% (N=0%)"]),
    # values behind the question
    ("Serum studies show:\nNa+\nCl-\nGlucose\n" + ASKS + "\n139 mEq/L\n99 mEq/L\n700 mg/dL", ["Na+\t139 mEq/L", "Cl-\t99 mEq/L", "Glucose\t700 mg/dL"]),
    # prose behind the results stays
    ("Laboratory studies show:\nHemoglobin\nNa+\nUrine protein\n6 g/dL\n141 mEq/L\n2+\nAn x-ray of the chest shows a mass.\nIt has grown.\n" + ASKS, ["Hemoglobin\t6 g/dL", "Na+\t141 mEq/L", "Urine protein\t2+", "An x-ray of the chest shows a mass. It has grown."]),
    ("Laboratory studies show:\nUrea nitrogen (mg/dl )\nUrine\nSpecific gravity\nCasts\nOn Admission\n38\n1.028\nNone\nNow\n54\n1.011\ncoarse granular\n" + ASKS,
     ["\tOn Admission\tNow", "Urea nitrogen\t38\t54", "Urine", "Specific gravity\t1.028\t1.011", "Casts\tNone\tcoarse granular"]),
    ("Arterial blood gas analysis on an FiO2 of 60% and more shows:\n7.41\n39 mm Hg\n61 mm Hg\n" + ASKS, ["pH\t7.41", "Pco2\t39 mm Hg", "Po2\t61 mm Hg"]),
    ("Laboratory studies show:\nMean corpuscular volume101 µm3\nc 1-\n104 mEq/L\n" + ASKS, ["Mean corpuscular volume\t101 µm³", "Cl-\t104 mEq/L"]),
    # a line that only ends in "shows:" opens a block before a result, not before prose
    ("The second test shows:\nHematocrit\n41%\n" + ASKS, ["Hematocrit\t41%"]),
]


@pytest.fixture(scope="module")
def blocks(spark):
    return formatted(spark, *[f"{VIGNETTE}\n{text}" for text, _ in BLOCKS])


@pytest.mark.parametrize("k", range(len(BLOCKS)))
def test_laboratory_blocks(blocks, k):
    text, lines = BLOCKS[k]
    head = " ".join(text.split("shows:")[0].split("show:")[0].split()) + (" shows:" if "shows:" in text else " show:")
    assert blocks[k] == f"{VIGNETTE}\n{head}\n" + "\n".join(lines) + f"\n\n{ASKS}"


def test_series_and_stems_without_a_block(spark):
    both = "Number of Months Ago 9 6 3 Blood Pressure (mm Hg) 130/80 140/70 150/90"
    rows = "Months ago 1 2 3\nBlood pressure 120/80 130/85 140/90 150/95\nHe feels well."
    got = formatted(spark, both, rows, "The examination shows:\nHematocrit\n40%", "Months ago he fell 3 times.", None, "")
    assert got[0] == "Number of Months Ago\t9\t6\t3\nBlood Pressure (mm Hg)\t130/80\t140/70\t150/90"
    assert got[1] == "Months ago\t1\t2\t3\nBlood pressure\t120/80\t130/85\t140/90\t150/95\nHe feels well."
    assert got[2:] == ["The examination shows:\nHematocrit\n40%", "Months ago he fell 3 times.", None, ""]


def test_results_on_choices_go_back_to_the_block(spark):
    def page(block, tail, n):
        listed_ = "\n".join(f"O {c}) {t}" for c, t in zip("ABCDE", FIVE))
        return f"Exam Section: Item {n} of 50\n{n}. {VIGNETTE}\n{block}\n{ASKS}\n{listed_}{tail}\nPrevious\nNext"

    texts = [
        page("Laboratory studies show:\nHemoglobin\nLeukocyte count\nK+", " 5 g/dL 9000/mm3 4 mEq/L", 1),
        page("Laboratory studies show:\nHematocrit\nLeukocyte count", " 40% 9000/mm3", 2),
        page("Laboratory studies show:\nUrine protein", "", 3).replace(FIVE[1], "Infusion of 0.9%"),
    ]
    got = PG.parse_question_pages(pages(spark, *texts)).orderBy("item").collect()
    block = lambda *lines: f"{VIGNETTE}\nLaboratory studies show:\n" + "\n".join(lines) + f"\n\n{ASKS}"
    assert got[0].stem == block("Hemoglobin\t5 g/dL", "Leukocyte count\t9000/mm³", "K+\t4 mEq/L") and listed(got[0].choices) == list(zip("ABCDE", FIVE))
    assert got[1].stem == block("Hematocrit\t40%", "Leukocyte count\t9000/mm³") and listed(got[1].choices) == list(zip("ABCDE", FIVE))
    assert got[2].stem == block("Urine protein") and got[2].choices[1].text == "Infusion of 0.9%"


def test_unit_families_of_percentages(spark):
    assert value(spark, L.value_family, "50% mixed", "30% (N=25% to 40%, male)", "mm 5%", "40%", "12 mg/dL") == ["percent", "percent", None, "percent", "chem"]


def test_typed_rows_of_segments(spark):
    stem = "He rests.\n\tOn Admission\tNow\nSerum\nGlucose\t38\t54\n140 mEq/L " + ASKS
    rows = B.stem_segments(spark.createDataFrame([(1, stem)], "item_id int, stem string")).orderBy("seg").collect()
    assert [r.kind for r in rows] == ["text", "labs", "text"] and rows[0].rows is None
    assert [(x.kind, x["name"], x.cells) for x in rows[1].rows] == [("header", "", ["On Admission", "Now"]), ("section", "Serum", []), ("row", "Glucose", ["38", "54"]), ("row", "", ["140 mEq/L"])]


def test_laboratory_lines(spark):
    assert value(spark, lambda t: L.line_class(L.normalize_token(t)), "Serum", "Na*", "140 mEq/L", "Leukocyte count", "An x-ray shows", "He walks.") == ["section", "name", "value", "name", "stop", "other"]
    assert value(spark, L.normalize_token, "HCO 3 -", "4 million/mm 3", None) == ["HCO3-", "4 million/mm³", None]
    tokens = value(spark, B.lab_tokens, "AST 68 U/L ALT 44 U/L Which of the following is next?")
    assert tokens == ["AST", "68 U/L", "ALT", "44 U/L"]
    stem = formatted(spark, f"{VIGNETTE}\nLaboratory studies show:\nHematocrit 40%\nFerritin 12 ng/mL\n{ASKS}", VIGNETTE)
    assert stem == [f"{VIGNETTE}\nLaboratory studies show:\nHematocrit\t40%\nFerritin\t12 ng/mL\n\n{ASKS}", VIGNETTE]


def test_segments_rebuild_the_stem(spark):
    text = f"{VIGNETTE}\nHematocrit\t40%\nLeukocyte count\nHe rests.\nNa+\n140 mEq/L\nShe walks."
    rows = B.stem_segments(spark.createDataFrame([(1, text), (2, ""), (3, "Leukocyte count")], "item_id int, stem string")).where("item_id = 1").orderBy("seg").collect()
    assert [r.kind for r in rows] == ["text", "labs", "text", "labs", "text"] and "\n".join(r.text for r in rows) == text
    assert all(text[r.seg_start :].startswith(r.text) for r in rows)


def test_lab_lines_are_dealt_over_tasks(spark, sf):
    """One small file is one task of input; classing its lines is not."""
    from itembank.plans import texts

    assert texts.QUERIES["lab_line_class"](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_unused_stems_are_not_tidied(spark, sf):
    from itembank.plans import texts

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = texts.page_choices(spark, sf)
    assert "(?i)^mark" in plan(rows) and "(?i)^mark" not in plan(rows.drop("stem"))


def test_guarded_choice_rules_equal_plain_ones(spark):
    """Texts of fragments that the rules look at: guards leave nothing out."""
    import random

    from pyspark.sql import functions as F

    from itembank.functions import patterns as P
    from itembank.functions.rules import _replaced, sub

    parts = ["A", "B)", "C.", " ", "\n", "  ", "O", "0", "x", "Q", "I", "l)", "1.", "H)", "Dl", "D1 ", "Heart", "no", "(Yes)", "%", ")", "\t", "Full Screen", "proceed to next item", "5", "Oa)", "\n\n"]
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(1, 14)))) for k in range(20000)]
    df = spark.createDataFrame(rows, "k int, t string")
    both = df.select("t", sub(F.col("t"), P.CHOICE_MARKUP).alias("a"), _replaced(F.col("t"), P.CHOICE_MARKUP).alias("b"), F.length(F.regexp_replace("t", "[^A-Za-z]", "")).alias("n"), F.rlike("t", F.lit(r"\A(?:[^A-Za-z]*+[A-Za-z]){8}")).alias("m"))
    assert both.where("a <> b").take(3) == []
    assert both.where("(n >= 8) <> m").take(3) == []
    assert both.where("a <> t").count() > 5000
