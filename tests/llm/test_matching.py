import itertools
import math

import pytest

from litlens.llm.titles import journals_agree, surname, title_form, title_score
from litlens.llm.matching import match, one_to_one
from litlens.session import Scratch

A = "Effect of 12-week aerobic exercise on sleep quality in shift workers with narcolepsy"
B = "Effect of 14-week aerobic exercise on sleep quality in shift workers with narcolepsy"


def test_title_forms():
    assert title_form("<i>Sleep</i> &amp; mood – conference abstract") == ("sleep and mood", "conference abstract|".rstrip("|"), "", False)
    assert title_form("Reply to: Sleep and mood")[:2] == ("sleep and mood", "reply") and title_form("Sleep and mood – Part II")[2] == "ii" and title_form("Sleep...")[3]
    assert title_form("Ｓｌｅｅｐ аnd mοоd")[0] == "sleep and mood" and title_form("nan")[0] == "" and title_form("role of IL-1Β")[0] == title_form("role of il-1β")[0]


def test_title_scores():
    w = lambda t: title_form(t)[0]
    assert title_score(w(A), w(A)) > 4 and title_score(w(A), w(B)) < 0 and title_score(w(A), w(A.replace("aerobic", "areobic").replace("quality", "qualty"))) > 3
    assert title_score(w(A), w(A + ". A pilot study")) > 2 and title_score(w(A + ". Part I"), w(A + ". Part II")) < 0
    assert journals_agree("J Sleep Res", "Journal of Sleep Research") and not journals_agree("J Sleep Res", "Annals of Sleep Research") and surname("van Brask R") == "brask"


def test_match(spark):
    kind = "id long, title string, first_author string, year {0}, journal string, confidence double, x string"
    left = [(1, A, "Brask", 2001, "J Sleep Res", 0.0, ""), (2, A.upper(), "Brask R", 2001, "Journal of Sleep Research", 0.0, ""), (3, B, "Brask", 2001, "J Sleep Res", 0.0, ""), (4, A, "Stesovikal", 1990, "Ann Oral Res", 0.0, ""),
            (5, None, "Brask", 2001, None, 0.0, ""), (6, "", None, None, None, 0.0, ""), (2, A.upper(), "Brask R", 2001, "Journal of Sleep Research", 0.0, "")]
    right = [(10, A.replace("aerobic", "areobic"), "Brask, Robert", "2002", None, 0.0, ""), (11, "Correction to: " + A, "Brask", "2001", "J Sleep Res", 0.0, ""), (12, B, None, "2001", "Journal of Sleep Research", 0.0, ""), (13, A, "Stesovikal K", "1990", None, 0.0, ""), (14, None, None, None, None, 0.0, ""), (15, "x" * 300_000, None, None, None, 0.0, "")]
    cols = ("id", "title", "first_author", "year", "journal")
    a, b = spark.createDataFrame(left, kind.format("int")), spark.createDataFrame(right, kind.format("string"))
    got = {(r.left_id, r.right_id) for r in match(a, b, cols, cols).collect() if r.confidence >= 0.5}
    assert got == {(1, 10), (2, 10), (3, 12), (4, 13)}
    assert match(a.limit(0), b, cols, cols).count() == 0 and match(a, b.limit(0), cols, cols).count() == 0


def test_short_titles_match_by_author_year_and_journal(spark):
    kind = "id long, title string, first_author string, year int, journal string"
    left = [(1, "Book review", "Trireibriakrus AB", 1998, "Archives of Rehabilitation Medicine"), (2, "Letter to the editor", "Brask R", 2001, None), (3, "Editorial", None, 2003, "J Sleep Res"), (4, "Editorial", "Stesovikal K", 2010, None), (5, "In this issue", "Kroba Y", 2011, "Radiology"), (6, "Editorial", "Sudiovufur K", 1999, None)]
    right = [(10, "Book Review", "Trireibriakrus A", 1998, "Arch Rehabil Med"), (11, "Book review", "Other A", 1998, "Arch Rehabil Med"), (12, "Letter to the Editor", "Brsak R", 2001, None), (13, "Editorial", None, 2003, "Journal of Sleep Research"), (14, "Editorail", "Stesovikal K", 2010, None), (15, "In this issue", "Kroba Y", 2011, "Radiol"), (16, "Editorial", "Sudiovufur K", 1990, None)]
    cols = ("id", "title", "first_author", "year", "journal")
    got = match(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), cols, cols)
    assert {(r.left_id, r.right_id) for r in got.collect() if r.confidence >= 0.5} == {(1, 10), (2, 12), (3, 13), (4, 14), (5, 15)}
    assert title_score("book review", "book review") > -9.0 == title_score("book review", "book review of sleep medicine")


def test_damaged_titles_meet_by_first_words_and_year(spark):
    kind = "id long, title string, first_author string, year int, journal string"
    long = "Randomised controlled trial comparing nocturnal melatonin supplementation against placebo tablets among hospitalised elderly patients recovering after cardiac valve replacement surgery within northern community centres"
    typos = long.replace("nocturnal", "nocturnel").replace("melatonin", "melatonim").replace("supplementation", "supplementatian").replace("against", "againts").replace("tablets", "tablest")  # 5 of the first 12 words
    left = [(1, "Sleep quality among nurses", None, 2001, "J Sleep Res"), (2, "Chronic pain after spinal surgery", "Stesovikal K", 2002, None), (3, "Muscle strength after stroke rehabilitation in older rural adults", None, 2003, None), (4, long, "Kroba Y", 2004, None)]
    right = [(10, "Sleep quality among nurses", "Brask R", 2001, "J Sleep Res"), (11, "Chronic pain after spinal surgery", "Setsovikal K", 2002, None), (12, "Muscle strength after stroke rehabilitatoin in older rural aduls", None, 2003, None), (13, typos, "Kroba Y", 2004, None)]
    cols = ("id", "title", "first_author", "year", "journal")
    got = match(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), cols, cols)
    assert {(r.left_id, r.right_id) for r in got.collect() if r.confidence >= 0.5} == {(1, 10), (2, 11), (3, 12), (4, 13)}


def exact(units):
    """Marginals by enumeration of all assignments with at most one pair per x and per y."""
    total, on = 0.0, [0.0] * len(units)
    for chosen in itertools.product((0, 1), repeat=len(units)):
        xs = [u[0] for u, c in zip(units, chosen, strict=True) if c]
        ys = [u[1] for u, c in zip(units, chosen, strict=True) if c]
        if len(set(xs)) < len(xs) or len(set(ys)) < len(ys):
            continue
        weight = math.exp(sum(u[2] for u, c in zip(units, chosen, strict=True) if c))
        total += weight
        for i, c in enumerate(chosen):
            on[i] += weight * c
    return [x / total for x in on]


@pytest.mark.parametrize("units", [[(1, 1, 2.0)], [(1, 1, 2.0), (1, 2, 1.0)], [(1, 1, 2.0), (1, 2, 1.0), (2, 2, 0.5)], [(1, 1, 3.0), (2, 1, 3.0), (2, 2, -1.0), (3, 2, 1.0)]])
def test_beliefs_are_exact_on_trees(spark, units):
    got = one_to_one(spark.createDataFrame(units, "x long, y long, unary double"), Scratch(spark, "t"), tolerance=1e-7, rounds=60)
    found = {(r.x, r.y): r.confidence for r in got.collect()}
    for u, want in zip(units, exact(units), strict=True):
        assert abs(found[u[:2]] - want) < 1e-4


def test_shouted_greek_and_two_typos_in_a_word():
    w = lambda t: title_form(t)[0]
    assert w("A 5 ΜG DOSE OF IL-1Β") == w("a 5 μg dose of IL-1β") == w("a 5 µg dose of IL-1β")
    assert title_score(w(A), w(A.replace("narcolepsy", "narcloepys"))) > 3 and title_score(w(A), w(A.replace("narcolepsy", "nacrloepsiy"))) < 0


def test_records_that_a_head_rejects_meet_each_other(spark):
    """Many articles share a first group and a year; copies of each must still become one class."""
    kind = "id long, title string, first_author string, year int, journal string"
    topics = ["naps", "light", "noise", "music", "yoga", "diet", "caffeine", "exercise", "massage", "reading", "walking", "swimming"]
    left = [(10 * i + k, f"Effect of evening {t} upon night workers", a, 2001, None) for i, t in enumerate(topics) for k, a in enumerate(("Brask R", "Brask", None))]
    right = [(1000 + i, f"Effect of evening {t} upon night workers", "Brask", 2001, "Sleep") for i, t in enumerate(topics)]
    cols = ("id", "title", "first_author", "year", "journal")
    got = {(r.left_id, r.right_id) for r in match(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), cols, cols).collect() if r.confidence >= 0.5}
    assert got == {(10 * i + k, 1000 + i) for i in range(len(topics)) for k in range(3)}
    assert match(spark.createDataFrame([], kind), spark.createDataFrame([], kind), cols, cols).count() == 0
