import unicodedata

from pyspark.sql import functions as F

from litlens.llm.confusables import lookalike_letters, lookalike_pairs, skeleton, skeleton_text


def test_what_looks_the_same():
    same = [("Ｓｌｅｅｐ　ａ", "Sleep a"), ("café", "café"), ("sl​ee­p", "sleep"), ("a b", "a b"), ("а роре", "a pope"), ("ﬁnal eﬀect", "final effect"), ("Part Ⅱ", "Part II"), ("5 µg", "5 μg"), ("non‑stop", "non-stop"), ("  a   b ", "a b")]
    assert all(skeleton_text(a) == skeleton_text(b) for a, b in same)


def test_what_does_not():
    apart = [("CO₂", "CO2"), ("cafe", "café"), ("Sleep", "sleep"), ("a - b", "a – b"), ("sleep.", "sleep"), ("IL-1β", "IL-1B"), ("x²", "x2"), ("O", "0"), ("l", "1")]
    assert all(skeleton_text(a) != skeleton_text(b) for a, b in apart)


def test_idempotent():
    for t in ("Ｓｌｅｅｐ　ﬁ́ е́", "ǅ ﷺ ½ ①", "​", ""):
        assert skeleton_text(skeleton_text(t)) == skeleton_text(t) == unicodedata.normalize("NFD", skeleton_text(t))


def test_column_agrees(spark):
    texts = ["plain  text ", "Ｓｌｅｅｐ", "", " ", None, "a\tb\nc", "x" * 200_000 + "а", "\x00a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", skeleton(F.col("t")).alias("s")).collect()
    assert all(r.s == (None if r.t is None else skeleton_text(r.t)) for r in rows)


def test_pairs(spark):
    left = [(1, "Sleep a"), (2, "Ｓｌｅｅｐ a"), (3, None), (4, ""), (5, "nan"), (6, "Sleep b"), (2, "Ｓｌｅｅｐ a")]
    right = [(10, "Sleep a"), (11, "Sl​eep a"), (12, "Sleep A"), (13, "ｎａｎ"), (14, "​"), (15, None)]
    a, b = spark.createDataFrame(left, "s long, text string"), spark.createDataFrame(right, "s long, text string").withColumnRenamed("s", "ta")
    got = sorted((r.s, r.ta) for r in lookalike_pairs(a, "s", "text", b, "ta", "text").collect())
    assert got == [(1, 11), (2, 10), (2, 10), (2, 11), (2, 11)]
    assert lookalike_pairs(a.limit(0), "s", "text", b, "ta", "text").count() == 0


def test_hot_title(spark):
    a = spark.range(3000).select(F.col("id").alias("x"), F.lit("Same title").alias("t"))
    b = spark.range(3000).select(F.col("id").alias("y"), F.when(F.col("id") == 0, "Ｓame title").otherwise("Same title").alias("t"))
    assert lookalike_pairs(a, "x", "t", b, "y", "t").count() == 3000


def test_letters_of_the_look_alike_data(spark):
    letters = lookalike_letters(spark)
    assert [letters.get(c) for c in "օսհᎪᎬᎳꓮꓐꓑνѵЬ"] == list("ouhAEWABPvvb") and len(letters) > 150
    assert not {"α", "γ", "ι", "ρ", "σ", "υ", "β"} & letters.keys() and all(len(v) == 1 and v.isascii() for v in letters.values()) and letters["І"] == "I" and letters["і"] == "i"
    same, apart = [("Ꭺ ѵisіt", "A visit"), ("ꓐody", "Body")], [("TNF-α", "TNF-a"), ("№ 1", "No 1"), ("⑴", "(1)")]
    rows = spark.createDataFrame([*same, *apart], "a string, b string").select((skeleton(F.col("a")) == skeleton(F.col("b"))).alias("same")).collect()
    assert [r.same for r in rows] == [True, True, False, False, False]
