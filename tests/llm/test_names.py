import pytest
from pyspark.sql import functions as F

from litlens.llm.name_parts import given_letters, given_similarity, parse, within_one
from litlens.llm.names import bands_for, link_names, minhash_bands, name_pairs


@pytest.mark.parametrize("name,want", [
    ("Sudiovufur KB", ("person", [("sudiovufur", "k b")])), ("K. B. Sudiovufur", ("person", [("sudiovufur", "k b")])), ("Sudiovufur, K.B.", ("person", [("sudiovufur", "k b")])), ("SUDIOVUFUR KB", ("person", [("sudiovufur", "k b")])),
    ("de Behianikand JW", ("person", [("behianikand", "j w")])), ("Bimyvikrul KT von", ("person", [("bimyvikrul", "k t")])), ("Anna von Bystalemul", ("person", [("bystalemul", "anna")])), ("Alex H. Goselitux", ("person", [("goselitux", "alex h")])),
    ("van Krukas", ("bare", [("krukas", "")])), ("Krukas", ("bare", [("krukas", "")])), ("nan", None), ("", None), ("  ", None), ("Zabotas WM", ("person", [("zabotas", "w m")])), ("Maso, Anne-Marie", ("person", [("maso", "anne marie")])),
    ("The Tralyt Insomnia Study Group", ("group", [("tralyt", "group insomnia study|i s g")])), ("Study Group Insomnia, Tralyt", ("group", [("tralyt", "group insomnia study|s g i")])),
])
def test_parse(name, want):
    assert parse(name) == want


def test_open_order_has_two_readings():
    assert parse("Vera Stesovikal") == ("person", [("stesovikal", "vera"), ("vera", "stesovikal")])


def test_given_parts():
    assert given_similarity("r", "bob") > 0.8 and given_similarity("robert", "bob") > 0.9 and given_similarity("k b", "y l") == 0 and given_similarity("j", "j h") > 0.9 and given_similarity("james", "joan") == 0 and given_similarity("", "j") == 0
    assert within_one("abcd", "abdc") and within_one("abc", "abcd") and not within_one("abcd", "badc")


def test_collision_curve(spark):
    b = bands_for(0.5, 0.98, 3)
    assert 1 - (1 - 0.5**3) ** b >= 0.98 > 1 - (1 - 0.5**3) ** (b - 1)
    rows = spark.createDataFrame([("kibruziafur", "kbruziafur"), ("stesovikal", "mubukekar")], "a string, b string").select(F.arrays_overlap(minhash_bands(F.col("a"), 3, 3, b), minhash_bands(F.col("b"), 3, 3, b)).alias("met")).collect()
    assert [r.met for r in rows] == [True, False]


def test_link_names(spark):
    people = [["Sudiovufur KB", "K. B. Sudiovufur", "Sudiovufur, Karl B.", "SUDIOVUFUR KB", "Suidovufur KB"], ["Sudiovufur YL", "Yusuf Sudiovufur"], ["Robert van Brask", "van Brask R", "Brask, Bob"],
              ["The Tralyt Insomnia Study Group", "Tralyt Insomnia Study Grp", "Study Group Insomnia, Tralyt", "Tralyt ISG"], ["Ryhy Insomnia Study Group"], ["Kroba Yusuf", "Kroba, Yusuf"], ["Sote, Yusuf"]]
    nobody = ["Sudiovufur", "van Brask", "nan", "", None, " "]
    rows = [(n, "x") for p in people for n in p for _ in range(2)] + [(n, "x") for n in nobody]
    got = name_pairs(link_names(spark.createDataFrame(rows, "name string, entity string"), "name"))
    want = {(a, b) for p in people for a in p for b in p if a < b}
    assert {(r.name_a, r.name_b) for r in got.collect()} == want
    assert link_names(spark.createDataFrame([], "name string"), "name").count() == 0


def test_crowded_buckets_are_exact(spark):
    import random

    from litlens.llm.names import _near_families
    from litlens.session import Scratch

    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abk") for _ in range(rng.randint(5, 7))) for _ in range(400)})
    df = spark.createDataFrame([("person", n) for n in names], "kind string, family string")
    got = {(r.fa, r.fb) for r in _near_families(df, 3, 0.5, 0.98, 3, Scratch(spark, "t")).collect()}
    want = {(a, b) for a in names for b in names if a < b and within_one(a, b)}
    assert want <= got and all(sorted(a) == sorted(b) for a, b in got - want)


def near_by_brute_force(names):
    return {(a, b) for a in names for b in names if a < b and within_one(a, b)}


def test_short_families_meet(spark):
    from litlens.llm.names import _near_families
    from litlens.session import Scratch

    names = ["wang", "wnag", "chen", "chne", "khan", "kahn", "kim", "km", "diaz", "diza", "brown", "bown", "li", "lu"]
    df = spark.createDataFrame([("person", n) for n in names], "kind string, family string")
    got = {(r.fa, r.fb) for r in _near_families(df, 3, 0.5, 0.98, 3, Scratch(spark, "t")).collect()}
    assert got == near_by_brute_force(names) - {("li", "lu")}
    linked = name_pairs(link_names(spark.createDataFrame([("Wang JB",), ("Wnag JB",), ("Bown, Karl",), ("Brown, Karl",)], "name string"), "name"))
    assert {(r.name_a, r.name_b) for r in linked.collect()} == {("Wang JB", "Wnag JB"), ("Bown, Karl", "Brown, Karl")}


def test_ordinary_buckets_are_exact_for_shorter_families(spark):
    import random

    from litlens.llm.names import _near_families, exact_length
    from litlens.session import Scratch

    rng = random.Random(5)
    names = set()
    for n in range(5, 11):
        for _ in range(20):
            name = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", n))
            i = rng.randrange(n - 1)
            names |= {name, name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + "é" + name[i + 1 :]}
    df = spark.createDataFrame([("person", n) for n in sorted(names)], "kind string, family string")
    got = {(r.fa, r.fb) for r in _near_families(df, 3, 0.5, 0.98, 3, Scratch(spark, "t")).collect()}
    assert exact_length(0.5, 3) == 10 and near_by_brute_force(names) <= got


def test_rare_other_use_of_a_family_name_changes_no_reading(spark):
    from litlens.llm.names import _resolved

    plain = [(f"Vera {c}.", 1) for c in "ABCDEFGHIJ"] + [(f"{w}, Vera", 1) for w in ("Sote", "Maso", "Kroba")]
    got = {r.name: r.family for r in _resolved(spark.createDataFrame([*plain, ("Vera Zibo", 1)], "name string, n long")).collect()}
    assert got["Vera Zibo"] == "vera"


def test_given_parts_in_another_order():
    assert given_similarity("jean paul", "paul jean") == 1.0 and given_similarity("jean paul", "pual jean") > 0.9 and given_similarity("j p", "p j") == 0.0
    assert given_similarity("jean paul", "paul") == 0.0 and given_similarity("anna maria", "maria") == 0.0


def test_letters_never_part_what_agrees():
    import itertools

    from litlens.llm.name_parts import FORMAL

    names = sorted({*list(FORMAL)[::4], "ames", "jmaes", "kames", "james", "ajames", "jean paul", "paul jean", "j", "r", "b", "j h", "james h", "h", "bob", "robert j", "jo", "anne marie", "marie anne"})
    for a, b in itertools.combinations(names, 2):
        assert given_similarity(a, b) < 0.85 or set(given_letters(a)) & set(given_letters(b)), (a, b)


def test_long_families_meet_by_length_and_edit(spark):
    import random

    from litlens.llm.names import _near_families
    from litlens.session import Scratch

    rng = random.Random(6)
    want: dict = {}
    for n in range(11, 16):
        for kind in ("swap", "other", "less", "more"):
            for _ in range(60):
                name = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", n))
                i = rng.randrange(n - 1)
                typo = {"swap": name[:i] + name[i + 1] + name[i] + name[i + 2 :], "other": name[:i] + "é" + name[i + 1 :], "less": name[:i] + name[i + 1 :], "more": name[:i] + "ü" + name[i:]}[kind]
                want.setdefault((n, kind), set()).add((min(name, typo), max(name, typo)))
    names = sorted({x for pairs in want.values() for p in pairs for x in p})
    got = {(r.fa, r.fb) for r in _near_families(spark.createDataFrame([("person", n) for n in names], "kind string, family string"), 3, 0.5, 0.98, 3, Scratch(spark, "t")).collect()}
    assert all(len(pairs & got) >= 0.98 * len(pairs) for pairs in want.values()), {k: len(v & got) / len(v) for k, v in want.items()}
