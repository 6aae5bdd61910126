import random

from pyspark.sql import functions as F

from litlens.llm.merkle import collapse

KIND = "id long, name string, tags array<string>, who array<struct<last:string,first:string>>, extra map<string,string>"


def test_formatting_and_order_do_not_count(spark):
    rows = [
        (1, "A b-c", ["x", "Y"], [("Doe", "J"), ("Roe", "K")], {"k": "v", "l": "w"}), (2, "a  BC", ["y!", "X"], [("ROE", "k."), ("doe", "j")], {"l": "W", "k": "v"}),
        (3, "a b c d", ["x", "y"], [("Doe", "J"), ("Roe", "K")], {"k": "v", "l": "w"}), (4, "A b-c", ["x"], [("Doe", "J"), ("Roe", "K")], {"k": "v", "l": "w"}),
        (5, None, None, None, None), (6, None, None, None, None), (7, "", [], [], {}), (8, " ", [], [], {}), (9, "A b-c", ["x", "Y"], [("J", "Doe"), ("Roe", "K")], {"k": "v", "l": "w"}),
    ]
    out = collapse(spark.createDataFrame(rows, KIND), ["tags", "name", "extra", "who"], keep={"ids": F.array_sort(F.collect_list("id"))})
    assert sorted((r.copies, r.ids) for r in out.collect()) == [(1, [3]), (1, [4]), (1, [9]), (2, [1, 2]), (2, [5, 6]), (2, [7, 8])]


def test_ordered_arrays_and_leaf_rules(spark):
    df = spark.createDataFrame([(["a", "b"],), (["b", "a"],)], "x array<string>")
    assert collapse(df, ["x"]).count() == 1 and collapse(df, ["x"], ordered=["x"]).count() == 2
    assert collapse(spark.createDataFrame([("A",), ("a",)], "x string"), ["x"], leaves={"x": lambda c: c}).count() == 2


def test_empty_clashing_long_and_hot(spark):
    assert collapse(spark.createDataFrame([], "root string, canonical string"), ["root"]).count() == 0
    long = "w " * 200_000
    df = spark.createDataFrame([(long, "a"), (long.upper(), "b")] + [("hot", str(i)) for i in range(2000)], "root string, copies string")
    assert sorted(r.copies for r in collapse(df, ["root"]).collect()) == [2, 2000]


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("aB -") for _ in range(rng.randint(0, 4))), [rng.choice(["p", "Q", "q "]) for _ in range(rng.randint(0, 3))]) for _ in range(600)]
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    want: dict = {}
    for a, b in rows:
        key = (plain(a), tuple(sorted(map(plain, b))))
        want[key] = want.get(key, 0) + 1
    got = collapse(spark.createDataFrame(rows, "a string, b array<string>"), ["b", "a"])
    assert sorted(r.copies for r in got.collect()) == sorted(want.values())
