import random

import pytest

from litlens.llm.components import components


def brute(edges):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None and b is None:
            continue
        a, b = find(a if a is not None else b), find(b if b is not None else a)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(parent)}


def shapes():
    rng = random.Random(5)
    yield [(f"n{i:04}", f"n{i + 1:04}") for i in range(300)]  # a chain
    yield [("hub", f"s{i}") for i in range(500)]  # a hub with all edges
    yield [(f"v{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}") for _ in range(350)]
    yield [("a", "a"), ("b", "a"), ("a", "b"), ("b", "a"), ("c", None), (None, "d"), (None, None), ("e", "e")]


@pytest.mark.parametrize("edges", list(shapes()))
def test_components(spark, edges):
    got = components(spark.createDataFrame([(*e, 1) for e in edges], "left string, right string, component int"), "left", "right")
    assert {r.vertex: r.component for r in got.collect()} == brute(edges)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
