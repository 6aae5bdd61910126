"""Connected components by randomised contraction.

Each round draws a fresh hash order, every vertex hooks to the neighbour (or itself) that comes first in it,
edges are relabelled by the hooks and deduplicated; the expected number of vertices falls by a constant factor
whatever the shape, so chains and stars take the same logarithmic number of rounds. At the end the rounds'
mappings are composed backwards. Every frame between rounds is a table in the shared folder. The number of
remaining edges is the only thing that reaches the driver. Text vertices go through the rounds as 64-bit hashes, which
are checked for collisions once, and get their names back at the end.

Skew: hooks are minima, combined before the shuffle, so a hub is one row per task; the relabelling join of a
hub's edges is split by adaptive skew handling, for its other side has one row per vertex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.session import Scratch


def _order(vertex: Column, seed: int) -> Column:
    return F.xxhash64(vertex, F.lit(seed))


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    """v -> the first of its closed neighbourhood in this round's order (ties by the vertex itself)."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    first = both.groupBy("a").agg(F.min(F.struct(_order(F.col("b"), seed).alias("h"), F.col("b").alias("v"))).alias("m"))
    own = F.struct(_order(F.col("a"), seed).alias("h"), F.col("a").alias("v"))
    return first.select(F.col("a").alias("v"), F.least(F.col("m"), own)["v"].alias("r"))


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 200) -> DataFrame:
    """``vertex``, ``component``: every vertex of an edge and the smallest vertex of its component.

    Null ends are no vertices: such an edge gives its other end as a component of its own. Self loops,
    repeated and reversed edges change nothing; extra columns are ignored; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    pairs = edges.select(F.coalesce(F.least(a, b), a, b).alias("a"), F.coalesce(F.greatest(a, b), b, a).alias("b")).where("a is not null")
    if not isinstance(pairs.schema["a"].dataType, T.StringType):
        return _named(_contracted(pairs, scratch, max_rounds), "v")
    texts = scratch.cut(pairs.distinct())
    ends = texts.select(F.explode(F.array("a", "b")).alias("name")).distinct().select(F.xxhash64("name").alias("v"), "name")
    names = scratch.cut(ends)
    if not names.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # two texts of one hash: go by the texts themselves
        return _named(_contracted(texts, scratch, max_rounds), "v")
    members = _contracted(texts.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), scratch, max_rounds)
    return _named(scratch.cut(members.join(names, "v").select("name", "r")), "name")


def _named(members: DataFrame, vertex: str) -> DataFrame:
    smallest = members.groupBy("r").agg(F.min(vertex).alias("component"))
    return members.join(smallest, "r").select(F.col(vertex).alias("vertex"), "component")


def _contracted(pairs: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    """v, r: every vertex of the pairs (a, b) with a representative that its component shares."""
    all_pairs = scratch.cut(pairs.distinct())
    work, rounds = all_pairs.where("a <> b"), []
    while not work.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError("contraction did not end")
        hooks = scratch.cut(_hooks(work, len(rounds) + 1))
        ra, rb = hooks.select(F.col("v").alias("a"), F.col("r").alias("ra")), hooks.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        moved = work.join(ra, "a").join(rb, "b").where("ra <> rb")
        following = scratch.cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if rounds:
            scratch.drop(work)
        rounds.append(hooks)
        work = following
    loops = all_pairs.where("a = b").select(F.col("a").alias("v"), F.col("a").alias("r"))
    if not rounds:
        return loops
    labels = rounds.pop()
    for n, hooks in enumerate(reversed(rounds), 1):
        up = labels.select(F.col("v").alias("r"), F.col("r").alias("top"))
        labels = hooks.join(up, "r", "left").select("v", F.coalesce("top", "r").alias("r"))
        if n % 4 == 0:  # keeps plans short however many rounds there were
            labels = scratch.cut(labels)
    labels = scratch.cut(labels)
    return scratch.cut(labels.unionByName(loops.join(labels.select("v"), "v", "left_anti")))
