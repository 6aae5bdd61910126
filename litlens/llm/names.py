"""Variant spellings of names: MinHash banding over padded q-grams, Monge-Elkan checks, star clustering.

Distinct strings are parsed once and collapsed into profiles (family part, given parts); families that may be
typos of each other are found by banding, profiles of equal or near families are compared part by part, and the
accepted links are clustered into stars: the fullest, most frequent spelling of a neighbourhood is its centre.
Everything between the steps is a join or an aggregation on short keys; a name on a third of all rows is one row
after the first aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.llm.name_parts import given_letters, given_similarity, group_similarity, parse
from litlens.session import Scratch

_READING = T.StructType([T.StructField("family", T.StringType()), T.StructField("given", T.StringType())])
_PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("readings", T.ArrayType(_READING))])


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` hashes with which a pair of this Jaccard similarity meets at least
    once with probability ``recall``: from the collision curve 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def exact_length(similarity: float, q: int) -> int:
    """The length up to which one typo may leave a family name less than this Jaccard similarity of padded q-grams:
    a swap of neighbours, the worst, keeps n - 2 of n + 2q."""
    return math.ceil((2 + 2 * q * similarity) / (1 - similarity))


def minhash_bands(text: Column, q: int, rows: int, bands: int) -> Column:
    """Band keys of a text's padded q-grams, in the JVM."""
    padded = F.concat(F.lit("^" * (q - 1)), text, F.lit("$" * (q - 1)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, q)))
    hashed = F.transform(grams, lambda g: F.xxhash64(g))

    def least(seed: Column) -> Column:
        return F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, seed)))

    def band(b: Column) -> Column:
        return F.xxhash64(b, *[least(b * rows + k) for k in range(rows)])

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)


@F.pandas_udf(_PARSED)
def _parsed(names: pd.Series) -> pd.DataFrame:
    out = [parse(n) if n else None for n in names]
    return pd.DataFrame({"kind": [p and p[0] for p in out], "readings": [p and [{"family": f, "given": g} for f, g in p[1]] for p in out]})


@F.pandas_udf(T.DoubleType())
def _agreement(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict = {}
    for batch in batches:
        out = []
        for k, x, y in zip(*batch, strict=True):
            found = known.get((k, x, y))
            if found is None:
                if len(known) > 200_000:
                    known.clear()
                found = known[k, x, y] = (group_similarity if k == "group" else given_similarity)(x, y)
            out.append(found)
        yield pd.Series(out, dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _letters(kinds: pd.Series, given: pd.Series) -> pd.Series:
    return pd.Series([["*"] if k == "group" else given_letters(g) for k, g in zip(kinds, given, strict=True)], dtype=object)


def _resolved(names: DataFrame) -> DataFrame:
    """name, n, kind, family, given: open readings are settled by how often words occur as family and given names
    in names whose order is plain."""
    parsed = names.withColumn("p", _parsed("name")).select("name", "n", "p.kind", "p.readings").where("kind is not null and kind <> 'bare'")
    plain = parsed.where(F.size("readings") == 1).select("name", "n", "kind", F.col("readings")[0]["family"].alias("family"), F.col("readings")[0]["given"].alias("given"))
    people = plain.where("kind = 'person'")
    as_family = people.groupBy(F.col("family").alias("word")).agg(F.count(F.lit(1)).alias("f"), F.lit(0).cast("long").alias("g"))
    as_given = people.select(F.split("given", " ")[0].alias("word"), "family").where(F.length("word") > 1).distinct().groupBy("word").agg(F.lit(0).cast("long").alias("f"), F.count(F.lit(1)).alias("g"))
    roles = as_family.unionByName(as_given).groupBy("word").agg(F.log((F.sum("f") + 1) / (F.sum("g") + 1)).alias("family_odds"))
    options = parsed.where(F.size("readings") == 2).select("name", "n", "kind", F.posexplode("readings").alias("pos", "r")).select("name", "n", "kind", "pos", "r.family", "r.given", F.split("r.given", " ")[0].alias("lead"))
    fam, lead = roles.select(F.col("word").alias("family"), F.col("family_odds").alias("fo")), roles.select(F.col("word").alias("lead"), F.col("family_odds").alias("lo"))
    scored = options.join(fam, "family", "left").join(lead, "lead", "left")
    score = F.round(F.coalesce("fo", F.lit(0.0)) - F.coalesce("lo", F.lit(0.0)), 9)
    best = scored.groupBy("name").agg(F.max(F.struct(score.alias("s"), (-F.col("pos")).alias("p"), "n", "kind", "family", "given")).alias("b"))
    return plain.unionByName(best.select("name", "b.n", "b.kind", "b.family", "b.given"))


def _near_families(profiles: DataFrame, q: int, similarity: float, recall: float, rows: int, scratch: Scratch) -> DataFrame:
    """kind, fa, fb (fa < fb): family parts within one edit of each other, found through shared bands.

    A band's families are compared where they begin or end with the same three letters, as any two of them within one
    edit do; so buckets of all sizes are treated alike and lose nothing. Families so short that a typo can leave them
    less than ``similarity`` meet through equal remainders after leaving out one letter, which any two strings within
    one edit have in common. One edit leaves nothing in common between two families of one or two letters (Li and
    Lu); they stay apart.
    """
    short = exact_length(similarity, q)
    # hashing is the work here, not bytes: keep the tasks that adaptive execution would merge
    tasks = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    families = profiles.select("kind", "family").where("family <> ''").distinct().repartition(tasks, "family")
    banded = families.where(F.length("family") >= short).select("kind", "family", F.explode(minhash_bands(F.col("family"), q, rows, bands_for(similarity, recall, rows))).alias("band"))
    ends = F.array(F.xxhash64("kind", "band", F.lit("^"), F.substring("family", 1, 3)), F.xxhash64("kind", "band", F.lit("$"), F.substring("family", -3, 3)))
    keyed = scratch.cut(banded.select("kind", "family", F.explode(ends).alias("key")))
    a = keyed.select("kind", "key", F.col("family").alias("fa"))
    b = keyed.select("kind", "key", F.col("family").alias("fb"))
    left_out = F.transform(F.sequence(F.lit(0), F.length("family")), lambda i: F.concat(F.substring("family", F.lit(1), i - 1), F.substring("family", i + 1, F.length("family"))))
    many = families.where(F.length("family") <= short).select("kind", "family", F.explode(F.array_distinct(left_out)).alias("rest"))
    c = many.select("kind", "rest", F.col("family").alias("fa"))
    e = many.select("kind", "rest", F.col("family").alias("fb"))
    met = a.join(b, ["kind", "key"]).select("kind", "fa", "fb").unionByName(c.join(e, ["kind", "rest"]).select("kind", "fa", "fb"))
    d = F.levenshtein("fa", "fb", 2)
    swapped = (d == 2) & (F.length("fa") == F.length("fb")) & (F.array_sort(F.split("fa", "")) == F.array_sort(F.split("fb", "")))
    return met.where("fa < fb and greatest(length(fa), length(fb)) > 2").where((F.abs(F.length("fa") - F.length("fb")) <= 1) & ((d == 1) | swapped)).distinct()


def star_clusters(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``centre`` by star clustering in rounds.

    ``nodes``: node, weight (any orderable, unique with the node); ``edges``: a, b, sim. In each round every node
    that outweighs all its unassigned neighbours becomes a centre and takes its unassigned neighbours; a node
    between several centres goes to the most similar, then the heaviest. Nodes without neighbours are centres. The
    heaviest unassigned node is always a centre, so every round assigns nodes and the rounds end.
    """
    both = edges.select(F.explode(F.array(F.struct("a", "b", "sim"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))).alias("e")).select("e.a", "e.b", "e.sim")
    rank = nodes.select("node", F.struct("weight", "node").alias("rank"))
    work = scratch.cut(both.join(rank.select(F.col("node").alias("a"), F.col("rank").alias("ra")), "a").join(rank.select(F.col("node").alias("b"), F.col("rank").alias("rb")), "b"))
    done = []
    while scratch.rows(work):
        lead = work.groupBy("a").agg(F.first("ra").alias("ra"), F.max("rb").alias("top")).where("ra > top").select(F.col("a").alias("c"))
        taken = work.join(lead.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.max(F.struct("sim", "rb", "b")).alias("m"))
        # a centre has no heavier neighbour, so centres are never neighbours of each other
        assigned = scratch.cut(lead.select(F.col("c").alias("node"), F.col("c").alias("centre")).unionByName(taken.select(F.col("a").alias("node"), F.col("m.b").alias("centre"))))
        done.append(assigned)
        gone = assigned.select("node")
        left = work.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        following = scratch.cut(left)
        scratch.drop(work)
        work = following
    if not done:
        return nodes.select("node", F.col("node").alias("centre"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return nodes.select("node").join(placed, "node", "left").select("node", F.coalesce("centre", "node").alias("centre"))


def link_names(names: DataFrame, column: str, q: int = 3, similarity: float = 0.5, recall: float = 0.98, rows: int = 3, accept: float = 0.85) -> DataFrame:
    """``name``, ``entity``: every string that names a person or group, with the identifier of its entity.

    Null, empty and placeholder strings and bare family names name nobody and are left out. Repeated strings
    count as frequency. An empty table gives no rows; other columns are ignored. ``similarity`` is the Jaccard
    similarity of padded q-grams that a long family name keeps after one typo, ``recall`` the share of such pairs
    that banding must find; shorter names are found without banding (see ``exact_length``).
    """
    scratch = Scratch(names.sparkSession, "names")
    counted = names.select(F.col(f"`{column}`").alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    known = scratch.cut(_resolved(scratch.cut(counted)).withColumn("node", F.xxhash64("kind", "family", "given")))
    parts = F.size(F.split("given", " "))
    full = F.size(F.filter(F.split("given", " "), lambda t: F.length(t) > 1))
    profiles = scratch.cut(known.groupBy("node", "kind", "family", "given").agg(F.sum("n").alias("n")).withColumn("weight", F.struct(F.least(parts, F.lit(2)).alias("parts"), F.col("n"), full.alias("full"))))
    near = _near_families(profiles, q, similarity, recall, rows, scratch)
    spans = scratch.cut(near.unionByName(profiles.select("kind", F.col("family").alias("fa"), F.col("family").alias("fb")).distinct()))
    # given parts that agree share a letter, through short forms and typos too; a pair counts at the first they share
    lettered = profiles.withColumn("letters", _letters("kind", "given")).select("kind", "family", "given", "node", "letters", F.explode("letters").alias("letter"))
    left = lettered.select("kind", F.col("family").alias("fa"), F.col("given").alias("ga"), F.col("node").alias("a"), F.col("letters").alias("la"), "letter")
    right = lettered.select("kind", F.col("family").alias("fb"), F.col("given").alias("gb"), F.col("node").alias("b"), F.col("letters").alias("lb"), "letter")
    pairs = spans.join(left, ["kind", "fa"]).join(right, ["kind", "fb", "letter"]).where("(fa < fb or a < b) and letter = array_min(array_intersect(la, lb))")
    scored = pairs.withColumn("sim", _agreement("kind", "ga", "gb") - F.when(F.col("fa") == F.col("fb"), 0.0).otherwise(0.05)).where(F.col("sim") >= accept)
    # "Somewhere SACN" is written for "Somewhere Sleep Apnoea Collaborative Network"
    groups = profiles.where("kind = 'group'").select("family", F.split("given", r"\|")[1].alias("given"), F.col("node").alias("a"))
    short = groups.join(profiles.where("kind = 'person'").select("family", "given", F.col("node").alias("b")), ["family", "given"])
    links = scored.select("a", "b", "sim").unionByName(short.select("a", "b", F.lit(0.9).alias("sim")))
    stars = star_clusters(profiles.select("node", "weight"), scratch.cut(links), scratch)
    return known.select("name", "node").join(stars, "node").select("name", F.col("centre").alias("entity"))


def name_pairs(members: DataFrame) -> DataFrame:
    """``name_a`` < ``name_b``: all pairs of strings of one entity."""
    a = members.select("entity", F.col("name").alias("name_a"))
    b = members.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
