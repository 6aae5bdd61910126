"""Matching descriptions of articles across two tables without a shared key, by loopy belief propagation.

Candidate pairs come from keys over groups of the title's words, the author, the year and the journal; a pair's own
evidence (title, author, year, journal) is its unary log-odds. Rows of one table that describe one article are first
joined into classes, so that the factors can be one-to-one: a class of the left table is at most one class of the
right one and the other way round. Messages between pairs and factors are exchanged through grouped sums and
joins until they converge. The marginals are the confidences; they hold for all rows of the two classes.

Both tables go through every step together, with a side number, so a step is one job for both. Equal descriptions
are one record from the start; keys are 64-bit numbers that travel with a record number and a signature of the
first words, so implausible pairs end where they meet and titles are fetched for the others only.
"""

from __future__ import annotations

import functools
import hashlib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.llm.components import components
from litlens.llm.titles import ABOUT_AFTER, ABOUT_BEFORE, AFTER_ENDS, KINDS, PART, description_score, journal_initials, journals_agree, short_keys, surname, surnames_agree, title_form, title_score
from litlens.session import Scratch

_FORM = T.StructType([T.StructField("words", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("part", T.StringType()), T.StructField("cut", T.BooleanType())])
_CACHE = 100_000  # entries that a Python task remembers


@F.pandas_udf(_FORM)
def _python_form(titles: pd.Series) -> pd.DataFrame:
    forms = [title_form(t) if t else ("", "", "", False) for t in titles]
    return pd.DataFrame(forms, columns=["words", "kind", "part", "cut"])


def _remembering(f):
    """A text function as a column function that meets each distinct text of a batch once."""

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        known = {t: f(t) for t in texts.dropna().unique()}
        return pd.Series([known.get(t) for t in texts], dtype=object)

    return apply


_python_surname, _python_initials = _remembering(surname), _remembering(journal_initials)


@F.pandas_udf(T.DoubleType())
def _score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    journals: dict = {}
    surnames: dict = {}

    def remembered(known: dict, agree, a: str, b: str) -> bool:
        found = known.get((a, b))
        if found is None:
            if len(known) > _CACHE:
                known.clear()
            found = known[a, b] = agree(a, b)
        return found

    for batch in batches:
        out = []
        for a, b, c, d, s, t, y, z, j, k in zip(*batch, strict=True):
            score = title_score(a, b, c, d)
            if score > -9.0:
                same_author = remembered(surnames, surnames_agree, s, t) if s and t and s != t else None if not s or not t else True
                same_journal = remembered(journals, journals_agree, j, k) if j and k and j != k else None if not j or not k else True
                score = description_score(score, same_author, None if y < 0 or z < 0 else abs(int(y) - int(z)), same_journal)
            out.append(score)
        yield pd.Series(out, dtype="float64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _short(words: pd.Series, authors: pd.Series, years: pd.Series, journals: pd.Series, kinds: pd.Series) -> pd.Series:
    def hashed(key: str) -> int:
        return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little", signed=True)

    rows = zip(words, authors, years, journals, kinds, strict=True)
    return pd.Series([[hashed(f"{k}|{x}") for x in short_keys(w, a, None if pd.isna(y) else int(y), j and journal_initials(j))] if w else [] for w, a, y, j, k in rows], dtype=object)


def _formed(df: DataFrame, title: str) -> DataFrame:
    """``df`` with ``words``, ``kind`` (with the part of a series) and ``cut`` by ``title_form``: titles of plain
    ASCII without markup in the JVM, the others in Python. One projection a step, so no pattern is run twice."""
    t = F.col(title)
    d = df.withColumn("__plain", F.coalesce(t.rlike(r"^[\x20-\x7e]*$") & ~t.rlike("[<&]"), F.lit(False)))
    d = d.withColumn("__f", _python_form(F.when(~F.col("__plain"), t))).withColumn("__w", F.when(F.col("__plain"), F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))))
    ends = [F.col("__w").endswith(w) for w in AFTER_ENDS]
    for mark, pattern, can in (("__m1", ABOUT_BEFORE.pattern, F.lit(True)), ("__m2", ABOUT_AFTER.pattern, functools.reduce(Column.__or__, ends))):
        d = d.withColumn(mark, F.when(can, F.regexp_extract("__w", pattern, 1)).otherwise(F.lit("")))
        d = d.withColumn("__w", F.when(F.col(mark) == "", F.col("__w")).otherwise(F.trim(F.regexp_replace("__w", pattern, ""))))
    d = d.withColumn("__w", F.when(F.col("__w").isin("nan", "none", "null"), F.lit("")).otherwise(F.col("__w")))
    d = d.withColumn("__m", F.when(F.col("__m2") == "", F.col("__m1")).otherwise(F.col("__m2"))).withColumn("__p", F.when(F.concat(F.lit(" "), "__w").rlike(" p(?:ar)?t "), F.regexp_extract(F.concat(F.lit(" "), "__w"), PART.pattern, 1)).otherwise(F.lit("")))
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("__m")], F.col("__m"))
    here = {"words": F.col("__w"), "kind": F.concat_ws("|", kind, "__p"), "cut": F.rtrim(t).endswith("...")}
    there = {"words": F.col("__f.words"), "kind": F.concat_ws("|", "__f.kind", "__f.part"), "cut": F.col("__f.cut")}
    made = d.withColumns({n: F.when(F.col("__plain"), here[n]).otherwise(there[n]) for n in here})
    return made.drop("__plain", "__f", "__w", "__m1", "__m2", "__m", "__p")


def _surname(author: Column) -> Column:
    """``surname``: a bare family name, with or without initials, in the JVM, the others in Python."""
    head = F.lower(F.regexp_extract(author, r"^([A-Z][a-z]+)(?: [A-Z]{1,2})?$", 1))
    simple = (head != "") & ~head.isin("nan", "none", "null")
    return F.coalesce(F.when(simple, head), _python_surname(F.when(~simple, author)), F.lit(""))


_DESCRIBED = ("words", "kind", "cut", "surname", "year", "journal")


def _rows(df: DataFrame, side: int, key: str, title: str, author: str, year: str, journal: str) -> DataFrame:
    """id, side, rec and the description of every row; words are empty where there is no usable title."""

    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    j = F.regexp_replace(col(journal).cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    y = F.regexp_extract(col(year).cast("string"), r"(1[5-9]\d\d|20\d\d)", 1)
    typed = df.select(
        col(key).alias("id"), F.lit(side).alias("side"), col(title).cast("string").alias("title"), _surname(col(author).cast("string")).alias("surname"),
        F.when(y != "", y.cast("int")).alias("year"), F.when(~F.lower(j).isin("", "nan", "none"), j).alias("journal"),
    )
    return _formed(typed, "title").drop("title").withColumn("rec", F.xxhash64("side", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _DESCRIBED]))


_FIRST = 11
_LOW = sum(1 << 5 * i for i in range(_FIRST))  # the lowest bit of each word's five


def _signature(w: Column) -> Column:
    """Two numbers for a title's words ``w``, by which keys can be checked without it: for each of its first words five
    bits of a hash, then three of its first letter's hash and two of its last's. Above them stand the number of words
    and whether the title was cut, in which case the last word says nothing."""

    def bits(c: Column, width: int, at: int) -> Column:
        return F.shiftleft(F.coalesce(F.pmod(F.xxhash64(c), F.lit(1 << width)), F.lit(0)).cast("long"), at)

    def joined(parts: list[Column]) -> Column:
        out = parts[0]
        for x in parts[1:]:
            out = out.bitwiseOR(x)
        return out

    each = [F.get(w, F.lit(i)) for i in range(_FIRST)]
    head = [F.shiftleft(F.least(F.size(w), F.lit(255)).cast("long"), 55), F.shiftleft(F.col("cut").cast("long"), 63)]
    words = joined(head + [bits(c, 5, 5 * i) for i, c in enumerate(each)])
    ends = joined([bits(f, n, 5 * i + k) for i, c in enumerate(each) for f, n, k in ((F.substring(c, 1, 1), 3, 0), (F.substring(c, -1, 1), 2, 3))])
    return F.named_struct(F.lit("w"), words, F.lit("e"), ends)


def _plausible(a: str, b: str) -> Column:
    """Whether two signatures differ in no more of the words both have than ``title_score`` takes for typos, and in
    none of them at both ends, where no typo or two leave a word alike."""
    n = lambda s: F.shiftrightunsigned(f"{s}.w", 55).bitwiseAND(F.lit(255)).cast("int")
    known = lambda s: n(s) - F.shiftrightunsigned(f"{s}.w", 63).cast("int")

    def fields(part: str, first: int, last: int) -> Column:
        x = F.col(f"{a}.{part}").bitwiseXOR(F.col(f"{b}.{part}"))
        out = F.shiftrightunsigned(x, first)
        for i in range(first + 1, last):
            out = out.bitwiseOR(F.shiftrightunsigned(x, i))
        return out.bitwiseAND(F.lit(_LOW))

    typos = F.when(F.least(n(a), n(b)) == 255, F.lit(_FIRST)).otherwise(F.greatest(F.lit(2), F.floor(F.least(n(a), n(b)) / 4).cast("int")))
    shared = F.least(known(a), known(b), F.lit(_FIRST))
    other = fields("w", 0, 5).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shared * 5) - 1)
    return (F.bit_count(other) <= typos) & (other.bitwiseAND(fields("e", 0, 3)).bitwiseAND(fields("e", 3, 5)) == 0)


def _with_keys(records: DataFrame) -> DataFrame:
    """``records`` with ``sig``, ``keys`` and ``lacking``: the signature and the blocking keys of each, as hashes.

    ``keys`` join records of one table and of both: two of the title's first four groups of four words; one of the
    first three with the beginning or the end of a family name; titles of under four words have keys of their own.
    ``lacking`` join records of both tables where one of two lacks the author: one group with the year or the
    journal's initials. A record that lacks it has such a key by another name, so that complete records do not meet
    by these.
    """
    few = F.size(F.split("words", " ")) < 4
    w = records.withColumn("initials", _python_initials("journal")).withColumn("short", _short(*[F.when(few, F.col(c)) for c in ("words", "surname", "year", "journal", "kind")]))
    w = w.withColumn("w", F.split("words", " ")).withColumn("s", F.split("surname", "/"))
    group = lambda i: F.when(F.size("w") >= 4 * i + 4, F.xxhash64("kind", *[F.get("w", F.lit(4 * i + k)) for k in range(4)]))
    name = lambda i: F.nullif(F.get("s", F.lit(i)), F.lit(""))
    ends = [f(name(i)).alias(f"{t}{i}") for i in (0, 1) for t, f in (("n", lambda c: F.substring(c, 1, 4)), ("e", lambda c: F.substring(c, -6, 6)))]
    anonymous = F.col("surname") == ""
    parts = w.select(*records.columns, "initials", "short", _signature(F.col("w")).alias("sig"), *[group(i).alias(f"g{i}") for i in range(4)], *ends, anonymous.alias("anonymous"))

    def key(tag: int, *of: str, when: Column | None = None) -> Column:
        here = F.col(of[0]).isNotNull() & F.col(of[1]).isNotNull()
        return F.when(here if when is None else here & when, F.xxhash64(F.lit(tag), *of))

    def lacking(tag: int, *of: str) -> list[Column]:
        # the first joins lacking left records with all right ones, the second complete left records with lacking right ones
        left, right = F.col("side") == 0, F.col("side") == 1
        return [key(tag, *of, when=(left & F.col("anonymous")) | right), key(tag + 1, *of, when=(left & ~F.col("anonymous")) | (right & F.col("anonymous")))]

    keys = [key(a * 4 + b, f"g{a}", f"g{b}") for a in range(4) for b in range(a + 1, 4)]
    keys += [key(20 + t * 3 + i, f"g{i}", f"{n}{j}") for t, n in enumerate("ne") for i in range(3) for j in (0, 1)]
    more = [k for i in range(3) for k in (*lacking(30 + 2 * i, f"g{i}", "year"), *lacking(40 + 2 * i, f"g{i}", "initials"))]
    # keys that a record has not are nulls, dropped where the arrays are taken apart
    return parts.select(*records.columns, "sig", F.concat(F.array(*keys), "short").alias("keys"), F.array(*more).alias("lacking"))


def _scored(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """a, b, score of pairs (a, b) of record numbers; pairs whose titles cannot agree are dropped."""
    side = ("words", "cut", "surname", "year", "journal")
    described = records.select("rec", "words", "cut", "surname", F.coalesce("year", F.lit(-1)).alias("year"), "journal")
    a = described.select(F.col("rec").alias("a"), *[F.col(c).alias(f"{c}_a") for c in side])
    b = described.select(F.col("rec").alias("b"), *[F.col(c).alias(f"{c}_b") for c in side])
    both = pairs.join(a, "a").join(b, "b")
    return both.select("a", "b", _score(*[f"{c}_{s}" for c in side for s in "ab"]).alias("score")).where("score > -4")


def _same_article(records: DataFrame, siblings: DataFrame, same: float, scratch: Scratch) -> DataFrame:
    """a, b: links between records of one table that describe the same article.

    A key's records are compared with its first record; those it rejects are compared with four of them, then with
    sixteen and so on until each is accepted or has met all, so the links of a hot article stay linear in its size
    and a key shared by many articles compares them all. ``siblings`` are further pairs to compare.
    """
    members = records.select("side", "rec", "sig", F.explode("keys").alias("key")).where("key is not null").select(F.xxhash64("key", "side").alias("key"), "rec", "sig")
    heads = members.groupBy("key").agg(F.min("rec").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    signatures = records.select("rec", "sig")
    found, count = [], 1
    while True:
        leads = heads.join(signatures.select(F.col("rec").alias("a"), F.col("sig").alias("sa")), "a")
        met = leads.join(members.select("key", "rec", F.col("sig").alias("sb")), "key").where("a <> rec")
        spokes = scratch.cut(met.select("key", "rec", F.least("a", "rec").alias("a"), F.greatest("a", "rec").alias("b"), _plausible("sa", "sb").alias("plausible")))
        scratch.release()
        if scratch.rows(spokes) == 0:
            break
        pairs = spokes.where("plausible").select("a", "b")
        links = scratch.cut(_scored((pairs.unionByName(siblings) if count == 1 else pairs).distinct(), records).where(F.col("score") >= same).select("a", "b"))
        found.append(links)
        joined = spokes.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("key", "rec", F.coalesce("linked", F.lit(False)).alias("linked"))
        if count > 1:
            joined = joined.unionByName(heads.select("key", F.col("a").alias("rec"), F.lit(True).alias("linked")))
        rest = joined.groupBy("key", "rec").agg(F.max("linked").alias("linked")).where("not linked").select("key", "rec")
        last, members = members, scratch.cut(rest.join(signatures, "rec"))
        scratch.drop(last)
        scratch.drop(spokes)
        scratch.release()
        if scratch.rows(members) == 0:
            break
        count *= 4
        order = F.row_number().over(Window.partitionBy("key").orderBy("rec"))
        heads = members.select("key", F.col("rec").alias("a"), order.alias("r")).where(F.col("r") <= count).select("key", "a")
    if not found:
        found = [scratch.cut(_scored(siblings.distinct(), records).where(F.col("score") >= same).select("a", "b"))]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _siblings(pairs: DataFrame, mine: str, other: str) -> DataFrame:
    best = pairs.groupBy(other).agg(F.max_by(mine, F.struct("score", mine)).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select(other, "top")
    return pairs.join(best, other).where(F.col(mine) != F.col("top")).select(F.least(mine, "top").alias("a"), F.greatest(mine, "top").alias("b"))


def match(left: DataFrame, right: DataFrame, left_cols: tuple[str, ...], right_cols: tuple[str, ...], same: float = 2.2, rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """``left_id``, ``right_id``, ``confidence`` of candidate pairs with a confidence of at least 0.01.

    ``left_cols``, ``right_cols``: id, title, author, year, journal. Rows without id or usable title match nothing;
    other missing attributes count neither way. Works about an article (corrections, replies, protocols,
    conference abstracts) and parts of a series only match their like. Repeated rows share their pairs; extra
    columns and clashing names do not matter; an empty table on either side gives no rows. ``same`` is the
    log-odds from which two rows of one table are one class.
    """
    scratch = Scratch(left.sparkSession, "match")
    sides = [_rows(left, 0, *left_cols), _rows(right, 1, *right_cols)]
    kinds = [s.schema["id"].dataType.simpleString() for s in sides]
    ids = [F.struct(*[(F.col("id") if i == j else F.lit(None).cast(kinds[j])).alias("lr"[j]) for j in (0, 1)]) for i in (0, 1)]
    # filtered after the cut: a filter pushed into the projections of the title forms would run their patterns again
    wide = scratch.cut(sides[0].withColumn("id", ids[0]).unionByName(sides[1].withColumn("id", ids[1])))
    rows = wide.where("(id.l is not null or id.r is not null) and words <> ''")
    # equal descriptions are one record, however many rows have them
    records = scratch.cut(_with_keys(rows.select("rec", "side", *_DESCRIBED).distinct()))
    slim = scratch.cut(rows.select("rec", "side", "id"))
    scratch.drop(wide)
    scratch.release()
    keys = records.select("side", "rec", "sig", F.explode(F.concat("keys", "lacking")).alias("key")).where("key is not null")
    a = keys.where("side = 0").select("key", F.col("rec").alias("a"), F.col("sig").alias("sa"))
    b = keys.where("side = 1").select("key", F.col("rec").alias("b"), F.col("sig").alias("sb"))
    met = scratch.cut(a.join(b, "key").where(_plausible("sa", "sb")).select("a", "b").distinct())
    scratch.release()
    pairs = scratch.cut(_scored(met, records))
    scratch.drop(met)
    scratch.release()
    siblings = _siblings(pairs, "a", "b").unionByName(_siblings(pairs, "b", "a"))
    classes = components(_same_article(records, siblings, same, scratch), "a", "b")

    def named(df: DataFrame, rec: str, name: str) -> DataFrame:
        return df.join(classes.select(F.col("vertex").alias(rec), F.col("component").alias(name)), rec, "left").withColumn(name, F.coalesce(name, rec))

    units = named(named(pairs, "a", "x"), "b", "y").groupBy("x", "y").agg(F.max("score").alias("unary"))
    beliefs = one_to_one(units, scratch, rounds, tolerance).where("confidence >= 0.01")
    members = named(slim, "rec", "cls")
    x = members.where("side = 0").select(F.col("cls").alias("x"), F.col("id.l").alias("left_id"))
    y = members.where("side = 1").select(F.col("cls").alias("y"), F.col("id.r").alias("right_id"))
    return beliefs.join(x, "x").join(y, "y").select("left_id", "right_id", "confidence")


def one_to_one(units: DataFrame, scratch: Scratch, rounds: int = 30, tolerance: float = 1e-3, damping: float = 0.2) -> DataFrame:
    """``x``, ``y``, ``confidence``: marginals of pair variables under an at-most-one factor for every ``x`` and
    every ``y``. ``units``: x, y, unary (log-odds).

    In odds a factor's message to a pair is 1 / (1 + sum of the other pairs' odds at the factor). Pairs alone at
    both factors are exact at once; the rest iterate, the factors of x and of y in turn, until no message moves by more than
    ``tolerance`` in log-odds. A round is two sums, combined before the shuffle, and two joins. Where messages still
    move after ``rounds`` rounds, a warning says by how much, and the last ones hold.
    """
    units = scratch.cut(units.withColumn("u", F.exp(F.least(F.col("unary"), F.lit(30.0)))))
    n = F.count(F.lit(1))
    counted = units.join(units.groupBy("x").agg(n.alias("nx")), "x").join(units.groupBy("y").agg(n.alias("ny")), "y")
    alone = counted.where("nx = 1 and ny = 1").select("x", "y", (F.col("u") / (1 + F.col("u"))).alias("confidence"))
    state = scratch.cut(counted.where("nx > 1 or ny > 1").select("x", "y", "u", F.lit(1.0).alias("mx"), F.lit(1.0).alias("my")))

    def message(total: Column, own: Column, old: str) -> Column:
        fresh = 1 / (1 + F.greatest(total - own, F.lit(0.0)))
        return F.exp(damping * F.log(old) + (1 - damping) * F.log(fresh))

    moved = None
    for _ in range(rounds if scratch.rows(state) else 0):
        out_x = F.col("u") * F.col("my")  # a pair's odds as its factor x sees them
        half = state.join(state.groupBy("x").agg(F.sum(out_x).alias("sx")), "x").withColumn("fx", message(F.col("sx"), out_x, "mx")).select("x", "y", "u", "mx", "my", "fx")
        out_y = F.col("u") * F.col("fx")
        fresh = half.join(half.groupBy("y").agg(F.sum(out_y).alias("sy")), "y").withColumn("fy", message(F.col("sy"), out_y, "my"))
        step = F.greatest(F.abs(F.log("fx") - F.log("mx")), F.abs(F.log("fy") - F.log("my")))
        following = scratch.cut(fresh.select("x", "y", "u", F.col("fx").alias("mx"), F.col("fy").alias("my"), step.alias("moved")))
        scratch.drop(state)
        state, moved = following, following.agg(F.max("moved")).first()[0]
        if moved < tolerance:
            break
    else:
        if moved is not None:
            warnings.warn(f"belief propagation: messages still move by {moved:.2g} after {rounds} rounds", stacklevel=2)
    odds = F.col("u") * F.col("mx") * F.col("my")
    return alone.unionByName(state.select("x", "y", (odds / (1 + odds)).alias("confidence")))
