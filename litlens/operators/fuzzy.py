"""The third matching layer: gold rows and retrieved metadata by title, author and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litlens.functions.similarity import author_batch, ratio_batch, sorted_tokens, title_batch, year_of


def described(rows: DataFrame, keys: list[str], title: str, author: str, year: str) -> DataFrame:
    """keys, t (sorted title words), a (author), y: normalised once per row, not once per pair."""
    made = rows.select(*keys, title_batch(F.col(title)).alias("t"), author_batch(F.col(author)).alias("a"), year_of(F.col(year)).alias("y"))
    return made.withColumn("t", sorted_tokens(F.col("t")))


def fuzzy_matches(gold: DataFrame, meta: DataFrame, title: float = 85.0, author: float = 80.0, years: int = 1) -> DataFrame:
    """Best candidate of every gold row: ``gold`` has study, gold_id, t, a, y; ``meta`` study, ord, t, a, y.

    A field counts where both sides have it; a match needs two fields present and two that agree, its score is
    the share that agrees; ties go to the first ``ord``. Two fields must agree, so a pair agrees in year and author,
    year and title, or title and author: candidates come from three equi-joins whose keys every such pair shares
    (year buckets with either the author's first letters or a title word), never from all pairs.

    An author ratio of at least 80 leaves pairs without a common beginning, and a title ratio of 85 pairs without a
    common word; ``exhaustive_fuzzy_matches`` finds those too, within blocks of a study.
    """
    return _best(_candidates(gold, meta), title, author, years)


def _candidates(gold: DataFrame, meta: DataFrame) -> DataFrame:
    g = gold.select("study", "gold_id", F.struct("t", "a", "y").alias("g"))
    m = meta.select("study", "ord", F.struct("t", "a", "y").alias("m"))
    near = lambda c: F.when(c.isNotNull(), F.array(c - 1, c, c + 1))
    # year and author, or title and author: authors' letter pairs; year and title: title words in agreeing years
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, 3)))
    ga = g.where("g.a <> ''").select("*", F.explode(pairs(F.col("g.a"))).alias("key"))
    ma = m.where("m.a <> ''").select("*", F.explode(pairs(F.col("m.a"))).alias("key"))
    gt = g.where("g.t <> '' and g.y is not null").select("*", F.explode(F.array_distinct(F.split("g.t", " "))).alias("w"), F.explode(near(F.col("g.y"))).alias("yy"))
    mt = m.where("m.t <> '' and m.y is not null").select("*", F.explode(F.array_distinct(F.split("m.t", " "))).alias("w"), F.col("m.y").alias("yy"))
    by_author = ga.join(ma, ["study", "key"]).select("study", "gold_id", "ord", "g", "m")
    by_title = gt.join(mt, ["study", "w", "yy"]).select("study", "gold_id", "ord", "g", "m")
    return by_author.unionByName(by_title).dropDuplicates(["study", "gold_id", "ord"])


def exhaustive_fuzzy_matches(gold: DataFrame, meta: DataFrame, title: float = 85.0, author: float = 80.0, years: int = 1, blocks: int = 16) -> DataFrame:
    """``fuzzy_matches`` over every pair of a study, exact: the gold rows that no identifier matched are a stated
    query set, compared block by block with all metadata of their study."""
    g = gold.select("study", "gold_id", F.struct("t", "a", "y").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    m = meta.select("study", "ord", F.struct("t", "a", "y").alias("m"), F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int").alias("block"))
    return _best(g.join(m, ["study", "block"]), title, author, years)


def _best(pairs: DataFrame, title: float, author: float, years: int) -> DataFrame:
    both_t, both_a = (F.col("g.t") != "") & (F.col("m.t") != ""), (F.col("g.a") != "") & (F.col("m.a") != "")
    both_y = F.col("g.y").isNotNull() & F.col("m.y").isNotNull()
    shorter, total = F.least(F.length("g.t"), F.length("m.t")), F.length("g.t") + F.length("m.t")
    possible = both_t & (200.0 * shorter / total >= title)  # the ratio cannot exceed this
    year_ok = both_y & (F.abs(F.col("g.y") - F.col("m.y")) <= years)
    # an indel ratio of r needs an edit distance of at most (1 - r) of both lengths: checked in the JVM first
    room = (1 - author / 100) * (F.length("g.a") + F.length("m.a"))
    near = both_a & (F.levenshtein("g.a", "m.a") <= room)
    one = lambda c: F.when(c, 1).otherwise(0)
    rough = pairs.withColumns({"year_ok": year_ok, "near": near, "possible": possible}).where(one(F.col("year_ok")) + one(F.col("near")) + one(F.col("possible")) >= 2)
    author_ok = F.col("near") & (ratio_batch(F.when(F.col("near"), F.col("g.a")), F.when(F.col("near"), F.col("m.a"))) >= author)
    rough = rough.withColumn("author_ok", F.coalesce(author_ok, F.lit(False)))
    title_ok = F.col("possible") & (ratio_batch(F.when(F.col("possible"), F.col("g.t")), F.when(F.col("possible"), F.col("m.t"))) >= title)
    scored = rough.withColumn("matched", one(F.col("year_ok")) + one(F.col("author_ok")) + one(title_ok)).withColumn("testable", one(both_t) + one(both_a) + one(both_y)).where("matched >= 2 and testable >= 2")
    best = Window.partitionBy("study", "gold_id").orderBy((F.col("matched") / F.col("testable")).desc(), "ord")
    return scored.withColumn("score", F.col("matched") / F.col("testable")).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("study", "gold_id", "ord", "score")
