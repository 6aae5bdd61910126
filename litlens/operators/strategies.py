"""Set-combination strategies over pools of retrieved articles.

``retrieval``: study, pool (orderable, unique per pool), ord (position in the pool), pmid, doi, art. An article's
key ``art`` is ``doi:`` plus its DOI where it has one, else ``pmid:`` plus its PMID. Pools come in the order of
``pool``. Every strategy is one aggregation by (study, art) with map-side combine; only ranks that a parameter
names are computed, so the ranking prunes inside each task before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARTICLE = ["study", "art"]

# The patterns of the default gate (letter case does not count).
CONDITION = r"\bmultiple sclerosis\b"
SLEEP = r"\bsleep\b|insomnia|apnea|restless\s*leg|narcolep|REM sleep"
RANDOMISED = r"randomi[sz]ed|trial|placebo|randomly"
NON_PHARMA = r"non[- ]?pharmacolog|non[- ]?invas|behavior|cognitive|exercise|rehabilitation|psychotherap|mindfulness|meditation"


def default_gate(text: Column) -> Column:
    """Whether a title (with its abstract, where there is one) passes the default gate: condition and sleep, and a
    randomised or a non-pharmacological study. Missing and blank texts do not pass."""
    has = lambda pattern: text.rlike(f"(?i){pattern}")
    return F.coalesce(has(CONDITION) & has(SLEEP) & (has(RANDOMISED) | has(NON_PHARMA)), F.lit(False))


def article_key(pmid: Column, doi: Column) -> Column:
    """``doi:``/``pmid:`` key, null where both are missing."""
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(doi)), F.concat(F.lit("pmid:"), pmid))


def first_pools(retrieval: DataFrame, n: int) -> DataFrame:
    """study, pool, q_ord of the first ``n`` pools of each study, q_ord from 0."""
    rank = F.row_number().over(Window.partitionBy("study").orderBy("pool"))
    return retrieval.select("study", "pool").distinct().withColumn("q_ord", rank - 1).where(F.col("q_ord") < n)


def _members(retrieval: DataFrame) -> DataFrame:
    """study, art with the first-seen identifiers (a later pool never fills a gap of an earlier one)."""
    first = F.min(F.struct("pool", "ord", "pmid", "doi")).alias("m")
    return retrieval.groupBy(*ARTICLE).agg(first).select(*ARTICLE, "m.pmid", "m.doi")


def union_all(retrieval: DataFrame) -> DataFrame:
    return _members(retrieval)


def consensus(retrieval: DataFrame, topk: int | None = 3, k: int = 2) -> DataFrame:
    """Articles in at least ``k`` of the first ``topk`` pools (of all pools where ``topk`` is None)."""
    used = retrieval if topk is None else retrieval.join(first_pools(retrieval, topk), ["study", "pool"])
    return _counted(used, "pool", "n_pools").where(F.col("n_pools") >= k)


def _counted(retrieval: DataFrame, of: str, name: str) -> DataFrame:
    """``_members`` with the number of distinct ``of`` an article was seen in: one aggregation by article and ``of``, then
    one by article, both combined before their shuffles."""
    seen = retrieval.groupBy(*ARTICLE, of).agg(F.min(F.struct("pool", "ord", "pmid", "doi")).alias("m"))
    return seen.groupBy(*ARTICLE).agg(F.min("m").alias("m"), F.count(of).alias(name)).select(*ARTICLE, "m.pmid", "m.doi", name)


def gate_articles(articles: DataFrame, texts: DataFrame, passes: Column) -> DataFrame:
    """Articles that pass: DOI-only ones always, those with a PMID where their text passes. ``texts``: study, pmid
    and what ``passes`` reads. A study without any text is not gated at all."""
    has_text = texts.select("study").distinct().withColumn("gated", F.lit(True))
    passing = texts.where(passes).select("study", "pmid").distinct().withColumn("ok", F.lit(True))
    judged = articles.join(has_text, "study", "left").join(passing, ["study", "pmid"], "left")
    return judged.where(F.col("gated").isNull() | F.col("pmid").isNull() | F.col("ok")).drop("gated", "ok")


def gated_union(retrieval: DataFrame, texts: DataFrame | None = None, passes: Column | None = None) -> DataFrame:
    members = _members(retrieval)
    return members if texts is None or passes is None else gate_articles(members, texts, passes)


def weighted_vote(retrieval: DataFrame, weights: Sequence[float] = (1.0,)) -> DataFrame:
    """Articles whose pools' weights reach the upper median of the weights in use. Pool i has ``weights[i]``, pools
    beyond the list its last entry."""
    w = [float(x) for x in weights]
    ranked = first_pools(retrieval, len(w))
    pools = retrieval.select("study", "pool").distinct().join(ranked, ["study", "pool"], "left")
    weight = F.coalesce(*[F.when(F.col("q_ord") == i, F.lit(x)) for i, x in enumerate(w)], F.lit(w[-1]))
    weighed = pools.select("study", "pool", weight.cast("decimal(18,6)").alias("w"))
    # the upper median from counts of distinct weights: no pool list is gathered
    share = weighed.groupBy("study", "w").agg(F.count(F.lit(1)).alias("n"))
    upto = share.withColumn("upto", F.sum("n").over(Window.partitionBy("study").orderBy("w"))).join(weighed.groupBy("study").agg(F.count(F.lit(1)).alias("pools")), "study")
    need = upto.where(F.col("upto") > F.floor(F.col("pools") / 2)).groupBy("study").agg(F.min("w").alias("need"))
    votes = retrieval.select("study", "pool", "art").distinct().join(weighed, ["study", "pool"]).groupBy(*ARTICLE).agg(F.sum("w").alias("votes"))
    return _members(retrieval).join(votes.join(need, "study").where(F.col("votes") >= F.col("need")).select(*ARTICLE, F.col("votes").cast("double").alias("votes")), ARTICLE)


def family_consensus(retrieval: DataFrame, families: DataFrame, required: int = 2) -> DataFrame:
    """Articles seen in at least ``required`` families of pools. ``families``: study, pool, family; a study whose
    labels and pools differ in number gives nothing."""
    pools = retrieval.select("study", "pool").distinct().groupBy("study").agg(F.count(F.lit(1)).alias("n"))
    labelled = families.where("family is not null").select("study", "pool").distinct().groupBy("study").agg(F.count(F.lit(1)).alias("n"))
    usable = pools.join(labelled, ["study", "n"]).select("study")
    seen = retrieval.join(usable, "study", "left_semi").join(families.select("study", "pool", "family").distinct(), ["study", "pool"], "left")
    return _counted(seen, "family", "n_families").where(F.col("n_families") >= required)


def two_stage_screen(retrieval: DataFrame, texts: DataFrame | None = None, passes: Column | None = None, topk: int = 3) -> DataFrame:
    """The first ``topk`` pools together, then the gates."""
    return gated_union(retrieval.join(first_pools(retrieval, topk).drop("q_ord"), ["study", "pool"]), texts, passes)


def half_split_hybrid(retrieval: DataFrame) -> DataFrame:
    """First and second half of the pools together; nothing for a study with one pool."""
    several = retrieval.groupBy("study").agg(F.min("pool").alias("lo"), F.max("pool").alias("hi")).where("lo <> hi").select("study")
    return _members(retrieval.join(several, "study", "left_semi"))


def compare_runs(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """Sizes of A, B, both, only A, only B, union, overlap and Jaccard, and TP/FP/FN of both against gold, by study.
    Inputs: study, art (duplicates do not count)."""
    both = a.select(*ARTICLE).distinct().withColumn("a", F.lit(1)).join(b.select(*ARTICLE).distinct().withColumn("b", F.lit(1)), ARTICLE, "full")
    marked = both.join(gold.select(*ARTICLE).distinct().withColumn("g", F.lit(1)), ARTICLE, "full")
    n = lambda c: F.count_if(c)
    A, B, G = F.col("a").isNotNull(), F.col("b").isNotNull(), F.col("g").isNotNull()
    out = marked.groupBy("study").agg(n(A).alias("n_a"), n(B).alias("n_b"), n(A & B).alias("n_both"), n(A & ~B).alias("only_a"), n(B & ~A).alias("only_b"), n(A | B).alias("n_union"),
        n(A & G).alias("tp_a"), n(A & ~G).alias("fp_a"), n(G & ~A).alias("fn_a"), n(B & G).alias("tp_b"), n(B & ~G).alias("fp_b"), n(G & ~B).alias("fn_b"))
    return out.withColumn("jaccard", F.col("n_both") / F.greatest("n_union", F.lit(1)))
