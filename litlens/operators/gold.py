"""Building and checking gold lists: candidates and cascade, confidence filter, votes, consensus, coverage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Words in journal names by which a reference counts as biomedical.
BIOMEDICAL = ("plos", "bmc", "jama", "nejm", "lancet", "nature", "science", "cell", "neurology", "medicine", "health", "clinical", "medical", "journal of", "american journal", "british journal", "european journal")


def biomedical(journal: Column) -> Column:
    """Whether a journal's name holds one of ``BIOMEDICAL``; a missing name does not."""
    name = F.lower(journal)
    return F.coalesce(functools.reduce(Column.__or__, [name.contains(w) for w in BIOMEDICAL]), F.lit(False))


def best_candidate(scored: DataFrame, key: list[str], minimum: float = 0.80) -> DataFrame:
    """Per key the candidate of the highest confidence that reaches ``minimum``, ties by strategy, rank and id; only
    candidates of the first strategy that returned anything count."""
    first = scored.groupBy(*key).agg(F.min("strategy_no").alias("strategy_no"))
    usable = scored.join(first, [*key, "strategy_no"]).where(F.col("confidence") >= minimum)
    order = Window.partitionBy(*key).orderBy(F.col("confidence").desc(), "rank", "cand_id")
    return usable.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def cascade(studies: DataFrame, pubmed: DataFrame, europepmc: DataFrame, crossref: DataFrame, key: str) -> DataFrame:
    """Identifiers after the lookups in turn. Rows with both ids are left alone; a PubMed match sets the PMID and fills
    or replaces the DOI where it has one, EuropePMC fills gaps, CrossRef sets the DOI. Each lookup: key, pmid, doi."""
    named = lambda df, s: df.select(key, F.col("pmid").alias(f"pmid_{s}"), F.col("doi").alias(f"doi_{s}"))
    joined = studies.join(named(pubmed, "p"), key, "left").join(named(europepmc, "e"), key, "left").join(named(crossref, "c"), key, "left")
    full = F.col("pmid").isNotNull() & F.col("doi").isNotNull()
    pmid = F.coalesce("pmid_p", "pmid", "pmid_e")
    doi = F.coalesce("doi_p", "doi", "doi_e", "doi_c")
    method = F.when(full, "kept").when(F.col("pmid_p").isNotNull(), "pubmed").when(F.col("pmid_e").isNotNull() | F.col("doi_e").isNotNull(), "europepmc").when(F.col("doi_c").isNotNull(), "crossref")
    return joined.select(key, F.when(full, F.col("pmid")).otherwise(pmid).alias("pmid"), F.when(full, F.col("doi")).otherwise(doi).alias("doi"), method.alias("method"))


def confident(col: Column, minimum: float = 0.85) -> Column:
    """Unknown confidence is accepted."""
    return col.isNull() | (col >= minimum)


def coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows with both ids, DOI only, PMID only, neither, and percentages of any, DOI and PMID."""
    d, p, n = F.col("doi").isNotNull(), F.col("pmid").isNotNull(), F.count(F.lit(1))
    percent = lambda c: F.round(100 * F.count_if(c) / n, 1)
    return rows.groupBy(*by).agg(n.alias("total"), F.count_if(d & p).alias("both"), F.count_if(d & ~p).alias("doi_only"), F.count_if(p & ~d).alias("pmid_only"), F.count_if(~p & ~d).alias("neither"),
        percent(d | p).alias("any_pct"), percent(d).alias("doi_pct"), percent(p).alias("pmid_pct"))


def votes(claims: DataFrame, runs: int | Column, threshold: float) -> DataFrame:
    """Clusters found by a share of at least ``threshold`` of the runs. ``claims``: study, cluster, run."""
    counted = claims.select("study", "cluster", "run").distinct().groupBy("study", "cluster").agg(F.count(F.lit(1)).alias("votes"))
    share = F.col("votes") / runs
    return counted.withColumn("share", share).where(F.col("share") >= threshold)


def consistency(claims: DataFrame, runs: int | Column, threshold: float) -> DataFrame:
    """Per study: clusters, those that reach the threshold, and their share."""
    every = votes(claims, runs, 0.0)
    return every.groupBy("study").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("share") >= threshold).alias("accepted")).withColumn("consistency", F.col("accepted") / F.col("clusters"))


def claim_buckets(claims: DataFrame, key: list[str]) -> DataFrame:
    """full, partial, all_different or missing agreement of the sources' PMIDs. ``claims``: key, source, pmid."""
    per = claims.where("pmid is not null").groupBy(*key, "pmid").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.count(F.lit(1)).alias("distinct_pmids"), F.max("n").alias("top"), F.sum("n").alias("given"))
    all_keys = claims.select(*key).distinct().join(per, key, "left").fillna(0, ["distinct_pmids", "top", "given"])
    bucket = F.when(F.col("given") == 0, "missing").when(F.col("distinct_pmids") == 1, "full").when(F.col("top") > 1, "partial").otherwise("all_different")
    return all_keys.withColumn("bucket", bucket)


def consensus_pmid(claims: DataFrame, key: list[str], priority: list[str]) -> DataFrame:
    """One PMID per key: unanimous, else a unique majority, else the source first in ``priority``, else the first
    source by name; with the reason."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source")), F.lit(0)) if priority else F.lit(0)
    given = claims.where("pmid is not null").withColumn("prio", F.when(rank > 0, rank).otherwise(1_000_000))
    per = given.groupBy(*key, "pmid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("prio", "source")).alias("lead"))
    w = Window.partitionBy(*key)
    seen = per.withColumn("top", F.max("n").over(w)).withColumn("kinds", F.count(F.lit(1)).over(w))
    seen = seen.withColumn("at_top", F.sum(F.when(F.col("n") == F.col("top"), 1).otherwise(0)).over(w))
    majority = (F.col("at_top") == 1) & (F.col("top") > 1)
    order = Window.partitionBy(*key).orderBy(F.when(majority & (F.col("n") == F.col("top")), 0).otherwise(1), "lead", "pmid")
    reason = F.when(F.col("kinds") == 1, "unanimous").when(majority, "majority").when(F.col("lead.prio") < 1_000_000, "priority").otherwise("first")
    return seen.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*key, "pmid", reason.alias("reason"))


def source_accuracy(claims: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Per source: correct, incorrect and missing claims and the share of correct among the given ones."""
    checked = claims.join(truth.select(*key, F.col("pmid").alias("true_pmid")), key)
    ok, bad = F.count_if(F.col("pmid") == F.col("true_pmid")), F.count_if(F.col("pmid") != F.col("true_pmid"))
    return checked.groupBy("source").agg(ok.alias("correct"), bad.alias("incorrect"), F.count_if(F.col("pmid").isNull()).alias("missing"), F.round(100 * ok / F.greatest(ok + bad, F.lit(1)), 1).alias("accuracy_pct"))


def merge_by_doi(rows: DataFrame) -> DataFrame:
    """doi, title, pmids: one row per DOI (lower case) with the first title by source and each source's PMID.
    ``rows``: source, doi, pmid, title. Rows without a DOI merge with nothing and are left out."""
    keyed = rows.where("doi is not null").withColumn("doi", F.lower("doi"))
    claims = keyed.where("pmid is not null").groupBy("doi", "source").agg(F.min("pmid").alias("pmid")).groupBy("doi").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "pmid")))).alias("pmids"))
    titles = keyed.groupBy("doi").agg(F.min(F.when(F.col("title").isNotNull(), F.struct("source", "title")))["title"].alias("title"))
    return titles.join(claims, "doi", "left")


def verified_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims with ``correct``: the claimed PMID's DOI in ``known`` (pmid, doi) and the claim's own DOI are both there
    and equal. Claims without a PMID have null."""
    found = known.groupBy("pmid").agg(F.min(F.lower("doi")).alias("true_doi"))
    same = F.coalesce(F.col("true_doi") == F.lower("doi"), F.lit(False))
    return claims.join(found, "pmid", "left").withColumn("correct", F.when(F.col("pmid").isNotNull(), same)).drop("true_doi")


def validated_pmids(claims: DataFrame, preferred: str) -> DataFrame:
    """study, pmid: the verified PMIDs of a study, or those of the preferred source where none is verified."""
    good = claims.where("correct").select("study", "pmid").distinct()
    rest = claims.where((F.col("source") == preferred) & F.col("pmid").isNotNull()).select("study", "pmid").distinct()
    return good.unionByName(rest.join(good.select("study").distinct(), "study", "left_anti"))


def titles_across_sources(rows: DataFrame, primary: str, similar, threshold: float = 0.7) -> DataFrame:
    """Each row of the primary source with the most similar title of every other source in its study, of at least
    ``threshold``; ties keep the first ``ord``. ``rows``: study, source, ord, title, pmid; ``similar`` compares two
    columns. All pairs of a study are compared: similar titles need not share a word."""
    each = rows.where("title is not null")
    a = each.where(F.col("source") == primary).select("study", F.col("ord").alias("main"), F.col("title").alias("main_title"))
    b = each.where(F.col("source") != primary)
    pairs = a.join(b, "study")
    scored = pairs.withColumn("similarity", similar(F.col("main_title"), F.col("title"))).where(F.col("similarity") >= threshold)
    order = Window.partitionBy("study", "main", "source").orderBy(F.col("similarity").desc(), "ord")
    return scored.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("study", "main", "source", "ord", "pmid", "similarity")
