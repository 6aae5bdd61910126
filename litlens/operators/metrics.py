"""Retrieval metrics against a gold list: plain sets, two-key sets, row-level layers, per-database scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(tp: Column, retrieved: Column, gold: Column) -> dict[str, Column]:
    """precision, recall, f1, jaccard, overlap with the guarded denominators; never clamped."""
    one = F.lit(1)
    p, r = tp / F.greatest(retrieved, one), tp / F.greatest(gold, one)
    return {"precision": p, "recall": r, "f1": 2 * p * r / F.greatest(p + r, F.lit(1e-12)), "jaccard": tp / F.greatest(retrieved + gold - tp, one), "overlap": tp / F.greatest(F.least(retrieved, gold), one)}


def set_metrics(retrieved: DataFrame, gold: DataFrame, by: list[str], key: str) -> DataFrame:
    """``by``, tp, retrieved, gold and rates of distinct keys. ``gold`` has the ``by`` columns it is split by (a
    subset of ``by``); groups come from ``retrieved``."""
    shared = [c for c in by if c in gold.columns]
    g = gold.where(F.col(key).isNotNull()).select(*shared, key).distinct()
    sizes = g.groupBy(*shared).agg(F.count(F.lit(1)).alias("gold")) if shared else g.agg(F.count(F.lit(1)).alias("gold"))
    hits = retrieved.where(F.col(key).isNotNull()).select(*by, key).distinct().join(g.withColumn("hit", F.lit(1)), [*shared, key], "left")
    counted = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("retrieved"), F.count("hit").alias("tp"))
    joined = counted.join(sizes, shared, "left") if shared else counted.crossJoin(F.broadcast(sizes))
    joined = joined.withColumn("gold", F.coalesce("gold", F.lit(0)))
    return joined.withColumns(rates(F.col("tp"), F.col("retrieved"), F.col("gold")))


def multi_key_metrics(retrieved: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """DOI-first scoring: TP = DOI hits, plus PMID hits only where gold has more PMIDs than DOIs (an article hit by
    both then counts twice, as published); sizes are the larger of the two id counts."""
    shared = [c for c in by if c in gold.columns]

    def ids(df: DataFrame, cols: list[str]) -> DataFrame:
        kinds = F.array(F.struct(F.lit("d").alias("k"), F.col("doi").alias("v")), F.struct(F.lit("p").alias("k"), F.col("pmid").alias("v")))
        return df.select(*cols, F.explode(kinds).alias("i")).select(*cols, "i.k", "i.v").where("v is not null").distinct()

    g = ids(gold, shared)
    count = lambda k, c=None: F.count_if((F.col("k") == k) & (F.col(c).isNotNull() if c else F.lit(True)))
    sizes = g.groupBy(*shared).agg(count("p").alias("gp"), count("d").alias("gd"))
    hits = ids(retrieved, by).join(g.withColumn("hit", F.lit(1)), [*shared, "k", "v"], "left")
    counted = hits.groupBy(*by).agg(count("d").alias("rd"), count("p").alias("rp"), count("d", "hit").alias("by_doi"), count("p", "hit").alias("by_pmid")).join(sizes, shared, "left").fillna(0, ["gp", "gd"])
    tp = F.col("by_doi") + F.when(F.col("gp") > F.col("gd"), F.col("by_pmid")).otherwise(0)
    out = counted.select(*by, tp.alias("tp"), F.greatest("rd", "rp").alias("retrieved"), F.greatest("gp", "gd").alias("gold"), "by_doi", "by_pmid")
    return out.withColumns(rates(F.col("tp"), F.col("retrieved"), F.col("gold")))


def row_level_matches(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Every gold row (study, gold_id, pmid, doi) with ``layer``: doi, pmid or null, the first that hits."""
    dois = retrieved.where("doi is not null").select("study", "doi").distinct().withColumn("d", F.lit(1))
    pmids = retrieved.where("pmid is not null").select("study", "pmid").distinct().withColumn("p", F.lit(1))
    found = gold.join(dois, ["study", "doi"], "left").join(pmids, ["study", "pmid"], "left")
    return found.withColumn("layer", F.when(F.col("d").isNotNull(), "doi").when(F.col("p").isNotNull(), "pmid")).drop("d", "p")


def row_level_metrics(retrieved: DataFrame, matches: DataFrame) -> DataFrame:
    """Per study: gold = rows, TP = rows matched in any layer (several rows may match one article), retrieved = the
    larger of the two id counts."""
    size = retrieved.groupBy("study").agg(F.count_distinct("doi").alias("rd"), F.count_distinct("pmid").alias("rp")).select("study", F.greatest("rd", "rp").alias("retrieved"))
    rows = matches.groupBy("study").agg(F.count(F.lit(1)).alias("gold"), F.count("layer").alias("tp"), *[F.count_if(F.col("layer") == k).alias(f"by_{k}") for k in ("doi", "pmid", "fuzzy")])
    joined = rows.join(size, "study", "left").fillna(0, ["retrieved"])
    return joined.withColumns(rates(F.col("tp"), F.col("retrieved"), F.col("gold")))


def needed_to_read(results: Column, tp: Column) -> Column:
    return results / F.greatest(tp, F.lit(1))


def database_scores(retrieved: DataFrame, gold: DataFrame, query: str, database: str) -> DataFrame:
    """Per query and database, and COMBINED per query: results, tp, gold, recall, nnr. COMBINED counts distinct
    articles again, so it is no sum of the databases."""
    combined = retrieved.withColumn(database, F.lit("COMBINED"))
    both = retrieved.select("study", query, database, "art").unionByName(combined.select("study", query, database, "art"))
    scored = set_metrics(both, gold, ["study", query, database], "art")
    return scored.select("study", query, database, F.col("retrieved").alias("results_count"), "tp", "gold", "recall", needed_to_read(F.col("retrieved"), F.col("tp")).alias("nnr"))
