"""The evaluation's workflows as single plans: score, aggregate, cross-study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlens.functions.similarity import extraction_similarity
from litlens.operators import fuzzy, gold, identity, metrics, stats, strategies

STRATEGIES = ("consensus", "precision_gated_union", "weighted_vote", "concept_family_consensus", "two_stage_screen", "time_stratified_hybrid")


def aggregate(retrieval: DataFrame, texts: DataFrame | None = None, gates: Column | None = None, families: DataFrame | None = None, topk: int = 3, k: int = 2, weights: tuple[float, ...] = (1.0,), split: bool = False) -> DataFrame:
    """strategy, study, art, pmid, doi of all strategies in one plan. Each strategy reads ``retrieval`` again, so give a
    narrow written table. With ``split`` pools are
    providers of one query, so all of them count (``topk`` does not hold)."""
    top = None if split else topk
    made = {
        f"consensus_k{k}": strategies.consensus(retrieval, top, k), "precision_gated_union": strategies.gated_union(retrieval, texts, gates), "weighted_vote": strategies.weighted_vote(retrieval, weights),
        "two_stage_screen": strategies.gated_union(retrieval, texts, gates) if split else strategies.two_stage_screen(retrieval, texts, gates, topk), "time_stratified_hybrid": strategies.half_split_hybrid(retrieval),
    }
    if families is not None:
        made["concept_family_consensus"] = strategies.family_consensus(retrieval, families)
    out = None
    for name, df in made.items():
        one = df.select(F.lit(name).alias("strategy"), "study", "art", "pmid", "doi")
        out = one if out is None else out.unionByName(one)
    return out


def score(retrieval: DataFrame, gold: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Row-level metrics of each study with the layers DOI, PMID and, where ``meta`` (study, ord, title, first_author,
    year) is given, fuzzy for the rows that no identifier matched."""
    matches = metrics.row_level_matches(retrieval, gold)
    if meta is not None:
        missed = fuzzy.described(matches.where("layer is null"), ["study", "gold_id"], "title", "first_author", "year")
        near = fuzzy.exhaustive_fuzzy_matches(missed, fuzzy.described(meta, ["study", "ord"], "title", "first_author", "year")).select("study", "gold_id", F.lit("fuzzy").alias("near"))
        matches = matches.join(near, ["study", "gold_id"], "left").withColumn("layer", F.coalesce("layer", "near")).drop("near")
    return metrics.row_level_metrics(retrieval, matches)


def score_sets(sets: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of strategy sets by the two unpaired id sets (the published ``score-sets`` algorithm), best first."""
    return metrics.multi_key_metrics(sets, gold, ["strategy", "study"]).orderBy(F.col("f1").desc(), F.col("recall").desc(), F.col("precision").desc(), "strategy", "study")


def cross_study(scores: DataFrame) -> dict[str, DataFrame]:
    """Statistics, ranks and the best strategy over studies. ``scores``: strategy, study and the rates."""
    statistics = stats.strategy_statistics(scores)
    return {"statistics": statistics, "population": stats.population_statistics(scores), "ranks": stats.rank_strategies(statistics), "best": stats.best_strategy(statistics)}


def vote_runs(rows: DataFrame, runs: int, threshold: float = 0.6) -> DataFrame:
    """study, cluster, votes, share of the clusters of repeated extractions that reach the threshold, most votes first.
    ``rows``: study, ord (run by run), title, first_author, year, doi, pmid; each row is a vote, as published."""
    clusters = identity.greedy_clusters(rows, "study", "ord", ["title", "first_author", "year"], extraction_similarity, identifiers=("doi", "pmid"))
    return gold.votes(clusters.select("study", "cluster", F.col("ord").alias("run")), runs, threshold).orderBy(F.col("votes").desc(), "study", "cluster")
