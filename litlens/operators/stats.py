"""Summaries of strategies and studies: statistics, ranks, pivots, document checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(col: str) -> list[Column]:
    """mean, sample deviation (0 for one value), minimum and maximum of a column."""
    return [F.avg(col).alias(f"{col}_mean"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias(f"{col}_std"), F.min(col).alias(f"{col}_min"), F.max(col).alias(f"{col}_max")]


def strategy_statistics(scores: DataFrame, perfect: float = 0.999) -> DataFrame:
    """Per strategy over studies: spread of recall, precision, f1 and retrieved, studies and perfect recalls."""
    return scores.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_studies"), F.count_if(F.col("recall") >= perfect).alias("n_perfect"), *[c for m in ("recall", "precision", "f1", "retrieved") for c in spread(m)])


def population_statistics(scores: DataFrame) -> DataFrame:
    """Per strategy mean and population deviation in percent, as bar charts show them."""
    return scores.groupBy("strategy").agg(*[x for m in ("recall", "precision", "f1") for x in ((100 * F.avg(m)).alias(f"{m}_pct"), (100 * F.stddev_pop(m)).alias(f"{m}_std_pct"))])


def rank_strategies(statistics: DataFrame) -> DataFrame:
    """Rank by each mean; retrieved counts upwards, the rest downwards; ties keep the order of names."""
    over = lambda c, up=False: F.row_number().over(Window.orderBy(F.col(c).asc() if up else F.col(c).desc(), "strategy"))
    return statistics.select("strategy", over("recall_mean").alias("rank_recall"), over("precision_mean").alias("rank_precision"), over("f1_mean").alias("rank_f1"), over("retrieved_mean", True).alias("rank_retrieved"))


def best_strategy(statistics: DataFrame) -> DataFrame:
    """Among strategies with perfect recall in every study (all, where there is none) the one that retrieves least on
    average; without any perfect one, the best mean F1."""
    perfect = F.col("n_perfect") == F.col("n_studies")
    order = F.when(perfect, F.struct(F.lit(0).alias("k"), F.col("retrieved_mean").alias("v"))).otherwise(F.struct(F.lit(1).alias("k"), (-F.col("f1_mean")).alias("v")))
    return statistics.withColumn("o", order).orderBy("o", "strategy").limit(1).select("strategy", "n_studies", "n_perfect", "recall_mean", "f1_mean", "retrieved_mean")


def matrix(scores: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """row x column table of the first value; missing cells are null. ``values`` are the columns wanted."""
    return scores.groupBy(row).pivot(column, values).agg(F.first(value))


def type_summary(scores: DataFrame, databases: list[str]) -> DataFrame:
    """Per query number and type: total results, best TP, best and mean recall, gold size, databases, results by
    database."""
    by_db = [F.sum(F.when(F.col("database") == d, F.col("results_count"))).alias(f"results_{d}") for d in databases]
    return scores.groupBy("query_num", "query_type").agg(F.sum("results_count").alias("results"), F.max("tp").alias("best_tp"), F.max("recall").alias("best_recall"), F.avg("recall").alias("mean_recall"), F.max("gold").alias("gold"),
        F.array_join(F.array_sort(F.collect_set("database")), ",").alias("databases"), *by_db)


def study_problems(studies: DataFrame, names: list[str]) -> DataFrame:
    """study_id and the problems of a result document: identifier, gold size, queries, databases, strategy names and
    rates. A document without problems is accepted."""
    bad = F.array_compact(F.array(
        F.when(~F.col("study_id").rlike(r"^[A-Za-z0-9_\-]+$") | F.col("study_id").isNull(), "study_id"), F.when(F.coalesce("gold_size", F.lit(0)) < 1, "gold_size"),
        F.when(F.coalesce("num_queries", F.lit(0)) < 1, "num_queries"), F.when(F.coalesce(F.size("databases"), F.lit(0)) < 1, "databases"),
        F.when(F.exists("strategies", lambda s: ~s["name"].isin(*names)), "strategy_name"), F.when(F.exists("strategies", lambda s: (s["recall"] < 0) | (s["recall"] > 1) | (s["precision"] > 1)), "rate"),
    ))
    return studies.select("study_id", bad.alias("problems"))
