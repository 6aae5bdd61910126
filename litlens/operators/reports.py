"""Frames and texts behind the reports: summaries by database, findings, comparisons of two queries, run reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlens.operators import stats
from litlens.sources.writers import markdown_table

COMBINED = "COMBINED"


def database_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per database, COMBINED left out: queries, total results and best recall. ``scores``: ``by``, database,
    results_count, recall; one row per query."""
    each = scores.where(F.col("database") != COMBINED)
    return each.groupBy(*by, "database").agg(F.count(F.lit(1)).alias("queries"), F.sum("results_count").alias("total_results"), F.max("recall").alias("best_recall"))


def findings(statistics: DataFrame, domains: int | Column) -> DataFrame:
    """One row of key findings over ``stats.strategy_statistics``: strategies, studies at most, strategies with perfect
    recall everywhere (names sorted), the one of them that retrieves least, the range of mean retrieved counts and the
    number of domains. No strategies give counts of 0 and nulls."""
    perfect = F.col("n_perfect") == F.col("n_studies")
    least = F.min(F.when(perfect, F.struct(F.col("retrieved_mean").alias("m"), F.col("strategy").alias("s"))))
    out = statistics.agg(
        F.count(F.lit(1)).alias("n_strategies"), F.coalesce(F.max("n_studies"), F.lit(0)).alias("n_studies"), F.count_if(perfect).alias("n_perfect"),
        F.array_join(F.array_sort(F.collect_set(F.when(perfect, F.col("strategy")))), ",").alias("perfect"), least["s"].alias("best_perfect"), F.min("retrieved_mean").alias("retrieved_least"), F.max("retrieved_mean").alias("retrieved_most"),
    )
    return out.withColumn("n_domains", domains if isinstance(domains, Column) else F.lit(domains))


def resolved(summary: DataFrame, fallback: DataFrame, by: list[str]) -> DataFrame:
    """``by``, results_count, tp, recall, recall_percent, precision_percent: a query's COMBINED row of the newest
    summary where there is one, else the study document's entry. Both have ``by``, results_count, tp, recall; each
    value falls back for itself. Precision is null where nothing was retrieved or a count is missing."""
    values = ("results_count", "tp", "recall")
    a = summary.select(*by, *[F.col(v).alias(f"__{v}") for v in values])
    both = a.join(fallback.select(*by, *values), by, "full")
    filled = both.select(*by, *[F.coalesce(f"__{v}", v).alias(v) for v in values])
    precision = F.when(F.col("results_count") > 0, F.col("tp") / F.col("results_count") * 100)
    return filled.withColumns({"recall_percent": F.col("recall") * 100, "precision_percent": precision})


def first_two_queries(metrics: DataFrame, papers: DataFrame) -> DataFrame:
    """study, query (Q1, Q2), recall_percent, precision_percent, retrieved, ratio_percent, recall_text, note, in the
    order of studies with case folded. ``metrics``: study, query_num, results_count and ``resolved``'s percentages;
    ``papers``: study, paper_count. Studies without any value in both queries are left out."""
    two = metrics.where("query_num in (1, 2)")
    known = two.where("results_count is not null or recall_percent is not null").select("study").distinct()
    joined = two.join(known, "study", "left_semi").join(papers, "study", "left")
    ratio = F.when(F.col("paper_count") > 0, F.col("results_count") / F.col("paper_count") * 100)
    note = F.when(F.col("results_count").isNull(), F.lit("")).when(ratio.isNotNull(), F.concat(F.format_number("results_count", 0), F.lit(" ("), F.format_string("%.1f", ratio), F.lit("%)"))).otherwise(F.concat(F.format_number("results_count", 0), F.lit(" (N/A)")))
    text = F.coalesce(F.format_string("%.3f", F.col("recall_percent") / 100), F.lit(""))
    out = joined.select("study", F.concat(F.lit("Q"), F.col("query_num").cast("string")).alias("query"), "recall_percent", "precision_percent", F.col("results_count").alias("retrieved"), ratio.alias("ratio_percent"), F.when(F.col("recall_percent").isNull(), F.lit("")).otherwise(text).alias("recall_text"), note.alias("note"))
    return out.orderBy(F.lower("study"), "study", "query")


def typed(scores: DataFrame, types: DataFrame, by: list[str]) -> DataFrame:
    """``scores`` with ``query_type``: of its query and database, COMBINED rows the one of the first database by name
    that has a type, ``Unknown`` where there is none. ``types``: ``by``, query_num, database, query_type."""
    keys = [*by, "query_num"]
    known = types.where("query_type is not null")
    any_db = known.groupBy(*keys).agg(F.min(F.struct("database", "query_type"))["query_type"].alias("query_type"))
    every = known.select(*keys, "database", "query_type").unionByName(any_db.withColumn("database", F.lit(COMBINED)))
    return scores.join(every, [*keys, "database"], "left").withColumn("query_type", F.coalesce("query_type", F.lit("Unknown")))


def merged_display(per_database: DataFrame, merged: DataFrame, by: list[str]) -> DataFrame:
    """Left outer merge of the two frames on ``by``, query_num and query_type; equal names of the second get the suffix
    ``_merged``."""
    keys = [*by, "query_num", "query_type"]
    second = merged.select(*keys, *[F.col(c).alias(f"{c}_merged" if c in per_database.columns else c) for c in merged.columns if c not in keys])
    return per_database.join(second, keys, "left")


def gold_report(rows: DataFrame, by: list[str], minimum: float = 0.85) -> DataFrame:
    """Per group: rows, accepted and rejected by confidence (unknown is accepted), coverage of the accepted, their
    confidence, and the warnings ``low_pmid`` (under 70 %), ``neither`` and ``rejections`` (over a fifth of the
    accepted). ``rows``: ``by``, pmid, doi, confidence."""
    ok = F.col("confidence").isNull() | (F.col("confidence") >= minimum)
    p, d = F.col("pmid").isNotNull(), F.col("doi").isNotNull()
    kept = F.when(ok, F.col("confidence"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(ok & p).alias("with_pmid"), F.count_if(ok & d).alias("with_doi"), F.count_if(ok & p & d).alias("with_both"),
        F.count_if(ok & ~p & ~d).alias("with_neither"), F.avg(kept).alias("confidence_mean"), F.min(kept).alias("confidence_min"), F.max(kept).alias("confidence_max"), F.count(kept).alias("with_confidence"),
    )
    share = F.col("with_pmid") / F.greatest("accepted", F.lit(1)) * 100
    warn = [F.when(share < 70, F.lit("low_pmid")), F.when(F.col("with_neither") > 0, F.lit("neither")), F.when(F.col("rejected") > 0.2 * F.col("accepted"), F.lit("rejections"))]
    return out.withColumns({"pmid_pct": share, "warnings": F.concat_ws(",", *warn)})


def source_histogram(rows: DataFrame, by: list[str], minimum: float = 0.85) -> DataFrame:
    """Per group and lookup source of accepted rows their number and percentage, ``Unknown`` where none is named."""
    ok = rows.where(F.col("confidence").isNull() | (F.col("confidence") >= minimum))
    counted = ok.groupBy(*by, F.coalesce("source", F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    total = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("accepted"))
    return counted.join(total, by).select(*by, "source", "n", (F.col("n") / F.col("accepted") * 100).alias("percent"))


def box_points(scores: DataFrame) -> DataFrame:
    """strategy, study, metric, value in percent: the points of box plots and of the recall-precision scatter."""
    metrics = F.create_map(*[x for m in ("recall", "precision", "f1") for x in (F.lit(m), F.col(m) * 100)])
    return scores.select("strategy", "study", F.explode(metrics).alias("metric", "value"))


def study_metadata(studies: DataFrame, queries: DataFrame, gold: DataFrame, imports: DataFrame) -> DataFrame:
    """study, domain, mindate, maxdate, gold_size, num_queries, databases of every study: its metadata assembled from
    the four tables. Studies without gold rows or queries have 0."""
    q = queries.groupBy("study").agg(F.count_distinct("query_num").alias("num_queries"), F.array_sort(F.collect_set("database")).alias("databases"))
    g = gold.groupBy("study").agg(F.count(F.lit(1)).alias("gold_size"))
    i = imports.select("study").distinct().withColumn("has_import", F.lit(True))
    out = studies.join(q, "study", "left").join(g, "study", "left").join(i, "study", "left")
    databases = F.coalesce("databases", F.array().cast("array<string>"))
    return out.select("study", "domain", "mindate", "maxdate", F.coalesce("gold_size", F.lit(0)).alias("gold_size"), F.coalesce("num_queries", F.lit(0)).alias("num_queries"),
        F.when(F.col("has_import") & ~F.array_contains(databases, "embase"), F.array_sort(F.array_append(databases, F.lit("embase")))).otherwise(databases).alias("databases"))


def run_report(a: DataFrame, b: DataFrame, gold: DataFrame | None = None, heads: tuple[DataFrame, DataFrame] | None = None) -> str:
    """The JSON report of two runs (art): counts, overlap coefficient, Jaccard, the first five summary rows of each and,
    with a gold list (art), TP, FP and FN of each. One aggregation; only its row and the heads reach the driver."""
    marked = a.select("art").distinct().withColumn("a", F.lit(1)).join(b.select("art").distinct().withColumn("b", F.lit(1)), "art", "full")
    g = (gold.select("art").distinct() if gold is not None else a.select("art").limit(0)).withColumn("g", F.lit(1))
    marked = marked.join(g, "art", "full")
    A, B, G = (F.col(c).isNotNull() for c in "abg")
    n = F.count_if
    r = marked.agg(n(A).alias("a"), n(B).alias("b"), n(A & B).alias("both"), n(A | B).alias("union"), n(A & G).alias("ta"), n(B & G).alias("tb"), n(G).alias("g")).first()
    out: dict = {
        "counts": {"A_total": r.a, "B_total": r.b, "A∩B": r.both, "A−B": r.a - r.both, "B−A": r.b - r.both},
        "overlap_coefficient": r.both / max(1, min(r.a, r.b)), "jaccard": r.both / max(1, r.union),
    }
    for name, head in zip("AB", heads or (), strict=False):
        out[f"summary_head_{name}"] = [x.asDict() for x in head.limit(5).collect()]
    if gold is not None:
        out["gold"] = {k: {"TP": t, "FP": s - t, "FN": r.g - t} for k, t, s in (("A", r.ta, r.a), ("B", r.tb, r.b))}
    return json.dumps(out, indent=2, default=str, ensure_ascii=False)


def markdown_report(scores: DataFrame, studies: DataFrame) -> str:
    """The cross-study report in eight sections. ``scores``: strategy, study and the rates; ``studies``: study, domain,
    gold_size. Only statistics by strategy and by domain reach the driver."""
    statistics = stats.strategy_statistics(scores)
    domains = studies.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("studies"), F.sum("gold_size").alias("gold"))
    f = findings(statistics, F.lit(domains.count())).first()
    best = stats.best_strategy(statistics).first()
    key = f"{f.n_perfect} of {f.n_strategies} strategies reach full recall in all studies: {f.perfect}" if f.n_perfect else f"No strategy reaches full recall in all {f.n_studies} studies."
    spread = lambda m: statistics.select("strategy", *[F.round(f"{m}_{x}", 4).alias(x) for x in ("mean", "std", "min", "max")]).orderBy("strategy")
    sections = {
        "Executive Summary": f"{f.n_strategies} strategies over {f.n_studies} studies.\n\n{key}\n\nRecommended: `{best.strategy if best else None}`",
        "Studies": markdown_table(domains.orderBy("domain")), "Strategy Ranking": markdown_table(stats.rank_strategies(statistics).orderBy("rank_recall")),
        "Recall": markdown_table(spread("recall")), "Precision": markdown_table(spread("precision")), "F1": markdown_table(spread("f1")), "Retrieved": markdown_table(spread("retrieved")),
        "Conclusions": f"1. {key}\n2. Mean retrieved counts lie between {f.retrieved_least or 0:.0f} and {f.retrieved_most or 0:.0f}.\n3. {f.n_domains} domains are covered.",
    }
    return "\n\n".join(["# Cross-Study Report", *[f"## {n}\n\n{text}" for n, text in sections.items()]]) + "\n"
