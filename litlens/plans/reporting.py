"""Queries of the report operators over whole test tables, each with its SQL twin written from the published rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlens.functions import confidence, query_text
from litlens.operators import gold, reports, stats, strategies
from litlens.plans import pipeline
from litlens.plans.reference import _G, _I, _PDS, _Q, _S, _STAT, _TYPE, SQL, STRATEGIES, _rated, _rounded, all_strategies, gold_rows, included, per_database_scores, query, r6, retrieval, strategy_scores
from litlens.session import Scratch, table


@query(rf"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i){strategies.CONDITION}') AND regexp_matches(text, '(?i){strategies.SLEEP}') AND (regexp_matches(text, '(?i){strategies.RANDOMISED}') OR regexp_matches(text, '(?i){strategies.NON_PHARMA}'))""")
def default_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text passes the default gate."""
    return table(spark, sf_dir, "documents").where(strategies.default_gate(F.col("text"))).select("doc_id")


def _profile_sql(text: str) -> str:
    cases = []
    for name, (exact, lower) in query_text.PROFILE.items():
        tests = [f"contains({text}, '{t}')" for t in exact] + [f"contains(lower({text}), '{t}')" for t in lower]
        cases.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    return f"list_sort(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))"


@query(f"SELECT {_Q}, array_to_string({_profile_sql('text')}, ', ') AS features FROM query_text WHERE text IS NOT NULL")
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "query_text").where("text is not null")
    return t.select("study_name", "provider", "query_num", F.array_join(query_text.profile(F.col("text")), ", ").alias("features"))


@query(f"""WITH f AS (SELECT {_Q}, {_profile_sql('text')} AS f FROM query_text WHERE text IS NOT NULL), d AS (SELECT a.study_name, a.provider, list_sort(list_filter(b.f, lambda x: NOT list_contains(a.f, x))) AS added, list_sort(list_filter(a.f, lambda x: NOT list_contains(b.f, x))) AS removed FROM f a JOIN f b ON b.study_name = a.study_name AND b.provider = a.provider AND b.query_num = 2 WHERE a.query_num = 1)
SELECT study_name, provider, CASE WHEN len(added) + len(removed) = 0 THEN 'Q2 preserves the same feature profile as Q1 and mainly tightens wording or synonym scope.' ELSE 'Q2 ' || CASE WHEN len(added) > 0 THEN 'adds ' || array_to_string(added, ', ') ELSE '' END || CASE WHEN len(added) > 0 AND len(removed) > 0 THEN ' and ' ELSE '' END || CASE WHEN len(removed) > 0 THEN 'drops ' || array_to_string(removed, ', ') ELSE '' END || '.' END AS delta FROM d""")
def feature_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "query_text").where("text is not null").select("study_name", "provider", "query_num", query_text.profile(F.col("text")).alias("f"))
    q = lambda n: t.where(F.col("query_num") == n).select("study_name", "provider", F.col("f").alias(f"f{n}"))
    return q(1).join(q(2), ["study_name", "provider"]).select("study_name", "provider", query_text.profile_delta(F.col("f1"), F.col("f2")).alias("delta"))


_BIO = " OR ".join(f"contains(lower(journal), '{w}')" for w in gold.BIOMEDICAL)


@query(f"WITH {_I} SELECT study_name, count(*) AS total, count(*) FILTER (WHERE {_BIO}) AS biomedical, count(*) FILTER (WHERE doi IS NOT NULL OR pmid IS NOT NULL) AS identified FROM i GROUP BY study_name")
def reference_biomedical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return included(spark, sf_dir).groupBy("study_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(gold.biomedical(F.col("journal"))).alias("biomedical"), F.count_if(F.col("doi").isNotNull() | F.col("pmid").isNotNull()).alias("identified"))


_AGREE = "CASE WHEN a AND y THEN 0.95 ELSE 0.85 END"


@query(f"""WITH c AS (SELECT cand_id, coalesce(num_results, 1) AS n, coalesce(len(list_filter(authors[1:5], lambda x: contains(lower(x), lower(first_author)))) > 0, false) AND coalesce(length(first_author), 0) > 0 AS a, year IS NOT NULL AS y, work_type AS w, coalesce(len(list_filter(pub_types, lambda x: contains(lower(x), 'preprint'))) > 0, false) AS pre FROM lookup_candidates)
SELECT cand_id, round(CAST({_AGREE} AS DOUBLE) * CASE WHEN n > 5 THEN 0.95 ELSE 1.0 END * CASE WHEN w IN ('posted-content', 'preprint') THEN 0.85 WHEN w IN ('proceedings-article', 'book-chapter') THEN 0.95 ELSE 1.0 END, 6) AS crossref, round(CAST({_AGREE} AS DOUBLE) * CASE WHEN n > 10 THEN 0.95 ELSE 1.0 END * CASE WHEN pre THEN 0.85 ELSE 1.0 END, 6) AS europepmc FROM c""")
def lookup_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of every candidate for a title that agrees fully, with the penalties of its type and result count."""
    c = table(spark, sf_dir, "lookup_candidates")
    one, n, y = F.lit(1.0), F.coalesce("num_results", F.lit(1)), F.col("year").isNotNull()
    a = confidence.author_listed(F.col("first_author"), F.col("authors"))
    return c.select("cand_id", r6(confidence.crossref_confidence(one, n, a, y, F.col("work_type"))).alias("crossref"), r6(confidence.europepmc_confidence(one, n, a, y, F.col("pub_types"))).alias("europepmc"))


_SETS = " UNION ALL ".join(f"SELECT '{n}' AS strategy, study, pmid, doi FROM ({SQL[q]})" for n, q in STRATEGIES.items())
_SETS_MULTI = f"""SELECT strategy, study, by_doi + CASE WHEN gp > gd THEN by_pmid ELSE 0 END AS tp, greatest(rd, rp) AS retrieved, greatest(gp, gd) AS gold FROM (
SELECT s.strategy, s.study, count(DISTINCT s.doi) AS rd, count(DISTINCT s.pmid) AS rp, count(DISTINCT d.doi) AS by_doi, count(DISTINCT p.pmid) AS by_pmid, coalesce(any_value(n.gd), 0) AS gd, coalesce(any_value(n.gp), 0) AS gp FROM ({_SETS}) s
LEFT JOIN (SELECT DISTINCT study, doi FROM g WHERE doi IS NOT NULL) d ON d.study = s.study AND d.doi = s.doi LEFT JOIN (SELECT DISTINCT study, pmid FROM g WHERE pmid IS NOT NULL) p ON p.study = s.study AND p.pmid = s.pmid
LEFT JOIN (SELECT study, count(DISTINCT doi) AS gd, count(DISTINCT pmid) AS gp FROM g GROUP BY study) n ON n.study = s.study GROUP BY s.strategy, s.study)"""


@query(f"WITH {_G} {_rated(_SETS_MULTI, 'strategy, study')}")
def score_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy's set by the two unpaired id sets."""
    return _rounded(pipeline.score_sets(all_strategies(spark, sf_dir), gold_rows(spark, sf_dir)), ["strategy", "study"])


@query()
def score_row_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level scores with all three layers: identifiers, then title, author and year of the imported records."""
    scratch = Scratch(spark, "score")
    records = table(spark, sf_dir, "embase_query3").select(F.col("study_name").alias("study"), F.explode("records").alias("r")).select("study", F.col("r.record_id").alias("ord"), "r.title", "r.first_author", F.col("r.year").cast("string").alias("year"))
    return _rounded(pipeline.score(scratch.cut(retrieval(spark, sf_dir)), gold_rows(spark, sf_dir), records), ["study"])


@query(f"WITH {_PDS} SELECT study, database, count(*) AS queries, CAST(sum(results_count) AS BIGINT) AS total_results, max(recall) AS best_recall FROM pd WHERE database <> 'COMBINED' GROUP BY study, database")
def database_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.database_summary(per_database_scores(spark, sf_dir), ["study"])


@query(f"""WITH {_S}, a AS ({_STAT}), b AS (SELECT *, n_perfect = n_studies AS perfect FROM a)
SELECT count(*) AS n_strategies, coalesce(max(n_studies), 0) AS n_studies, count(*) FILTER (WHERE perfect) AS n_perfect, coalesce(array_to_string(list_sort(list(strategy) FILTER (WHERE perfect)), ','), '') AS perfect, min(retrieved_mean) AS retrieved_least, max(retrieved_mean) AS retrieved_most, (SELECT count(DISTINCT coalesce(domain, 'unknown')) FROM study) AS n_domains,
(SELECT strategy FROM b WHERE perfect ORDER BY retrieved_mean, strategy LIMIT 1) AS best_perfect FROM b""")
def executive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = stats.strategy_statistics(strategy_scores(spark, sf_dir))
    domains = table(spark, sf_dir, "study").agg(F.count_distinct(F.coalesce("domain", F.lit("unknown"))).alias("n"))
    statistics = statistics.withColumn("retrieved_mean", F.round("retrieved_mean", 9))
    return reports.findings(statistics, 0).drop("n_domains").crossJoin(domains.withColumnRenamed("n", "n_domains"))  # one row each


_TWO = f"""WITH {_PDS}, q AS (SELECT study, results_count, tp, recall, row_number() OVER (PARTITION BY study ORDER BY query_num) AS n FROM pd WHERE database = 'COMBINED' AND query_num IS NOT NULL)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = per_database_scores(spark, sf_dir).where("database = 'COMBINED' and query_num is not null")
    return combined.withColumn("query_num", F.row_number().over(Window.partitionBy("study").orderBy("query_num")))


@query(f"""{_TWO}, p AS (SELECT study_name, count(*) AS paper_count FROM included_studies GROUP BY study_name)
SELECT study, 'Q' || n AS query, round(recall * 100, 4) AS recall_percent, round(CASE WHEN results_count > 0 THEN tp / results_count * 100 END, 6) AS precision_percent, results_count AS retrieved, round(results_count / paper_count * 100, 6) AS ratio_percent FROM q LEFT JOIN p ON p.study_name = q.study WHERE n <= 2""")
def first_two_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _numbered(spark, sf_dir)
    measured = reports.resolved(q, q.limit(0), ["study", "query_num"])
    papers = table(spark, sf_dir, "included_studies").groupBy(F.col("study_name").alias("study")).agg(F.count(F.lit(1)).alias("paper_count"))
    out = reports.first_two_queries(measured, papers)
    return out.select("study", "query", F.round("recall_percent", 4).alias("recall_percent"), r6("precision_percent").alias("precision_percent"), "retrieved", r6("ratio_percent").alias("ratio_percent"))


@query(f"""{_TWO}, f AS (SELECT study_name AS study, row_number() OVER (PARTITION BY study_name ORDER BY year(imported_at)) AS n, CAST(sum(results_count) AS BIGINT) AS results_count FROM embase_query3 WHERE imported_at IS NOT NULL GROUP BY study_name, year(imported_at))
SELECT coalesce(q.study, f.study) AS study, coalesce(q.n, f.n) AS query_num, coalesce(q.results_count, f.results_count) AS results_count, q.tp AS tp, round(q.recall * 100, 4) AS recall_percent, round(CASE WHEN coalesce(q.results_count, f.results_count) > 0 THEN q.tp / coalesce(q.results_count, f.results_count) * 100 END, 6) AS precision_percent FROM q FULL JOIN f ON f.study = q.study AND f.n = q.n""")
def resolved_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COMBINED rows of each study's queries, else the counts that the imports themselves state."""
    e = table(spark, sf_dir, "embase_query3").where("imported_at is not null").groupBy(F.col("study_name").alias("study"), F.year("imported_at").alias("y")).agg(F.sum("results_count").alias("results_count"))
    fallback = e.select("study", F.row_number().over(Window.partitionBy("study").orderBy("y")).alias("query_num"), "results_count", F.lit(None).cast("long").alias("tp"), F.lit(None).cast("double").alias("recall"))
    out = reports.resolved(_numbered(spark, sf_dir), fallback, ["study", "query_num"])
    return out.select("study", "query_num", "results_count", "tp", F.round("recall_percent", 4).alias("recall_percent"), r6("precision_percent").alias("precision_percent"))


_OK = "(lookup_metadata.confidence IS NULL OR lookup_metadata.confidence >= 0.85)"


@query(f"""WITH {_I}, c AS (SELECT study_name, count(*) AS total, count(*) FILTER (WHERE {_OK}) AS accepted, count(*) FILTER (WHERE NOT {_OK}) AS rejected, count(*) FILTER (WHERE {_OK} AND pmid IS NOT NULL) AS with_pmid, count(*) FILTER (WHERE {_OK} AND doi IS NOT NULL) AS with_doi, count(*) FILTER (WHERE {_OK} AND pmid IS NOT NULL AND doi IS NOT NULL) AS with_both, count(*) FILTER (WHERE {_OK} AND pmid IS NULL AND doi IS NULL) AS with_neither,
round(avg(lookup_metadata.confidence) FILTER (WHERE {_OK}), 6) AS confidence_mean, round(min(lookup_metadata.confidence) FILTER (WHERE {_OK}), 6) AS confidence_min, round(max(lookup_metadata.confidence) FILTER (WHERE {_OK}), 6) AS confidence_max, count(lookup_metadata.confidence) FILTER (WHERE {_OK}) AS with_confidence FROM i GROUP BY study_name)
SELECT *, round(100 * with_pmid / greatest(accepted, 1), 6) AS pmid_pct, array_to_string(list_filter([CASE WHEN 100 * with_pmid / greatest(accepted, 1) < 70 THEN 'low_pmid' END, CASE WHEN with_neither > 0 THEN 'neither' END, CASE WHEN rejected > 0.2 * accepted THEN 'rejections' END], lambda x: x IS NOT NULL), ',') AS warnings FROM c""")
def gold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = included(spark, sf_dir).select("study_name", "pmid", "doi", F.col("lookup_metadata.confidence").alias("confidence"))
    out = reports.gold_report(rows, ["study_name"])
    return out.withColumns({c: r6(c) for c in ("confidence_mean", "confidence_min", "confidence_max", "pmid_pct")})


@query(f"""WITH {_I}, k AS (SELECT study_name, coalesce(lookup_metadata.source, 'Unknown') AS source FROM i WHERE {_OK}) SELECT study_name, source, count(*) AS n, round(100 * count(*) / any_value(t.accepted), 6) AS percent FROM k JOIN (SELECT study_name AS s, count(*) AS accepted FROM k GROUP BY 1) t ON t.s = k.study_name GROUP BY study_name, source""")
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = included(spark, sf_dir).select("study_name", F.col("lookup_metadata.confidence").alias("confidence"), F.col("lookup_metadata.source").alias("source"))
    return reports.source_histogram(rows, ["study_name"]).withColumn("percent", r6("percent"))


_TYPED = f"""{_TYPE}, ty AS (SELECT study_name AS study, query_num, provider AS database, CAST(length(text) AS INTEGER) AS chars, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN lower(p) NOT IN ('note', 'notes', 'important', 'warning', 'example', 'examples', '') THEN p END AS t FROM k WHERE text IS NOT NULL AND provider IS NOT NULL AND query_num IS NOT NULL),
sc AS (SELECT study, query_num, database, chars FROM ty UNION ALL SELECT study, query_num, 'COMBINED', CAST(sum(chars) AS INTEGER) FROM ty GROUP BY study, query_num),
anyt AS (SELECT study, query_num, arg_min(t, database) AS t FROM ty WHERE t IS NOT NULL GROUP BY study, query_num),
typed AS (SELECT sc.study, sc.query_num, sc.database, sc.chars, coalesce(CASE WHEN sc.database = 'COMBINED' THEN anyt.t ELSE ty.t END, 'Unknown') AS query_type FROM sc LEFT JOIN ty ON ty.study = sc.study AND ty.query_num = sc.query_num AND ty.database = sc.database LEFT JOIN anyt ON anyt.study = sc.study AND anyt.query_num = sc.query_num)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "query_text").where("text is not null and provider is not null and query_num is not null")
    each = q.select(F.col("study_name").alias("study"), "query_num", F.col("provider").alias("database"), F.length("text").alias("chars"), query_text.query_type(F.col("comment")).alias("query_type"))
    combined = each.groupBy("study", "query_num").agg(F.sum("chars").cast("int").alias("chars")).withColumn("database", F.lit(reports.COMBINED))
    scores = each.drop("query_type").unionByName(combined)
    return reports.typed(scores, each.drop("chars"), ["study"])


@query(f"{_TYPED} SELECT study, query_num, database, chars, query_type FROM typed")
def typed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("study", "query_num", "database", "chars", "query_type")


@query(f"""{_TYPED} SELECT p.study, p.query_num, p.query_type, p.database, p.chars, m.chars AS chars_merged FROM typed p LEFT JOIN typed m ON m.database = 'COMBINED' AND m.study = p.study AND m.query_num = p.query_num AND m.query_type = p.query_type WHERE p.database <> 'COMBINED'""")
def merged_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _typed(spark, sf_dir).select("study", "query_num", "database", "chars", "query_type")
    return reports.merged_display(t.where("database <> 'COMBINED'"), t.where("database = 'COMBINED'").drop("database"), ["study"])


@query(f"WITH {_S} SELECT strategy, study, metric, round(value, 4) AS value FROM (SELECT strategy, study, unnest(['recall', 'precision', 'f1']) AS metric, unnest([recall * 100, precision * 100, f1 * 100]) AS value FROM s)")
def box_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.box_points(strategy_scores(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query("""SELECT s.study_name AS study, s.domain, s.mindate, s.maxdate, coalesce(g.n, 0) AS gold_size, coalesce(q.n, 0) AS num_queries, array_to_string(list_sort(list_distinct(list_concat(coalesce(q.dbs, []), CASE WHEN e.s IS NOT NULL THEN ['embase'] ELSE [] END))), ',') AS databases FROM study s
LEFT JOIN (SELECT study_name, count(*) AS n FROM gold_list GROUP BY 1) g ON g.study_name = s.study_name LEFT JOIN (SELECT study_name, count(DISTINCT query_num) AS n, list(DISTINCT provider) FILTER (WHERE provider IS NOT NULL) AS dbs FROM query_text GROUP BY 1) q ON q.study_name = s.study_name
LEFT JOIN (SELECT DISTINCT study_name AS s FROM embase_query3) e ON e.s = s.study_name""")
def study_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = lambda n, *more: table(spark, sf_dir, n).select(F.col("study_name").alias("study"), *more)
    out = reports.study_metadata(study("study", "domain", "mindate", "maxdate"), study("query_text", "query_num", F.col("provider").alias("database")), study("gold_list"), study("embase_query3"))
    return out.withColumn("databases", F.array_join("databases", ","))
