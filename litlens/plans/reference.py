"""Queries of the evaluation engine's own operators over whole test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.functions import citations, confidence, query_text, similarity
from litlens.functions.identifiers import clean_null
from litlens.operators import fuzzy, gold, identity, metrics, stats, strategies
from litlens.plans import pipeline
from litlens.session import Scratch, table
from litlens.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if SQL can express it on whole tables."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- inputs ---------------------------------------------------------------------------------------------------

TRIAL = r"sleep|insomnia|apnea|apnoea|restless\s*leg|narcolep"
DESIGN = r"randomi[sz]ed|trial|placebo|behaviou?r|cognitive|exercise|mindfulness"


def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "embase_query3").select(F.col("study_name").alias("study"), F.col("import_id").alias("pool"), F.posexplode(F.arrays_zip("retrieved_dois", "retrieved_pmids")).alias("ord", "h"))
    ids = hits.select("study", "pool", "ord", _id("h.retrieved_pmids").alias("pmid"), F.lower(_id("h.retrieved_dois")).alias("doi"))
    return ids.withColumn("art", strategies.article_key(F.col("pmid"), F.col("doi"))).where("art is not null")


def _id(name: str) -> Column:
    t = F.trim(name)
    return F.when(~F.lower(t).isin("", "nan", "none"), t)


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gold_list")
    rows = g.select(F.col("study_name").alias("study"), "gold_id", _id("pmid").alias("pmid"), F.lower(_id("doi")).alias("doi"), "title", "first_author", "year", "journal")
    return rows.withColumn("art", strategies.article_key(F.col("pmid"), F.col("doi")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "embase_query3").select(F.col("study_name").alias("study"), F.explode("records").alias("r"))
    return r.select("study", _id("r.pmid").alias("pmid"), F.col("r.title").alias("title")).where("pmid is not null and title is not null")


def gates() -> Column:
    return F.lower("title").rlike(TRIAL) & F.lower("title").rlike(DESIGN)


def included(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "included_studies")
    return t.withColumns({"pmid": _id("pmid"), "doi": F.lower(_id("doi"))})


_ID = "CASE WHEN lower(trim({0}, ' ')) IN ('','nan','none') THEN NULL ELSE trim({0}, ' ') END"
_R = f"""
hit AS (SELECT study_name AS study, import_id AS pool, unnest(retrieved_dois) AS d0, unnest(retrieved_pmids) AS p0, unnest(range(len(retrieved_dois))) AS ord FROM embase_query3),
r0 AS (SELECT study, pool, ord, {_ID.format("p0")} AS pmid, lower({_ID.format("d0")}) AS doi FROM hit),
r AS (SELECT *, coalesce('doi:' || doi, 'pmid:' || pmid) AS art FROM r0 WHERE doi IS NOT NULL OR pmid IS NOT NULL),
p AS (SELECT study, pool, row_number() OVER (PARTITION BY study ORDER BY pool) - 1 AS q_ord, count(*) OVER (PARTITION BY study) AS n_pools FROM (SELECT DISTINCT study, pool FROM r)),
rp AS (SELECT r.*, p.q_ord, p.n_pools FROM r JOIN p USING (study, pool))"""
_G = f"""g AS (SELECT study_name AS study, gold_id, {_ID.format("pmid")} AS pmid, lower({_ID.format("doi")}) AS doi, coalesce('doi:' || lower({_ID.format("doi")}), 'pmid:' || {_ID.format("pmid")}) AS art, title, first_author, year, journal FROM gold_list)"""
_T = f"""t AS (SELECT study, {_ID.format("x.pmid")} AS pmid, x.title AS title FROM (SELECT study_name AS study, unnest(records) AS x FROM embase_query3) WHERE {_ID.format("x.pmid")} IS NOT NULL AND x.title IS NOT NULL),
ok AS (SELECT DISTINCT study, pmid FROM t WHERE regexp_matches(lower(title), '{TRIAL}') AND regexp_matches(lower(title), '{DESIGN}'))"""
_M = "nullif(arg_min(coalesce(pmid, ''), pool * 1000000 + ord), '') AS pmid, nullif(arg_min(coalesce(doi, ''), pool * 1000000 + ord), '') AS doi"
_GATED = "SELECT m.study, m.art, m.pmid, m.doi FROM m WHERE m.pmid IS NULL OR EXISTS (SELECT 1 FROM ok WHERE ok.study = m.study AND ok.pmid = m.pmid) OR m.study NOT IN (SELECT study FROM t)"


def _member(where: str = "true") -> str:
    return f"SELECT study, art, {_M} FROM rp WHERE {where} GROUP BY study, art"


# ---- strategies -----------------------------------------------------------------------------------------------


@query(f"WITH {_R} SELECT study, art, {_M}, count(DISTINCT pool) AS n_pools FROM rp WHERE q_ord < 3 GROUP BY study, art HAVING count(DISTINCT pool) >= 2")
def consensus_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.consensus(retrieval(spark, sf_dir), 3, 2)


@query(f"WITH {_R} SELECT study, art, {_M}, count(DISTINCT pool) AS n_pools FROM rp GROUP BY study, art HAVING count(DISTINCT pool) >= 3")
def consensus_k3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.consensus(retrieval(spark, sf_dir), None, 3)


@query(f"WITH {_R} {_member()}")
def union_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.union_all(retrieval(spark, sf_dir))


@query(f"WITH {_R}, {_T}, m AS ({_member()}) {_GATED}")
def gated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.gated_union(retrieval(spark, sf_dir), texts(spark, sf_dir), gates())


def _vote_sql(weights: list[float]) -> str:
    case = "CASE " + " ".join(f"WHEN q_ord = {i} THEN {w}" for i, w in enumerate(weights)) + f" ELSE {weights[-1]} END"
    return f"""WITH {_R}, w AS (SELECT study, pool, n_pools, CAST({case} AS DECIMAL(18,6)) AS w FROM p),
need AS (SELECT study, w AS need FROM (SELECT study, w, n_pools, row_number() OVER (PARTITION BY study ORDER BY w) AS i FROM w) WHERE i = n_pools // 2 + 1),
v AS (SELECT study, art, sum(w) AS votes FROM (SELECT DISTINCT study, pool, art FROM r) JOIN w USING (study, pool) GROUP BY study, art),
m AS ({_member()}) SELECT m.*, CAST(votes AS DOUBLE) AS votes FROM m JOIN v USING (study, art) JOIN need USING (study) WHERE votes >= need"""


@query(_vote_sql([1.0]))
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.weighted_vote(retrieval(spark, sf_dir), [1.0])


@query(_vote_sql([3.0, 2.0, 1.0]))
def weighted_vote_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.weighted_vote(retrieval(spark, sf_dir), [3.0, 2.0, 1.0])


@query(f"""WITH {_R}, f AS (SELECT study_name AS study, import_id AS pool, CAST(year(imported_at) AS VARCHAR) AS family FROM embase_query3 WHERE imported_at IS NOT NULL),
u AS (SELECT study FROM p GROUP BY study HAVING count(*) = (SELECT count(DISTINCT f.pool) FROM f WHERE f.study = p.study AND f.pool IN (SELECT pool FROM r))),
c AS (SELECT r.study, art, count(DISTINCT family) AS n_families FROM r JOIN f USING (study, pool) WHERE r.study IN (SELECT study FROM u) GROUP BY r.study, art HAVING count(DISTINCT family) >= 2),
m AS ({_member()}) SELECT m.*, n_families FROM m JOIN c USING (study, art)""")
def family_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieval(spark, sf_dir)
    return strategies.family_consensus(r, _families(spark, sf_dir, r), 2)


@query(f"WITH {_R}, {_T}, m AS ({_member('q_ord < 3')}) {_GATED}")
def two_stage_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.two_stage_screen(retrieval(spark, sf_dir), texts(spark, sf_dir), gates(), 3)


@query(f"WITH {_R} {_member('n_pools > 1')}")
def half_split_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.half_split_hybrid(retrieval(spark, sf_dir))


STRATEGIES = {"concept_family_consensus": "family_consensus", "consensus_k2": "consensus_k2", "precision_gated_union": "gated_union", "time_stratified_hybrid": "half_split_hybrid", "two_stage_screen": "two_stage_screen", "weighted_vote": "weighted_vote"}
_RATES = "tp / greatest(retrieved, 1) AS precision, tp / greatest(gold, 1) AS recall, tp / greatest(retrieved + gold - tp, 1) AS jaccard, tp / greatest(least(retrieved, gold), 1) AS overlap"


def _rated(inner: str, keys: str) -> str:
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "jaccard", "overlap"))
    return f"SELECT {keys}, tp, retrieved, gold, {rounded}, round(2 * precision * recall / greatest(precision + recall, 1e-12), 6) AS f1 FROM (SELECT *, {_RATES} FROM ({inner}))"


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "tp", "retrieved", "gold", *[r6(c).alias(c) for c in ("precision", "recall", "jaccard", "overlap", "f1")])


_ALL = " UNION ALL ".join(f"SELECT '{n}' AS strategy, study, art FROM ({SQL[q]})" for n, q in STRATEGIES.items())
_SCORED = f"""SELECT s.strategy, s.study, count(*) AS retrieved, count(gg.art) AS tp, coalesce(any_value(n.gold), 0) AS gold FROM ({_ALL}) s
LEFT JOIN (SELECT DISTINCT study, art FROM g WHERE art IS NOT NULL) gg ON gg.study = s.study AND gg.art = s.art
LEFT JOIN (SELECT study, count(DISTINCT art) AS gold FROM g GROUP BY study) n ON n.study = s.study GROUP BY s.strategy, s.study"""


def all_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies over one narrow table of hits, written once and read by each."""
    scratch = Scratch(spark, "strategies")
    r = scratch.cut(retrieval(spark, sf_dir))
    return pipeline.aggregate(r, scratch.cut(texts(spark, sf_dir)), gates(), _families(spark, sf_dir, r))


def _families(spark: SparkSession, sf_dir: str, r: DataFrame) -> DataFrame:
    f = table(spark, sf_dir, "embase_query3").select(F.col("study_name").alias("study"), F.col("import_id").alias("pool"), F.year("imported_at").cast("string").alias("family"))
    return f.join(r.select("study", "pool").distinct(), ["study", "pool"], "left_semi")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.set_metrics(all_strategies(spark, sf_dir), gold_rows(spark, sf_dir).select("study", "art"), ["strategy", "study"], "art")


@query(f"WITH {_G} {_rated(_SCORED, 'strategy, study')}")
def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores(spark, sf_dir), ["strategy", "study"])


# ---- metrics --------------------------------------------------------------------------------------------------

_SIZE = "(SELECT study, count(DISTINCT art) AS gold FROM g GROUP BY study)"


@query(f"WITH {_R}, {_G} " + _rated(f"SELECT a.study, count(*) AS retrieved, count(gg.art) AS tp, coalesce(any_value(n.gold), 0) AS gold FROM (SELECT DISTINCT study, art FROM r) a LEFT JOIN (SELECT DISTINCT study, art FROM g) gg ON gg.study = a.study AND gg.art = a.art LEFT JOIN {_SIZE} n ON n.study = a.study GROUP BY a.study", "study"))
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.set_metrics(retrieval(spark, sf_dir), gold_rows(spark, sf_dir).select("study", "art"), ["study"], "art"), ["study"])


_MULTI = """SELECT study, by_doi + CASE WHEN gp > gd THEN by_pmid ELSE 0 END AS tp, greatest(rd, rp) AS retrieved, greatest(gp, gd) AS gold FROM (
SELECT a.study, rd, rp, coalesce(gd, 0) AS gd, coalesce(gp, 0) AS gp, (SELECT count(DISTINCT r.doi) FROM r JOIN g ON g.study = r.study AND g.doi = r.doi WHERE r.study = a.study) AS by_doi, (SELECT count(DISTINCT r.pmid) FROM r JOIN g ON g.study = r.study AND g.pmid = r.pmid WHERE r.study = a.study) AS by_pmid
FROM (SELECT study, count(DISTINCT doi) AS rd, count(DISTINCT pmid) AS rp FROM r GROUP BY study) a LEFT JOIN (SELECT study, count(DISTINCT doi) AS gd, count(DISTINCT pmid) AS gp FROM g GROUP BY study) b ON a.study = b.study)"""


@query(f"WITH {_R}, {_G} {_rated(_MULTI, 'study')}")
def metrics_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.multi_key_metrics(retrieval(spark, sf_dir), gold_rows(spark, sf_dir), ["study"]), ["study"])


_LAYER = """l AS (SELECT g.study, gold_id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.study = g.study AND r.doi = g.doi) THEN 'doi' WHEN EXISTS (SELECT 1 FROM r WHERE r.study = g.study AND r.pmid = g.pmid) THEN 'pmid' END AS layer FROM g)"""


@query(f"WITH {_R}, {_G}, {_LAYER} " + _rated("SELECT l.study, count(*) AS gold, count(layer) AS tp, coalesce(any_value(n.retrieved), 0) AS retrieved FROM l LEFT JOIN (SELECT study, greatest(count(DISTINCT doi), count(DISTINCT pmid)) AS retrieved FROM r GROUP BY study) n ON n.study = l.study GROUP BY l.study", "study"))
def metrics_row_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieval(spark, sf_dir)
    return _rounded(metrics.row_level_metrics(r, metrics.row_level_matches(r, gold_rows(spark, sf_dir))), ["study"])


@query(f"""WITH {_R}, {_G}, d AS (SELECT DISTINCT study, CAST(year(imported_at) AS VARCHAR) AS query_num, coalesce(provider, 'unknown') AS database, art FROM r JOIN (SELECT import_id AS pool, imported_at, provider FROM embase_query3) USING (pool)),
b AS (SELECT * FROM d UNION SELECT DISTINCT study, query_num, 'COMBINED', art FROM d)
SELECT b.study, b.query_num, b.database, count(*) AS results_count, count(gg.art) AS tp, coalesce(any_value(n.gold), 0) AS gold, round(count(gg.art) / greatest(coalesce(any_value(n.gold), 0), 1), 6) AS recall, round(count(*) / greatest(count(gg.art), 1), 6) AS nnr
FROM b LEFT JOIN (SELECT DISTINCT study, art FROM g) gg ON gg.study = b.study AND gg.art = b.art LEFT JOIN {_SIZE} n ON n.study = b.study GROUP BY b.study, b.query_num, b.database""")
def per_database_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = table(spark, sf_dir, "embase_query3").select(F.col("import_id").alias("pool"), F.year("imported_at").cast("string").alias("query_num"), F.coalesce("provider", F.lit("unknown")).alias("database"))
    r = retrieval(spark, sf_dir).join(imports, "pool")
    out = metrics.database_scores(r, gold_rows(spark, sf_dir).select("study", "art"), "query_num", "database")
    return out.withColumns({"recall": r6("recall"), "nnr": r6("nnr")})


@query(f"""WITH {_R} SELECT study, count(*) AS raw, count(DISTINCT doi) AS dois, (SELECT count(*) FROM (SELECT pmid FROM r x WHERE x.study = r.study AND pmid IS NOT NULL GROUP BY pmid HAVING count(doi) = 0)) AS pmid_only,
count(DISTINCT doi) + (SELECT count(*) FROM (SELECT pmid FROM r x WHERE x.study = r.study AND pmid IS NOT NULL GROUP BY pmid HAVING count(doi) = 0)) AS unique_articles FROM r GROUP BY study""")
def combined_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.combined_counts(retrieval(spark, sf_dir), ["study"])


@query(f"WITH {_R} SELECT study, pool, pmid, nullif(coalesce(arg_min(doi, ord) FILTER (WHERE doi IS NOT NULL), ''), '') AS doi FROM r WHERE pmid IS NOT NULL GROUP BY study, pool, pmid")
def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.linked_records(retrieval(spark, sf_dir), ["study", "pool"])


@query(f"""WITH {_R}, k AS (SELECT study, pmid, min(doi) AS known FROM r WHERE pmid IS NOT NULL AND doi IS NOT NULL GROUP BY study, pmid),
f AS (SELECT r.study, r.pmid, coalesce(r.doi, known) AS doi FROM r LEFT JOIN k ON k.study = r.study AND k.pmid = r.pmid)
SELECT study, coalesce('doi:' || doi, 'pmid:' || pmid) AS art, min(pmid) AS pmid, min(doi) AS doi FROM f GROUP BY 1, 2""")
def registry_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.registry_fast(retrieval(spark, sf_dir), ["study"])


@query()
def registry_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.registry_exact(retrieval(spark, sf_dir), ["study", "pool"])


@query(f"""WITH {_R}, q AS (SELECT r.*, coalesce(e.provider, 'unknown') || '_' || e.import_id AS pool_key FROM r JOIN embase_query3 e ON e.import_id = r.pool)
SELECT study, pool_key, count(DISTINCT art) AS articles, count(DISTINCT pmid) AS pmids, count(DISTINCT doi) AS dois FROM q GROUP BY study, pool_key""")
def split_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embase_query3").select(F.col("import_id").alias("pool"), F.concat(F.coalesce("provider", F.lit("unknown")), F.lit("_"), "import_id").alias("pool_key"))
    return retrieval(spark, sf_dir).join(e, "pool").groupBy("study", "pool_key").agg(F.count_distinct("art").alias("articles"), F.count_distinct("pmid").alias("pmids"), F.count_distinct("doi").alias("dois"))


@query(f"""WITH {_R}, {_G}, k AS (SELECT study, art, max(a) AS a, max(b) AS b, max(gg) AS g FROM (SELECT study, art, 1 AS a, 0 AS b, 0 AS gg FROM rp WHERE q_ord = 0 UNION ALL SELECT study, art, 0, 1, 0 FROM rp WHERE q_ord = 1 UNION ALL SELECT study, art, 0, 0, 1 FROM g WHERE art IS NOT NULL) GROUP BY study, art),
c AS (SELECT study, count(*) FILTER (WHERE a = 1) AS n_a, count(*) FILTER (WHERE b = 1) AS n_b, count(*) FILTER (WHERE a + b = 2) AS n_both, count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE b = 1 AND a = 0) AS only_b, count(*) FILTER (WHERE a + b > 0) AS n_union,
count(*) FILTER (WHERE a = 1 AND g = 1) AS tp_a, count(*) FILTER (WHERE a = 1 AND g = 0) AS fp_a, count(*) FILTER (WHERE a = 0 AND g = 1) AS fn_a, count(*) FILTER (WHERE b = 1 AND g = 1) AS tp_b, count(*) FILTER (WHERE b = 1 AND g = 0) AS fp_b, count(*) FILTER (WHERE b = 0 AND g = 1) AS fn_b FROM k GROUP BY study)
SELECT *, round(n_both / greatest(n_union, 1), 6) AS jaccard FROM c""")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieval(spark, sf_dir)
    ranked = r.join(strategies.first_pools(r, 2), ["study", "pool"])
    out = strategies.compare_runs(ranked.where("q_ord = 0"), ranked.where("q_ord = 1"), gold_rows(spark, sf_dir).where("art is not null"))
    return out.withColumn("jaccard", r6("jaccard"))


@query(f"""WITH {_R}, {_G}, {_LAYER}, o AS ({_MULTI}), n AS (SELECT study, count(layer) AS tp, count(*) AS gold FROM l GROUP BY study)
SELECT o.study, o.tp AS old_tp, coalesce(n.tp, o.tp) AS new_tp, coalesce(n.tp, o.tp) - o.tp AS delta_tp, round(o.tp / greatest(o.gold, 1), 6) AS old_recall, round(coalesce(n.tp / greatest(n.gold, 1), o.tp / greatest(o.gold, 1)), 6) AS new_recall FROM o LEFT JOIN n ON n.study = o.study""")
def rescore_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g = retrieval(spark, sf_dir), gold_rows(spark, sf_dir)
    old = metrics.multi_key_metrics(r, g, ["study"]).select("study", F.col("tp").alias("old_tp"), F.col("recall").alias("old_recall"))
    new = metrics.row_level_metrics(r, metrics.row_level_matches(r, g)).select("study", F.col("tp").alias("n"), F.col("recall").alias("rec"))
    new_tp = F.coalesce("n", "old_tp")
    return old.join(new, "study", "left").select("study", "old_tp", new_tp.alias("new_tp"), (new_tp - F.col("old_tp")).alias("delta_tp"), r6("old_recall").alias("old_recall"), r6(F.coalesce("rec", "old_recall")).alias("new_recall"))


# ---- query texts ----------------------------------------------------------------------------------------------

_QN = "length({0}) - length(replace({0}, '{1}', ''))"
_Q = "study_name, provider, query_num"
_LINT = f"""(CASE WHEN {_QN.format('text', '(')} <> {_QN.format('text', ')')} THEN 1 ELSE 0 END + CASE WHEN ({_QN.format('text', '"')}) % 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN contains(text, '()') THEN 1 ELSE 0 END
+ CASE WHEN contains(text, 'OR OR') OR contains(text, 'AND AND') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '\\b(NEAR|ADJ|adj|near)\\b') THEN 1 ELSE 0 END)"""
_DEPTH = "list_max(list_prepend(0, list_transform(range(1, len(m) + 1), lambda k: pre[k] - least(0, list_min(pre[1:k])))))"


@query(f"""WITH q AS (SELECT *, regexp_extract_all(text, '[()]') AS m FROM query_text WHERE text IS NOT NULL),
s AS (SELECT *, list_transform(range(1, len(m) + 1), lambda k: len(list_filter(m[1:k], lambda c: c = '(')) - len(list_filter(m[1:k], lambda c: c = ')'))) AS pre FROM q)
SELECT {_Q}, {_LINT} AS issues, CAST(length(text) AS INTEGER) AS chars, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS INTEGER) AS words, CAST({_DEPTH} AS INTEGER) AS depth, CAST((length(text) - length(replace(text, ' AND ', ''))) / 5 AS INTEGER) + 1 AS blocks, sha256(text) AS query_id FROM s""")
def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    q = table(spark, sf_dir, "query_text").where("text is not null")
    return q.select("study_name", "provider", "query_num", query_text.lint(t).alias("issues"), F.length(t).alias("chars"), query_text.tokens(t).alias("words"), query_text.max_depth(t).alias("depth"), query_text.blocks(t).alias("blocks"), query_text.query_id(t).alias("query_id"))


def _scored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # invented results: as many hits as the text has characters, so burden and selection are checked on whole tables
    q = table(spark, sf_dir, "query_text").where("text is not null").select("study_name", "provider", "query_num", "text")
    covered = query_text.concept_coverage(q, ["study_name", "provider", "query_num", "text"], "text", _concepts(spark, sf_dir))
    t = F.col("text")
    burden_ = query_text.burden(F.length(t), 50, 500)
    simple = query_text.simplicity_penalty(F.length(t), query_text.tokens(t), query_text.max_depth(t), 300, 40, 1)
    out = covered.select("study_name", "provider", "query_num", F.length(t).alias("results"), r6("coverage").alias("coverage"), r6(burden_).alias("burden"), r6(simple).alias("simplicity"), query_text.lint(t).alias("issues"))
    return out.withColumn("score", r6(query_text.selector_score(F.col("coverage"), F.col("burden"), F.col("issues"), F.lit(0.0), F.col("simplicity"))))


def _concepts(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """concept -> patterns of the configuration table; patterns that the JVM cannot compile are left out."""
    out: dict[str, list[str]] = {}
    for r in table(spark, sf_dir, "concept_terms").collect():
        if r.concept is not None and readers.java_pattern(spark, r.term_regex):
            out.setdefault(r.concept, []).append(r.term_regex)
    return out


# a pattern that cannot be compiled gives null under TRY and is no pattern
_COV = """v AS (SELECT concept, term_regex FROM concept_terms WHERE TRY(regexp_matches('', '(?i)' || term_regex)) IS NOT NULL), n AS (SELECT count(DISTINCT concept) AS n FROM v),
q AS (SELECT row_number() OVER () AS i, * FROM query_text WHERE text IS NOT NULL), h AS (SELECT q.i, count(DISTINCT v.concept) AS hits FROM q JOIN v ON TRY(regexp_matches(q.text, '(?i)' || v.term_regex)) GROUP BY q.i),
c AS (SELECT q.*, round(coalesce(hits, 0) / greatest((SELECT n FROM n), 1), 6) AS coverage FROM q LEFT JOIN h USING (i))"""
_SIMPLE = "greatest(length(text) - 300, 0) / 300 + 0.5 * greatest(words - 40, 0) / 40 + 0.5 * greatest(depth - 1, 0)"
_BURDEN = "CASE WHEN length(text) < 50 THEN -1.0 ELSE greatest(-1.0, 1 - abs(length(text) - 500) / 500) END"


@query(f"WITH {_COV} SELECT {_Q}, coverage FROM c")
def concept_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "query_text").where("text is not null")
    return query_text.concept_coverage(q, ["study_name", "provider", "query_num"], "text", _concepts(spark, sf_dir)).withColumn("coverage", r6("coverage"))


_SELECT = f"""WITH {_COV}, d AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS words, list_transform(range(1, len(regexp_extract_all(text, '[()]')) + 1), lambda k: len(list_filter(regexp_extract_all(text, '[()]')[1:k], lambda c: c = '(')) - len(list_filter(regexp_extract_all(text, '[()]')[1:k], lambda c: c = ')'))) AS pre, regexp_extract_all(text, '[()]') AS m FROM c),
e AS (SELECT *, {_DEPTH} AS depth FROM d), f AS (SELECT {_Q}, CAST(length(text) AS INTEGER) AS results, coverage, round(CAST({_BURDEN} AS DOUBLE), 6) AS burden, round(CAST({_SIMPLE} AS DOUBLE), 6) AS simplicity, {_LINT} AS issues FROM e)
SELECT *, round(2.0 * coverage + burden - 0.5 * issues - simplicity, 6) AS score FROM f"""


@query(_SELECT)
def selector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_queries(spark, sf_dir)


@query(f"SELECT study_name, provider, query_num, score, coverage, results FROM (SELECT *, row_number() OVER (PARTITION BY study_name ORDER BY score DESC, coverage DESC, results, query_num, provider) AS rn FROM ({_SELECT})) WHERE rn = 1")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = [F.col("score").desc(), F.col("coverage").desc(), "results", "query_num", "provider"]
    return identity.first_by_priority(_scored_queries(spark, sf_dir), ["study_name"], rank).select("study_name", "provider", "query_num", "score", "coverage", "results")


@query(f"""SELECT {_Q}, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?i)"([^"]+)"\\[(?:mh|MeSH Terms)(?::noexp)?\\]', 1), regexp_extract_all(text, '(?i)"([^"]+)"\\[majr\\]', 1)))), '|') AS headings FROM query_text WHERE text IS NOT NULL""")
def mesh_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "query_text").where("text is not null").select("study_name", "provider", "query_num", F.array_join(query_text.mesh_headings(F.col("text")), "|").alias("headings"))


@query(f"""SELECT {_Q}, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)pubyear|\\[(?:edat|dp|date - publication)\\]|\\bPY=') THEN 'date_filter' END, CASE WHEN regexp_matches(text, '(?i)\\[(?:tiab|ti|tw)\\]|:ti|TITLE-ABS') THEN 'field_tags' END, CASE WHEN regexp_matches(text, '\\bNOT\\b') THEN 'negation' END,
CASE WHEN regexp_matches(text, '(?i)\\b(?:NEAR|ADJ|W)/?\\d') THEN 'proximity' END, CASE WHEN regexp_matches(text, '(?i)\\[(?:mh|mesh|mesh terms|majr)') THEN 'subject_headings' END, CASE WHEN contains(text, '*') THEN 'truncation' END], lambda x: x IS NOT NULL), ',') AS features,
CASE WHEN provider = 'scopus' AND NOT contains(lower(text), 'pubyear') THEN '(' || text || ') AND PUBYEAR > 1999 AND PUBYEAR < 2021' ELSE text END AS dated FROM query_text WHERE text IS NOT NULL""")
def query_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    dated = F.when(F.col("provider") == "scopus", query_text.year_filter(t, "scopus", 2000, 2020)).otherwise(t)
    return table(spark, sf_dir, "query_text").where("text is not null").select("study_name", "provider", "query_num", F.array_join(query_text.features(t), ",").alias("features"), dated.alias("dated"))


_TYPE = """WITH c AS (SELECT *, trim(regexp_replace(comment, '^#+', '')) AS c FROM query_text), k AS (SELECT *, trim(regexp_extract(c, '(?i)^Query\\s+\\d+\\s*:\\s*(.+?)(?:\\s+-\\s+.*|\\s*)$', 1)) AS a, trim(regexp_extract(c, '(?i)^Query\\s+\\d+\\s*-\\s*(.+?)(?:\\s*:\\s+.*|\\s*)$', 1)) AS b, trim(regexp_extract(c, '^(.+?)(?:\\s*[-:]\\s+.*|\\s*)$', 1)) AS p FROM c)"""


@query(_TYPE + f" SELECT {_Q}, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN lower(p) NOT IN ('note', 'notes', 'important', 'warning', 'example', 'examples', '') THEN p END AS query_type FROM k")
def query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "query_text").select("study_name", "provider", "query_num", query_text.query_type(F.col("comment")).alias("query_type"))


@query(f"""WITH {_R}, q AS (SELECT study_name, text FROM query_text WHERE query_num = 3 AND provider = 'embase' AND text IS NOT NULL), n AS (SELECT study_name, count(DISTINCT entry_key) AS entries FROM embase_query3 GROUP BY study_name),
x AS (SELECT DISTINCT study_name, entry_key FROM embase_query3)
SELECT q.study_name, CASE WHEN x.entry_key IS NOT NULL THEN 'exact' WHEN n.entries = 1 THEN 'single' ELSE 'none' END AS found FROM q LEFT JOIN n ON n.study_name = q.study_name LEFT JOIN x ON x.study_name = q.study_name AND x.entry_key = sha256(q.text)""")
def local_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the local provider finds a query's results: by its hash, by being the only entry, or not at all."""
    e = table(spark, sf_dir, "embase_query3")
    q = table(spark, sf_dir, "query_text").where("query_num = 3 and provider = 'embase' and text is not null").select("study_name", query_text.query_id(F.col("text")).alias("entry_key"))
    n = e.groupBy("study_name").agg(F.count_distinct("entry_key").alias("entries"))
    x = e.select("study_name", "entry_key").distinct().withColumn("hit", F.lit(1))
    found = F.when(F.col("hit").isNotNull(), "exact").when(F.col("entries") == 1, "single").otherwise("none")
    return q.join(n, "study_name", "left").join(x, ["study_name", "entry_key"], "left").select("study_name", found.alias("found"))


# ---- statistics -----------------------------------------------------------------------------------------------

_S = f"s AS ({SQL['strategy_scores']})"
_SPREAD = ", ".join(f"round(avg({m}), 9) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std, round(CAST(min({m}) AS DOUBLE), 6) AS {m}_min, round(CAST(max({m}) AS DOUBLE), 6) AS {m}_max" for m in ("recall", "precision", "f1", "retrieved"))
_STAT = f"SELECT strategy, count(*) AS n_studies, count(*) FILTER (WHERE recall >= 0.999) AS n_perfect, {_SPREAD} FROM s GROUP BY strategy"


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.strategy_statistics(strategy_scores(spark, sf_dir))
    # means of values with 6 digits are rounded to 9, where no tie of decimals is in the way
    digits = lambda c: 9 if c.endswith("_mean") else 6
    return out.select("strategy", "n_studies", "n_perfect", *[F.round(F.col(c).cast("double"), digits(c)).alias(c) for c in out.columns[3:]])


@query(f"WITH {_S} {_STAT}")
def strategy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir)


_RANKS = ", ".join(f"CAST(row_number() OVER (ORDER BY {m}_mean {o}, strategy) AS INTEGER) AS rank_{m}" for m, o in (("recall", "DESC"), ("precision", "DESC"), ("f1", "DESC"), ("retrieved", "ASC")))


@query(f"WITH {_S}, a AS ({_STAT}) SELECT strategy, {_RANKS} FROM a")
def strategy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_strategies(_statistics(spark, sf_dir))


@query(f"WITH {_S}, a AS ({_STAT}) SELECT strategy, n_studies, n_perfect, recall_mean, f1_mean, retrieved_mean FROM a ORDER BY CASE WHEN n_perfect = n_studies THEN 0 ELSE 1 END, CASE WHEN n_perfect = n_studies THEN retrieved_mean ELSE -f1_mean END LIMIT 1")
def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.best_strategy(_statistics(spark, sf_dir))


@query(f"WITH {_S} SELECT strategy, " + ", ".join(f"round(100 * avg({m}), 7) AS {m}_pct, round(stddev_pop(100 * {m}), 6) AS {m}_std_pct" for m in ("recall", "precision", "f1")) + " FROM s GROUP BY strategy")
def bar_stats_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strategy_scores(spark, sf_dir)
    return s.groupBy("strategy").agg(*[x for m in ("recall", "precision", "f1") for x in (F.round(100 * F.avg(m), 7).alias(f"{m}_pct"), F.round(F.stddev_pop(100 * F.col(m)), 6).alias(f"{m}_std_pct"))])


@query(f"WITH {_S} SELECT study, " + ", ".join(f"max(recall) FILTER (WHERE strategy = '{n}') AS {n}" for n in STRATEGIES) + " FROM s GROUP BY study")
def recall_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.matrix(strategy_scores(spark, sf_dir), "study", "strategy", list(STRATEGIES), "recall")


@query(f"WITH {_S} SELECT strategy, round(quantile_cont(100 * precision, 0.95), 6) AS cap, round(quantile_cont(100 * precision, 0.25), 6) AS q1, round(quantile_cont(100 * precision, 0.5), 6) AS median, round(quantile_cont(100 * precision, 0.75), 6) AS q3 FROM s GROUP BY strategy")
def precision_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: r6(F.percentile(100 * F.col("precision"), F.lit(p)))
    return strategy_scores(spark, sf_dir).groupBy("strategy").agg(q(0.95).alias("cap"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


@query("""SELECT coalesce(s.domain, 'unknown') AS domain, count(*) AS n_studies, count(*) FILTER (WHERE has_embase) AS with_embase, round(avg(gold), 6) AS gold_mean, min(gold) AS gold_min, max(gold) AS gold_max, CAST(sum(gold) AS BIGINT) AS gold_total
FROM study s LEFT JOIN (SELECT study_name, count(*) AS gold FROM gold_list GROUP BY study_name) g ON g.study_name = s.study_name GROUP BY 1""")
def study_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gold_list").groupBy("study_name").agg(F.count(F.lit(1)).alias("gold"))
    s = table(spark, sf_dir, "study").join(g, "study_name", "left")
    return s.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("n_studies"), F.count_if("has_embase").alias("with_embase"), r6(F.avg("gold")).alias("gold_mean"), F.min("gold").alias("gold_min"), F.max("gold").alias("gold_max"), F.sum("gold").alias("gold_total"))


_PDS = f"pd AS ({SQL['per_database_scores']})"


@query(f"""WITH {_PDS} SELECT query_num, study AS query_type, CAST(sum(results_count) AS BIGINT) AS results, max(tp) AS best_tp, max(recall) AS best_recall, round(avg(recall), 9) AS mean_recall, max(gold) AS gold, array_to_string(list_sort(list_distinct(list(database))), ',') AS databases,
CAST(sum(results_count) FILTER (WHERE database = 'embase') AS BIGINT) AS results_embase, CAST(sum(results_count) FILTER (WHERE database = 'COMBINED') AS BIGINT) AS "results_COMBINED" FROM pd GROUP BY query_num, study""")
def query_type_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = per_database_scores(spark, sf_dir).withColumnRenamed("study", "query_type")
    return stats.type_summary(s, ["embase", "COMBINED"]).withColumn("mean_recall", F.round("mean_recall", 9))


@query("""SELECT i.study_name, count(DISTINCT i.ref_id) AS listed, any_value(e.retrieved) AS retrieved, round(any_value(e.retrieved) / count(DISTINCT i.ref_id), 6) AS ratio FROM included_studies i
LEFT JOIN (SELECT study_name, CAST(sum(len(retrieved_dois)) AS BIGINT) AS retrieved FROM embase_query3 GROUP BY study_name) e ON e.study_name = i.study_name GROUP BY i.study_name""")
def retrieval_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embase_query3").groupBy("study_name").agg(F.sum(F.when(F.col("retrieved_dois").isNotNull(), F.size("retrieved_dois"))).alias("retrieved"))
    i = table(spark, sf_dir, "included_studies").groupBy("study_name").agg(F.count_distinct("ref_id").alias("listed"))
    return i.join(e, "study_name", "left").select("study_name", "listed", "retrieved", r6(F.col("retrieved") / F.col("listed")).alias("ratio"))


# ---- normalisers and lookups ----------------------------------------------------------------------------------


@query(r"SELECT ref_id, trim(lower(regexp_replace(coalesce(title, ''), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) AS title FROM included_studies")
def title_norm_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "included_studies").select("ref_id", similarity.title_native(F.col("title")).alias("title"))


@query()
def title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "included_studies").select("ref_id", similarity.title_batch(F.col("title")).alias("title"), similarity.author_batch(F.col("first_author")).alias("author"))


@query(r"""WITH p AS (SELECT cand_id, first_author, list_filter(regexp_split_to_array(trim(first_author), '\s+'), lambda t: t <> '') AS w FROM lookup_candidates)
SELECT cand_id, CASE WHEN len(w) = 0 THEN first_author WHEN length(w[len(w)]) = 1 THEN w[greatest(len(w) - 1, 1)] ELSE w[1] END AS last_name FROM p""")
def author_lastname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lookup_candidates").select("cand_id", similarity.last_name(F.col("first_author")).alias("last_name"))


@query(r"""SELECT gold_id, CASE WHEN regexp_matches(y, '^(1[0-9]{3}|20[0-9]{2}|2100)$') THEN CAST(y AS INTEGER) END AS year FROM (SELECT gold_id, regexp_extract(year, '\b(\d{4})\b', 1) AS y FROM gold_list)""")
def extract_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gold_list").select("gold_id", similarity.year_of(F.col("year")).alias("year"))


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows that no identifier matched, against the metadata of their study's hits."""
    r, g = retrieval(spark, sf_dir), gold_rows(spark, sf_dir)
    missed = metrics.row_level_matches(r, g).where("layer is null")
    meta = table(spark, sf_dir, "embase_query3").select(F.col("study_name").alias("study"), F.explode("records").alias("r")).select("study", F.col("r.record_id").alias("ord"), "r.title", "r.first_author", "r.year")
    left = fuzzy.described(missed, ["study", "gold_id"], "title", "first_author", "year")
    right = fuzzy.described(meta, ["study", "ord"], "title", "first_author", "year")
    return fuzzy.exhaustive_fuzzy_matches(left, right).withColumn("score", r6("score"))


@query(f"""WITH c AS (SELECT *, regexp_replace(trim(lower(title)), '\\s+', ' ', 'g') AS k, CASE source WHEN 'pubmed' THEN 1 WHEN 'scopus' THEN 2 WHEN 'wos' THEN 3 WHEN 'web_of_science' THEN 4 WHEN 'embase' THEN 5 ELSE 6 END AS prio FROM lookup_candidates WHERE title IS NOT NULL)
SELECT k AS key, cand_id, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prio, cand_id) AS rn FROM c) WHERE rn = 1""")
def metadata_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lookup_candidates").where("title is not null").withColumn("key", F.regexp_replace(F.trim(F.lower("title")), r"\s+", " "))
    prio = F.array_position(F.array(*[F.lit(s) for s in ("pubmed", "scopus", "wos", "web_of_science", "embase")]), F.col("source"))
    return identity.first_by_priority(c, ["key"], [F.when(prio > 0, prio).otherwise(6), "cand_id"]).select("key", "cand_id", "source")


_L = """WITH l AS (SELECT ref_id, lookup_metadata.similarity AS s, CAST(len(authors) AS INTEGER) AS n, coalesce(len(list_filter(authors[1:5], lambda a: contains(lower(a), lower(first_author)))) > 0, false) AND coalesce(length(first_author), 0) > 0 AS a, year IS NOT NULL AS y, extraction_method AS w FROM included_studies WHERE lookup_metadata.similarity IS NOT NULL AND authors IS NOT NULL)"""
_BASE = "CASE WHEN s >= 0.95 AND a AND y THEN 0.95 WHEN s >= 0.90 THEN CASE WHEN a AND y THEN 0.90 ELSE 0.85 END WHEN s >= 0.80 THEN CASE WHEN a THEN 0.80 ELSE 0.70 END WHEN s >= 0.70 THEN 0.60 ELSE s * 0.5 END"


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "included_studies").where("lookup_metadata.similarity is not null and authors is not null")
    return t.select("ref_id", F.col("lookup_metadata.similarity").alias("s"), F.size("authors").alias("n"), confidence.author_listed(F.col("first_author"), F.col("authors")).alias("a"), F.col("year").isNotNull().alias("y"), F.col("extraction_method").alias("w"))


@query(_L + " SELECT ref_id, round((CASE WHEN n = 1 AND s > 0.95 THEN 0.95 WHEN s >= 0.90 THEN CASE WHEN n <= 3 THEN 0.90 ELSE 0.85 END WHEN s >= 0.80 THEN CASE WHEN n <= 3 THEN 0.80 ELSE 0.70 END WHEN s >= 0.70 THEN 0.60 ELSE s * 0.5 END) * CASE WHEN a THEN 1.0 ELSE 0.9 END, 6) AS confidence FROM l")
def lookup_confidence_pubmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir).select("ref_id", r6(confidence.pubmed_confidence(F.col("s"), F.col("n"), F.col("a"))).alias("confidence"))


@query(_L + f" SELECT ref_id, round(({_BASE}) * CASE WHEN n > 5 THEN 0.95 ELSE 1 END, 6) AS confidence FROM l")
def lookup_confidence_crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir).select("ref_id", r6(confidence.crossref_confidence(F.col("s"), F.col("n"), F.col("a"), F.col("y"), F.col("w"))).alias("confidence"))


@query(_L + f" SELECT ref_id, round(({_BASE}) * CASE WHEN n > 10 THEN 0.95 ELSE 1 END, 6) AS confidence FROM l")
def lookup_confidence_europepmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir).select("ref_id", r6(confidence.europepmc_confidence(F.col("s"), F.col("n"), F.col("a"), F.col("y"), F.array(F.col("w")))).alias("confidence"))


_C0 = r"SELECT cand_id, regexp_replace(trim(lower(title)), '\s+', ' ', 'g') AS k, source, strategy_no, rank FROM lookup_candidates WHERE title IS NOT NULL"


@query(rf"""WITH i AS (SELECT ref_id, regexp_replace(trim(lower(title)), '\s+', ' ', 'g') AS k FROM included_studies WHERE title IS NOT NULL), c AS ({_C0}),
x AS (SELECT ref_id, cand_id, strategy_no, rank, min(strategy_no) OVER (PARTITION BY ref_id) AS first_no, CASE WHEN rank <= 1 THEN 0.95 WHEN rank <= 3 THEN 0.9 ELSE 0.7 END AS confidence FROM i JOIN c USING (k))
SELECT ref_id, cand_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY confidence DESC, rank, cand_id) AS rn FROM x WHERE strategy_no = first_no AND confidence >= 0.8) WHERE rn = 1""")
def best_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace(F.trim(F.lower("title")), r"\s+", " ").alias("k")
    i = table(spark, sf_dir, "included_studies").where("title is not null").select("ref_id", key)
    c = table(spark, sf_dir, "lookup_candidates").where("title is not null").select("cand_id", key, "strategy_no", "rank")
    scored = i.join(c, "k").withColumn("confidence", F.when(F.col("rank") <= 1, 0.95).when(F.col("rank") <= 3, 0.9).otherwise(0.7))
    return gold.best_candidate(scored, ["ref_id"], 0.8).select("ref_id", "cand_id", "confidence")


_I = f"i AS (SELECT ref_id, study_name, {_ID.format('pmid')} AS pmid, lower({_ID.format('doi')}) AS doi, lookup_metadata, title, year, first_author, journal, raw_citation FROM included_studies)"
_LK = "(SELECT ref_id, min(pmid) AS pmid, min(doi) AS doi FROM i WHERE lookup_metadata.source = '{0}' GROUP BY ref_id)"


@query(f"""WITH {_I}, s AS (SELECT ref_id, CASE WHEN ref_id % 3 = 0 THEN pmid END AS pmid, CASE WHEN ref_id % 2 = 0 THEN doi END AS doi FROM i), j AS (SELECT s.*, p.pmid AS pp, p.doi AS pd, e.pmid AS ep, e.doi AS ed, c.doi AS cd
FROM s LEFT JOIN {_LK.format('PubMed')} p USING (ref_id) LEFT JOIN {_LK.format('EuropePMC')} e USING (ref_id) LEFT JOIN {_LK.format('CrossRef')} c USING (ref_id))
SELECT ref_id, CASE WHEN pmid IS NOT NULL AND doi IS NOT NULL THEN pmid ELSE coalesce(pp, pmid, ep) END AS pmid, CASE WHEN pmid IS NOT NULL AND doi IS NOT NULL THEN doi ELSE coalesce(pd, doi, ed, cd) END AS doi,
CASE WHEN pmid IS NOT NULL AND doi IS NOT NULL THEN 'kept' WHEN pp IS NOT NULL THEN 'pubmed' WHEN ep IS NOT NULL OR ed IS NOT NULL THEN 'europepmc' WHEN cd IS NOT NULL THEN 'crossref' END AS method FROM j""")
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers partly blanked (by ref_id) and filled again from the recorded answers of each service."""
    i = included(spark, sf_dir)
    s = i.select("ref_id", F.when(F.col("ref_id") % 3 == 0, F.col("pmid")).alias("pmid"), F.when(F.col("ref_id") % 2 == 0, F.col("doi")).alias("doi"))
    answers = lambda name: i.where(F.col("lookup_metadata.source") == name).groupBy("ref_id").agg(F.min("pmid").alias("pmid"), F.min("doi").alias("doi"))
    return gold.cascade(s, answers("PubMed"), answers("EuropePMC"), answers("CrossRef"), "ref_id")


@query(f"WITH {_I} SELECT ref_id, study_name, pmid, doi FROM i WHERE lookup_metadata.confidence IS NULL OR lookup_metadata.confidence >= 0.85")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return included(spark, sf_dir).where(gold.confident(F.col("lookup_metadata.confidence"))).select("ref_id", "study_name", "pmid", "doi")


@query(f"WITH {_I}, k AS (SELECT *, coalesce('pmid:' || pmid, 'doi:' || doi, 'title:' || title) AS k FROM i), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ref_id) AS rn FROM k WHERE k IS NOT NULL) SELECT ref_id, pmid, doi FROM n WHERE rn = 1 UNION ALL SELECT ref_id, pmid, doi FROM k WHERE k IS NULL")
def gold_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.deduplicate(included(spark, sf_dir).select("ref_id", "pmid", "doi", "title"), ["pmid", "doi", "title"], ["ref_id"]).select("ref_id", "pmid", "doi")


@query(f"WITH {_I} SELECT study_name, pmid, count(*) AS n, min(ref_id) AS first_ref FROM i WHERE pmid IS NOT NULL GROUP BY study_name, pmid HAVING count(*) > 1")
def duplicate_pmids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return included(spark, sf_dir).where("pmid is not null").groupBy("study_name", "pmid").agg(F.count(F.lit(1)).alias("n"), F.min("ref_id").alias("first_ref")).where("n > 1")


@query(f"""WITH {_I} SELECT study_name, count(*) AS total, count(*) FILTER (WHERE doi IS NOT NULL AND pmid IS NOT NULL) AS both, count(*) FILTER (WHERE doi IS NOT NULL AND pmid IS NULL) AS doi_only, count(*) FILTER (WHERE doi IS NULL AND pmid IS NOT NULL) AS pmid_only, count(*) FILTER (WHERE doi IS NULL AND pmid IS NULL) AS neither,
round(100 * count(*) FILTER (WHERE doi IS NOT NULL OR pmid IS NOT NULL) / count(*), 1) AS any_pct, round(100 * count(doi) / count(*), 1) AS doi_pct, round(100 * count(pmid) / count(*), 1) AS pmid_pct FROM i GROUP BY study_name""")
def identifier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.coverage(included(spark, sf_dir), ["study_name"])


@query(f"""WITH {_I} SELECT study_name, count(*) AS total, count(*) FILTER (WHERE regexp_matches(lower(journal), 'sleep|resp|clin|med')) AS biomedical, round(avg(lookup_metadata.confidence), 6) AS mean_confidence, round(min(lookup_metadata.confidence), 6) AS min_confidence, round(max(lookup_metadata.confidence), 6) AS max_confidence, min(year) AS first_year, max(year) AS last_year,
count(*) FILTER (WHERE title IS NULL OR length(title) < 5) AS bad_titles, count(*) FILTER (WHERE year IS NULL OR year < 1900 OR year > 2030) AS bad_years, count(*) FILTER (WHERE first_author IS NULL OR length(first_author) < 2) AS bad_authors FROM i GROUP BY study_name""")
def reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("lookup_metadata.confidence")
    bad = lambda col, cond: F.count_if(F.col(col).isNull() | cond)
    return included(spark, sf_dir).groupBy("study_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.lower("journal").rlike("sleep|resp|clin|med")).alias("biomedical"), r6(F.avg(c)).alias("mean_confidence"), r6(F.min(c)).alias("min_confidence"), r6(F.max(c)).alias("max_confidence"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), bad("title", F.length("title") < 5).alias("bad_titles"), bad("year", (F.col("year") < 1900) | (F.col("year") > 2030)).alias("bad_years"), bad("first_author", F.length("first_author") < 2).alias("bad_authors"))


_CL = f"cl AS (SELECT DISTINCT x.study_name, x.k, x.source, x.pmid FROM (SELECT study_name, lower(trim(title)) AS k, coalesce(lookup_metadata.source, 'none') AS source, {_ID.format('pmid')} AS pmid FROM included_studies WHERE title IS NOT NULL) x)"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "included_studies").where("title is not null")
    return t.select("study_name", F.lower(F.trim("title")).alias("k"), F.coalesce("lookup_metadata.source", F.lit("none")).alias("source"), _id("pmid").alias("pmid")).distinct()


@query(f"""WITH {_CL}, c AS (SELECT study_name, k, pmid, count(*) AS n FROM cl WHERE pmid IS NOT NULL GROUP BY ALL), a AS (SELECT study_name, k, count(*) AS distinct_pmids, max(n) AS top, CAST(sum(n) AS BIGINT) AS given FROM c GROUP BY study_name, k)
SELECT b.study_name, b.k, coalesce(distinct_pmids, 0) AS distinct_pmids, coalesce(top, 0) AS top, coalesce(given, 0) AS given, CASE WHEN coalesce(given, 0) = 0 THEN 'missing' WHEN distinct_pmids = 1 THEN 'full' WHEN top > 1 THEN 'partial' ELSE 'all_different' END AS bucket FROM (SELECT DISTINCT study_name, k FROM cl) b LEFT JOIN a ON a.study_name = b.study_name AND a.k = b.k""")
def pmid_consensus_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.claim_buckets(_claims(spark, sf_dir), ["study_name", "k"])


@query(f"""WITH {_CL}, q AS (SELECT *, CASE source WHEN 'PubMed' THEN 1 WHEN 'CrossRef' THEN 2 ELSE 1000000 END AS prio FROM cl WHERE pmid IS NOT NULL), c AS (SELECT study_name, k, pmid, count(*) AS n, min(lpad(CAST(prio AS VARCHAR), 8, '0') || source) AS lead, min(prio) AS prio FROM q GROUP BY study_name, k, pmid),
d AS (SELECT *, max(n) OVER w AS top, count(*) OVER w AS kinds FROM c WINDOW w AS (PARTITION BY study_name, k)), e AS (SELECT *, sum(CASE WHEN n = top THEN 1 ELSE 0 END) OVER (PARTITION BY study_name, k) AS at_top FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY study_name, k ORDER BY CASE WHEN at_top = 1 AND top > 1 AND n = top THEN 0 ELSE 1 END, lead, pmid) AS rn FROM e)
SELECT study_name, k, pmid, CASE WHEN kinds = 1 THEN 'unanimous' WHEN at_top = 1 AND top > 1 THEN 'majority' WHEN prio < 1000000 THEN 'priority' ELSE 'first' END AS reason FROM f WHERE rn = 1""")
def pmid_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.consensus_pmid(_claims(spark, sf_dir), ["study_name", "k"], ["PubMed", "CrossRef"])


@query(f"""WITH {_CL}, tr AS (SELECT study_name, lower(trim(title)) AS k, min({_ID.format('pmid')}) AS true_pmid FROM gold_list WHERE {_ID.format('pmid')} IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2)
SELECT source, count(*) FILTER (WHERE pmid = true_pmid) AS correct, count(*) FILTER (WHERE pmid <> true_pmid) AS incorrect, count(*) FILTER (WHERE pmid IS NULL) AS missing, round(100 * count(*) FILTER (WHERE pmid = true_pmid) / greatest(count(*) FILTER (WHERE pmid IS NOT NULL), 1), 1) AS accuracy_pct FROM cl JOIN tr USING (study_name, k) GROUP BY source""")
def source_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gold_list").select("study_name", F.lower(F.trim("title")).alias("k"), _id("pmid").alias("pmid")).where("pmid is not null and k is not null")
    return gold.source_accuracy(_claims(spark, sf_dir), g.groupBy("study_name", "k").agg(F.min("pmid").alias("pmid")), ["study_name", "k"])


@query("""WITH n AS (SELECT count(DISTINCT extraction_method) AS runs FROM included_studies), v AS (SELECT study_name AS study, lower(trim(title)) AS cluster, count(DISTINCT coalesce(extraction_method, 'none')) AS votes FROM included_studies WHERE title IS NOT NULL GROUP BY 1, 2)
SELECT study, cluster, votes, round(votes / 3, 6) AS share FROM v WHERE votes / 3 >= 0.5""")
def vote_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "included_studies").where("title is not null").select(F.col("study_name").alias("study"), F.lower(F.trim("title")).alias("cluster"), F.coalesce("extraction_method", F.lit("none")).alias("run"))
    return gold.votes(c, 3, 0.5).withColumn("share", r6("share"))


@query(r"""SELECT gold_id, CASE WHEN regexp_matches(trim(pmid), '^\d{7,9}$') THEN trim(pmid) END AS pmid, CASE WHEN regexp_matches(trim(doi), '^10\.\d{4,}/\S+$') THEN lower(trim(doi)) END AS doi FROM gold_list WHERE regexp_matches(trim(pmid), '^\d{7,9}$') OR regexp_matches(trim(doi), '^10\.\d{4,}/\S+$')""")
def gold_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = F.trim("pmid"), F.trim("doi")
    okp, okd = F.coalesce(p.rlike(r"^\d{7,9}$"), F.lit(False)), F.coalesce(d.rlike(r"^10\.\d{4,}/\S+$"), F.lit(False))
    return table(spark, sf_dir, "gold_list").where(okp | okd).select("gold_id", F.when(okp, p).alias("pmid"), F.when(okd, F.lower(d)).alias("doi"))


@query(r"""SELECT ref_id, nullif(regexp_extract(raw_citation, '(?i)PMID:?\s*(\d+)', 1), '') AS pmid, coalesce(CAST(nullif(regexp_extract(raw_citation, '\b(19\d{2}|20[012]\d)\b', 1), '') AS INTEGER), 2000) AS year, nullif(regexp_extract(raw_citation, '\d{4};(\d+)(?:\((\d+)\))?:(\d+[\s-]+\d+|[\de\s]+)', 1), '') AS volume FROM included_studies WHERE raw_citation IS NOT NULL""")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = citations.citation_fields(F.col("raw_citation"))
    return table(spark, sf_dir, "included_studies").where("raw_citation is not null").select("ref_id", f["pmid"].alias("pmid"), f["year"].alias("year"), f["volume"].alias("volume"))


@query("""SELECT study_name, CAST(CAST(replace(mindate, '/', '-') AS DATE) AS VARCHAR) AS first_day, CAST(CAST(replace(maxdate, '/', '-') AS DATE) AS VARCHAR) AS last_day FROM study""")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.to_date(F.replace(F.col(c), F.lit("/"), F.lit("-")), "yyyy-MM-dd").cast("string")
    return table(spark, sf_dir, "study").select("study_name", day("mindate").alias("first_day"), day("maxdate").alias("last_day"))
