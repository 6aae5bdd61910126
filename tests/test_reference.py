"""Every query with an SQL twin against DuckDB on the smallest tables, and single operators against brute force."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litlens.functions import citations, query_text, similarity
from litlens.operators import fuzzy, gold, identity, metrics, strategies
from litlens.plans import catalog, pipeline

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    for c in df.columns:
        df[c] = df[c].map(lambda v: "" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_twin(spark, db, name):
    pd.testing.assert_frame_equal(tidy(catalog.QUERIES[name](spark, DATA).toPandas()), tidy(db.execute(catalog.SQL[name]).df()))


def hits(spark, rows):
    df = spark.createDataFrame(rows, "study string, pool long, ord int, pmid string, doi string")
    return df.withColumn("art", strategies.article_key(F.col("pmid"), F.col("doi")))


def test_strategy_edges(spark):
    one_pool = hits(spark, [("s", 1, 0, "1", None), ("s", 1, 1, None, "D")])
    assert strategies.half_split_hybrid(one_pool).count() == 0 and strategies.union_all(one_pool).count() == 2 and strategies.weighted_vote(one_pool).count() == 2
    two = hits(spark, [("s", 1, 0, None, "d"), ("s", 2, 0, "7", "d"), ("s", 2, 1, "8", None)])
    kept = strategies.consensus(two, 3, 2).collect()
    assert [(r.art, r.pmid) for r in kept] == [("doi:d", None)]  # the first-seen article stays without the PMID
    none = spark.createDataFrame([], "study string, pmid string, title string")
    assert strategies.gated_union(two, none, F.col("title").rlike("x")).count() == 2  # no text at all: no gate
    some = spark.createDataFrame([("s", "8", "nothing")], "study string, pmid string, title string")
    assert {r.art for r in strategies.gated_union(two, some, F.col("title").rlike("x")).collect()} == {"doi:d"}


def test_metric_identities(spark):
    r = hits(spark, [("s", 1, i, str(i), f"d{i}") for i in range(10)])
    same = metrics.set_metrics(r, r.select("study", "art"), ["study"], "art").first()
    assert (same.precision, same.recall, same.f1, same.jaccard) == (1, 1, 1, 1)
    half = metrics.set_metrics(r.where("ord < 5"), r.select("study", "art"), ["study"], "art").first()
    assert (half.precision, half.recall) == (1, 0.5)
    assert metrics.multi_key_metrics(r, r, ["study"]).first().tp == 10
    # gold with more PMIDs than DOIs: an article hit by both counts twice, as published
    g = hits(spark, [("s", 1, 0, "1", "d1"), ("s", 1, 1, "2", None)])
    assert metrics.multi_key_metrics(r, g, ["study"]).first().tp == 3


def test_registry_order(spark):
    apart = hits(spark, [("s", 1, 0, None, "d1"), ("s", 1, 1, "p1", None), ("s", 1, 2, "p1", "d1")])
    assert {(r.pmid, r.doi) for r in identity.registry_exact(apart, ["study"]).collect()} == {("p1", "d1"), ("p1", None)}
    dropped = hits(spark, [("s", 1, 0, "p1", "d1"), ("s", 1, 1, "p2", "d1")])
    assert [(r.pmid, r.doi) for r in identity.registry_exact(dropped, ["study"]).collect()] == [("p1", "d1")]


def test_similarities(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("", "a"), ("abc", "abc"), ("smith", "smyth")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("native"), similarity.ratio_batch("a", "b").alias("batch")).collect()
    for r in rows:
        n, m = len(r.a), len(r.b)
        t = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                t[i + 1][j + 1] = t[i][j] + 1 if r.a[i] == r.b[j] else max(t[i][j + 1], t[i + 1][j])
        want = 100.0 if n + m == 0 else 200 * t[n][m] / (n + m)
        assert r.native == pytest.approx(want) and r.batch == pytest.approx(want)
    assert similarity.normal_title("Caf&eacute;_du  Σ!") == "cafe du σ" and similarity.normal_author("van der Berg, A.") == "vanderberg" and similarity.normal_author("Ann Bërg") == "berg"


def test_years(spark):
    rows = spark.createDataFrame([("2003 Mar",), ("10023",), ("10.1016/x",), ("3000",), ("1999.0",), (None,)], "x string").select(similarity.year_of(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [2003, None, 1016, None, 1999, None]


def test_fuzzy_layer(spark):
    kind = "study string, {0} long, t string, a string, y int"
    g = spark.createDataFrame([("s", 1, "deep sleep study", "smith", 2000), ("s", 2, "", "roe", 1990), ("s", 3, "lone title", "", None)], kind.format("gold_id"))
    m = spark.createDataFrame([("s", 5, "other words here", "smith", 2001), ("s", 6, "deep sleep study", "smyth", 2000), ("s", 7, "x", "roe", 1991), ("t", 8, "lone title", "", 2000)], kind.format("ord"))
    want = {(1, 6, 1.0), (2, 7, 1.0)}  # author and year alone are enough where no title speaks
    assert {(r.gold_id, r.ord, round(r.score, 3)) for r in fuzzy.exhaustive_fuzzy_matches(g, m).collect()} == want
    assert {(r.gold_id, r.ord, round(r.score, 3)) for r in fuzzy.fuzzy_matches(g, m).collect()} == want


def test_query_features(spark):
    q = 'A "x"[mh] AND ((b)) OR OR NEAR c) ()'
    r = spark.createDataFrame([(q,)], "q string").select(query_text.lint(F.col("q")).alias("l"), query_text.max_depth(F.col("q")).alias("d"), query_text.mesh_headings(F.col("q")).alias("m"), query_text.burden(F.lit(10)).alias("low"), query_text.burden(F.lit(5000)).alias("on")).first()
    assert (r.l, r.d, r.m, r.low, r.on) == (4, 2, ["x"], -1.0, 1.0)
    assert query_text.build_query([["a", "b"], ["c"]], "wos") == 'TS=(("a" OR "b") AND ("c"))'


def test_citations(spark):
    text = "## Table 1: Characteristics of included studies\nDoe [2]\n\n## References\n[1] Doe J. First title. J Med 2001;5(2):10-12. doi:10.1000/x. PMID: 77\nmore\n| a |\n2. Roe K. Second. Ann 1999\n"
    rows = citations.review_citations(spark.createDataFrame([("s", text), ("t", None), ("u", "")], "study string, text string"), "study", "text")
    f = citations.citation_fields(F.col("raw_citation"))
    got = rows.orderBy("reference_number").select("reference_number", "included", *[c.alias(n) for n, c in f.items()]).collect()
    assert [(r.reference_number, r.included) for r in got] == [(1, False), (2, True)]
    r = got[0]
    assert (r.doi, r.pmid, r.first_author, r.year, r.title, r.journal, r.volume, r.issue, r.pages) == ("10.1000/x", "77", "Doe J", 2001, "First title", "J Med", "5", "2", "10-12")


def test_consensus_and_votes(spark):
    rows = [("a", "s1", "1"), ("a", "s2", "1"), ("b", "s1", "1"), ("b", "s2", "2"), ("c", "s1", None), ("d", "s1", "5"), ("d", "s2", "5"), ("d", "s3", "6")]
    claims = spark.createDataFrame(rows, "k string, source string, pmid string")
    got = {r.k: (r.pmid, r.reason) for r in gold.consensus_pmid(claims, ["k"], ["s2"]).collect()}
    assert got == {"a": ("1", "unanimous"), "b": ("2", "priority"), "d": ("5", "majority")}
    assert {r.k: r.bucket for r in gold.claim_buckets(claims, ["k"]).collect()} == {"a": "full", "b": "all_different", "c": "missing", "d": "partial"}


def test_greedy_clusters(spark):
    rows = spark.createDataFrame([("s", 1, "alpha"), ("s", 2, "alpha"), ("s", 3, "beta"), ("t", 1, "beta")], "study string, n int, t string")
    got = identity.greedy_clusters(rows, "study", "n", "t", lambda a, b: float(a == b))
    assert {(r.study, r.n): r.cluster for r in got.collect()} == {("s", 1): 0, ("s", 2): 0, ("s", 3): 1, ("t", 1): 0}


def test_runs_vote_over_clusters_whose_representative_gains_identifiers(spark):
    chain = spark.createDataFrame([("s", 1, "aaaa", None), ("s", 2, "aaab", "10.1/x"), ("s", 3, "aabb", None)], "study string, n int, t string, doi string")
    near = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 4
    label = lambda **more: {r.n: r.cluster for r in identity.greedy_clusters(chain, "study", "n", "t", near, 0.75, **more).collect()}
    assert label() == {1: 0, 2: 0, 3: 1} and label(identifiers=("doi",)) == {1: 0, 2: 0, 3: 0}
    rows = [("s", 1, "Sleep and mood in nurses", "Brask", 2001, None, None), ("s", 2, "Pain after surgery", "Kroba", None, None, None), ("s", 3, "Sleep and mood in nurses.", "Brask", 2001, "10.1/x", None), ("s", 4, "Sleep and moods in nurses", "Brask", 2002, None, "7"), ("t", 1, None, None, None, None, None)]
    got = pipeline.vote_runs(spark.createDataFrame(rows, "study string, ord int, title string, first_author string, year int, doi string, pmid string"), 3)
    assert [tuple(r) for r in got.collect()] == [("s", 0, 3, 1.0)]


def test_partitions_do_not_matter(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, catalog.QUERIES["weighted_vote_custom"](spark, DATA).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


def test_gold_checks(spark):
    rows = spark.createDataFrame([("a", "10.1/X", "1", "T"), ("b", "10.1/x", "2", "U"), ("c", None, "3", "V")], "source string, doi string, pmid string, title string")
    assert [(r.doi, r.title, dict(r.pmids)) for r in gold.merge_by_doi(rows).collect()] == [("10.1/x", "T", {"a": "1", "b": "2"})]
    known = spark.createDataFrame([("1", "10.1/x"), ("2", "10.1/y")], "pmid string, doi string")
    claims = gold.verified_claims(rows.withColumn("study", F.when(F.col("source") == "c", "t").otherwise("s")), known)
    assert {r.pmid: r.correct for r in claims.collect()} == {"1": True, "2": False, "3": False}
    assert {(r.study, r.pmid) for r in gold.validated_pmids(claims, "c").collect()} == {("s", "1"), ("t", "3")}
    titles = spark.createDataFrame([("s", "a", 1, "deep sleep", "1"), ("s", "b", 1, "deep sleep.", "2"), ("s", "b", 2, "deep sleep", "3"), ("s", "c", 1, "other", "4")], "study string, source string, ord int, title string, pmid string")
    assert [(r.main, r.source, r.pmid) for r in gold.titles_across_sources(titles, "a", similarity.obershelp_batch).collect()] == [(1, "b", "2")]


def test_titles_across_sources_need_no_common_word(spark):
    rows = [("s", "a", 1, "Polysomnography", None), ("s", "b", 2, "Polysomnografy", "2"), ("s", "b", 3, "Pain", "3"), ("s", "a", 4, "睡眠时间与情绪障碍的关系", None), ("s", "b", 5, "睡眠时间和情绪障碍的关系", "5")]
    titles = spark.createDataFrame(rows, "study string, source string, ord int, title string, pmid string")
    assert {(r.main, r.pmid) for r in gold.titles_across_sources(titles, "a", similarity.obershelp_batch).collect()} == {(1, "2"), (4, "5")}


def test_study_metadata(spark):
    text = 'x AND ("2001/02/03"[Date - Publication] : "2010/12/31"[Date - Publication]) sleep sleep cancer'
    keys = {"oncology": ["cancer", "tumour"], "sleep medicine": ["sleep"]}
    df = spark.createDataFrame([("a", text), ("cancer_2", "sleep"), ("b", "(1999:2003[edat])"), ("c", None)], "n string, t string")
    got = {r.n: (r.d, r.r and tuple(r.r)) for r in df.select("n", query_text.domain(F.col("n"), F.col("t"), keys).alias("d"), query_text.date_range(F.col("t")).alias("r")).collect()}
    assert got == {"a": ("sleep medicine", ("2001-02-03", "2010-12-31")), "cancer_2": ("oncology", None), "b": ("general medicine", ("1999-01-01", "2003-12-31")), "c": ("general medicine", None)}
