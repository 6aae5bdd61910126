import pytest
from pyspark.sql import functions as F

from litlens.plans import pipeline
from litlens.plans.reference import gates, gold_rows, retrieval, texts
from litlens.sources import config, recorded

HITS = [("q", "pubmed", 0, "10.1/a", "1", 2000, "T", "Doe", "J", 3), ("q", "pubmed", 1, None, "2", 2005, "U", "Roe", "J", 3), ("q", "pubmed", 2, None, "3", 2010, None, None, None, 3), ("q", "scopus", 0, "10.1/a", "s1", 2000, None, None, None, 1)]


def test_recorded_search(spark, tmp_path):
    path = str(tmp_path / "hits")
    names = "query_id string, provider string, ord int, doi string, native_id string, year int, title string, first_author string, journal string, total int"
    spark.createDataFrame(HITS, names).withColumn("query_id", F.sha2("query_id", 256)).write.parquet(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(recorded.RecordedSearch)
    read = lambda **o: spark.read.format("recorded_search").options(path=path, **o).load()
    assert {r.native_id for r in read(provider="PubMed", query="q", mindate="2001/01/01").collect()} == {"2", "3"}
    assert {r.native_id for r in read(provider="pubmed", query="q", retmax=1).collect()} == {"1"}
    got = read(query="q").where("year <= 2000").select("native_id", "id_type").collect()
    assert {tuple(r) for r in got} == {("1", "pmid"), ("s1", "scopus_id")} and read(query="other").count() == 0
    with pytest.raises(ValueError):
        recorded.provider_name("nowhere")


def test_fallbacks(spark):
    hits = spark.createDataFrame([("1", None), ("2", None), ("3", "10.1/c")], "pmid string, doi string")
    answers = spark.createDataFrame([("1", "1", "10.1/A"), ("2", "9", "10.1/b")], "pmid string, answered_pmid string, doi string")
    assert {(r.pmid, r.doi) for r in recorded.fill_dois(hits, answers).collect()} == {("1", "10.1/a"), ("2", None), ("3", "10.1/c")}
    known = spark.createDataFrame([("1", "10.1/X")], "pmid string, doi string")
    rows = spark.createDataFrame([("1", None), (None, "10.1/x"), (None, None)], "pmid string, doi string")
    assert sorted(map(str, ((r.pmid, r.doi) for r in recorded.cross_ids(rows, known).collect()))) == ["('1', '10.1/x')", "('1', '10.1/x')", "(None, None)"]
    mesh = spark.createDataFrame([("Sleep", "u1", 1999), ("New", "u2", 2020)], "heading string, uid string, intro_year int")
    q = spark.createDataFrame([(1, ["Sleep", "New", "Bad"]), (2, [])], "k int, h array<string>")
    assert {(r.k, r.invalid, r.late) for r in recorded.heading_years(q, "k", "h", mesh, 2010).collect()} == {(1, 1, 1), (2, 0, 0)}
    m = recorded.medline_texts(spark.createDataFrame([("PMID- 7\nTI  - A long\n      title\nDP  - 2001 Mar\n",)], "t string"), "t").first()
    assert (m.pmid, m.title, m.year, m.abstract) == ("7", "A long title", 2001, None)


def test_config(monkeypatch):
    monkeypatch.setenv("LIMIT", "9")
    assert config.resolve("limit", 0, "LIMIT") == 0 and config.resolve("limit", None, "LIMIT", {"limit": 1}) == "9" and config.resolve("x", None, None, {}, {"x": 2}) == 2
    assert config.databases("wos, PubMed,web_of_science") == ["web_of_science", "pubmed"] and config.parse_bool("Yes") and not config.parse_bool("off")


def test_workflows(spark):
    d = "/root/testdata/sf0.001"
    r, g = retrieval(spark, d), gold_rows(spark, d)
    sets = pipeline.aggregate(r, texts(spark, d), gates())
    assert {x.strategy for x in sets.select("strategy").distinct().collect()} == {"consensus_k2", "precision_gated_union", "weighted_vote", "two_stage_screen", "time_stratified_hybrid"}
    scored = pipeline.score_sets(sets, g)
    out = pipeline.cross_study(scored)
    assert out["best"].count() == 1 and out["ranks"].count() == 5
    meta = spark.read.parquet(f"{d}/embase_query3.parquet").select(F.col("study_name").alias("study"), F.explode("records").alias("r")).select("study", F.col("r.record_id").alias("ord"), "r.title", "r.first_author", "r.year")
    plain, near = pipeline.score(r, g).agg(F.sum("tp")).first()[0], pipeline.score(r, g, meta).agg(F.sum("tp")).first()[0]
    assert near >= plain > 0


def test_switches():
    assert not config.parse_bool("maybe") and not config.parse_bool(None) and config.parse_bool(True)
    assert config.enabled_providers(["wos"], {"pubmed": {"enabled": False}}) == ["web_of_science"]
    with pytest.raises(ValueError):
        config.enabled_providers(["pubmed"], {"pubmed": {"enabled": False}})
