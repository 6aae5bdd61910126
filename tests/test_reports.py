import json
import time

import pytest
from pyspark.sql import functions as F

from litlens.functions import query_text
from litlens.operators import gold, reports, strategies
from litlens.sources import summaries


def test_database_summary_leaves_combined_out(spark):
    rows = [("s", "1", "pubmed", 10, 0.5), ("s", "2", "pubmed", 5, 0.75), ("s", "1", "COMBINED", 99, 1.0)]
    got = reports.database_summary(spark.createDataFrame(rows, "study string, query_num string, database string, results_count int, recall double"), ["study"]).collect()
    assert [tuple(r) for r in got] == [("s", "pubmed", 2, 15, 0.75)]


def test_findings(spark):
    rows = [("a", 2, 2, 50.0), ("b", 2, 2, 40.0), ("c", 2, 1, 10.0)]
    f = reports.findings(spark.createDataFrame(rows, "strategy string, n_studies long, n_perfect long, retrieved_mean double"), 3).first()
    assert (f.n_strategies, f.n_perfect, f.perfect, f.best_perfect, f.retrieved_least, f.retrieved_most, f.n_domains) == (3, 2, "a,b", "b", 10.0, 50.0, 3)
    none = reports.findings(spark.createDataFrame([], "strategy string, n_studies long, n_perfect long, retrieved_mean double"), 0).first()
    assert (none.n_strategies, none.n_studies, none.n_perfect, none.perfect, none.best_perfect) == (0, 0, 0, "", None)


def test_two_queries_with_fallback(spark):
    kind = "study string, query_num int, results_count double, tp double, recall double"
    csv = spark.createDataFrame([("B", 1, 200.0, 4.0, 0.5), ("B", 2, None, 1.0, None)], kind)
    doc = spark.createDataFrame([("B", 2, 0.0, 2.0, 0.25), ("a", 1, 1234.0, 2.0, 1.0), ("c", 1, None, None, None), ("B", 3, 9.0, 9.0, 0.9)], kind)
    measured = reports.resolved(csv, doc, ["study", "query_num"])
    got = [tuple(r) for r in reports.first_two_queries(measured, spark.createDataFrame([("a", 100), ("B", None)], "study string, paper_count int")).collect()]
    assert got == [("a", "Q1", 100.0, 2.0 / 1234 * 100, 1234.0, 1234.0, "1.000", "1,234 (1234.0%)"), ("B", "Q1", 50.0, 2.0, 200.0, None, "0.500", "200 (N/A)"), ("B", "Q2", 25.0, None, 0.0, None, "0.250", "0 (N/A)")]


def test_types_and_merge(spark):
    scores = spark.createDataFrame([("s", 1, "pubmed", 5), ("s", 1, "wos", 6), ("s", 1, "COMBINED", 9), ("s", 2, "pubmed", 1)], "study string, query_num int, database string, results int")
    types = spark.createDataFrame([("s", 1, "wos", "broad"), ("s", 1, "pubmed", None)], "study string, query_num int, database string, query_type string")
    typed = reports.typed(scores, types, ["study"])
    assert {(r.query_num, r.database): r.query_type for r in typed.collect()} == {(1, "pubmed"): "Unknown", (1, "wos"): "broad", (1, "COMBINED"): "broad", (2, "pubmed"): "Unknown"}
    out = reports.merged_display(typed.where("database <> 'COMBINED'"), typed.where("database = 'COMBINED'").drop("database"), ["study"])
    assert {(r.query_num, r.database): r.results_merged for r in out.collect()} == {(1, "pubmed"): None, (1, "wos"): 9, (2, "pubmed"): None}


def test_gold_report(spark):
    rows = [("s", "1", "d", 0.9), ("s", None, None, None), ("s", None, "d", 0.86), ("s", "2", None, 0.2), ("t", "1", None, 1.0)]
    df = spark.createDataFrame(rows, "study string, pmid string, doi string, confidence double")
    got = {r.study: (r.total, r.accepted, r.rejected, r.with_neither, r.warnings) for r in reports.gold_report(df, ["study"]).collect()}
    assert got == {"s": (4, 3, 1, 1, "low_pmid,neither,rejections"), "t": (1, 1, 0, 0, "")}
    h = reports.source_histogram(df.withColumn("source", F.when(F.col("doi") == "d", "CrossRef")), ["study"])
    assert {(r.study, r.source): (r.n, round(r.percent, 1)) for r in h.collect()} == {("s", "CrossRef"): (2, 66.7), ("s", "Unknown"): (1, 33.3), ("t", "Unknown"): (1, 100.0)}


def test_run_report(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "art string")
    r = json.loads(reports.run_report(ids("a", "b", "b"), ids("b", "c", "d"), ids("b", "c"), (ids("a"), ids(*"abcdefg"))))
    assert r["counts"] == {"A_total": 2, "B_total": 3, "A∩B": 1, "A−B": 1, "B−A": 2} and r["overlap_coefficient"] == 0.5 and r["jaccard"] == 0.25
    assert r["gold"] == {"A": {"TP": 1, "FP": 1, "FN": 1}, "B": {"TP": 2, "FP": 1, "FN": 0}} and len(r["summary_head_B"]) == 5


def test_markdown_report_has_all_sections(spark):
    scores = spark.createDataFrame([("x", "s", 1.0, 0.1, 0.2, 10), ("y", "s", 0.5, 0.2, 0.3, 5)], "strategy string, study string, recall double, precision double, f1 double, retrieved long")
    text = reports.markdown_report(scores, spark.createDataFrame([("s", None, 4)], "study string, domain string, gold_size int"))
    assert text.count("\n## ") == 8 and "`x`" in text and "unknown" in text


def test_gate_profile_and_journals(spark):
    t = ["Sleep in multiple sclerosis: a randomized trial", "Insomnia and MULTIPLE SCLEROSIS after exercise", "Sleep in multiple sclerosis", "sleep trial", None, ""]
    assert [r.g for r in spark.createDataFrame([(x,) for x in t], "t string").select(strategies.default_gate(F.col("t")).alias("g")).collect()] == [True, True, False, False, False, False]
    q = spark.createDataFrame([('"A"[Mesh] AND b[tiab]', "b[tiab] AND adult AND english[la]"), ("x", "x")], "a string, b string")
    assert [r.d for r in q.select(query_text.profile_delta(query_text.profile(F.col("a")), query_text.profile(F.col("b"))).alias("d")).collect()] == [
        "Q2 adds filter layer, population restriction and drops controlled vocabulary.", "Q2 preserves the same feature profile as Q1 and mainly tightens wording or synonym scope."]
    assert [r.s for r in q.select(query_text.short_query(F.col("a"), 10).alias("s")).collect()] == ['"A"[Mes...', "x"]
    assert [r.b for r in spark.createDataFrame([("The Lancet",), ("Sleep",), (None,)], "j string").select(gold.biomedical(F.col("j")).alias("b")).collect()] == [True, False, False]


def test_consistency(spark):
    claims = spark.createDataFrame([("s", "c1", 1), ("s", "c1", 2), ("s", "c1", 2), ("s", "c2", 1)], "study string, cluster string, run int")
    assert [tuple(r) for r in gold.consistency(claims, 3, 0.6).collect()] == [("s", 2, 1, 0.5)]


HEAD = "query,results_count,TP,gold_size,recall,NNR_proxy\n"


def test_benchmark_summaries(spark, tmp_path):
    for n, rows in (("query_02", "q2,20,2,4,0.5,10\n"), ("query_10", "q10,7,1,4,0.25,7\nother,1,1,1,1,1\n")):
        (tmp_path / "S" / n).mkdir(parents=True)
        (tmp_path / "S" / n / "summary_1.csv").write_text(HEAD + "old,1,1,1,1,1\n")
        time.sleep(1.1)
        (tmp_path / "S" / n / "summary_0.csv").write_text(HEAD + rows)
        (tmp_path / "S" / n / "summary_per_database_9.csv").write_text("query_num,database,query,results_count,TP,gold_size,recall,NNR_proxy\n1,pubmed,q,3,1,4,0.25,3\n1,Combined,q,5,2,4,0.5,2.5\n")
    got = [(r.query_num, r.query_text, r.results_count, r.true_positives, r.recall, r.nnr_proxy) for r in summaries.benchmark_queries(spark, f"file://{tmp_path}/S").collect()]
    assert got == [(2, "q2", 20, 2, 0.5, 10.0), (10, "q10", 7, 1, 0.25, 7.0)]
    combined = summaries.combined_rows(spark, f"file://{tmp_path}/*/query_*/summary_per_database_*.csv")
    assert sorted((r.study, r.query_num, r.results_count, r.tp) for r in combined.collect()) == [("S", 2, 5.0, 2.0), ("S", 10, 5.0, 2.0)]
    (tmp_path / "T").mkdir()
    (tmp_path / "T" / "s.csv").write_text("query,database,results_count,TP,recall\nq,pubmed,3,1,0.1\nq,combined,4,2,0.2\n")
    assert [(r.query_text, r.results_count, r.nnr_proxy) for r in summaries.benchmark_queries(spark, f"file://{tmp_path}/T", f"file://{tmp_path}/T/s.csv").collect()] == [("q", 4, 0.0)]
    (tmp_path / "T" / "bad.csv").write_text("query,TP\nq,1\n")
    with pytest.raises(ValueError):
        summaries.benchmark_queries(spark, f"file://{tmp_path}/T", f"file://{tmp_path}/T/bad.csv")


def test_study_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"gold_size": 3}')
    (tmp_path / "a" / "y.json").write_text('{"study_id": "why"}')
    read = lambda: sorted(r.study_id for r in summaries.study_documents(spark, f"file://{tmp_path}/a").collect())
    assert read() == ["why", "x"]
    (tmp_path / "a" / "all_studies.json").write_text('{"k": {"gold_size": 1}, "l": {"study_id": "L"}}')
    assert read() == ["L", "k"]


def test_validation_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿\n\nTitle,PubMed ID,DOI\nOne,PMID: 12,https://doi.org/10.1/x\n,nan,none\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('Authors,title\n"A, B",Two\n')
    got = sorted(((r.title, r.pmid, r.doi, r.authors, r.path[-5:]) for r in summaries.validation_rows(spark, f"file://{tmp_path}/*.csv").collect()), key=str)
    assert got == [("One", "12", "10.1/x", None, "a.csv"), ("Two", None, None, "A, B", "b.csv"), (None, None, None, None, "a.csv")]


def test_recorded_candidates(spark):
    p = spark.createDataFrame([("1", "T", None, None, "2001", [("pubmed", "1"), ("doi", "10.1/x")], [("Roe", "J"), (None, "K"), ("Poe", None)]), ("2", None, "J", "2003", "2001", None, None)], summaries.PUBMED)
    assert [(r.pmid, r.doi, r.title, r.authors, r.journal, r.year) for r in summaries.pubmed_candidates(p).collect()] == [("1", "10.1/x", "T", ["Roe J", "Poe"], "", 2001), ("2", None, "", None, "J", 2003)]
    c = spark.createDataFrame([("10.1/x", ["T", "U"], None, [("Roe", "Jane")], None, ([[2004, 5]],), "journal-article"), (None, None, None, None, None, None, None)], summaries.CROSSREF)
    assert [(r.doi, r.title, r.journal, r.authors, r.year, r.type) for r in summaries.crossref_candidates(c).collect()] == [("10.1/x", "T", "", ["Roe Jane"], 2004, "journal-article")]
    e = spark.createDataFrame([("T", None, None, "PMC9", None, "1999", "Roe J, , Poe K", (["review"],)), (None, None, "3", None, "J", "", None, None)], summaries.EUROPEPMC)
    assert [(r.pmid, r.year, r.authors, r.pub_types) for r in summaries.europepmc_candidates(e).collect()] == [("PMC9", 1999, ["Roe J", "Poe K"], ["review"]), ("3", None, [], [])]


def test_sealed_and_reference_json(spark, tmp_path):
    for n in ("sealed_2.json", "sealed_10.json", "sealed_1.json"):
        (tmp_path / n).write_text("{}")
    last = summaries.latest_sealed(spark, f"file://{tmp_path}/sealed_*.json")
    assert last.endswith("/sealed_2.json") and summaries.final_name(last).endswith("/final_2.json") and summaries.latest_sealed(spark, f"file://{tmp_path}/none_*") is None
    rows = spark.createDataFrame([("T", None, 2001)], "title string, doi string, year int")
    text = summaries.reference_json(rows, ["title", "doi", "year"])
    assert json.loads(text.first().json) == {"title": "T", "doi": None, "year": 2001}
    assert [tuple(r) for r in summaries.reference_rows(spark.createDataFrame([('{"title": "T", "extra": 1}',)], "json string"), "title string, doi string").collect()] == [("T", None)]


def test_study_metadata(spark):
    s = spark.createDataFrame([("a", "d", "2000", None), ("b", None, None, None)], "study string, domain string, mindate string, maxdate string")
    q = spark.createDataFrame([("a", 1, "pubmed"), ("a", 2, "pubmed")], "study string, query_num int, database string")
    g, i = spark.createDataFrame([("a",), ("a",)], "study string"), spark.createDataFrame([("a",), ("b",)], "study string")
    got = {r.study: (r.gold_size, r.num_queries, r.databases) for r in reports.study_metadata(s, q, g, i).collect()}
    assert got == {"a": (2, 2, ["embase", "pubmed"]), "b": (0, 0, ["embase"])}
