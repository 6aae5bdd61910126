import json

import pytest

from litlens.sources import readers, writers


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_query_files(spark, tmp_path):
    put(tmp_path, "queries.txt", "# Q1: High-recall\nA OR B\nAND C\n\n\n# only a comment\n\n# Query 2: Balanced\nD\n")
    got = readers.query_blocks(spark, str(tmp_path / "queries.txt")).orderBy("query_num").collect()
    assert [(r.query_num, r.comment, r.text) for r in got] == [(1, "# Q1: High-recall", "A OR B AND C"), (2, "# Query 2: Balanced", "D")]
    kept = readers.query_blocks(spark, str(tmp_path / "queries.txt"), keep_comments=True, joiner="\n").orderBy("query_num").collect()
    assert kept[1].text == "# Query 2: Balanced\nD"
    put(tmp_path, "queries_wos.txt", "X\n\nY\n")
    q = readers.provider_queries(spark, str(tmp_path), ["pubmed", "web_of_science"])
    b = {r.query_num: (r.canonical, dict(r.per_provider)) for r in readers.bundles(q).collect()}
    assert b[2] == ("D", {"pubmed": "D", "web_of_science": "Y"})
    put(tmp_path, "queries_scopus.txt", "X\n")
    with pytest.raises(ValueError):
        readers.provider_queries(spark, str(tmp_path), ["pubmed", "scopus"])


def test_gold_lists(spark, tmp_path):
    full = put(tmp_path, "a.csv", "PMID,First Author,year,title,journal,DOI\n0123,Doe,2001,T,J,10.1/AB\nnan,,x,,,\n")
    got = [(r.pmid, r.doi, r.year, r.first_author) for r in readers.gold_list(spark, full).collect()]
    assert got == [("0123", "10.1/ab", 2001, "Doe"), (None, None, None, None)]
    bare = put(tmp_path, "b.csv", "111\n222\n")
    assert [r.pmid for r in readers.gold_list(spark, bare).collect()] == ["111", "222"]
    assert readers.id_sets(readers.gold_list(spark, full)).first()["count"] == 1


def test_lists_and_terms(spark, tmp_path):
    ids = put(tmp_path, "ids.txt", "# c\n12\n\n 7 \n12\n")
    assert {r.id for r in readers.id_lines(spark, ids).collect()} == {"12", "7"} and {r.pmid for r in readers.digit_tokens(spark, ids).collect()} == {"12", "7"}
    good, bad = readers.concept_terms(spark, put(tmp_path, "c.csv", 'concept,term_regex\nsleep,\\bsleep\nx,(a\n'))
    assert good == {"sleep": ["\\bsleep"]} and bad == ["(a"]
    assert [(r.csv, r.query) for r in readers.manifest(spark, put(tmp_path, "m.txt", "# c\na.csv|x OR y|z\n")).collect()] == [("a.csv", "x OR y|z")]


def test_result_documents(spark, tmp_path):
    put(tmp_path, "1.json", json.dumps([{"query": "q", "retrieved_pmids": ["9"], "retrieved_dois": ["10.1/z"], "provider_details": {"pubmed": {"linked_records": [{"pmid": "1", "doi": "10.1/A"}]}, "wos": {"error": "x", "linked_records": [{"pmid": "5"}]}}}, {"query": "r", "retrieved_pmids": ["2", "nan"], "retrieved_dois": ["10.1/b"]}]))
    put(tmp_path, "2.json", json.dumps({"query": "s", "retrieved_pmids": ["3"], "retrieved_dois": []}))
    put(tmp_path, "3.json", json.dumps({"abc": {"query": "t", "provider": "embase", "retrieved_dois": ["10.1/c", "10.1/d"], "retrieved_pmids": ["4", None], "records": [{"pmid": "4", "doi": "10.1/c"}, {"doi": "10.1/D"}]}}))
    got = {(r.path[-6:], r.pmid, r.doi) for r in readers.result_articles(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("1.json", "1", "10.1/a"), ("1.json", "2", "10.1/b"), ("2.json", "3", None), ("3.json", "4", "10.1/c"), ("3.json", None, "10.1/d")}


def test_exports(spark, tmp_path):
    vertical = put(tmp_path, "v.csv", 'TITLE,First\nDOI,10.1/X\nAUTHOR NAMES,"Doe J.","Roe K."\nYEAR,2001\nTITLE,Second\nMEDLINE PMID,77\n')
    head = put(tmp_path, "h.csv", 'Title,DOI,Medline PMID,Author Names,Publication Year,Source\nFirst,10.1/X,,"Doe J., Roe K.",2001 Mar,J Med\n')
    v = readers.export_records(spark, vertical).orderBy("rec").collect()
    assert [(r.title, r.doi, r.pmid, r.first_author, r.year) for r in v] == [("First", "10.1/x", None, "Doe J.", 2001), ("Second", None, "77", None, None)]
    h = readers.export_records(spark, head).first()
    assert (h.title, h.doi, h.first_author, h.year, h.journal) == ("First", "10.1/x", "Doe J.", 2001, "J Med")


def test_scores_and_newest(spark, tmp_path):
    put(tmp_path, "sets.csv", "name,TP,Retrieved,Gold,Precision,Recall,F1\na,3,10,4,0.3,0.75,0.43\n")
    r = readers.set_scores(spark, str(tmp_path / "sets.csv")).first()
    assert (r.FN, r.Jaccard) == (1, 0.0)
    with pytest.raises(ValueError):
        readers.set_scores(spark, put(tmp_path, "bad.csv", "name,TP\na,1\n"))
    assert readers.newest_per(spark, str(tmp_path / "*.csv"), r"\.csv$", "bad").count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("10", None), ("9", "d1"), (None, "d0")], "pmid string, doi string")
    writers.write_articles(df.coalesce(1), str(tmp_path / "a"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "a"), header=True).coalesce(1).collect()] == [("9", "d1"), ("10", None), (None, "d0")]
    writers.write_ids(df, str(tmp_path / "i"))
    assert [r.value for r in spark.read.text(str(tmp_path / "i")).coalesce(1).collect()] == ["9", "10"]
    assert writers.union_of_fields([df, df.drop("doi").withColumnRenamed("pmid", "a")]).columns == ["a", "doi", "pmid"]
    assert "| N/A |" in writers.markdown_table(df)
    entries = spark.createDataFrame([("k", "q", None)], "entry_key string, query string, pmids array<string>")
    writers.write_local_imports(entries, str(tmp_path / "l"))
    assert readers.local_imports(spark, str(tmp_path / "l" / "*.txt")).first().query == "q"


def test_files_of_different_headers_in_one_glob(spark, tmp_path):
    put(tmp_path, "g1.csv", "\ufeff\nDOI,pmid\n10.1/A,5\n")
    put(tmp_path, "g2.csv", "7\n8\n")
    put(tmp_path, "g3.csv", "")
    put(tmp_path, "g4.csv", "PMID,title\n9," + "x" * 200_000 + "\n")
    got = {(r.path[-6:], r.row, r.pmid, r.doi) for r in readers.gold_list(spark, str(tmp_path / "g*.csv")).collect()}
    assert got == {("g1.csv", 1, "5", "10.1/a"), ("g2.csv", 0, "7", None), ("g2.csv", 1, "8", None), ("g4.csv", 1, "9", None)}


def test_patterns_are_those_of_the_jvm(spark):
    assert readers.java_pattern(spark, r"a\p{L}+") and not readers.java_pattern(spark, "(a") and not readers.java_pattern(spark, "(?P<n>a)") and not readers.java_pattern(spark, None)
