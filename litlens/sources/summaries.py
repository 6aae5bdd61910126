"""Readers of benchmark summaries, study documents, run folders and recorded lookup answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlens.functions.identifiers import clean_null
from litlens.sources.readers import flexible_csv

#: Schemas of recorded answers, as the services send them.
PUBMED = "pmid string, title string, journal string, article_year string, issue_year string, ids array<struct<type:string,value:string>>, authors array<struct<LastName:string,Initials:string>>"
CROSSREF = "DOI string, title array<string>, `container-title` array<string>, author array<struct<family:string,given:string>>, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, type string"
EUROPEPMC = "title string, doi string, pmid string, pmcid string, journalTitle string, pubYear string, authorString string, pubTypeList struct<pubType:array<string>>"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=True).withColumns({"path": F.col("_metadata.file_path"), "__time": F.col("_metadata.file_modification_time"), "__at": F.monotonically_increasing_id()})


def _newest(rows: DataFrame, of: list[str]) -> DataFrame:
    """The rows of the newest file (then the last by name) of each group."""
    best = rows.groupBy(*of).agg(F.max(F.struct("__time", "path")).alias("__m"))
    return rows.join(best, of).where(F.col("path") == F.col("__m.path")).drop("__m", "__time")


def query_number(path: Column) -> Column:
    """The number of a ``query_NN`` folder in a path, null without one."""
    n = F.regexp_extract(path, r"/query_0*(\d+)(?:/|$)", 1)
    return F.when(n != "", n.cast("int"))


def query_rows(rows: DataFrame) -> DataFrame:
    """query_num, query_text, results_count, true_positives, recall, nnr_proxy of summary rows; NNR 0 where missing."""
    nnr = F.coalesce(F.col("NNR_proxy").cast("double"), F.lit(0.0)) if "NNR_proxy" in rows.columns else F.lit(0.0)
    return rows.select("query_num", F.col("query").alias("query_text"), F.col("results_count").cast("int").alias("results_count"), F.col("TP").cast("int").alias("true_positives"), F.col("recall").cast("double").alias("recall"), nnr.alias("nnr_proxy"))


def benchmark_queries(spark: SparkSession, study_dir: str, csv: str | None = None) -> DataFrame:
    """``query_rows`` of a study: the first row of the newest ``summary_*`` file (not ``summary_per_database_*``) of each
    ``query_NN`` folder in numeric order; where there are no such folders, the rows of ``csv``, of which those of the
    database COMBINED count where it names databases. Raises where a required column is missing."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    pattern = fs_path(f"{study_dir}/query_*/summary_*.csv")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    single = [str(f.getPath()) for f in found or [] if not f.getPath().getName().startswith("summary_per_database_")]
    if single:
        rows = _newest(_csv(spark, single).withColumn("query_num", query_number(F.col("path"))), ["query_num"])
        first = rows.groupBy("query_num").agg(F.min_by(F.struct(*rows.drop("query_num").columns), "__at").alias("r"))
        return query_rows(first.select("query_num", "r.*")).orderBy("query_num")
    rows = _csv(spark, csv or study_dir)
    if missing := [c for c in ("query", "results_count", "TP", "recall") if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    if "database" in rows.columns:
        rows = rows.where(F.upper("database") == "COMBINED")
    number = F.col("query_num").cast("int") if "query_num" in rows.columns else F.row_number().over(Window.orderBy("__at"))
    return query_rows(rows.withColumn("query_num", number)).orderBy("query_num")


def combined_rows(spark: SparkSession, path: str) -> DataFrame:
    """study, query_num, results_count, tp, gold, recall, nnr, path of the COMBINED row of the newest
    ``summary_per_database_*`` file of every study and query (``.../<study>/query_NN/``)."""
    rows = _csv(spark, path).withColumn("query_num", query_number(F.col("path"))).withColumn("study", F.regexp_extract("path", r"/([^/]+)/query_\d+/[^/]*$", 1))
    newest = _newest(rows, ["study", "query_num"]).where(F.upper("database") == "COMBINED").dropDuplicates(["study", "query_num"])
    return newest.select("study", "query_num", *[F.col(c).cast("double").alias(n) for c, n in (("results_count", "results_count"), ("TP", "tp"), ("gold_size", "gold"), ("recall", "recall"), ("NNR_proxy", "nnr"))], "path")


def study_documents(spark: SparkSession, folder: str) -> DataFrame:
    """study_id, path, document (JSON text): of ``all_studies.json`` where the folder has it (a map by study or a list),
    else of every ``*.json`` file, one study each. Documents without a study_id take the map's key or the file's name."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    every = fs_path(f"{folder}/all_studies.json")
    if every.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(every):
        raw = spark.read.text(f"{folder}/all_studies.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        as_list = F.ltrim("value").startswith("[")
        mapped = raw.where(~as_list).select("path", F.explode(F.from_json("value", "map<string,string>")).alias("key", "document"))
        listed = raw.where(as_list).select("path", F.lit(None).cast("string").alias("key"), F.explode(F.from_json("value", "array<string>")).alias("document"))
        rows = mapped.unionByName(listed)
    else:
        rows = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
        rows = rows.withColumn("key", F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.json$", 1), "%20", " "))
    return rows.select(F.coalesce(F.get_json_object("document", "$.study_id"), "key").alias("study_id"), "path", "document").where("study_id is not null")


def validation_rows(spark: SparkSession, path: str) -> DataFrame:
    """title, pmid, doi, authors, path of validation CSVs: blank first lines and a byte-order mark are skipped, PMIDs
    keep their digits, resolver addresses before DOIs go, columns by their usual names; one header per file."""
    rows = flexible_csv(spark, path, {"title": ["title", "study title"], "pmid": ["pmid", "pubmed id"], "doi": ["doi"], "authors": ["authors", "author"]})
    pmid, doi = F.regexp_replace("pmid", r"\D", ""), F.regexp_replace(clean_null(F.col("doi")), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")
    return rows.select(clean_null(F.col("title")).alias("title"), F.nullif(pmid, F.lit("")).alias("pmid"), F.nullif(doi, F.lit("")).alias("doi"), clean_null(F.col("authors")).alias("authors"), "path")


def pubmed_candidates(answers: DataFrame) -> DataFrame:
    """pmid, doi, title, authors, journal, year of recorded answers (columns of ``PUBMED``): the DOI from the article's
    id list only, the year of the electronic date, else of the issue; authors without a family name are left out."""
    doi = F.get(F.filter("ids", lambda i: i["type"] == "doi"), F.lit(0))["value"]
    authors = F.transform(F.filter("authors", lambda a: F.coalesce(a["LastName"], F.lit("")) != ""), lambda a: F.trim(F.concat_ws(" ", a["LastName"], a["Initials"])))
    year = F.coalesce(F.nullif("article_year", F.lit("")), F.nullif("issue_year", F.lit("")))
    return answers.select("pmid", doi.alias("doi"), F.coalesce("title", F.lit("")).alias("title"), authors.alias("authors"), F.coalesce("journal", F.lit("")).alias("journal"), F.try_to_number(year, F.lit("9999")).cast("int").alias("year"))


def crossref_candidates(answers: DataFrame) -> DataFrame:
    """doi, title, authors, journal, year, type of recorded items (columns of ``CROSSREF``); items without a DOI are no
    candidates. The year of the print date, else of the online one."""
    parts = F.coalesce(F.col("`published-print`.`date-parts`"), F.col("`published-online`.`date-parts`"))
    authors = F.transform(F.filter("author", lambda a: F.coalesce(a["family"], F.lit("")) != ""), lambda a: F.trim(F.concat_ws(" ", a["family"], a["given"])))
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    return answers.where("DOI is not null and DOI <> ''").select(F.col("DOI").alias("doi"), first("title").alias("title"), authors.alias("authors"), first("`container-title`").alias("journal"), F.get(F.get(parts, F.lit(0)), F.lit(0)).alias("year"), "type")


def europepmc_candidates(answers: DataFrame) -> DataFrame:
    """title, doi, pmid, journal, year, authors, pub_types of recorded items (columns of ``EUROPEPMC``); the PMC id stands
    in for a missing PMID; authors are split at commas."""
    authors = F.filter(F.transform(F.split(F.coalesce("authorString", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    return answers.select(F.coalesce("title", F.lit("")).alias("title"), "doi", F.coalesce(F.nullif("pmid", F.lit("")), F.nullif("pmcid", F.lit(""))).alias("pmid"), F.coalesce("journalTitle", F.lit("")).alias("journal"),
        F.try_to_number(F.nullif("pubYear", F.lit("")), F.lit("9999")).cast("int").alias("year"), authors.alias("authors"), F.coalesce("pubTypeList.pubType", F.array().cast("array<string>")).alias("pub_types"))


def final_name(path: str) -> str:
    """The name of a finalised file: ``sealed_`` becomes ``final_`` in the file's own name."""
    folder, slash, name = path.rpartition("/")
    return folder + slash + name.replace("sealed_", "final_", 1)


def latest_sealed(spark: SparkSession, pattern: str) -> str | None:
    """The last ``sealed_*`` file by name, None where there is none."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = fs_path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return max((str(f.getPath()) for f in found or []), key=lambda p: p.rpartition("/")[2], default=None)


def reference_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``json``: each reference as a JSON text of the named columns, nulls kept."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def reference_rows(texts: DataFrame, schema: str) -> DataFrame:
    """References of JSON texts (``json``); keys that the schema has not are dropped."""
    return texts.select(F.from_json("json", schema).alias("r")).select("r.*")
