"""Readers of query files, gold lists, exports, result documents and score tables.

Each reader takes a path (or glob) and gives a DataFrame with the file in ``path``, so many studies are read in one
scan. Order inside a file is a column, never an assumption about partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.functions.identifiers import clean_null

_LINK = T.StructType([T.StructField("pmid", T.StringType()), T.StructField("doi", T.StringType())])
_META = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "first_author")] + [T.StructField("year", T.IntegerType()), T.StructField("journal", T.StringType())])
_RECORD = T.StructType([*_LINK.fields, *_META.fields])
LOCAL_ENTRY = T.StructType([T.StructField("query", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("results_count", T.IntegerType()), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("retrieved_dois", "retrieved_pmids", "pmids")],
    T.StructField("records", T.ArrayType(_RECORD)), T.StructField("source", T.StringType()), T.StructField("note", T.StringType())])
_PROVIDER = T.StructType([T.StructField("query", T.StringType()), T.StructField("results_count", T.IntegerType()), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("retrieved_ids", "retrieved_dois")], T.StructField("id_type", T.StringType()),
    T.StructField("linked_records", T.ArrayType(_LINK)), T.StructField("metadata", T.MapType(T.StringType(), _META)), T.StructField("error", T.StringType())])
DETAILS = T.StructType([T.StructField("query", T.StringType()), T.StructField("results_count", T.IntegerType()), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("retrieved_pmids", "retrieved_dois", "tp_pmids")], T.StructField("provider_details", T.MapType(T.StringType(), _PROVIDER))])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def query_blocks(spark: SparkSession, path: str, keep_comments: bool = False, joiner: str = " ") -> DataFrame:
    """path, query_num (from 1), comment, text: blocks between blank lines. ``#`` lines are comments; their last line
    names the query. With ``keep_comments`` blocks keep ``# Query`` lines and are joined by ``joiner``, as the batch
    import does. A file without queries gives no rows."""
    blocks = _whole(spark, path).select("path", F.posexplode(F.split("text", r"\r?\n[ \t]*\r?\n")).alias("at", "block"))
    lines = F.filter(F.transform(F.split("block", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    comments = F.filter(lines, lambda x: x.startswith("#"))
    body = F.filter(lines, lambda x: ~x.startswith("#") | (F.lit(keep_comments) & x.rlike(r"(?i)^#\s*query")))
    made = blocks.select("path", "at", F.when(F.size(comments) > 0, F.element_at(comments, -1)).alias("comment"), F.array_join(body, joiner).alias("text"), (F.size(F.filter(lines, lambda x: ~x.startswith("#"))) > 0).alias("real")).where("real")
    number = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    return made.select("path", number.alias("query_num"), "comment", "text")


def provider_queries(spark: SparkSession, folder: str, providers: list[str], base: str = "queries") -> DataFrame:
    """provider, query_num, text for each provider, from ``base_provider``, ``base.provider`` or ``base-provider``
    (``wos`` for ``web_of_science``), else the base file. Raises where the numbers of queries differ."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for p in providers:
        names = [p, "wos"] if p == "web_of_science" else [p]
        options = [f"{folder}/{base}{sep}{n}.txt" for n in names for sep in "_.-"] + [f"{folder}/{base}.txt"]
        found = next((o for o in options if fs_path(o).getFileSystem(conf).exists(fs_path(o))), None)
        if found is None:
            raise FileNotFoundError(f"no query file for {p} in {folder}")
        one = query_blocks(spark, found).select(F.lit(p).alias("provider"), "query_num", "text")
        out = one if out is None else out.unionByName(one)
    counts = {r["provider"]: r["n"] for r in out.groupBy("provider").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(set(counts.get(p, 0) for p in providers)) > 1:
        raise ValueError(f"numbers of queries differ: {counts}")
    return out


def bundles(queries: DataFrame, main: str = "pubmed") -> DataFrame:
    """query_num, canonical, per_provider: aligned queries folded by number; the canonical text is the main
    provider's, else that of the provider first by name."""
    first = F.min(F.struct((F.col("provider") != main).alias("other"), "provider", "text"))
    return queries.groupBy("query_num").agg(first["text"].alias("canonical"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "text")))).alias("per_provider"))


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, id: one identifier per line; blank and ``#`` lines do not count, repeats neither."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("id"))
    return lines.where("id <> '' and not id like '#%'").distinct()


def digit_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every run of digits in a file, distinct."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit("([0-9]+)"), 1)).alias("pmid")).distinct()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """csv, query of ``csv|query`` lines; ``#`` lines are comments."""
    lines = spark.read.text(path).where("trim(value) <> '' and not trim(value) like '#%'").select(F.split("value", r"\|", 2).alias("p")).where("size(p) = 2")
    return lines.select(F.trim(F.col("p")[0]).alias("csv"), F.trim(F.col("p")[1]).alias("query"))


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 1), cells, values of CSV files, each read whole: ``cells`` by the file's own header, names in lower
    case without blanks and underscores; ``values`` in order. Row 0 is the header. A byte-order mark and blank first
    lines are skipped, so a glob may mix files of different headers."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            rows = []
            for p, text in zip(batch["path"], batch["text"], strict=True):
                names: list[str] | None = None
                for n, values in enumerate(v for v in csv.reader(io.StringIO(text.lstrip("\ufeff \t\r\n"))) if v):
                    if names is None:
                        names = ["".join(v.lower().replace("_", " ").split()) for v in values]
                    rows.append((p, n, dict(zip(names, values, strict=False)), values))
            yield pd.DataFrame(rows, columns=["path", "row", "cells", "values"])

    return _whole(spark, path).mapInPandas(scan, "path string, row int, cells map<string,string>, values array<string>")


def _picked(names: list[str]) -> Column:
    return F.coalesce(*[clean_null(F.col("cells")[re.sub(r"[\s_]+", "", n).lower()]) for n in names])


def flexible_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """path, row and the columns named in ``aliases``, each from the first alias that has a value (case, blanks and a
    byte-order mark do not count), else null; all text, missing spellings null. Every file goes by its own header."""
    return csv_cells(spark, path).where("row > 0").select(*[_picked(names).alias(c) for c, names in aliases.items()], "path", "row")


_GOLD = {"pmid": ["pmid", "pubmed id", "pubmed_id", "pubmedid"], "doi": ["doi"], "title": ["title"], "first_author": ["first_author", "first author"], "year": ["year"], "journal": ["journal"]}


def gold_list(spark: SparkSession, path: str) -> DataFrame:
    """pmid, doi, title, first_author, year, journal, path, row of gold CSVs. In a file without a header that names an
    identifier the first column is the PMID of every row, the first included; identifiers stay text; years count where
    all digits."""
    cells = csv_cells(spark, path)
    named = F.coalesce(F.map_contains_key("cells", F.lit("pmid")) | F.map_contains_key("cells", F.lit("pubmedid")) | F.map_contains_key("cells", F.lit("doi")), F.lit(False))
    headed = cells.where("row = 0").where(named).select("path", F.lit(True).alias("headed"))
    rows = cells.join(headed, "path", "left").withColumn("headed", F.coalesce("headed", F.lit(False))).where("row > 0 or not headed")
    out = rows.select(*[F.when(F.col("headed"), _picked(names)).alias(c) for c, names in _GOLD.items()], clean_null(F.get("values", F.lit(0))).alias("bare"), "headed", "path", "row")
    made = out.withColumns({"pmid": F.when(F.col("headed"), F.col("pmid")).otherwise(F.col("bare")), "doi": F.lower("doi"), "year": F.when(F.col("year").rlike(r"^\d+$"), F.col("year").cast("int"))})
    return made.drop("bare", "headed")


def id_sets(rows: DataFrame) -> DataFrame:
    """pmids, dois, count: sizes of a CSV's two id sets; count is the larger."""
    return rows.agg(F.count_distinct("pmid").alias("pmids"), F.count_distinct("doi").alias("dois")).withColumn("count", F.greatest("pmids", "dois"))


def java_pattern(spark: SparkSession, pattern: str | None) -> bool:
    """Whether the JVM, which runs the patterns, can compile one."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"(?i){pattern}")
    except Exception:  # noqa: BLE001  (the gateway wraps the JVM's exception)
        return False
    return pattern is not None


def concept_terms(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], list[str]]:
    """({concept: patterns}, [bad patterns]) of a configuration CSV (concept, term_regex), in the order of the file."""
    good: dict[str, list[str]] = {}
    bad = []
    for r in flexible_csv(spark, path, {"concept": ["concept"], "term_regex": ["term_regex"]}).where("concept is not null and term_regex is not null").orderBy("path", "row").collect():
        if java_pattern(spark, r.term_regex):
            good.setdefault(r.concept, []).append(r.term_regex)
        else:
            bad.append(r.term_regex)
    return good, bad


def local_imports(spark: SparkSession, path: str) -> DataFrame:
    """path, entry_key and the fields of each entry of local import documents (one map by query hash per file)."""
    parsed = _whole(spark, path).select("path", F.from_json("text", T.MapType(T.StringType(), LOCAL_ENTRY)).alias("m"))
    return parsed.select("path", F.explode("m").alias("entry_key", "e")).select("path", "entry_key", "e.*")


def result_articles(spark: SparkSession, path: str) -> DataFrame:
    """path, item, ord, provider, pmid, doi of result documents in any of their shapes: a list of details, a sealed
    object, a local import keyed by hash, a map of lists. Linked records are preferred, then records, then the two id
    lists paired by index. ``item`` numbers the queries of a file."""
    raw = _whole(spark, path)
    trimmed = F.ltrim("text")
    is_list, is_sealed = trimmed.startswith("["), F.col("text").rlike(r'^\s*\{[^{]*"retrieved_pmids"\s*:')
    details = raw.where(is_list | is_sealed).select("path", F.posexplode(F.from_json(F.when(is_list, F.col("text")).otherwise(F.concat(F.lit("["), "text", F.lit("]"))), T.ArrayType(DETAILS))).alias("item", "d"))
    linked = details.select("path", "item", F.explode("d.provider_details").alias("provider", "p")).where("p.error is null and size(p.linked_records) > 0").select("path", "item", "provider", F.posexplode("p.linked_records").alias("ord", "r")).select("path", "item", "ord", "provider", "r.pmid", "r.doi")
    has = linked.select("path", "item").distinct()
    paired = details.join(has, ["path", "item"], "left_anti").select("path", "item", F.posexplode(F.arrays_zip(F.col("d.retrieved_pmids").alias("p"), F.col("d.retrieved_dois").alias("d"))).alias("ord", "z")).select("path", "item", "ord", F.lit(None).cast("string").alias("provider"), F.col("z.p").alias("pmid"), F.col("z.d").alias("doi"))
    keyed = local_imports(spark, path).where("records is not null or retrieved_dois is not null").join(raw.where(~is_list & ~is_sealed).select("path"), "path", "left_semi")
    local = keyed.select("path", F.xxhash64("entry_key").alias("item"), F.coalesce("provider", F.lit("embase")).alias("provider"), "records", "retrieved_pmids", "retrieved_dois")
    zipped = F.transform(F.arrays_zip(F.col("retrieved_pmids").alias("p"), F.col("retrieved_dois").alias("d")), lambda z: F.struct(z["p"].alias("pmid"), z["d"].alias("doi")))
    chosen = F.when(F.size("records") > 0, F.transform("records", lambda r: F.struct(r["pmid"].alias("pmid"), r["doi"].alias("doi")))).otherwise(zipped)
    locals_ = local.select("path", "item", "provider", F.posexplode(chosen).alias("ord", "r")).select("path", "item", "ord", "provider", "r.pmid", "r.doi")
    every = linked.withColumn("item", F.col("item").cast("long")).unionByName(paired.withColumn("item", F.col("item").cast("long"))).unionByName(locals_)
    return every.withColumns({"pmid": clean_null(F.col("pmid")), "doi": F.lower(clean_null(F.col("doi")))}).where("pmid is not null or doi is not null")


def vertical_records(spark: SparkSession, path: str) -> DataFrame:
    """path, rec, fields of vertical exports: lines of a field name and values; ``TITLE`` starts a record. The record
    number is a running count inside each file. Several values of one field are joined by ``; ``."""
    # one file is one export of at most some thousand records; files are spread over tasks
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for batch in batches:
            rows = []
            for p, text in zip(batch["path"], batch["text"], strict=True):
                rec = 0
                for cells in csv.reader(io.StringIO(text.lstrip("﻿"))):
                    if not cells or not cells[0].strip():
                        continue
                    name = cells[0].strip().upper()
                    rec += name == "TITLE"
                    if rec:
                        rows.append((p, rec, name, "; ".join(c.strip() for c in cells[1:] if c.strip())))
            yield pd.DataFrame(rows, columns=["path", "rec", "field", "value"])

    cells = _whole(spark, path).mapInPandas(scan, "path string, rec int, field string, value string")
    return cells.groupBy("path", "rec", "field").agg(F.array_join(F.array_sort(F.collect_set("value")), "; ").alias("value")).groupBy("path", "rec").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


_EXPORT = {"title": ["Title", "TITLE"], "doi": ["DOI"], "pmid": ["Medline PMID", "MEDLINE PMID", "PMID", "PubMed ID"], "authors": ["Author Names", "AUTHOR NAMES", "Authors"], "year": ["Year", "Publication Year", "YEAR"], "journal": ["Source", "Source title", "SOURCE", "Journal"]}


def export_records(spark: SparkSession, path: str) -> DataFrame:
    """rec, title, doi, pmid, first_author, year, journal of one export, vertical or with a header (told by the first
    cell being ``TITLE`` with at most three cells)."""
    head = (spark.read.text(path).limit(1).collect() or [[""]])[0][0].lstrip("﻿")
    cells = head.split(",")
    if cells[0].strip().strip('"').upper() == "TITLE" and len(cells) <= 3:
        v = vertical_records(spark, path)
        named = v.select("rec", *[F.coalesce(*[F.col("fields")[n.upper()] for n in names]).alias(c) for c, names in _EXPORT.items()])
    else:
        named = flexible_csv(spark, path, _EXPORT).withColumnRenamed("row", "rec")
    year = F.regexp_extract("year", r"(\d{4})", 1)
    return named.select(F.col("rec").cast("long").alias("rec"), "title", F.lower("doi").alias("doi"), F.regexp_replace("pmid", r"\D", "").alias("pmid"), F.trim(F.split("authors", "[;,]")[0]).alias("first_author"), F.when(year != "", year.cast("int")).alias("year"), "journal")


def newest_per(spark: SparkSession, path: str, pattern: str, exclude: str | None = None) -> DataFrame:
    """folder, path of the newest file (then the last by name) of each folder that matches ``pattern``."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").where(F.col("path").rlike(pattern))
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    best = files.groupBy(folder.alias("folder")).agg(F.max(F.struct("modificationTime", "path")).alias("m"))
    return best.select("folder", F.col("m.path").alias("path"))


def set_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score table of strategies: the seven required columns, FN = Gold - TP, Jaccard and OverlapCoeff 0 where they
    are missing. Raises where a required column is missing."""
    raw = spark.read.csv(path, header=True)
    need = ["name", "TP", "Retrieved", "Gold", "Precision", "Recall", "F1"]
    if missing := [c for c in need if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    extra = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in raw.columns else F.lit(0.0) for c in ("Jaccard", "OverlapCoeff")}
    return raw.select("name", *[F.col(c).cast("int").alias(c) for c in ("TP", "Retrieved", "Gold")], *[F.col(c).cast("double").alias(c) for c in ("Precision", "Recall", "F1")], *[x.alias(c) for c, x in extra.items()]).withColumn("FN", F.col("Gold") - F.col("TP"))
