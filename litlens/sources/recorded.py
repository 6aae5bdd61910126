"""Recorded search responses as a Spark data source: one contract for every provider, no network.

``spark.dataSource.register(RecordedSearch)`` then ``spark.read.format("recorded_search")`` with options ``path`` (a
Parquet folder of recorded hits: query_id, provider, ord, doi, native_id, year, title, first_author, journal, total),
``provider``, ``query`` (text or its hash in ``query_id``), ``mindate``/``maxdate`` (``YYYY/MM/DD``) and ``retmax``.
Date bounds and the hit limit become filters of the scan, as a provider would apply them; equality and range filters
on year, ord and native_id are pushed down. A file is a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Names under which providers are known, their kind of identifier and page size.
PROVIDERS = {"pubmed": ("pmid", 100_000), "scopus": ("scopus_id", 25), "web_of_science": ("wos_uid", 50), "embase": ("pmid", 100_000)}
ALIASES = {"ncbi": "pubmed", "wos": "web_of_science", "webofscience": "web_of_science", "medline": "pubmed", "embase_local": "embase"}
_OPERATORS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def provider_name(name: str) -> str:
    """The canonical name; raises for an unknown provider."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return key


class RecordedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "query_id string, provider string, id_type string, ord int, doi string, native_id string, year int, title string, first_author string, journal string, total int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _OPERATORS and len(f.attribute) == 1 and f.attribute[0] in ("year", "ord", "native_id"):
                self.filters.append((f.attribute[0], _OPERATORS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds

        return [InputPartition(f) for f in ds.dataset(self.options["path"]).files]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds

        o = self.options
        want = [("provider", "==", provider_name(o["provider"]))] if "provider" in o else []
        if "query_id" in o or "query" in o:
            want.append(("query_id", "==", o.get("query_id") or hashlib.sha256(o["query"].encode()).hexdigest()))
        want += [("year", op, int(o[k][:4])) for k, op in (("mindate", ">="), ("maxdate", "<=")) if o.get(k)]
        want += [("ord", "<", int(o["retmax"]))] if "retmax" in o else []
        test = None
        for column, op, value in want + self.filters:
            field = ds.field(column)
            one = {"==": field == value, ">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value}[op]
            test = one if test is None else test & one
        names = ["query_id", "provider", "ord", "doi", "native_id", "year", "title", "first_author", "journal", "total"]
        for batch in ds.dataset(partition.value).to_batches(columns=names, filter=test):
            if batch.num_rows:
                kind = pa.array([PROVIDERS.get(p, ("unknown", 0))[0] for p in batch.column("provider").to_pylist()])
                columns = dict(zip(names, batch.columns, strict=True)) | {"id_type": kind}
                order = ["query_id", "provider", "id_type", "ord", "doi", "native_id", "year", "title", "first_author", "journal", "total"]
                cast = [columns[c].cast(pa.int32()) if c in ("ord", "year", "total") else columns[c].cast(pa.string()) for c in order]
                yield pa.RecordBatch.from_arrays(cast, names=order)


def metadata_key(doi: Column, pmid: Column) -> Column:
    """Key of an article's metadata: the DOI in lower case, else ``pmid:`` and the PMID."""
    return F.coalesce(F.lower(doi), F.concat(F.lit("pmid:"), pmid))


def fill_dois(hits: DataFrame, crossref: DataFrame) -> DataFrame:
    """Hits with a missing DOI filled from a recorded PMID-to-DOI answer (pmid, answered_pmid, doi); an answer for
    another PMID than the one asked is rejected."""
    good = crossref.where("answered_pmid is null or answered_pmid = pmid").groupBy("pmid").agg(F.min(F.lower("doi")).alias("found"))
    return hits.join(good, "pmid", "left").withColumn("doi", F.coalesce("doi", "found")).drop("found")


def cross_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Missing PMID or DOI of each row from a table of known pairs (pmid, doi), by the identifier it has."""
    by_doi = known.groupBy(F.lower("doi").alias("doi")).agg(F.min("pmid").alias("p"))
    by_pmid = known.groupBy("pmid").agg(F.min(F.lower("doi")).alias("d"))
    return rows.join(by_doi, "doi", "left").join(by_pmid, "pmid", "left").withColumns({"pmid": F.coalesce("pmid", "p"), "doi": F.coalesce("doi", "d")}).drop("p", "d")


def heading_years(queries: DataFrame, key: str, headings: str, mesh: DataFrame, max_year: int) -> DataFrame:
    """key, invalid, late: headings of a query that ``mesh`` (heading, uid, intro_year) lacks, and those introduced
    after ``max_year`` (year 0 is unknown)."""
    each = queries.select(key, F.explode_outer(headings).alias("heading")).join(mesh.select("heading", "uid", "intro_year"), "heading", "left")
    named = F.col("heading").isNotNull()
    return each.groupBy(key).agg(F.count_if(named & F.col("uid").isNull()).alias("invalid"), F.count_if(F.col("intro_year") > max_year).alias("late"))


def medline_texts(lines: DataFrame, text: str) -> DataFrame:
    """pmid, title, abstract, journal, year from MEDLINE records (``TAG - value``, continued lines indented), one
    record per row."""
    flat = F.regexp_replace(F.col(text), r"\r?\n {2,}", " ")
    field = lambda tag: F.nullif(F.trim(F.regexp_extract(flat, rf"(?m)^{tag}\s*- (.*)$", 1)), F.lit(""))
    return lines.select(field("PMID").alias("pmid"), field("TI").alias("title"), field("AB").alias("abstract"), field("JT").alias("journal"), F.nullif(F.substring(field("DP"), 1, 4), F.lit("")).cast("int").alias("year"))


def search_texts(title: Column, last_name: Column, year: Column) -> Column:
    """The queries a title lookup tries in turn: exact title, title with author and year, title with author, title
    words, first twelve words; the first that returns anything counts (see ``best_candidate``)."""
    words = F.split(title, r"\s+")
    return F.array_compact(F.array(
        F.concat(F.lit('"'), title, F.lit('"[Title]')), F.concat(title, F.lit(" AND "), last_name, F.lit("[Author] AND "), year.cast("string"), F.lit("[Date - Publication]")), F.concat(title, F.lit(" AND "), last_name, F.lit("[Author]")), title, F.array_join(F.slice(words, 1, 12), " "),
    ))
