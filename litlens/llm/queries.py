"""Queries of the problems over the test tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.functions.identifiers import doi_key, pmid_key
from litlens.llm.components import components
from litlens.llm.confusables import lookalike_pairs
from litlens.llm.leakage import find_leaks, remove_leaks
from litlens.llm.matching import match
from litlens.llm.merkle import collapse
from litlens.llm.names import link_names, name_pairs
from litlens.llm.packing import pack
from litlens.llm.spam import spam_pages
from litlens.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included rows and imported records whose titles look the same and are not the same string."""
    refs = table(spark, sf_dir, "included_studies")
    hits = table(spark, sf_dir, "embase_query3").select(F.explode("records").alias("r")).select("r.record_id", "r.title")
    return lookalike_pairs(refs, "ref_id", "title", hits, "record_id", "title")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every DOI mentioned at least twice in both tables together, with its mentions."""
    hits = table(spark, sf_dir, "embase_query3").select(F.explode("retrieved_dois").alias("raw"))
    rows = table(spark, sf_dir, "included_studies").select(F.col("doi").alias("raw"))
    records = collapse(hits.unionAll(rows), ["raw"], leaves={"raw": doi_key}, keep={"doi": F.first(doi_key(F.col("raw")))})
    return records.where("copies >= 2 and doi is not null").select("doi", "copies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of strings in ``authors`` and ``first_author`` that name the same person or group."""
    rows = table(spark, sf_dir, "included_studies")
    written = rows.select(F.explode("authors").alias("name")).unionAll(rows.select(F.col("first_author").alias("name")))
    return name_pairs(link_names(written, "name"))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included rows and candidates with the confidence that they are the same article."""
    left, right = table(spark, sf_dir, "included_studies"), table(spark, sf_dir, "lookup_candidates")
    found = match(left, right, ("ref_id", "title", "first_author", "year", "journal"), ("cand_id", "title", "first_author", "year", "journal"))
    return found.select(F.col("left_id").alias("ref_id"), F.col("right_id").alias("cand_id"), "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that are more likely the same article than not."""
    return p4_matches(spark, sf_dir).where("confidence >= 0.5").select("ref_id", "cand_id").distinct()


def hit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doi, pmid of every hit that has both, as prefixed identifiers."""
    hits = table(spark, sf_dir, "embase_query3").select(F.explode(F.arrays_zip("retrieved_dois", "retrieved_pmids")).alias("h"))
    ids = hits.select(doi_key(F.col("h.retrieved_dois")).alias("d"), pmid_key(F.col("h.retrieved_pmids")).alias("p")).where("d is not null and p is not null")
    return ids.select(F.concat(F.lit("doi:"), "d").alias("doi"), F.concat(F.lit("pmid:"), "p").alias("pmid"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier linked through hits, with the smallest identifier of its group."""
    found = components(hit_links(spark, sf_dir), "doi", "pmid")
    return found.select(F.col("vertex").alias("ident"), F.col("component").alias("group_ident"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items of which they contain at least 12 consecutive words."""
    found = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text", 12)
    return found.select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks held-out passages, without them; null where they cover most of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = remove_leaks(docs, "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text", 12)
    return cleaned.where("not (clean_text <=> text)").select("doc_id", "clean_text")


def p6_packed(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document placed in windows of each capacity; ``vocabulary`` defaults to the installed public one."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    targets = {r.target_name: r.capacity_tokens for r in table(spark, sf_dir, "pack_targets").collect()}
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", targets, vocabulary)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are keyword-stuffed or link-list pages; the table names a page's host in ``source``."""
    pages = spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return pages.where("is_spam").select("doc_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p6_packed": p6_packed, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found}


def _doi_sql(raw: str) -> str:
    """CTEs that end in ``fit`` (doi and the other columns) from a query that gives d and other columns."""
    return rf"""raw AS ({raw}),
bare AS (SELECT * EXCLUDE (d), lower(translate(regexp_replace(d, '[\s\x{{a0}}\x{{2007}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}\x{{ad}}]+', '', 'g'), '‐‑‒–—―−', '-------')) AS s FROM raw),
cut AS (SELECT * EXCLUDE (s), regexp_replace(regexp_extract(s, '(10\.[0-9]{{4,9}})/+([^/].*)$', 1) || '/' || regexp_replace(regexp_extract(s, '(10\.[0-9]{{4,9}})/+([^/].*)$', 2), '\[doi\].*$', ''), '[.,;:''"\]}}]+$', '') AS s FROM bare WHERE s LIKE '%10.%/%'),
fit AS (SELECT * EXCLUDE (s), regexp_replace(CASE WHEN s LIKE '%>' AND len(s) - len(replace(s, '>', '')) > len(s) - len(replace(s, '<', '')) THEN rtrim(s, '>') ELSE s END, '[.,;:''"\]}}]+$', '') AS doi FROM cut)"""


_MENTIONS = "SELECT unnest(retrieved_dois) AS d FROM embase_query3 UNION ALL SELECT doi FROM included_studies"
_HITS = r"SELECT d, nullif(regexp_extract(lower(regexp_replace(p0, '[\s\x{a0}]+', '', 'g')), '^(?:pmid)?[:]?0*([1-9][0-9]*)(?:\.0*)?$', 1), '') AS p FROM (SELECT unnest(retrieved_dois) AS d, unnest(retrieved_pmids) AS p0 FROM embase_query3)"
SQL = {
    "p2_found": f"WITH {_doi_sql(_MENTIONS)} SELECT doi, count(*) AS copies FROM fit WHERE doi <> '/' GROUP BY doi HAVING count(*) >= 2",
    # reachability over the links, then the least identifier that each reaches
    "p5_found": f"""WITH RECURSIVE {_doi_sql(_HITS)}, e AS (SELECT DISTINCT 'doi:' || doi AS a, 'pmid:' || p AS b FROM fit WHERE doi <> '/' AND p IS NOT NULL), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, x.b FROM reach JOIN both_ways x ON reach.b = x.a) SELECT a AS ident, min(b) AS group_ident FROM reach GROUP BY a""",
}
