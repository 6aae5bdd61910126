"""Identity of retrieved articles across providers and ordered merging of partial identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def combined_counts(retrieval: DataFrame, by: list[str]) -> DataFrame:
    """Per group: unique articles = distinct DOIs + distinct PMIDs that come with no DOI anywhere in the group, and
    the raw number of hits."""
    pmids = retrieval.where("pmid is not null").groupBy(*by, "pmid").agg(F.max("doi").alias("d")).groupBy(*by).agg(F.count_if(F.col("d").isNull()).alias("pmid_only"))
    dois = retrieval.groupBy(*by).agg(F.count_distinct("doi").alias("dois"), F.count(F.lit(1)).alias("raw"))
    return dois.join(pmids, by, "left").select(*by, "raw", "dois", F.coalesce("pmid_only", F.lit(0)).alias("pmid_only"), (F.col("dois") + F.coalesce("pmid_only", F.lit(0))).alias("unique_articles"))


def linked_records(retrieval: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (pmid, doi) per group for providers that key by PMID: pairs, then PMIDs without one. Hits with a DOI
    only are not linked (as published)."""
    return retrieval.where("pmid is not null").groupBy(*by, "pmid").agg(F.min(F.struct("ord", "doi")).alias("first"), F.min(F.when(F.col("doi").isNotNull(), F.struct("ord", "doi"))).alias("m")).select(*by, "pmid", F.col("m.doi").alias("doi"))


def registry_fast(retrieval: DataFrame, by: list[str]) -> DataFrame:
    """Merged articles per group where PMID and DOI are one-to-one: a hit with a PMID only takes the DOI that the
    PMID has elsewhere; key is the DOI, else the PMID."""
    known = retrieval.where("pmid is not null and doi is not null").groupBy(*by, "pmid").agg(F.min("doi").alias("known_doi"))
    filled = retrieval.join(known, [*by, "pmid"], "left").withColumn("doi", F.coalesce("doi", "known_doi"))
    key = F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("pmid:"), "pmid"))
    return filled.withColumn("art", key).where("art is not null").groupBy(*by, "art").agg(F.min("pmid").alias("pmid"), F.min("doi").alias("doi"))


def registry_exact(retrieval: DataFrame, by: list[str]) -> DataFrame:
    """The order-dependent registry: each hit is looked up by DOI, else by PMID; a hit fills a missing identifier of
    the article found but never joins two articles. One group (a query of a study) is folded per task."""
    kinds = ", ".join(f"`{c}` {retrieval.schema[c].dataType.simpleString()}" for c in by)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        articles: list[list] = []
        doi_at: dict[str, int] = {}
        pmid_at: dict[str, int] = {}
        group = group.sort_values("ord")
        for pmid, doi in zip(group["pmid"], group["doi"], strict=True):
            pmid, doi = pmid or None, (doi or "").lower() or None
            if not pmid and not doi:
                continue
            at = doi_at.get(doi) if doi else None
            if at is None and pmid:
                at = pmid_at.get(pmid)
            if at is None:
                at = len(articles)
                articles.append([pmid, doi])
                if doi:
                    doi_at[doi] = at
                if pmid:
                    pmid_at.setdefault(pmid, at)
                continue
            if pmid and not articles[at][0]:
                articles[at][0] = pmid
                pmid_at.setdefault(pmid, at)
            if doi and not articles[at][1]:
                articles[at][1] = doi
                doi_at.setdefault(doi, at)
        out = pd.DataFrame(articles, columns=["pmid", "doi"])
        for c in reversed(by):
            out.insert(0, c, group[c].iat[0])
        return out

    return retrieval.select(*by, "ord", "pmid", "doi").groupBy(*by).applyInPandas(fold, f"{kinds}, pmid string, doi string")


def first_by_priority(rows: DataFrame, key: list[str], priority: list) -> DataFrame:
    """The first row of each key in the order of ``priority``."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*priority))).where("__rank = 1").drop("__rank")


def deduplicate(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First occurrence by the first key a row has (PMID, then DOI, then title); rows without any key all stay."""
    tagged = rows.withColumn("__key", F.coalesce(*[F.concat(F.lit(f"{k}:"), F.col(k)) for k in keys]))
    return first_by_priority(tagged.where("__key is not null"), ["__key"], order).unionByName(tagged.where("__key is null")).drop("__key")


def greedy_clusters(rows: DataFrame, by: str, order: str, text: str | list[str], similar, threshold: float = 0.85, identifiers: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``order``, cluster: each row in order joins the best cluster of at least ``threshold``, else founds
    one. A cluster is compared through its first row, replaced by each later member that has one of ``identifiers``.
    ``similar`` gets two values of ``text``, or two tuples of its columns. Order-dependent, so one group of ``by`` (the
    repeated extractions of one study) is folded per task."""
    columns = [text] if isinstance(text, str) else list(text)

    def fold(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        group = groups.sort_values(order)
        plain = group.astype(object).where(group.notna(), None)
        seen = [v[0] or "" for v in plain[columns].to_numpy()] if isinstance(text, str) else [tuple(v) for v in plain[columns].to_numpy()]
        known = [any(x not in (None, "") for x in v) for v in plain[list(identifiers)].to_numpy()] if identifiers else [False] * len(seen)
        heads: list = []
        label = []
        for t, named in zip(seen, known, strict=True):
            scores = [similar(t, h) for h in heads]
            best = max(range(len(scores)), key=scores.__getitem__) if scores else -1
            if best < 0 or scores[best] < threshold:
                heads.append(t)
                best = len(heads) - 1
            elif named:
                heads[best] = t
            label.append(best)
        return pd.DataFrame({by: group[by], order: group[order], "cluster": label})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (by, order))
    return rows.select(*dict.fromkeys([by, order, *columns, *identifiers])).groupBy(by).applyInPandas(fold, f"{kinds}, cluster int")
