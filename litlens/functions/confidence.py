"""Confidence of a looked-up identifier, per service, and the checks a candidate must pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pubmed_confidence(similarity: Column, results: Column, author: Column) -> Column:
    few = results <= 3
    base = (F.when((results == 1) & (similarity > 0.95), 0.95).when(similarity >= 0.90, F.when(few, 0.90).otherwise(0.85)).when(similarity >= 0.80, F.when(few, 0.80).otherwise(0.70))
            .when(similarity >= 0.70, 0.60).otherwise(similarity * 0.5))
    return base * F.when(author, 1.0).otherwise(0.90)


def _by_agreement(similarity: Column, author: Column, year: Column) -> Column:
    both = author & year
    return (F.when((similarity >= 0.95) & both, 0.95).when(similarity >= 0.90, F.when(both, 0.90).otherwise(0.85)).when(similarity >= 0.80, F.when(author, 0.80).otherwise(0.70))
            .when(similarity >= 0.70, 0.60).otherwise(similarity * 0.5))


def crossref_confidence(similarity: Column, results: Column, author: Column, year: Column, work_type: Column) -> Column:
    penalty = F.when(work_type.isin("posted-content", "preprint"), 0.85).when(work_type.isin("proceedings-article", "book-chapter"), 0.95).otherwise(1.0)
    return _by_agreement(similarity, author, year) * F.when(results > 5, 0.95).otherwise(1.0) * penalty


def europepmc_confidence(similarity: Column, results: Column, author: Column, year: Column, pub_types: Column) -> Column:
    preprint = F.coalesce(F.exists(pub_types, lambda t: F.lower(t).contains("preprint")), F.lit(False))
    return _by_agreement(similarity, author, year) * F.when(results > 10, 0.95).otherwise(1.0) * F.when(preprint, 0.85).otherwise(1.0)


def author_listed(last_name: Column, authors: Column, first: int = 5) -> Column:
    """Whether a family name is part of one of the first authors; an empty name is in no list."""
    hit = F.exists(F.slice(F.coalesce(authors, F.array().cast("array<string>")), 1, first), lambda a: F.contains(F.lower(a), F.lower(last_name)))
    return F.when(F.coalesce(F.length(last_name), F.lit(0)) == 0, False).otherwise(F.coalesce(hit, F.lit(False)))


def acceptable(year: Column, candidate_year: Column, last_name: Column, authors: Column, max_years: int = 1, work_type: Column | None = None, allowed: list[str] | None = None) -> Column:
    """Year within ``max_years`` where both are known, family name among the authors where it is known, type allowed
    where one is given."""
    named = F.coalesce(F.length(last_name), F.lit(0)) == 0
    ok = (year.isNull() | candidate_year.isNull() | (F.abs(year - candidate_year) <= max_years)) & (named | author_listed(last_name, authors))
    return ok & (work_type.isNull() | work_type.isin(*allowed)) if allowed and work_type is not None else ok
