"""Bibliographic identifiers as Catalyst expressions: everything stays in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hyphen-like characters written for "-" in identifiers.
HYPHENS = "‐‑‒–—―−﹘﹣－"
# Spellings of a missing value (compared in lower case, blanks removed).
MISSING = ("", "nan", "none", "null", "n/a", "na", "-")
_BLANK = r"[\s\p{Z}\p{Cf}\p{Cc}]+"


def clean_null(col: Column) -> Column:
    """Trimmed text, or null for null, blank, ``nan``, ``none`` in any case."""
    t = F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(~F.lower(t).isin("", "nan", "none"), t)


_MARKS = r"[.,;:'\"\]}”’]+$"
# a DOI that stands alone: nothing before or after it, one slash after the registrant, a letter or digit at its end
_CLEAN = r"^10\.[0-9]{4,9}(?:\.[0-9]+)*/[0-9A-Za-z](?:[0-9A-Za-z.()_/-]*[0-9A-Za-z])?\z"
_DOI = r"^10\.[0-9]{4,9}(?:\.[0-9]+)*/[^/]"


def doi_key(col: Column) -> Column:
    """The bare DOI in lower case (``10.``, registrant, one slash, suffix), or null where the text holds none.

    Blanks and invisible characters anywhere, resolver addresses, ``doi`` labels, quotes and brackets around,
    ``[doi]``/``[pii]`` notes, hyphen look-alikes, doubled slashes after the registrant, percent and entity
    escapes and marks at the end are no part of a DOI; ``>`` and ``)`` at the end count as marks only where
    unbalanced. Dots and digits inside are kept as they stand. Each step uses the step before once, so the
    expression stays linear in generated code; clean DOIs, by far the most, skip the steps.
    """
    s = F.lower(F.translate(F.regexp_replace(col, _BLANK, ""), HYPHENS, "-" * len(HYPHENS)))
    for escape, char in (("%2f", "/"), ("%3c", "<"), ("%3e", ">"), ("%28", "("), ("%29", ")"), ("%3a", ":"), ("%3b", ";"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(escape), F.lit(char))
    s = F.regexp_replace(s, r"^(?:.*?[^0-9.])?(10\.[0-9]{4,9}(?:\.[0-9]+)*)/+([^/].*?)(?:\[(?:doi|pii)\].*)?$", "$1/$2")
    s = F.regexp_replace(s, _MARKS, "")
    s = F.regexp_replace(s, r"^([^<>]*(?:<[^<>]*>[^<>]*)*)>+$", "$1")
    s = F.regexp_replace(s, r"^([^()]*(?:\([^()]*\)[^()]*)*)\)+$", "$1")
    s = F.regexp_replace(s, _MARKS, "")
    return F.when(col.rlike(_CLEAN), F.lower(col)).otherwise(F.when(s.rlike(_DOI), s))


def pmid_key(col: Column) -> Column:
    """The PMID as a plain number without leading zeros, or null (placeholders, text, zero)."""
    s = F.lower(F.regexp_replace(col, _BLANK, ""))
    n = F.regexp_extract(s, r"^(?:pmid|pubmed|pubmedid)?[:=#]?0*([1-9][0-9]*)(?:\.0*)?$", 1)
    return F.when(n != "", n)
