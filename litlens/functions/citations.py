"""Citations and review texts: fields of one citation, the reference section, the table of included studies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings of the table that lists included studies, and of the reference section.
TABLE_HEADINGS = (
    r"Table\s+\d+[\s:]+.*[Ii]ncluded\s+[Ss]tudies", r"Table\s+\d+[\s:]+.*[Cc]haracteristics\s+of\s+.*[Ss]tudies", r"Table\s+\d+[\s:]+.*[Bb]aseline\s+[Cc]haracteristics",
    r"## [Ii]ncluded [Ss]tudies", r"## [Cc]haracteristics of [Ii]ncluded [Ss]tudies", r"##\s+Table\s+\d+[\s:]+.*[Cc]haracteristics",
)
SECTION = r"^##?\s*(?:References?|Bibliography)\s*$"
NUMBERED = (r"^\s*-\s*\[(\d+)\]\s+(.*)", r"^\s*\[(\d+)\]\s+(.*)", r"^\s*(\d+)\.\s+(.*)")


def citation_fields(raw: Column) -> dict[str, Column]:
    """doi, pmid, first_author, year, title, journal, volume, issue, pages of a citation text."""
    c = F.regexp_replace(F.trim(raw), r"^\*\s*", "")
    pick = lambda pattern, g=1: F.regexp_extract(c, pattern, g)
    none = lambda x: F.when(x != "", x)
    parts = F.split(c, r"\. ")
    title = F.regexp_replace(F.trim(F.get(parts, F.lit(1))), r"[.,;:]\s*$", "")
    volume = r"\d{4};(\d+)(?:\((\d+)\))?:(\d+[\s-]+\d+|[\de\s]+)"
    return {
        "doi": none(F.rtrim(F.regexp_replace(pick(r"(?i)(?:doi:|https?://doi\.org/)(10\.\d{4,}[^\s,;]+)"), r"\.+$", ""))), "pmid": none(pick(r"(?i)PMID:?\s*(\d+)")),
        "first_author": F.coalesce(none(pick(r"^([A-Z][a-zA-Z'-]+\s+[A-Z]+(?:\s+[A-Z]+)?)")), F.lit("Unknown")), "year": F.coalesce(none(pick(r"\b(19\d{2}|20[012]\d)\b")).cast("int"), F.lit(2000)),
        "title": F.when(F.coalesce(F.length(title), F.lit(0)) > 0, title).otherwise(F.when(F.length(c) > 100, F.concat(F.substring(c, 1, 100), F.lit("..."))).otherwise(c)),
        "journal": F.coalesce(none(F.trim(pick(r"\.\s+([A-Z][^.]+?)\s+\d{4}"))), F.lit("Unknown Journal")),
        "volume": none(pick(volume)), "issue": none(pick(volume, 2)), "pages": none(F.replace(pick(volume, 3), F.lit(" "), F.lit(""))),
    }


def references_of(text: str) -> dict[int, str]:
    """Numbered references of a text's reference section; further lines belong to the reference before, table lines
    to none; a number given again replaces the text it had."""
    lines = iter(text.split("\n"))
    if not any(re.match(SECTION, line.strip()) for line in lines):
        return {}
    out: dict[int, list[str]] = {}
    now: list[str] | None = None
    for line in lines:
        m = next((m for p in NUMBERED if (m := re.match(p, line))), None)
        if m:
            now = out[int(m[1])] = [m[2]]
        elif now is not None and line.strip() and not re.match(r"^\s*\||^\s*[-|]+\s*$", line):
            now.append(line.strip())
    return {n: " ".join(parts).strip() for n, parts in out.items()}


def included_numbers(text: str) -> list[int]:
    """Reference numbers in the table of included studies: from the first matching heading to the next section or a
    gap of more than three blank lines."""
    lines = text.split("\n")
    start = next((i for i, line in enumerate(lines) if any(re.search(p, line) for p in TABLE_HEADINGS)), None)
    if start is None:
        return []
    body, gap = [lines[start]], 0
    for line in lines[start + 1 :]:
        if re.match(r"^##\s+\w", line.strip()):
            break
        gap = 0 if line.strip() else gap + 1
        if gap > 3:
            break
        body.append(line)
    return sorted({int(n) for n in re.findall(r"\[(\d+)\]", "\n".join(body))})


def review_citations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, reference_number, raw_citation, included of every review text."""
    kind = texts.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                wanted = set(included_numbers(t or ""))
                rows += [(k, n, c, n in wanted) for n, c in references_of(t or "").items()]
            yield pd.DataFrame(rows, columns=[key, "reference_number", "raw_citation", "included"])

    return texts.select(key, text).mapInPandas(scan, f"`{key}` {kind}, reference_number int, raw_citation string, included boolean")
