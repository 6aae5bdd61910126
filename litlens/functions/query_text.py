"""Features of Boolean query strings as Catalyst expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def lint(q: Column) -> Column:
    """Number of kinds of defect: unbalanced parentheses, odd quotes, ``()``, a doubled operator, proximity words."""
    checks = [count_of(q, "(") != count_of(q, ")"), count_of(q, '"') % 2 != 0, q.contains("()"), q.contains("OR OR") | q.contains("AND AND"), q.rlike(r"\b(NEAR|ADJ|adj|near)\b")]
    return sum((F.when(c, 1).otherwise(0) for c in checks[1:]), F.when(checks[0], 1).otherwise(0))


def max_depth(q: Column) -> Column:
    """Deepest nesting of parentheses; a surplus closing one does not go below zero."""
    marks = F.regexp_extract_all(q, F.lit("([()])"), 1)
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, ch: Column) -> Column:
        now = F.when(ch == "(", acc["now"] + 1).otherwise(F.greatest(acc["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(marks, zero, step, lambda acc: acc["top"])


def tokens(q: Column) -> Column:
    """Number of words between blanks."""
    return F.size(F.filter(F.split(q, r"\s+"), lambda t: t != ""))


def simplicity_penalty(chars: Column, words: Column, depth: Column, max_chars: int = 2000, max_words: int = 250, deepest: int = 6) -> Column:
    over = lambda v, limit: F.greatest(v - limit, F.lit(0))
    return over(chars, max_chars) / max_chars + 0.5 * over(words, max_words) / max_words + 0.5 * over(depth, deepest)


def burden(results: Column, least: int = 50, target: int = 5000) -> Column:
    return F.when(results < least, -1.0).otherwise(F.greatest(F.lit(-1.0), 1 - F.abs(results - target) / max(target, 1)))


def selector_score(coverage: Column, burden_: Column, lint_: Column, vocabulary: Column, simplicity: Column) -> Column:
    return 2.0 * coverage + burden_ - 0.5 * lint_ - vocabulary - simplicity


def mesh_headings(q: Column) -> Column:
    """Distinct headings of ``"X"[mh]``, ``[MeSH Terms]`` (with or without ``:noexp``) and ``[majr]``, sorted."""
    found = F.concat(F.regexp_extract_all(q, F.lit(r'(?i)"([^"]+)"\[(?:mh|MeSH Terms)(?::noexp)?\]'), 1), F.regexp_extract_all(q, F.lit(r'(?i)"([^"]+)"\[majr\]'), 1))
    return F.array_sort(F.array_distinct(found))


def vocabulary_penalty(invalid: Column, late: Column) -> Column:
    """0.5 for every unknown heading and 0.25 for every one introduced after the search window."""
    return 0.5 * invalid + 0.25 * late


def query_type(comment: Column) -> Column:
    """The type that a query's comment names: ``Query N: TYPE - text``, ``Query N - TYPE: text``, ``TYPE: text``."""
    c = F.trim(F.regexp_replace(comment, "^#+", ""))
    pick = lambda pattern: F.trim(F.regexp_extract(c, pattern, 1))
    numbered = pick(r"(?i)^Query\s+\d+\s*:\s*(.+?)(?:\s+-\s+.*|\s*)$")
    dashed = pick(r"(?i)^Query\s+\d+\s*-\s*(.+?)(?:\s*:\s+.*|\s*)$")
    plain = pick(r"^(.+?)(?:\s*[-:]\s+.*|\s*)$")
    known = ~F.lower(plain).isin("note", "notes", "important", "warning", "example", "examples", "")
    return F.when(numbered != "", numbered).when(dashed != "", dashed).when(known, plain)


def features(q: Column) -> Column:
    """Sorted names of the features a query shows: filters, subject headings, title/abstract fields, proximity,
    truncation, negation."""
    flags = {
        "date_filter": q.rlike(r"(?i)pubyear|\[(?:edat|dp|date - publication)\]|\bPY="), "field_tags": q.rlike(r"(?i)\[(?:tiab|ti|tw)\]|:ti|TITLE-ABS"), "negation": q.rlike(r"\bNOT\b"),
        "proximity": q.rlike(r"(?i)\b(?:NEAR|ADJ|W)/?\d"), "subject_headings": q.rlike(r"(?i)\[(?:mh|mesh|mesh terms|majr)"), "truncation": q.contains("*"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(flags.items())]))


# Feature -> (marks as written, marks in lower case) that show it in a query.
PROFILE = {
    "controlled vocabulary": (("[Mesh]", "[Majr]", "[mh]", "/exp", "/de", ".mp.", " exp "), ()),
    "fielded free text": ((), ("[tiab]", "title-abs-key(", "ts=(", ":ti,ab", ".ti,ab.")),
    "population restriction": ((), ("child", "adolescent", "pediatric", "paediatric", "adult", "aged", "women", "men")),
    "design or analytic restriction": ((), ("cohort", "prospective", "retrospective", "trial", "observational", "cross-sectional", "case-control", "sensitivity and specificity", "diagnos", "valid", "agreement")),
    "filter layer": ((), ("english", "language", "humans[filter]", "doctype(", "dt=(article", "review[pt]", "publication type")),
}


def profile(q: Column) -> Column:
    """Sorted names of the published feature profile that a query shows."""
    has = lambda exact, lower: functools.reduce(Column.__or__, [*[q.contains(t) for t in exact], *[F.lower(q).contains(t) for t in lower]])
    return F.array_compact(F.array(*[F.when(has(*PROFILE[n]), F.lit(n)) for n in sorted(PROFILE)]))


def profile_delta(first: Column, second: Column) -> Column:
    """How the second query's profile differs from the first's, as a sentence."""
    added, removed = F.array_sort(F.array_except(second, first)), F.array_sort(F.array_except(first, second))
    say = lambda verb, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{verb} "), F.array_join(names, ", ")))
    same = "Q2 preserves the same feature profile as Q1 and mainly tightens wording or synonym scope."
    return F.when(F.size(added) + F.size(removed) == 0, F.lit(same)).otherwise(F.concat(F.lit("Q2 "), F.concat_ws(" and ", say("adds", added), say("drops", removed)), F.lit(".")))


def short_query(q: Column, limit: int = 220) -> Column:
    """The query with blanks squeezed, cut to ``limit`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(q, r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def blocks(q: Column) -> Column:
    """Number of concept blocks: occurrences of `` AND `` plus one."""
    return count_of(q, " AND ") + 1


def query_id(q: Column) -> Column:
    return F.sha2(q, 256)


def year_filter(q: Column, provider: str, first: int, last: int) -> Column:
    """The query with the provider's year filter unless it has one."""
    if provider == "scopus":
        return F.when(F.lower(q).contains("pubyear"), q).otherwise(F.concat(F.lit("("), q, F.lit(f") AND PUBYEAR > {first - 1} AND PUBYEAR < {last + 1}")))
    if provider in ("wos", "web_of_science"):
        return F.when(F.upper(q).contains("PY="), q).otherwise(F.concat(F.lit("("), q, F.lit(f") AND PY=({first}-{last})")))
    return q


def build_query(terms: list[list[str]], database: str) -> str:
    """A query from concept blocks: terms joined by OR, blocks by AND, quoted and tagged for the database."""
    wrap = {"pubmed": '"{}"[tiab]', "scopus": '"{}"', "wos": '"{}"', "embase": "'{}':ti,ab"}[database]
    text = " AND ".join("(" + " OR ".join(wrap.format(t) for t in block) + ")" for block in terms)
    return {"scopus": f"TITLE-ABS-KEY({text})", "wos": f"TS=({text})"}.get(database, text)


def concept_coverage(queries: DataFrame, keys: list[str], text: str, concepts: dict[str, list[str]]) -> DataFrame:
    """Per query the share of concepts with a term that matches, 0 without concepts. ``concepts`` is configuration
    (a few dozen patterns), so it is part of the plan: one pass, no join."""
    hits = [F.when(F.greatest(*[F.col(text).rlike(f"(?i){p}") for p in ps], F.lit(False)), 1).otherwise(0) for ps in concepts.values()]
    total = sum(hits, F.lit(0))
    return queries.select(*keys, (total / max(len(concepts), 1)).cast("double").alias("coverage"))


def date_range(text: Column) -> Column:
    """(start, end) of a query's publication window: two dated bounds, else two entry years; null without either."""
    bound = r'"(\d{4}/\d{2}/\d{2})"\[Date - Publication\]'
    full = bound + r"\s*:\s*" + bound
    years = r"\((\d{4}):(\d{4})\[edat\]\)"
    day = lambda i: F.replace(F.regexp_extract(text, full, i), F.lit("/"), F.lit("-"))
    year = lambda i: F.regexp_extract(text, years, i)
    return F.when(day(1) != "", F.struct(day(1).alias("start"), day(2).alias("end"))).when(year(1) != "", F.struct(F.concat(year(1), F.lit("-01-01")).alias("start"), F.concat(year(2), F.lit("-12-31")).alias("end")))


def domain(name: Column, text: Column, keywords: dict[str, list[str]], default: str = "general medicine") -> Column:
    """The domain whose keyword is in the study's name, else the one with most keyword occurrences in the text (the
    first of equals), else ``default``. ``keywords`` is configuration."""
    low_name, low = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    by_name = [F.when(F.greatest(*[low_name.contains(k) for k in ks], F.lit(False)), F.lit(d)) for d, ks in keywords.items()]
    counts = {d: sum((count_of(low, k) for k in ks), F.lit(0)) for d, ks in keywords.items()}
    top = F.greatest(*counts.values(), F.lit(0))
    by_text = [F.when((c == top) & (top > 0), F.lit(d)) for d, c in counts.items()]
    return F.coalesce(*by_name, *by_text, F.lit(default))
