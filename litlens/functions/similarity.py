"""String similarities: indel ratio, sorted-token ratio, Ratcliff-Obershelp, in the JVM and in Arrow batches."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, as one expression; for short strings (rebuilds a row per letter)."""
    letters = F.filter(F.split(b, ""), lambda c: c != "")
    start = F.transform(F.sequence(F.lit(0), F.length(a)), lambda _: F.lit(0))

    def step(row: Column, ch: Column) -> Column:
        # row[i] is the value for the first i letters of a; the new row is built from left to right
        def grow(acc: Column, i: Column) -> Column:
            left = F.element_at(acc, -1)
            match = F.get(row, i - 1) + 1
            return F.concat(acc, F.array(F.when(F.substring(a, i, 1) == ch, match).otherwise(F.greatest(left, F.get(row, i)))))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.array(F.lit(0)), grow)

    done = F.element_at(F.aggregate(letters, start, step), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(done)


def ratio(a: Column, b: Column) -> Column:
    """200 times the common subsequence over the lengths together; 100 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common_subsequence(a, b) / total)


def sorted_tokens(col: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(col, r"\s+"), lambda t: t != "")), " ")


def indel_ratio(a: str, b: str) -> float:
    """The same ratio for one pair: bit-parallel, a word of bits per letter of ``a``."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def extraction_similarity(a: tuple, b: tuple) -> float:
    """0.7 title + 0.2 author + 0.1 for the year (half for one off) of two extracted (title, first author, year);
    a year that only one has counts as different."""
    title, author = (indel_ratio(x.lower(), y.lower()) / 100 if x and y else 0.0 for x, y in zip(a[:2], b[:2], strict=True))
    year = 1.0 if a[2] == b[2] else 0.5 if a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 1 else 0.0
    return 0.7 * title + 0.2 * author + 0.1 * year


@F.pandas_udf(T.DoubleType())
def ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_sort_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    tidy = lambda s: " ".join(sorted(s.split()))
    return pd.Series([None if x is None or y is None else indel_ratio(tidy(x), tidy(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def obershelp_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of texts in lower case without ``et al``, commas, points and semicolons."""
    clean = lambda s: re.sub(r"\s+", " ", re.sub(r"et al|[,.;]", "", s.lower())).strip()
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, clean(x), clean(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def normal_title(text: str) -> str:
    """Entities decoded, accents dropped, everything but letters and digits a blank, lower case; other scripts stay."""
    bare = "".join(c for c in unicodedata.normalize("NFD", html.unescape(text)) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[\W_]+", " ", bare).lower().split())


def normal_author(text: str) -> str:
    """The part before a comma, else the last word; unaccented ASCII letters in lower case."""
    bare = "".join(c for c in unicodedata.normalize("NFD", html.unescape(text)) if not unicodedata.combining(c))
    part = bare.split(",")[0] if "," in bare else (bare.split() or [""])[-1]
    return re.sub(r"[^a-zA-Z]", "", part).lower()


@F.pandas_udf(T.StringType())
def title_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda t: normal_title(t or ""))


@F.pandas_udf(T.StringType())
def author_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda t: normal_author(t or ""))


def title_native(col: Column) -> Column:
    """The title normaliser without accents and entities, in the JVM (exact on text without either)."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\p{L}\p{M}\p{N}]+", " ")))


def year_of(col: Column) -> Column:
    """The first four digits that stand alone, where they are from 1000 to 2100; numbers are cut to integers."""
    text = F.regexp_replace(col.cast("string"), r"^(\d+)\.0*$", "$1")
    y = F.regexp_extract(text, r"\b(\d{4})\b", 1)
    return F.when(y.rlike("^(1[0-9]{3}|20[0-9]{2}|2100)$"), y.cast("int"))


def study_similarity(title: Column, author: Column, year_a: Column, year_b: Column) -> Column:
    """0.7 title + 0.2 author (ratios of 0..1) + 0.1 for the year (half for one off)."""
    return 0.7 * title + 0.2 * author + F.when(year_a == year_b, 0.1).when(F.abs(year_a - year_b) == 1, 0.05).otherwise(0.0)


def repair_pdf_title(col: Column) -> Column:
    """Ligature names, a split word and lost hyphens of extracted titles put right."""
    s = F.regexp_replace(F.regexp_replace(col, "/?uniFB01", "fi"), "/?uniFB02", "fl")
    s = F.regexp_replace(s, r"(?i)Barore\s+fl?\s*ex", "Baroreflex")
    s = F.regexp_replace(s, r"(?i)(Twenty|Thirty|Forty|Fifty)-(four|five|six|seven|eight|nine)hour", "$1-$2-hour")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)(\d+)(hour|day|week|month|year)(?!-)", "$1-$2"), r"\s+", " "))


def clean_title(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(repair_pdf_title(col), r"[^\p{L}\p{M}\p{N}_\s-]", " "), r"\s+", " "))


def last_name(col: Column) -> Column:
    """The word before a closing one-letter initial, else the first word."""
    parts = F.filter(F.split(F.trim(col), r"\s+"), lambda t: t != "")
    return F.when(F.size(parts) == 0, col).when(F.length(F.element_at(parts, -1)) == 1, F.get(parts, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.get(parts, F.lit(0)))
