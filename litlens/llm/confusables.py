"""Texts that look the same although their characters differ: confusables skeletons.

A skeleton is made in three steps: canonical decomposition, replacement of every character by the prototype of
the look-alike table, decomposition again. Texts with equal skeletons look the same when displayed. The table
covers what makes *no* visible difference (width of letters and blanks, ligatures, roman-numeral characters,
letters of other scripts with the same shape, characters that do not show); letter case, accents, super- and
subscripts, dashes of different length and quotes stay different. Most of the table follows from the character
database by rule. The letters shared by shape between scripts are those of the Unicode look-alike data, which the
driver asks the spoof checker of Spark's own ICU library for, once a session; a small list stands in without a session.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.llm.text import LOOK_ALIKES

# Decomposition tags of the character database that keep the look; blanks and ligatures are <compat>.
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U000e0000-\U000e0fff]")
_BLANKS = re.compile(r"\s+")
#: Characters that stand for themselves, so a text of these only needs its blanks squeezed.
PLAIN = r"^[\x20-\x7e]*$"


# Scripts whose letters are drawn as Latin ones where the look-alike data says so, and the small Greek
# letters of which that is true; the others (alpha, gamma, iota, rho, sigma, upsilon) visibly differ from a, y, i, p, o, u.
SCRIPTS = ("ARMENIAN", "CHEROKEE", "COPTIC", "CYRILLIC", "GEORGIAN", "GREEK", "LISU", "TIFINAGH")
_SMALL_GREEK = "οϳν"
_LETTERS: dict[str, str] = {}


def lookalike_letters(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts and the one Latin letter each looks like, by the session's ICU look-alike data.

    The data gives capital I, small l and 1 one prototype, which visibly differ here; so a capital with it becomes I.
    """
    if not _LETTERS:
        found = [chr(c) for c in range(0x370, 0x110000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and unicodedata.name(chr(c), "").startswith(SCRIPTS)]
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        for char, like in zip(found, checker.getSkeleton("\n".join(found)).split("\n"), strict=True):
            kind = unicodedata.category(char)
            if unicodedata.name(char).startswith("GREEK SMALL") and char not in _SMALL_GREEK:
                continue
            if like == "l" and kind != "Ll":
                like = "I"
            if len(like) == 1 and like.isascii() and like.isalpha():
                _LETTERS[char] = like
        _LETTERS.update(LOOK_ALIKES)
    return _LETTERS


class _Table(dict):
    """Prototypes by code point, found by rule at first use; ``letters`` come first."""

    def __init__(self, letters: dict[str, str]):
        super().__init__()
        self.letters = letters

    def __missing__(self, code: int):
        char = chr(code)
        out = self.letters.get(char)
        if out is None:
            tag, _, rest = unicodedata.decomposition(char).partition(" ")
            category = unicodedata.category(char)
            if category in ("Zs", "Zl", "Zp"):
                out = " "
            elif category in ("Cc", "Cf") and not char.isspace():
                out = ""
            elif tag in _SAME_LOOK and rest and not (tag == "<compat>" and category in ("So", "No")):  # No. and (1) in one character are drawn otherwise
                out = "".join(self[int(x, 16)] if int(x, 16) != code else chr(int(x, 16)) for x in rest.split())
            else:
                out = char
        self[code] = out
        return out


def skeleton_text(text: str, table: dict | None = None) -> str:
    """The skeleton of one text."""
    text = unicodedata.normalize("NFD", _INVISIBLE.sub("", text)).translate(_TABLE if table is None else table)
    return _BLANKS.sub(" ", unicodedata.normalize("NFD", text)).strip()


_TABLE = _Table(LOOK_ALIKES)


def skeleton(col: Column) -> Column:
    """Skeleton of a text column: null for null, empty for texts that show nothing. Only texts with characters
    beyond plain ASCII go to Python, in Arrow batches; the others are squeezed in the JVM."""
    letters = dict(lookalike_letters(SparkSession.active()))

    @F.pandas_udf(T.StringType())
    def skeletons(texts: pd.Series) -> pd.Series:
        table = _Table(letters)
        return texts.map(lambda t: skeleton_text(t, table), na_action="ignore").astype(object)

    plain = F.trim(F.regexp_replace(col, "[\\x00-\\x20]+", " "))
    return F.coalesce(skeletons(F.when(~col.rlike(PLAIN), col)), plain)


def lookalike_pairs(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """(left_id, right_id) of rows whose texts have equal skeletons but are different strings.

    Null texts, texts that show nothing and spellings of a missing value (``nan``, ``none``) match nothing;
    repeated rows give repeated pairs; extra columns and equal column names on both sides do not matter.
    Strings are paired before rows: each side is reduced to distinct (skeleton, string) digests, so a title that
    a third of all rows share is one row there, and pairs of equal strings are never formed. Only 128-bit
    digests and ids are shuffled.
    """

    def rows(df: DataFrame, key: str, text: str) -> DataFrame:
        return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")

    def digest(col: Column) -> Column:
        return F.unhex(F.md5(col))

    def variants(df: DataFrame, name: str) -> DataFrame:
        made = df.select(skeleton(F.col("text")).alias("s"), digest(F.col("text")).alias(name))
        return made.where(~F.lower("s").isin("", "nan", "none")).select(digest(F.col("s")).alias("s"), name).distinct()

    a, b = rows(left, left_id, left_text), rows(right, right_id, right_text)
    pairs = variants(a, "ta").join(variants(b, "tb"), "s").where("ta <> tb").select("ta", "tb")
    ids_a = a.select(digest(F.col("text")).alias("ta"), F.col("id").alias("__a"))
    ids_b = b.select(digest(F.col("text")).alias("tb"), F.col("id").alias("__b"))
    return pairs.join(ids_a, "ta").join(ids_b, "tb").select(F.col("__a").alias(left_id), F.col("__b").alias(right_id))
