"""Titles and journals of articles: normal form, kind of work, and agreement of two descriptions."""

from __future__ import annotations

import html
import re
import unicodedata

from litlens.llm.name_parts import fold, parse, within_one
from litlens.llm.text import LOOK_ALIKES

# What marks a work about another work, or another stage of it, before or after its title.
ABOUT_BEFORE = re.compile(r"^(correction|corrigendum|erratum|addendum|retraction|reply|response|comment|commentary|letter|protocol|study protocol|authors reply|editorial)(?: (?:to the editor on|to|on|for|of|regarding))?(?= )")
ABOUT_AFTER = re.compile(r" (conference abstract|meeting abstract|poster abstract|abstract|poster|study protocol|protocol|erratum|correction|reply|comment|response)$")
AFTER_ENDS = ("abstract", "poster", "protocol", "erratum", "correction", "reply", "comment", "response")
PART = re.compile(r" (?:part|pt) ([ivx]+|\d+)(?= |$)")

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
# Combining marks and characters that do not show, by code range.
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u061c\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u200b-\u200f\u202a-\u202e\u2060-\u2064\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\ufeff]")
_SHAPES = str.maketrans(LOOK_ALIKES)
# the small forms of look-alike capitals too, so a shouted title (IL-1Β, 5 ΜG) meets its plain spelling (IL-1β, 5 μg)
_SMALL = {ord(c.casefold()): latin.casefold() for c, latin in LOOK_ALIKES.items() if len(c.casefold()) == 1 and not c.isascii()}
KINDS = {"correction": "erratum", "corrigendum": "erratum", "response": "reply", "authors reply": "reply", "commentary": "comment", "study protocol": "protocol", "meeting abstract": "conference abstract", "poster abstract": "conference abstract", "abstract": "conference abstract", "poster": "conference abstract"}


def title_form(title: str) -> tuple[str, str, str, bool]:
    """(words, kind, part, cut): the words of the title itself; kind is empty for an article of its own; cut is
    whether the title ends in an ellipsis. Markup, case, accents, look-alike and invisible characters, ``&`` and
    hyphens do not count."""
    text = html.unescape(title) if "&" in title else title
    text = (_TAG.sub("", text) if "<" in text else text).replace("&", " and ")
    if text.isascii():
        words = " ".join(_WORD.findall(text.lower()))
    else:
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
        words = " ".join(w.casefold() if w.isascii() else _plain_word(w) for w in _WORD.findall(text))
    cut, kind = text.rstrip().endswith("..."), ""
    for pattern in (ABOUT_BEFORE, ABOUT_AFTER):
        if m := pattern.search(words):
            kind = KINDS.get(m[1], m[1])
            words = pattern.sub("", words).strip()
    if words in ("", "nan", "none", "null"):
        return "", kind, "", cut
    part = (m := PART.search(f" {words}")) and m[1] or ""
    return words, kind, part, cut


def _plain_word(word: str) -> str:
    """A word in small letters with look-alike letters made Latin, whichever case they were in."""
    return word.translate(_SHAPES).casefold().translate(_SMALL)


def surname(author: str | None) -> str:
    """The folded family part of an author as typed, both with ``/`` between where the order of names is open,
    empty where there is none; groups give their proper name."""
    found = parse(author) if author else None
    return "/".join(dict.fromkeys(f for f, _ in found[1])) if found else ""


def surnames_agree(a: str, b: str) -> bool:
    """Whether any reading of two authors' family parts is the same but for typos."""
    return any(p == q or within_one(p, q) or (min(len(p), len(q)) >= 7 and _words_agree(p, q) < 9) for p in a.split("/") for q in b.split("/"))


def _words_agree(a: str, b: str) -> float:
    """0 same, 1 a typo apart, more: another word."""
    if a == b:
        return 0.0
    if len(a) < 4 or len(b) < 4 or a.isdigit() or b.isdigit():
        return 9.0
    if within_one(a, b):
        return 1.0
    if min(len(a), len(b)) >= 7 and a[0] == b[0] and within_two(a, b):
        return 1.6
    return 9.0


def within_two(a: str, b: str) -> bool:
    """Whether at most two typos lie between two words: a letter more, less or other, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 2 or len(set(a) ^ set(b)) > 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    before, row = [9] * (len(y) + 1), list(range(len(y) + 1))
    for p in range(1, len(x) + 1):
        fresh = [p]
        for q in range(1, len(y) + 1):
            cost = min(row[q] + 1, fresh[q - 1] + 1, row[q - 1] + (x[p - 1] != y[q - 1]))
            if p > 1 and q > 1 and x[p - 1] == y[q - 2] and x[p - 2] == y[q - 1]:
                cost = min(cost, before[q - 2] + 1)
            fresh.append(cost)
        if min(fresh) > 2:
            return False
        before, row = row, fresh
    return row[-1] <= 2


def title_score(a: str, b: str, cut_a: bool = False, cut_b: bool = False) -> float:
    """Log-odds from two titles' words: one must be the other or a beginning of it, typos aside. Titles of under
    four words ("Editorial") are shared by many works, so author, year and journal decide; under three words, a
    beginning of another title says nothing."""
    x, y = a.split(), b.split()
    if len(x) > len(y):
        x, y, cut_a, cut_b = y, x, cut_b, cut_a
    n = len(x)
    if not n or n < 3 and n < len(y):
        return -9.0
    typos = 0.0
    for i, (p, q) in enumerate(zip(x, y, strict=False)):
        d = _words_agree(p, q)
        if d >= 9.0:
            if i == n - 1 and n < len(y) and cut_a and q.startswith(p):
                continue
            return -9.0
        typos += d
    if typos > max(2.0, 0.25 * n):
        return -9.0
    known = min(4.0, 0.35 * n) if n < len(y) else 4.5 if n >= 4 else -1.0
    return known - 0.4 * typos


def _one_less(text: str) -> set[str]:
    """The text and its remainders without one letter, of which two texts within one typo share one; the ends of
    long texts."""
    rests = {text[:i] + text[i + 1 :] for i in range(len(text) + 1)} if len(text) <= 41 else set()
    return rests | ({"^" + text[:20], "$" + text[-20:]} if len(text) >= 40 else set())


def short_keys(words: str, author: str, year: int | None, initials: str | None) -> list[str]:
    """Blocking keys of a title of under four words: the title with a family name, either of them with a typo, or
    with year and journal, the least besides an equal title that reaches even odds without author."""
    keys = set()
    for s in filter(None, author.split("/")):
        keys |= {f"sn|{words}|{rest}" for rest in _one_less(s)} | {f"sa|{words}|{s[:4]}", f"sz|{words}|{s[-4:]}"}
        keys |= {f"sr|{rest}|{s[:4]}" for rest in _one_less(words)}
    if year and initials:
        keys.add(f"sd|{words}|{year}|{initials}")
    return sorted(keys)


def _journal_words(journal: str) -> list[str]:
    return [w for w in _WORD.findall(fold(journal)) if w not in ("of", "the", "and", "for", "in")]


def journal_initials(journal: str) -> str | None:
    """The initials of a journal's words, which its abbreviations keep; a single short word is taken for initials."""
    w = _journal_words(journal)
    return (w[0] if len(w) == 1 and len(w[0]) <= 5 else "".join(t[0] for t in w)) or None


def journals_agree(a: str, b: str) -> bool:
    """Whether two journal names can be the same, one or both abbreviated word by word."""
    x, y = _journal_words(a), _journal_words(b)
    if len(x) == len(y):
        return all(p.startswith(q) or q.startswith(p) or within_one(p, q) for p, q in zip(x, y, strict=True))
    if len(x) == 1 or len(y) == 1:  # initials
        one, many = (x, y) if len(x) == 1 else (y, x)
        return one[:1] == ["".join(w[0] for w in many)]
    return False


def description_score(title: float, same_author: bool | None, years_apart: int | None, same_journal: bool | None) -> float:
    """Log-odds that two descriptions are of one article: the title's plus those of author, year and journal, each
    None where either description lacks it."""
    score = title - 2.0
    if same_author is not None:
        score += 3.5 if same_author else -4.0
    if years_apart is not None:
        score += {0: 2.0, 1: 1.0, 2: -1.5}.get(years_apart, -3.5)
    if same_journal is not None:
        score += 1.5 if same_journal else -1.5
    return score
