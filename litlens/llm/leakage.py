"""Held-out passages inside training text, found with a generalised suffix automaton over words.

The test items are few: their words build one automaton on the driver, or several where there are very many, each of
a bounded number of words, and each is broadcast as flat arrays. The corpus is streamed once an automaton, document by
document, without a shuffle: the automaton gives the longest match ending at every word. Items and texts are brought
to one form first (compatibility composition, no invisible characters, case folded).
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INLINE = re.compile(r"</?(?:a|abbr|b|em|font|i|mark|small|span|strong|sub|sup|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"([^\W_]+)[-­‐‑][ \t\xa0]*\r?\n\s*([^\W_]+)")


# Characters that do not show; a soft hyphen at a line end breaks a word and stays.
_UNSEEN = re.compile("[\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]|\u00ad(?![ \t\xa0]*\r?\n)")
_CLUSTER = re.compile("[\x00-\x7f]*[\x00-\x7f](?=[\x00-\x7f])|[\x00-\x7f]$|.[\u0300-\u036f\u1160-\u11ff\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]*", re.S)


def _one_form(text: str, offsets: bool) -> tuple[str, list[int] | None]:
    """The text without invisible characters and in compatibility composition, and where each of its characters
    stands in ``text`` (None where nothing changed or no offsets are asked for)."""
    if text.isascii() or unicodedata.is_normalized("NFKC", text) and not _UNSEEN.search(text):
        return text, None
    if not offsets:
        return unicodedata.normalize("NFKC", _UNSEEN.sub("", text)), None
    gone = {m.start() for m in _UNSEEN.finditer(text)}
    keep = [i for i in range(len(text)) if i not in gone]
    bare, out, at = "".join(text[i] for i in keep), [], []
    for m in _CLUSTER.finditer(bare):
        if m[0].isascii():
            out.append(m[0])
            at.extend(keep[m.start() : m.end()])
        else:
            form = unicodedata.normalize("NFKC", m[0])
            out.append(form)
            at.extend([keep[m.start()]] * len(form))
    return "".join(out), at


def words(text: str, known: set[str] | dict | None = None, offsets: bool = True) -> list[tuple[str, int, int]]:
    """(word with its case folded, start, end) of every run of letters and digits; ``offsets`` refer to ``text`` (to
    its plain form, if not asked for).

    Characters that do not show, full-width and decomposed forms make no difference. Tags in angle brackets vanish
    (inline ones join what they divide, others divide). A word broken by a hyphen at a line end is one word if the
    whole word is in ``known`` (any, where ``known`` is None), else two.
    """
    plain, at = _one_form(text, offsets)
    found = _words(plain, known)
    return found if at is None else [(w, at[s], at[e] if e < len(at) else len(text)) for w, s, e in found]


def _words(text: str, known: set[str] | dict | None) -> list[tuple[str, int, int]]:
    if "<" in text:
        # a tag becomes characters that are no words; inline tags inside a word are cut out with an offset map
        if re.search(r"[^\W_]</?(?:a|abbr|b|em|font|i|mark|small|span|strong|sub|sup|u)(?:\s[^<>]*)?/?>[^\W_]", text, re.I):
            return _mapped(text, known)
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    out = [(m[0].casefold(), m.start(), m.end()) for m in _WORD.finditer(text)]
    return _join(out, text, known) if "\n" in text and _BREAK.search(text) else out


def _mapped(text: str, known) -> list[tuple[str, int, int]]:
    keep, at = [], 0
    for m in _INLINE.finditer(text):
        keep.extend(range(at, m.start()))
        at = m.end()
    keep.extend(range(at, len(text)))
    flat = _TAG.sub(lambda m: " " * len(m[0]), "".join(text[i] for i in keep))
    out = [(m[0].casefold(), m.start(), m.end()) for m in _WORD.finditer(flat)]
    return [(w, keep[s], keep[e - 1] + 1) for w, s, e in (_join(out, flat, known) if _BREAK.search(flat) else out)]


def _join(out: list[tuple[str, int, int]], text: str, known) -> list[tuple[str, int, int]]:
    joins = {m.start(2): (m[1] + m[2]).casefold() for m in _BREAK.finditer(text)}
    done: list[tuple[str, int, int]] = []
    for w, s, e in out:
        whole = joins.get(s)
        if whole and done and (known is None or whole in known):
            done[-1] = (whole, done[-1][1], e)
        else:
            done.append((w, s, e))
    return done


class SuffixAutomaton:
    """All word sequences that occur in the items, as states with longest length, suffix link, edges and items.

    Built with one dict a state, then laid out flat: a state's edges are a slice of two arrays, sorted by word, its
    items a slice of a third. Flat it takes about 50 bytes an item word besides the vocabulary.
    """

    def __init__(self, items: dict[int, list[str]]):
        self.vocabulary: dict[str, int] = {}
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        ends: list[set[int]] = [set()]
        for number, sequence in enumerate(items.values()):
            last = 0
            for w in sequence:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), ends)
                ends[last].add(number)
        for v in sorted(range(1, len(self._length)), key=self._length.__getitem__, reverse=True):
            if self._link[v] > 0:
                ends[self._link[v]] |= ends[v]
        self.keys = list(items)
        self.link, self.length = array("i", self._link), array("i", self._length)
        self.first, self.word, self.target = array("i", [0]), array("i"), array("i")
        self.first_item, self.item = array("i", [0]), array("i")
        for edges, owners in zip(self._next, ends, strict=True):
            for c in sorted(edges):
                self.word.append(c)
                self.target.append(edges[c])
            self.first.append(len(self.word))
            self.item.extend(sorted(owners))
            self.first_item.append(len(self.item))
        del self._next, self._link, self._length

    @classmethod
    def of(cls, parts: dict) -> SuffixAutomaton:
        """The automaton of broadcast parts (plain arrays and dicts, so workers need no class to read them)."""
        machine = cls.__new__(cls)
        machine.__dict__.update(parts)
        return machine

    def _state(self, length: int, nxt: dict[int, int], link: int, ends: list[set[int]]) -> int:
        self._next.append(nxt)
        self._length.append(length)
        self._link.append(link)
        ends.append(set())
        return len(self._next) - 1

    def _split(self, p: int, q: int, c: int, ends: list[set[int]]) -> int:
        clone = self._state(self._length[p] + 1, dict(self._next[q]), self._link[q], ends)
        self._link[q] = clone
        while p >= 0 and self._next[p].get(c) == q:
            self._next[p][c] = clone
            p = self._link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        q = self._next[last].get(c)
        if q is not None:  # this item repeats what an earlier one has
            return q if self._length[q] == self._length[last] + 1 else self._split(last, q, c, ends)
        new, p = self._state(self._length[last] + 1, {}, 0, ends), last
        while p >= 0 and c not in self._next[p]:
            self._next[p][c] = new
            p = self._link[p]
        if p >= 0:
            q = self._next[p][c]
            self._link[new] = q if self._length[q] == self._length[p] + 1 else self._split(p, q, c, ends)
        return new

    def matches(self, sequence: list[str], at_least: int) -> list[tuple[int, int, int]]:
        """(position of the last word, longest match ending there, state) wherever it has ``at_least`` words."""
        first, word, target, link, length, ids = self.first, self.word, self.target, self.link, self.length, self.vocabulary.get
        out, state, run = [], 0, 0
        for i, w in enumerate(sequence):
            c = ids(w)
            if c is None:
                state = run = 0
                continue
            while True:
                a, b = first[state], first[state + 1]
                if b - a > 1:
                    a = bisect_left(word, c, a, b)
                if a < b and word[a] == c:
                    state, run = target[a], run + 1
                    if run >= at_least:
                        out.append((i, run, state))
                    break
                if not state:
                    break
                state = link[state]
                run = length[state]
        return out

    def leaks(self, sequence: list[str], at_least: int) -> tuple[dict[int, int], dict[int, int]]:
        """({item: its longest match in words}, {item: words of the sequence in any match with it})."""
        best: dict[int, int] = {}
        covered: dict[int, int] = {}
        until: dict[int, int] = {}
        for i, run, state in self.matches(sequence, at_least):
            v, n, seen = state, run, set()
            while n >= at_least:  # suffixes that more items share
                for k in self.item[self.first_item[v] : self.first_item[v + 1]]:
                    if k not in seen:
                        seen.add(k)
                        key = self.keys[k]
                        best[key] = max(best.get(key, 0), n)
                        covered[key] = covered.get(key, 0) + i - max(until.get(key, -1), i - n)
                        until[key] = i
                v = self.link[v]
                n = self.length[v] if v > 0 else 0
        return best, covered

    def spans(self, sequence: list[str], at_least: int) -> list[tuple[int, int]]:
        """(first word, last word) of the matched stretches, merged."""
        out: list[tuple[int, int]] = []
        for i, run, _ in self.matches(sequence, at_least):
            start = i - run + 1
            while out and out[-1][1] >= start - 1:
                start = min(start, out.pop()[0])
            out.append((start, i))
        return out


def build(items: DataFrame, item_id: str, item_text: str, shard_words: int = 500_000) -> Iterator[SuffixAutomaton]:
    """Automata of all items, each of whole items with about ``shard_words`` words together. Null and empty items add
    nothing. Items reach the driver one by one; only the dicts of one automaton being built are held there."""
    rows = items.select(F.col(f"`{item_id}`").alias("k"), F.col(f"`{item_text}`").alias("t")).where("k is not null and t is not null")
    # rows of one id stay together; a separator that no text holds keeps matches from running across them
    grouped = rows.groupBy("k").agg(F.collect_list("t").alias("t"))
    found: dict[int, list[str]] = {}
    size = 0
    for k, texts in grouped.toLocalIterator():
        found[k] = [w for n, t in enumerate(texts) for w in (*(w for w, _, _ in words(t, None, False)), f"\0{len(found)}.{n}")]
        size += len(found[k])
        if size >= shard_words:
            yield SuffixAutomaton(found)
            found, size = {}, 0
    if found:
        yield SuffixAutomaton(found)


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 12, shard_words: int = 500_000) -> DataFrame:
    """``doc_id``, ``item_id``, ``longest`` (words), ``coverage`` (share of the document's words in leaks of the item).

    One row per document and item that share at least ``min_words`` consecutive words. Null, empty and short
    texts give no rows; repeated documents give repeated rows; ids keep their types; other columns are ignored. Items
    of more than ``shard_words`` words together are searched for in several passes over the corpus.
    """
    spark = docs.sparkSession
    kinds = (docs.schema[doc_id].dataType, items.schema[item_id].dataType)
    schema = T.StructType([T.StructField(doc_id, kinds[0]), T.StructField(item_id, kinds[1]), T.StructField("longest", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    source = docs.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").alias("t")).where(F.length("t") >= 2 * min_words - 1)

    def searched(automaton) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = SuffixAutomaton.of(automaton.value)
            for batch in batches:
                rows = []
                for key, t in zip(batch["k"], batch["t"], strict=True):
                    sequence = [w for w, _, _ in words(t, machine.vocabulary, False)]
                    best, covered = machine.leaks(sequence, min_words)
                    rows += [(key, item, n, covered[item] / len(sequence)) for item, n in best.items()]
                yield pd.DataFrame(rows, columns=[doc_id, item_id, "longest", "coverage"])

        return source.mapInPandas(scan, schema)

    out = None
    for machine in build(items, item_id, item_text, shard_words):
        found = searched(spark.sparkContext.broadcast(vars(machine)))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def remove_leaks(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 12, max_coverage: float = 0.5, shard_words: int = 500_000) -> DataFrame:
    """All rows and columns of ``docs`` plus ``clean_text``: leaked spans cut out, null where leaks cover more
    than ``max_coverage`` of the words (such a document should go). Null texts stay null, others without a leak
    stay as they are."""
    spark, col = docs.sparkSession, F.col(f"`{text}`")

    def spans(automaton):
        @F.pandas_udf("array<int>")
        def of(texts: pd.Series) -> pd.Series:
            machine = SuffixAutomaton.of(automaton.value)

            def one(t: str | None) -> list[int]:
                found = words(t, machine.vocabulary) if t else []
                return [x for a, b in machine.spans([w for w, _, _ in found], min_words) for x in (found[a][1], found[b][2])]

            return pd.Series([one(t) for t in texts], dtype=object)

        return of(col)

    found = [spans(spark.sparkContext.broadcast(vars(m))) for m in build(items, item_id, item_text, shard_words)]
    if not found:
        return docs.withColumn("clean_text", col.cast("string"))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t: str | None, flat) -> str | None:
            if t is None or flat is None or not len(flat):
                return t
            merged: list[list[int]] = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            starts = [s for _, s, _ in words(t)]
            if sum(bisect_left(starts, b) - bisect_left(starts, a) for a, b in merged) > max_coverage * len(starts):
                return None
            parts, at = [], 0
            for a, b in merged:
                parts.append(t[at:a])
                at = b
            return "".join([*parts, t[at:]])

        return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    return docs.withColumn("clean_text", clean(col, F.concat(*found)))
