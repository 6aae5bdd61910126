"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features, trained from weak
labels, then smoothed with the spam rate of each page's host.

Features of whole texts come from one Arrow pass; everything after it is columns. Weak labels are votes of a few
high-precision rules, most pages get none. The trees are fitted on a bounded, hash-ordered sample of weakly
labelled pages (``max_train``) and score every page; host rates are computed over all pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.session import Scratch

# Frequent function words of English, German, Spanish and French.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it was on with as by at from or an be this were not but had more did no which their who than have has our we are all after before if you is here there when although because so its they been into during "
    "de la el los las y en que un una con por se del al lo su para es no como le les des et du une dans pour sur avec qui il au aux par plus est sont ne pas "
    "der die das und ist mit von zu den im ein eine einer für auf bei war nicht nach sich dem aus als wurden wie zum zur weniger".split()
)
FEATURES = ["length", "distinct", "top_word", "top_pair", "repeated", "function", "links", "tags", "marks", "digits", "sentences", "operators", "identifiers", "colons", "keyed"]

_PIECE = re.compile(r"[^\W_]+|[.!?](?=\s|$)|\n")
_ENDS = {".": True, "!": True, "?": True, "\n": False}
_URL = re.compile(r"(?:https?://|www\.)\S+")
_HTML = re.compile(r"</?[a-zA-Z][^<>]*>")
_OPERATOR = re.compile(r"\b(?:AND|OR|NOT|NEAR|ADJ)\b|\[(?:tiab|Mesh|mh|majr|tw)[^\]]*\]|:ti,ab|TITLE-ABS-KEY|TS=")
_VOLUME = re.compile(r";\d+")


def features(text: str) -> tuple[float, ...] | None:
    """The values of ``FEATURES`` for one text, None where it has fewer than 5 words."""
    links = _URL.findall(text) if "http" in text or "www." in text else []
    bare = _URL.sub(" ", text) if links else text
    bare = (_HTML.sub(" ", bare) if "<" in bare else bare).lower()
    found: list[str] = []
    segments: list[tuple[int, int, bool]] = []  # first word, end, closed as a sentence
    start = 0
    for piece in _PIECE.findall(bare):
        if piece in _ENDS:
            if len(found) - start >= 4:
                segments.append((start, len(found), _ENDS[piece]))
            start = len(found)
        else:
            found.append(piece)
    if len(found) - start >= 4:
        segments.append((start, len(found), False))
    m, n = max(len(found), 1), len(found) + 3 * len(links)
    if n < 5:
        return None
    counts = Counter(found)
    # stuffed pairs recur at least 3 times and make up 2% of the text; so do the words they are made of
    least = max(3, 0.02 * m)
    often = {w for w, c in counts.items() if c >= least and w not in FUNCTION_WORDS and not w.isdigit()}
    pairs = Counter(p for p in zip(found, found[1:], strict=False) if p[0] in often and p[1] in often)
    stuffed = {p: c for p, c in pairs.items() if c >= least}
    covered, last = 0, -2
    if stuffed:
        for i, p in enumerate(zip(found, found[1:], strict=False)):
            if p in stuffed:
                covered += 1 if last == i - 1 else 2
                last = i
    prose = keyed = 0
    for a, b, sentence in segments:
        ws = found[a:b]
        if stuffed and sum(p in stuffed for p in zip(ws, ws[1:], strict=False)) * 2 >= 0.3 * (b - a):
            keyed += b - a
        elif sentence and not FUNCTION_WORDS.isdisjoint(ws):
            prose += b - a
    asked = "AND" in text or "OR" in text or "[" in text or ":ti" in text
    lines = text.split("\n")
    return (
        n**0.25,
        len(counts) / m,
        max((counts[w] for w in often), default=0) / m,
        max(stuffed.values(), default=0) / m,
        covered / m,
        sum(counts[w] for w in FUNCTION_WORDS & counts.keys()) / m,
        3 * sum("doi.org" not in u for u in links) / n,
        (text.count("#") + text.count("</a>") + text.count("](")) / n,
        sum(map(text.count, "|>*•·,;/")) / n,
        sum(map(text.count, "0123456789")) / len(text),
        prose / m,
        (len(_OPERATOR.findall(text)) if asked else 0) / n,
        (text.count("doi.org/") + text.count("doi:") + text.count("PMID") + len(_VOLUME.findall(text))) / n,
        sum(":" in line and len(line) < 80 for line in lines) / len(lines),
        keyed / m,
    )


def page_features(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """``id``, ``host`` and the features; null texts and texts of under 5 words have null features."""
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("host", T.StringType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = (None,) * len(FEATURES)
        for batch in batches:
            rows = [(features(t) if t else None) or empty for t in batch["t"]]
            out = pd.DataFrame(rows, columns=FEATURES, dtype="float64")
            out.insert(0, "host", batch["host"])
            out.insert(0, "id", batch["id"])
            yield out

    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").alias("t"))
    return source.mapInPandas(measure, schema)


def weak_label(c=F.col) -> Column:
    """1 spam, 0 no spam, null where no rule speaks."""
    scholarly = (c("operators") > 0.03) | (c("identifiers") > 0.04) | (c("digits") > 0.12) & (c("links") == 0)
    spam = (
        (c("repeated") > 0.3) & (c("sentences") < 0.3) & (c("top_pair") > 0.03)
        | (c("keyed") > 0.6) & (c("top_pair") > 0.06)
        | (c("top_word") > 0.2) & (c("keyed") > 0.3) & (c("length") > 2.3)
        | (c("links") > 0.2) & (c("sentences") < 0.2)
        | (c("tags") > 0.12) & (c("sentences") < 0.2) & (c("function") < 0.1)
    ) & ~scholarly
    ham = (c("sentences") > 0.6) & (c("repeated") < 0.15) | scholarly & (c("repeated") < 0.3) & (c("links") < 0.05) | (c("colons") > 0.7) & (c("repeated") < 0.15) & (c("links") == 0)
    ham |= (c("repeated") < 0.05) & (c("keyed") < 0.05) & (c("links") < 0.02) & (c("tags") < 0.04) & (c("top_word") < 0.2)
    return F.when(spam, 1.0).when(ham & ~spam, 0.0)


def spam_pages(docs: DataFrame, doc_id: str, text: str, host: str, trees: int = 30, max_depth: int = 6, max_train: int = 20_000, smoothing: float = 0.3, prior_pages: float = 50.0, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``page_score``, ``host_rate``, ``score``, ``is_spam`` of every row.

    ``page_score`` is the trees' mean; ``score`` moves its log-odds by ``smoothing`` times the log-odds of the
    host's rate over the corpus rate, the rate being shrunk by ``prior_pages`` pages of corpus rate. Null hosts
    are one host. Texts too short to measure score 0. Where weak labels show one class only, no tree can be
    fitted and the rules' votes are the scores. An empty table gives no rows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scratch = Scratch(docs.sparkSession, "spam")
    pages = scratch.cut(page_features(docs, doc_id, text, host))
    labelled = pages.where("length is not null").withColumn("label", weak_label()).where("label is not null")
    totals = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        scored = pages.withColumn("page_score", F.coalesce(weak_label(), F.lit(0.0)))
    else:
        # a bounded sample per class in the order of a hash of the features, so repeated pages do not crowd it out
        n = min(max_train // 2, max(totals.values()))
        order = F.xxhash64(*FEATURES)
        shares = F.when(F.col("label") == 1.0, min(1.0, 1.2 * n / totals[1.0])).otherwise(min(1.0, 1.2 * n / totals[0.0]))
        weight = F.when(F.col("label") == 1.0, F.lit(max(1.0, totals[0.0] / totals[1.0]))).otherwise(F.lit(max(1.0, totals[1.0] / totals[0.0])))
        sample = labelled.withColumn("weight", F.least(weight, F.lit(3.0))).where(F.pmod(order, F.lit(1_000_003)) < shares * 1_000_003).dropDuplicates(FEATURES).limit(2 * max_train)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip")
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=max_depth, featureSubsetStrategy="all", subsamplingRate=1.0, minInstancesPerNode=2, seed=7)
        model = forest.fit(vectors.transform(scratch.cut(sample.select("label", "weight", *FEATURES))))
        filled = pages.withColumns({f: F.coalesce(f, F.lit(0.0)) for f in FEATURES}).withColumn("measured", F.col("length") > 0)
        scored = model.transform(vectors.transform(filled)).withColumn("page_score", F.when(F.col("measured"), vector_to_array("probability")[1]).otherwise(0.0))
    kept = scratch.cut(scored.select("id", "host", "page_score"))
    overall = kept.agg(F.avg("page_score")).first()[0] or 0.0
    rates = kept.groupBy("host").agg(((F.sum("page_score") + prior_pages * overall) / (F.count(F.lit(1)) + prior_pages)).alias("host_rate"))

    def odds(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(p / (1 - p))

    joined = kept.join(rates.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    score = 1 / (1 + F.exp(-(odds(F.col("page_score")) + smoothing * (odds(F.col("host_rate")) - odds(F.lit(overall))))))
    return joined.withColumn("score", F.when(F.col("page_score") > 0, score).otherwise(0.0)).select(F.col("id").alias(doc_id), "page_score", "host_rate", "score", (F.col("score") >= threshold).alias("is_spam"))
