"""Filling windows of fixed token capacity: multiway Karmarkar-Karp differencing per block.

Texts are sized with a public tokenizer, cut only where longer than the capacity, and spread over blocks of a
bounded number of windows by a hash of the row, so no task holds more than a block whatever the sources' sizes.
In each block differencing merges partial partitions with opposing imbalances into near-equal windows.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.session import Scratch

# Fixed value: the split pattern of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """``doc_id``, ``tokens`` of every row; ``vocabulary`` is the path of a byte-level ``.tiktoken`` file, read on
    the driver and broadcast (about 1 MB). Null texts count 0 tokens. Whole texts are sized."""
    with open(vocabulary, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("tokens", T.LongType())])

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.value.splitlines() if line)}
        tokenizer = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "tokens": [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch["t"]]})

    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).mapInPandas(size, schema)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window number of every item by multiway differencing: the two partial partitions with the largest spreads
    are merged, the fullest windows of one with the emptiest of the other, until one partition is left.

    A partial partition keeps its non-empty windows only, so all of them together never hold more entries than items.
    """
    n = len(sizes)
    tree: list[tuple[int, int]] = []  # node n + i joins two sets of items
    order = np.argsort(-sizes, kind="stable").tolist()
    heap = [(-float(sizes[i]), turn, np.array([float(sizes[i])]), np.array([i])) for turn, i in enumerate(order)]
    if windows == 1:
        return np.zeros(n, dtype=np.int64)
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, sums_a, a = heapq.heappop(heap)
        _, _, sums_b, b = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - windows)  # the windows that neither has empty
        sums = np.concatenate([sums_a[: len(a) - both], sums_a[len(a) - both :] + sums_b[len(b) - both :][::-1], sums_b[: len(b) - both]])
        sets = np.concatenate([a, b[: len(b) - both]])
        for k in range(both):
            at = len(a) - both + k
            tree.append((int(a[at]), int(b[len(b) - 1 - k])))
            sets[at] = n + len(tree) - 1
        by_size = np.argsort(-sums, kind="stable")
        sums, sets = sums[by_size], sets[by_size]
        if len(sums) == windows:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-float(sums[0]), turn, sums, sets))
        turn += 1
    label = np.empty(n, dtype=np.int64)
    for w, root in enumerate(heap[0][3].tolist() if heap else []):
        stack = [root]
        while stack:
            v = stack.pop()
            if v < n:
                label[v] = w
            else:
                stack.extend(tree[v - n])
    return label


def _best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    label, free, n = np.empty(len(sizes), dtype=np.int64), [], 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        at = bisect.bisect_left(free, (int(sizes[i]), -1))
        room, w = free.pop(at) if at < len(free) else (capacity, n)
        n = max(n, w + 1)
        bisect.insort(free, (room - int(sizes[i]), w))
        label[i] = w
    return label


def fill(sizes: np.ndarray, capacity: int, slack: float = 0.01, rounds: int = 8) -> np.ndarray:
    """Window number of every item (each of size 1 to ``capacity``); no window exceeds ``capacity``.

    Differencing over the least possible number of windows; windows of at least ``1 - slack`` of the capacity
    are closed and the items of all others are divided again. What no round closes is divided over as many windows as
    best fit needs, or left to best fit where they would not hold it: differencing spreads unused space evenly, where
    it is of no use to any item.
    """
    label, pool, used = np.full(len(sizes), -1, dtype=np.int64), np.arange(len(sizes)), 0
    for _ in range(rounds):
        if not len(pool):
            return label
        windows = int(-(-sizes[pool].sum() // capacity))
        part = difference(sizes[pool], windows)
        sums = np.bincount(part, weights=sizes[pool], minlength=windows)
        closed = (sums <= capacity) & ((sums >= (1 - slack) * capacity) | bool(sums.max() <= capacity))
        if not closed.any():
            break
        number = np.where(closed, used + np.cumsum(closed) - 1, -1)
        label[pool] = number[part]
        used, pool = used + int(closed.sum()), pool[~closed[part]]
    if len(pool):
        best = _best_fit(sizes[pool], capacity)
        even = difference(sizes[pool], int(best.max()) + 1)
        holds = np.bincount(even, weights=sizes[pool]).max() <= capacity
        label[pool] = used + (even if holds else best)
    return label


def pack(docs: DataFrame, doc_id: str, text: str, capacities: dict[str, int], vocabulary: str, windows_per_block: int = 256) -> DataFrame:
    """``target``, ``capacity``, ``window``, ``doc_id``, ``part``, ``first_token``, ``tokens``: where each piece goes.

    One row per piece, for every entry of ``capacities`` (a handful of named capacities, each at least 1). A text
    of more tokens than the capacity is cut into full windows and a rest; every other text is one piece. Null and
    empty texts have no tokens and need no window. Repeated rows and ids are packed as often as they come. An
    empty table or no capacities give no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    scratch = Scratch(spark, "packing")
    # row numbers are written with the sizes, so every later scan sees the same ones
    sized = scratch.cut(token_counts(docs, doc_id, text, vocabulary).where("tokens > 0").withColumn("row", F.monotonically_increasing_id()))
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity is below 1")
    named = F.array(*[F.struct(F.lit(n).alias("target"), F.lit(int(c)).alias("capacity")) for n, c in capacities.items()]) if capacities else F.expr("cast(array() as array<struct<target:string,capacity:int>>)")
    each = sized.withColumn("c", F.explode(named)).select("id", "row", "tokens", "c.target", "c.capacity")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    cut = each.where(full > 0).select("*", F.explode(F.sequence(F.lit(0), full - 1)).alias("part")).select(
        "target", "capacity", F.concat(F.lit("full-"), "row", F.lit("-"), "part").alias("window"), F.col("id").alias(doc_id), "part", (F.col("part").cast("long") * F.col("capacity")).alias("first_token"), F.col("capacity").cast("long").alias("tokens"))
    rest = each.withColumn("part", full).withColumn("size", F.col("tokens") % F.col("capacity")).where("size > 0")
    totals = {r.target: r.total for r in rest.groupBy("target").agg(F.sum("size").alias("total")).collect()}
    blocks = [max(1, round(totals.get(n, 0) / (c * windows_per_block))) for n, c in capacities.items()]
    count = F.create_map(*[x for n, b in zip(capacities, blocks, strict=True) for x in (F.lit(n), F.lit(b))])[F.col("target")] if capacities else F.lit(1)
    spread = rest.withColumn("block", F.pmod(F.xxhash64("row", "target"), count).cast("int"))

    def fill_block(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        target, block = key
        items = items.sort_values("row")
        capacity = int(items["capacity"].iat[0])
        label = fill(items["size"].to_numpy(dtype=np.int64), capacity)
        return pd.DataFrame({"target": target, "capacity": capacity, "window": [f"{block}-{w}" for w in label], doc_id: items["id"], "part": items["part"], "first_token": items["part"].astype("int64") * capacity, "tokens": items["size"]})

    schema = f"target string, capacity int, window string, `{doc_id}` {kind}, part int, first_token long, tokens long"
    packed = spread.select("target", "block", "row", "id", "part", "capacity", "size").groupBy("target", "block").applyInPandas(fill_block, schema)
    return cut.unionByName(packed)
