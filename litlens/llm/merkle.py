"""Collapse of records that differ only in formatting, by bottom-up (Merkle) hashing of nested values.

Every leaf is normalised, every inner node gets a canonical form and a digest of its children's digests, with
children sorted at unordered nodes. Rows are grouped by root digest *and* canonical form, so equal digests of
different records never merge: the canonical form is the full structural comparison. All of it is one
expression tree and one hash aggregation with map-side combine, so a record that holds a third of all rows
reaches the reducers once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Leaf = Callable[[Column], Column]


def plain_text(col: Column) -> Column:
    """Leaf rule for text: letters and digits in lower case; case, blanks and punctuation do not count."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{M}\p{N}]+", "")


def _node(col: Column, kind: T.DataType, path: str, leaves: dict[str, Leaf], ordered: Collection[str]) -> tuple[Column, Column]:
    """(canonical text, 64-bit digest) of one value. Nulls have their own canonical form, unlike any text."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, *_node(col[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, leaves, ordered)) for f in sorted(kind.fields, key=lambda f: f.name.lower())]
        if not parts:
            return F.lit("{}"), F.xxhash64(F.lit("{}"))
        canon = F.concat(F.lit("{"), *[F.concat(F.lit(f"{len(n)}:{n.lower()}="), c) for n, c, _ in parts], F.lit("}"))
        digest = F.xxhash64(F.lit("struct"), *[x for n, _, d in parts for x in (F.lit(n.lower()), d)])
    elif isinstance(kind, T.ArrayType):
        both = F.transform(col, lambda x: (lambda cd: F.struct(cd[1].alias("d"), cd[0].alias("c")))(_node(x, kind.elementType, f"{path}[]", leaves, ordered)))
        if path not in ordered:
            both = F.array_sort(both)
        canon = F.concat(F.lit("["), F.array_join(F.transform(both, lambda x: x["c"]), ""), F.lit("]"))
        digest = F.xxhash64(F.lit("array"), F.transform(both, lambda x: x["d"]))
    elif isinstance(kind, T.MapType):
        entry = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return _node(F.map_entries(col), entry, path, leaves, ())
    else:
        rule = leaves.get(path) or (plain_text if isinstance(kind, T.StringType) else None)
        value = (rule(col) if rule else col).cast("string")
        canon = F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("~"))
        return canon, F.xxhash64(canon)
    missing = col.isNull()
    return F.when(missing, F.lit("~")).otherwise(canon), F.when(missing, F.xxhash64(F.lit("~"))).otherwise(digest)


def root_digest(df: DataFrame, columns: Collection[str], leaves: dict[str, Leaf] | None = None, ordered: Collection[str] = ()) -> tuple[Column, Column]:
    """(canonical text, digest) of the record made of ``columns``; their order does not matter.

    ``leaves`` gives the rule of a leaf by path (``doi``, ``records[].title``); text leaves default to
    ``plain_text``. Arrays are unordered (multisets) unless their path is in ``ordered``.
    """
    kind = T.StructType([df.schema[c] for c in columns])
    return _node(F.struct(*[F.col(f"`{c}`") for c in columns]), kind, "", leaves or {}, ordered)


def collapse(df: DataFrame, columns: Collection[str], leaves: dict[str, Leaf] | None = None, ordered: Collection[str] = (), keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct record: ``root``, ``canonical``, ``copies`` and the aggregates in ``keep``.

    Null, empty and blank text leaves: null differs from empty; blank and empty are equal after ``plain_text``.
    An empty table gives no rows. Columns other than ``columns`` are ignored, so names may clash freely; the
    group key is computed before aggregation and its own names never meet those of ``df`` (``keep`` sees ``df``).
    """
    canon, digest = root_digest(df, columns, leaves, ordered)
    keyed = df.select(digest.alias("__root"), canon.alias("__canonical"), "*")
    aggs = [F.count(F.lit(1)).alias("copies"), *[c.alias(n) for n, c in (keep or {}).items()]]
    return keyed.groupBy("__root", "__canonical").agg(*aggs).withColumnsRenamed({"__root": "root", "__canonical": "canonical"})
