"""Writers of the evaluation's result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits_order(col: str) -> Column:
    """Numeric order of an identifier's digits, however long."""
    return F.regexp_replace(col, r"\D", "").cast("decimal(38,0)")


def write_ids(rows: DataFrame, path: str, column: str = "pmid") -> None:
    """One identifier per line in numeric order."""
    rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(digits_order(column), column).write.mode("errorifexists").text(path)


def write_articles(rows: DataFrame, path: str) -> None:
    """pmid, doi: rows with a PMID first, in numeric order, then those with a DOI only."""
    rows.select("pmid", "doi").orderBy(F.col("pmid").isNull(), digits_order("pmid"), "pmid", "doi").write.mode("errorifexists").csv(path, header=True)


def write_strategy_sets(rows: DataFrame, path: str) -> None:
    """All strategies' sets in one job, a folder each."""
    rows.select("strategy", "study", "pmid", "doi").write.mode("errorifexists").partitionBy("strategy").parquet(path)


def write_local_imports(entries: DataFrame, path: str) -> None:
    """A JSON document per import with its entry under the query's hash; imports without hits are written too."""
    entry = F.struct(*[c for c in entries.columns if c not in ("path", "entry_key")])
    entries.select(F.to_json(F.create_map("entry_key", entry)).alias("value")).write.mode("errorifexists").text(path)


def write_study_documents(studies: DataFrame, path: str) -> None:
    studies.write.mode("errorifexists").json(path)


def union_of_fields(frames: list[DataFrame]) -> DataFrame:
    """All rows with the sorted union of the columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def markdown_table(small: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a small result (statistics by strategy or study, at most ``limit`` rows)."""
    rows = small.limit(limit).collect()
    lines = ["| " + " | ".join(small.columns) + " |", "|" + "---|" * len(small.columns)]
    show = lambda v: "N/A" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
