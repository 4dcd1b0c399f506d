"""Outlines of files in three levels, and search over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .symbols import symbols_of

# Weights of a token in path, summary and signatures; sizes of the levels.
PATH, SUMMARY, SIGNATURE = 5, 3, 2
L2_CHARS, PLAIN_LINES, SUMMARY_CHARS, NAMES = 8000, 30, 200, 10


def plain_l0(path: Column, text: Column) -> Column:
    return F.concat(F.lit("File: "), T.basename(path), F.lit(" ("), F.size(F.split(text, "\n")).cast("string"), F.lit(" lines)"))


def plain_l1(text: Column) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, PLAIN_LINES), "\n")


def _code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, text in zip(batch["path"], batch["text"]):
            own = [r for r in symbols_of(path, text or "") if r[1] == "declaration"]
            top = [r for r in own if not r[7]]
            doc = ""
            for quote in ('"""', "'''"):
                if (text or "").lstrip().startswith(quote):
                    doc = (text.lstrip()[3:].split(quote)[0].strip().split("\n") or [""])[0]
            names = ", ".join(r[2] for r in top[:NAMES])
            l0 = (doc[:SUMMARY_CHARS] + (" | " if doc and names else "") if doc else "") + (f"Defines: {names}" if names else "") or f"File: {path.rsplit('/', 1)[-1]}"
            lines = []
            for r in top:
                lines.append(r[5] or r[2])
                lines += [f"    {m[5] or m[2]}" for m in own if m[7] == r[2]]
            rows.append((path, l0, "\n".join(lines)))
        yield pd.DataFrame(rows, columns=["path", "l0_summary", "l1_architecture"])


def build_outlines(files: DataFrame) -> DataFrame:
    """(path, text) -> path, l0_summary, l1_architecture, l2_references; code by its symbols, other texts by their lines."""
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    l2 = F.substring("text", 1, L2_CHARS).alias("l2_references")
    is_code = T.extension(F.col("path")).isin(*T.CODE_EXTS)
    plain = files.where(~is_code).select("path", plain_l0(F.col("path"), F.col("text")).alias("l0_summary"), plain_l1(F.col("text")).alias("l1_architecture"), l2)
    code = files.where(is_code)
    return plain.unionByName(code.mapInPandas(_code, "path string, l0_summary string, l1_architecture string").join(code.select("path", l2), "path"))


def search_outlines(outlines: DataFrame, query: str, k: int = 5, root: str | None = None) -> DataFrame:
    """The k outlines with the highest score; if none has any, the first k by path.  Ties go by path."""
    if root:
        outlines = outlines.where(F.col("path").startswith(root.rstrip("/") + "/"))
    tokens = T.query_tokens(query)
    score = T.keyword_score(tokens, F.col("path"), PATH) + T.keyword_score(tokens, F.col("l0_summary"), SUMMARY) + T.keyword_score(tokens, F.col("l1_architecture"), SIGNATURE)
    top = outlines.withColumn("score", score).orderBy(F.desc("score"), "path").limit(k)
    return top.withColumn("_any", F.max("score").over(Window.partitionBy(F.lit(1)))).where("score > 0 or _any = 0").drop("_any")


def fetch_l2(outlines: DataFrame, path: str) -> DataFrame:
    return outlines.where(F.col("path") == path).select("path", "l2_references")


def sync_outlines(outlines: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Outlines after files (path, text) changed and paths were deleted."""
    gone = changed.select("path").unionByName(deleted.select("path")).distinct()
    return outlines.join(gone, "path", "left_anti").unionByName(build_outlines(changed))
