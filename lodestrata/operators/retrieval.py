"""Dense and lexical retrieval over collections of chunks; fusion, federation and reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Depth of retrieval and of the answer, characters that a reranker reads.
RETRIEVE, ANSWER, RERANK_CHARS = 30, 5, 1200
K1, B, RRF = 1.2, 0.75, 60
WORD = r"[a-z0-9_]+"


def _ranked(rows: DataFrame, k: int, by: str = "score", within: list[str] | None = None) -> DataFrame:
    """The k best of each group, ties by id.  Spark cuts each task's rows to k a group before it shuffles them."""
    w = Window.partitionBy(*(within or [F.lit(1)])).orderBy(F.desc(by), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_topk(vectors: DataFrame, query: list[float], k: int = RETRIEVE, within: list[str] | None = None) -> DataFrame:
    """Vectors (id, embedding, ...) nearest by cosine to one vector, exactly: id, ..., score, rank."""
    q = np.array(query, dtype=np.float64)
    norm = float(np.sqrt((q * q).sum()))
    lit = F.array(*[F.lit(float(x)) for x in q])
    dot = F.aggregate(F.zip_with("embedding", lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return _ranked(vectors.withColumn("score", F.round(F.try_divide(dot, size * norm), 6)).where("score is not null"), k, within=within)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def bm25_topk(docs: DataFrame, query: str, k: int = RETRIEVE, within: list[str] | None = None) -> DataFrame:
    """Documents (id, text, ...) by BM25 of one question's distinct words; corpus counts are taken over all of them.

    One pass counts sizes and frequencies of the question's words alone; nothing of the corpus is exploded or shuffled.
    """
    import re

    asked = list(dict.fromkeys(re.findall(WORD, query.lower())))
    words = docs.withColumn("_w", terms(F.col("text"))).withColumn("_n", F.size("_w"))
    for i, t in enumerate(asked):
        words = words.withColumn(f"_t{i}", F.size(F.filter("_w", lambda x: x == t)))  # noqa: B023
    words = words.drop("_w")
    if not asked:
        return _ranked(words.withColumn("score", F.lit(0.0)).where("score > 0").drop("_n"), k, within=within)
    sums = [F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(asked))]]
    rows = words.join(words.groupBy(*within).agg(*sums), within) if within else words.crossJoin(F.broadcast(words.agg(*sums)))  # one row
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.log(1 + (F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        score = score + idf * F.col(f"_t{i}") * (K1 + 1) / (F.col(f"_t{i}") + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))
    hits = rows.withColumn("score", F.round(score, 6)).where("score > 0")
    return _ranked(hits.drop(*[c for c in hits.columns if c.startswith("_")]), k, within=within)


def fuse_ranks(dense: DataFrame, lexical: DataFrame, k: int = RETRIEVE) -> DataFrame:
    """Two rankings (id, rank) -> id, score, rank: reciprocal ranks, summed."""
    both = dense.select("id", F.col("rank").alias("a")).join(lexical.select("id", F.col("rank").alias("b")), "id", "full")
    one = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return _ranked(both.select("id", F.round(one("a") + one("b"), 8).alias("score")), k)


def fuse_scores(dense: DataFrame, lexical: DataFrame, alpha: float = 0.5, k: int = RETRIEVE) -> DataFrame:
    """Two rankings (id, score) -> id, score, rank: scores brought to 0..1 in each, then weighted."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(F.lit(1))
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select("id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)).alias(name))

    both = scaled(dense, "a").join(scaled(lexical, "b"), "id", "full")
    return _ranked(both.select("id", F.round(alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), 6).alias("score")), k)


def resolve_collections(asked: str | list[str] | None, known: list[str], default: str) -> list[str]:
    """None: the default; ``all``: every one; a list, or names between commas: these."""
    if asked is None or asked == "":
        return [default]
    if isinstance(asked, str):
        asked = known if asked.strip().lower() == "all" else [c.strip() for c in asked.split(",") if c.strip()]
    return list(dict.fromkeys(asked)) or [default]


def federated(vectors: DataFrame, query: list[float], collections: list[str], k: int = RETRIEVE) -> DataFrame:
    """The k best of each collection; where there are several, a text names its collection first."""
    own = vectors.where(F.col("collection").isin(*collections))
    found = dense_topk(own, query, k, ["collection"])
    return found.withColumn("text", F.concat(F.lit("# Collection: "), "collection", F.lit("\n"), "text")) if len(collections) > 1 else found


def lexical_score(query: str, text: Column) -> Column:
    """The share of the question's words that the text's first characters hold."""
    tokens = list(dict.fromkeys(T.query_tokens(query)))
    return F.round(T.keyword_score(tokens, F.substring(text, 1, RERANK_CHARS), 1) / max(1, len(tokens)), 6)


def rerank(pooled: DataFrame, query: str, k: int = ANSWER, model: Callable[[str, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Pooled passages (id, text, score) -> the k best by the reranker, ties by first score, then id."""
    if model is None:
        rows = pooled.withColumn("rerank_score", lexical_score(query, F.col("text")))
    else:
        scored = F.pandas_udf(lambda t: model(query, t.str.slice(0, RERANK_CHARS)).astype("float64"), "double")
        rows = pooled.withColumn("rerank_score", scored("text"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("rerank_score"), F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank_fallback(pooled: DataFrame, k: int = ANSWER, collections: list[str] | None = None) -> DataFrame:
    """Without a reranker: the k best by score; or, given an order of collections, the first k of the pool in that order."""
    order = [F.desc("score"), "id"] if collections is None else [F.array_position(F.array(*map(F.lit, collections)), F.col("collection")), F.desc("score"), "id"]
    return pooled.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).where(F.col("rank") <= k)


def hashed_embedding(text: str | None, dim: int = 64) -> list[float]:
    """Signed counts of hashed words, of unit length: an embedder that needs no model."""
    out = np.zeros(dim)
    for word in (text or "").lower().split():
        h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
        out[h % dim] += 1 if h >> 63 else -1
    size = np.sqrt((out * out).sum())
    return (out / size if size else out).astype("float32").tolist()


def embed(texts: DataFrame, model: Callable[[str | None], list[float]] = hashed_embedding) -> DataFrame:
    """Adds embedding (array<float>) of the column text, in batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(model)

    return texts.withColumn("embedding", run("text"))
