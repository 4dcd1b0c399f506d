"""Incremental ingest: what changed, what is cached, which points a file has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: file times closer than this are the same.
MTIME_TOLERANCE = 1e-4


def classify(scanned: DataFrame, cached: DataFrame) -> DataFrame:
    """Scanned (path, mtime, sha256) against cached (path, mtime, sha256, point_ids): path, status, point_ids.

    new, unchanged (same time, or same content), touched (another time, the same content), modified, deleted.
    """
    s = scanned.select("path", F.col("mtime").alias("m1"), F.col("sha256").alias("h1"))
    c = cached.select("path", F.col("mtime").alias("m0"), F.col("sha256").alias("h0"), "point_ids")
    status = (
        F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "deleted").when(F.abs(F.col("m1") - F.col("m0")) < MTIME_TOLERANCE, "unchanged")
        .when(F.col("h1") == F.col("h0"), "touched").otherwise("modified")
    )
    return s.join(c, "path", "full").select("path", status.alias("status"), "point_ids", F.col("m1").alias("mtime"), F.col("h1").alias("sha256"))


def missing(cached: DataFrame, scanned: DataFrame) -> DataFrame:
    """Cached files that are in no scan any more, and, where the scan says so, don't exist."""
    gone = cached.join(scanned.select("path").distinct(), "path", "left_anti")
    return gone.where(~F.coalesce(F.col("exists"), F.lit(False))).drop("exists") if "exists" in gone.columns else gone


def cache_keys(texts: DataFrame, model: str) -> DataFrame:
    """Adds chunk_sha256 (of the trimmed text) and model."""
    return texts.withColumns({"chunk_sha256": T.content_hash(F.col("text")), "model": F.lit(model)})


def probe(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their embedding, misses) of texts (idx, text); idx keeps the order."""
    both = cache_keys(texts, model).join(cache.select("chunk_sha256", "model", "embedding"), ["chunk_sha256", "model"], "left")
    return both.where("embedding is not null"), both.where("embedding is null").drop("embedding")


def hit_rate(hits: int, total: int) -> float:
    return round(100.0 * hits / total, 1) if total else 0.0


def cache_statistics(cache: DataFrame) -> DataFrame:
    """entries, total bytes (four a number), MB."""
    size = 4 * F.size("embedding").cast("long")
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes")).withColumn("mb", F.round(F.col("total_bytes") / (1024 * 1024), 2))


def file_points(points: DataFrame) -> DataFrame:
    """path -> its point ids, sorted."""
    return points.groupBy("path").agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


def point_id(collection: str) -> Column:
    """An id that a chunk keeps as long as its place and text stay."""
    return F.sha2(F.concat_ws("\x1f", F.lit(collection), "path", F.col("chunk_no").cast("string"), "text"), 256)
