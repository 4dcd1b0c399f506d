"""The folder that a run shares, written intermediates, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests in local mode) a folder of this process is used; on a
    cluster the setting is needed, as machine-local folders can't be read elsewhere.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"shared-{spark.sparkContext.applicationId}")
    os.makedirs(own, exist_ok=True)
    return "file://" + own


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting for what runs inside, then as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: What a query shuffled is deleted when it is done, and not some time after the driver's next garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def gathered(df: DataFrame) -> list[Row]:
    """The rows of ``df``, which are few; what was shuffled for them is deleted."""
    with setting(df.sparkSession, CLEANUP, "true"):
        return df.collect()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage, survives lost executors, has a known size.  What the write shuffled is deleted."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of an undirected graph: ``edges`` (a, b) -> (id, component = smallest id).

    Alternating large-star and small-star rounds: each is one pass of grouped minima, the number
    of rounds grows with the logarithm of a component's size, and no component is ever in one
    place.  Each round is a written table.  Ids without an edge to another id aren't returned.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, tag)
        discard(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = (
            linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(linked.select("a", F.col("m").alias("b")))
            .distinct()
        )
        small = written(small, tag)
        discard(large)
        # A forest of stars: no node is both a child and a parent, and each child has one parent.
        split = small.groupBy("a").count().where("count > 1").limit(1).count()
        chained = small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        now = small
        if not split and not chained:
            roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
