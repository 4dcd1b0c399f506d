"""File changes as a stream: debounced, last one wins, synced in micro-batches."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "path string, event_type string, dest_path string, ts timestamp, event_id long"


def expand_moves(events: DataFrame) -> DataFrame:
    """A move is a delete of the old path and a change of the new one."""
    e = lambda path, kind: F.struct(path.alias("path"), F.lit(kind).alias("event_type"))
    same = F.array(F.struct(F.col("path").alias("path"), F.col("event_type").alias("event_type")))
    rows = events.withColumn("_e", F.explode(F.when(F.col("event_type") == "moved", F.array(e(F.col("path"), "deleted"), e(F.col("dest_path"), "modified"))).otherwise(same)))
    return rows.select(F.col("_e.path").alias("path"), F.col("_e.event_type").alias("event_type"), *[c for c in events.columns if c not in ("path", "event_type", "dest_path")])


def debounce(events: DataFrame, gap: str = "2 seconds", watermark: str | None = None) -> DataFrame:
    """Events (path, event_type, ts, event_id) -> path, first_ts, last_ts, n_events, event_type of the last: one row for each
    run of events of a path without a pause of ``gap``.  The same on a stream, where a watermark bounds what is held; later rows
    than that are dropped."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return rows.drop("w")


def last_event(events: DataFrame) -> DataFrame:
    """path -> its last event: what a flush would act on."""
    return events.groupBy("path").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("last_ts"))


def telemetry(events: DataFrame) -> DataFrame:
    """One row: total_processed, last_event_time, last_synced_file, pending_count (paths whose last event is a change)."""
    last = last_event(events)
    a = events.agg(F.count(F.lit(1)).alias("total_processed"), F.max("ts").alias("last_event_time"), F.max_by("path", F.struct("ts", "event_id")).alias("last_synced_file"))
    return a.crossJoin(last.agg(F.count_if(F.col("event_type") != "deleted").alias("pending_count")))


def read_events(spark: SparkSession, folder: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(EVENTS).format(fmt).load(folder)


class Watch:
    """Two streams that belong together."""

    def __init__(self, *queries):
        self.queries = queries

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    @property
    def isActive(self) -> bool:  # noqa: N802  as a query's
        return all(q.isActive for q in self.queries)


def watch(events: DataFrame, sync: Callable[[DataFrame], None], remove: Callable[[DataFrame], None], checkpoint: str, gap: str = "2 seconds", watermark: str = "10 seconds") -> Watch:
    """Starts the streams: deletes are removed at once, changes synced when their run is over.  Each micro-batch hands (path) frames
    to ``remove`` or ``sync``.  Both replace by key, so that a repeated batch does no harm; they never run at the same time.  A delete
    that is followed by a change is removed and, when the run is over, synced; a run that ends with a delete is not synced."""
    moves, lock = expand_moves(events), threading.Lock()

    def guarded(act: Callable[[DataFrame], None], wanted: str) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            paths = last_event(batch).where(wanted).select("path") if wanted.startswith("event_type =") else batch.where(wanted).select("path").distinct()
            with lock:
                if not paths.isEmpty():
                    act(paths)
            batch.unpersist()

        return run

    start = lambda rows, act, wanted, name: rows.writeStream.outputMode("append").foreachBatch(guarded(act, wanted)).option("checkpointLocation", f"{checkpoint}/{name}").trigger(processingTime="500 milliseconds").start()
    return Watch(start(moves, remove, "event_type = 'deleted'", "deletes"), start(debounce(moves, gap, watermark), sync, "event_type <> 'deleted'", "changes"))
