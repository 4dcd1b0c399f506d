"""Decisions about commands and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of commands that need a confirmation; tools that change files, or record an outcome.
DESTRUCTIVE = (r"\brm\s+-[a-zA-Z]*r[a-zA-Z]*f\s+[/~]", r"\bgit\s+reset\s+--hard\b", r"\bdocker\s+system\s+prune\s+-a\b", r"\bGRAPH\.DELETE\b")
MODIFYING = ("write_to_file", "replace_file_content", "multi_replace_file_content")
RECORDING = ("record_system_outcome",)


def command_decision(command: Column) -> Column:
    """``ask`` for a destructive command, else ``allow``."""
    hit = F.lit(False)
    for p in DESTRUCTIVE:
        hit = hit | F.coalesce(command, F.lit("")).rlike(f"(?i){p}")
    return F.when(hit, "ask").otherwise("allow")


def stop_decisions(calls: DataFrame, modifying=MODIFYING, recording=RECORDING) -> DataFrame:
    """Tool calls (session, name) -> session, modified, recorded, decision: go on if files changed and nothing was recorded."""
    any_of = lambda names: F.coalesce(F.bool_or(F.array_size(F.filter(F.array(*map(F.lit, names)), lambda n: F.col("name").contains(n))) > 0), F.lit(False))
    rows = calls.groupBy("session").agg(any_of(modifying).alias("modified"), any_of(recording).alias("recorded"))
    return rows.withColumn("decision", F.when(F.col("modified") & ~F.col("recorded"), "continue").otherwise("stop"))


def tool_calls(transcripts: DataFrame) -> DataFrame:
    """Transcript steps -> session, name; calls through a wrapper count by the wrapped tool's name or command."""
    c = transcripts.select("session", F.explode("tool_calls").alias("c"))
    return c.select("session", F.concat_ws(" ", F.coalesce("c.name", "c.tool_name"), F.try_element_at("c.args", F.lit("ToolName")), F.try_element_at("c.args", F.lit("CommandLine"))).alias("name"))


def reminds(turn: Column, every: int = 10) -> Column:
    """Whether a turn shows the invariants again: the first, and every tenth."""
    return (turn == 0) | (turn % every == 0)
