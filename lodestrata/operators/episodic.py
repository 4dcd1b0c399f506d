"""Episodes, entities and facts with supersession instead of deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..store import upsert

# Weights of a token, in facts and in episodes.
FACT_WEIGHT, EPISODE_WEIGHT, SUMMARY_CHARS = 3, 2, 200


def valid(superseded: Column = None) -> Column:
    return ~F.coalesce(F.col("superseded") if superseded is None else superseded, F.lit(False))


def supersede(episodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Episodes whose name or content holds a pattern (seq, pattern, by, reason) become superseded, by the first that fits.

    What was superseded before stays as it was.  Patterns are few: they are folded into one expression.
    """
    found = patterns.orderBy("seq").collect()
    hit = lambda p: F.col("name").contains(p["pattern"]) | F.coalesce(F.col("content").contains(p["pattern"]), F.lit(False))
    first = F.lit(None).cast("int")
    for p in reversed(found):
        first = F.when(hit(p), F.lit(p["seq"])).otherwise(first)
    marked = episodes.withColumn("_p", F.when(valid(), first))
    by = patterns.select(F.col("seq").alias("_p"), F.col("by").alias("_by"), F.col("reason").alias("_why"))
    out = marked.join(F.broadcast(by) if len(found) < 10_000 else by, "_p", "left")
    is_new = F.col("_p").isNotNull()
    return out.withColumns(
        {
            "superseded": F.when(is_new, F.lit(True)).otherwise(F.col("superseded")), "superseded_by": F.when(is_new, F.col("_by")).otherwise(F.col("superseded_by")),
            "superseded_at": F.when(is_new, F.current_timestamp()).otherwise(F.col("superseded_at")), "superseded_reason": F.when(is_new, F.col("_why")).otherwise(F.col("superseded_reason")),
        }
    ).drop("_p", "_by", "_why")


def record(tables: dict[str, DataFrame], name: str, content: str, tags: list[str] = (), project: str = "", entities: list[dict] = (), facts: list[dict] = (), supersedes: list[str] = ()) -> dict[str, DataFrame]:
    """The tables after an outcome: patterns superseded, then episode, entities, mentions and facts written.

    A name that is recorded again is valid again; who superseded it before is kept.
    """
    spark = tables["episodes"].sparkSession
    episodes = tables["episodes"]
    if supersedes:
        rows = [(i, p, name, f"superseded by {name}") for i, p in enumerate(supersedes)]
        episodes = supersede(episodes, spark.createDataFrame(rows, "seq int, pattern string, by string, reason string"))
    new = spark.createDataFrame([(name, content, project, ",".join(tags))], "name string, content string, project string, tags string")
    before = episodes.select("name", "superseded_by", "superseded_at", "superseded_reason")
    new = new.join(before, "name", "left").withColumns({"created_at": F.current_timestamp(), "superseded": F.lit(False)})
    out = {**tables, "episodes": upsert(episodes, new, ["name"])}
    now = F.current_timestamp()
    if entities:
        rows = spark.createDataFrame([(e["name"], e.get("summary", ""), e.get("type", "")) for e in entities], "name string, summary string, entity_type string")
        out["entities"] = upsert(tables["entities"], rows.withColumn("updated_at", now), ["name"])
        out["mentions"] = upsert(tables["mentions"], rows.select(F.lit(name).alias("episode"), F.col("name").alias("entity")), ["episode", "entity"])
    if facts:
        rows = spark.createDataFrame([(f["source"], f["target"], f["fact"], f["relation"].upper().replace(" ", "_")) for f in facts], "source string, target string, fact string, relation string")
        out["facts"] = upsert(tables["facts"], rows.withColumns({"created_at": now, "superseded": F.lit(False)}), ["source", "target", "fact", "relation"])
    return out


def delete_fact(tables: dict[str, DataFrame], fact_id: str, reason: str) -> dict[str, DataFrame]:
    """Marks episodes of that name, or whose name holds it, and facts whose text holds it."""
    mark = lambda df, hit: df.withColumns(
        {
            "superseded": F.when(hit & valid(), F.lit(True)).otherwise(F.col("superseded")), "superseded_reason": F.when(hit & valid(), F.lit(reason)).otherwise(F.col("superseded_reason")),
            "superseded_at": F.when(hit & valid(), F.current_timestamp()).otherwise(F.col("superseded_at")),
        }
    )
    return {**tables, "episodes": mark(tables["episodes"], F.col("name").contains(fact_id)), "facts": mark(tables["facts"], F.col("fact").contains(fact_id))}


def search_facts(facts: DataFrame, episodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Valid facts by score, then valid episodes to fill up: text, source, score, rank.  Ties go to the newer, then by text."""
    tokens = T.query_tokens(query)
    sentence = F.concat("source", F.lit(" "), "relation", F.lit(" "), "target", F.lit(": "), "fact")
    f = facts.where(valid()).select(sentence.alias("text"), F.lit("fact").alias("source"), T.keyword_score(tokens, sentence, FACT_WEIGHT).alias("score"), "created_at")
    summary = F.concat(F.lit("Episode "), "name", F.lit(": "), F.substring("content", 1, SUMMARY_CHARS))
    both = F.concat_ws(" ", "name", "content", "tags")
    e = episodes.where(valid()).select(summary.alias("text"), F.lit("episode").alias("source"), T.keyword_score(tokens, both, EPISODE_WEIGHT).alias("score"), "created_at")
    order = [F.when(F.col("source") == "fact", 0).otherwise(1), F.desc("score"), F.desc_nulls_last("created_at"), F.col("text")]
    rows = f.unionByName(e).where("score > 0").groupBy("source", "text").agg(F.max("score").alias("score"), F.max("created_at").alias("created_at"))
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def prune(episodes: DataFrame, stale_names: list[str] = (), purge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(episodes that stay, episodes for the archive): superseded ones and those named are archived, and leave if purged."""
    dead = ~valid() | F.col("name").isin(*stale_names) if stale_names else ~valid()
    stay = episodes.where(~dead) if purge else episodes.withColumn("superseded", F.when(dead, F.lit(True)).otherwise(F.col("superseded")))
    return stay, episodes.where(dead)


def journal_missing(entries: DataFrame, episodes: DataFrame) -> DataFrame:
    """Journal entries (title, ...) whose title no episode has."""
    return entries.join(episodes.select(F.col("name").alias("title")).distinct(), "title", "left_anti")


def journal_section(title: str, body: str, tags: list[str], project: str, supersedes: list[str], hour: str) -> str:
    """A section of a daily note, as journal_entries reads it."""
    lines = [f"## {hour} — {title}", "", body, "", f"**Tags:** {', '.join(tags)}", f"**Project:** {project}"]
    return "\n".join([*lines, f"**Supersedes:** {', '.join(supersedes)}"] if supersedes else lines) + "\n\n"
