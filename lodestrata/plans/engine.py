"""The engine's interface: index a tree, search all tiers, record outcomes, trace impact, consolidate."""

from __future__ import annotations

import json
import logging
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..operators import chunking, consolidate, episodic, graph, ingest, outline, retrieval, symbols
from ..shared import written
from ..sources import files as sources
from ..sources import scip
from ..store import Store
from ..streaming import watch

LOG = logging.getLogger(__name__)
GRAPH = ("files", "defined_in", "imports", "references", "links", "sections", "tags", "relations")


class Engine:
    """``embedder``: text -> vector.  ``reranker``: (question, series of texts) -> scores.  ``extractor``: text -> dict of entities and
    facts, as record_outcome takes them; asked for outcomes that come without any."""

    def __init__(self, spark: SparkSession, root: str, model: str = "hashed-64", embedder=retrieval.hashed_embedding, reranker=None, extractor=None):
        self.spark, self.store, self.model, self.embedder = spark, Store(spark, root), model, embedder
        self.reranker, self.extractor = reranker, extractor

    def graph(self) -> dict[str, DataFrame]:
        return {t: self.store.read(t) for t in GRAPH}

    # Write path.
    def index(self, root: str, collection: str = "default", scip_index: str | None = None, excludes=sources.EXCLUDED, commits: DataFrame | None = None) -> dict[str, int]:
        """Scans a tree and brings all tables up to date with what changed; counts by status and of points.

        commits: (path, commit_hash, commit_date, commit_msg) of each file's last commit.
        """
        scanned = sources.scan_files(self.spark, root, excludes=excludes).persist()
        cached = self.store.read("file_cache").where(F.col("collection") == collection)
        state = ingest.classify(scanned, cached).persist()
        counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
        self.remove(state.where("status = 'deleted'").select("path"))
        changed = scanned.join(state.where("status in ('new', 'modified')").select("path"), "path", "left_semi")
        counts["points"] = self.sync(changed, collection, commits)
        touched = state.where("status = 'touched'").select("path", F.lit(collection).alias("collection"), "mtime", "sha256", "point_ids", F.unix_timestamp().cast("double").alias("updated_at"))
        self.store.upsert("file_cache", touched)
        if scip_index:
            self.ingest_scip(scip_index)
        scanned.unpersist()
        state.unpersist()
        return counts

    def sync(self, changed: DataFrame, collection: str = "default", commits: DataFrame | None = None) -> int:
        """Files (path, text, mtime, sha256) replace what the tables have of them; how many points they have now."""
        changed = changed.persist()
        if changed.isEmpty():
            changed.unpersist()
            return 0
        found = symbols.extract_symbols(changed).persist()
        for name, rows in symbols.symbol_tables(found).items():
            self.store.replace_by(name, rows, "path", changed)
        is_note = T.extension(F.col("path")).isin("md", "markdown")
        notes = symbols.extract_notes(changed.where(is_note)).persist()
        plain = changed.where(~is_note).select("path", F.lit(None).cast("string").alias("title"), F.lit(False).alias("is_markdown"))
        self.store.upsert("files", plain.unionByName(notes.select("path", "title", F.lit(True).alias("is_markdown"))))
        self.store.replace_by("sections", notes.select("path", F.explode("sections").alias("s")).select("s.id", "path", "s.name", "s.level", "s.line", "s.heading_path"), "path", changed)
        self.store.replace_by("tags", notes.select("path", F.explode("tags").alias("tag")), "path", changed)
        links = symbols.resolve_links(notes.select(F.col("path").alias("src"), F.explode("links").alias("l")).select("src", "l.*"), self.store.read("files"))
        links = links.select("src", F.coalesce("target_path", "target_name").alias("target"), "is_resolved", "label", "line", "link_type", "raw_target")
        self.store.replace_by("links", links, "src", changed.withColumnRenamed("path", "src"))
        self.store.replace_by("outlines", outline.build_outlines(changed), "path", changed)
        if commits is None:
            commits = self.spark.createDataFrame([], "path string, commit_hash string, commit_date string, commit_msg string")
        chunks = chunking.with_commits(chunking.chunk_documents(changed), commits, changed)
        points = ingest.cache_keys(chunks, self.model).withColumns({"collection": F.lit(collection), "point_id": ingest.point_id(collection)}).persist()
        self.store.replace_by("chunks", points.select(*self.store.read("chunks").columns), "path", changed)
        fresh = points.select("chunk_sha256", "model", "text").dropDuplicates(["chunk_sha256", "model"]).join(self.store.read("embedding_cache").select("chunk_sha256", "model"), ["chunk_sha256", "model"], "left_anti")
        embedded = retrieval.embed(fresh, self.embedder).select("chunk_sha256", "model", "embedding", F.size("embedding").alias("dim"), F.unix_timestamp().cast("double").alias("created_at"))
        self.store.insert_if_absent("embedding_cache", embedded)
        vectors = points.join(self.store.read("embedding_cache").select("chunk_sha256", "model", "embedding"), ["chunk_sha256", "model"])
        words = points.select("point_id", F.explode(retrieval.terms(F.col("text"))).alias("term")).groupBy("point_id", "term").agg(F.count(F.lit(1)).cast("float").alias("n"))
        words = words.groupBy("point_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("terms"))
        self.store.replace_by("vectors", vectors.join(words, "point_id", "left").select("point_id", "collection", "path", "text", "embedding", "terms"), "path", changed)
        own = changed.select("path", "mtime", "sha256").join(ingest.file_points(points), "path", "left")
        self.store.upsert("file_cache", own.select("path", F.lit(collection).alias("collection"), "mtime", "sha256", F.coalesce("point_ids", F.array().cast("array<string>")).alias("point_ids"), F.unix_timestamp().cast("double").alias("updated_at")))
        n = points.count()
        for df in (changed, found, notes, points):
            df.unpersist()
        return n

    def remove(self, paths: DataFrame) -> None:
        for name in ("files", "defined_in", "imports", "references", "sections", "tags", "outlines", "vectors", "chunks", "file_cache"):
            self.store.delete_by(name, "path", paths)
        self.store.delete_by("links", "src", paths.withColumnRenamed("path", "src"))

    def ingest_scip(self, path: str) -> dict[str, int]:
        documents = scip.read_index(self.spark, path).persist()
        tables, changed = scip.index_tables(documents), documents.select(F.col("relative_path").alias("path"))
        self.store.upsert("files", tables["files"])
        # Relations go with the definitions they belong to: those of symbols that the files defined before, or define now.
        before = self.store.read("defined_in").join(changed, "path", "left_semi").select("symbol")
        stale = written(before.unionByName(tables["defined_in"].select("symbol")).unionByName(tables["relations"].select("symbol")).distinct(), "stale-relations")
        self.store.replace_by("relations", tables["relations"], "symbol", stale)
        for name in ("defined_in", "imports", "references"):
            self.store.replace_by(name, tables[name], "path", changed)
        counts = scip.index_counts(documents).first().asDict()
        documents.unpersist()
        return counts

    def create_collection(self, name: str) -> None:
        """A collection exists as soon as it has points; creating one that is there empties it."""
        self.store.write("vectors", self.store.read("vectors").where(F.col("collection") != name))

    def collections(self) -> DataFrame:
        return self.store.read("vectors").groupBy("collection").agg(F.count(F.lit(1)).alias("points"))

    def record_outcome(self, name: str, content: str, **more) -> dict[str, int]:
        """See episodic.record; how many episodes were superseded by it, and entities and facts written.

        The outcome is a section of the day's note, journal/<date>.md, too.
        """
        if self.extractor is not None and not more.get("entities") and not more.get("facts"):
            more |= {k: v for k, v in self.extractor(content).items() if k in ("entities", "facts")}
        kinds = ("episodes", "entities", "mentions", "facts")
        after = episodic.record({t: self.store.read(t) for t in kinds}, name, content, **more)
        before = self.store.read("episodes").where(~episodic.valid()).select("name")
        superseded = after["episodes"].where(~episodic.valid()).join(before, "name", "left_anti").count()
        for t in kinds:
            self.store.write(t, after[t])
        now = datetime.now()
        section = episodic.journal_section(name, content, list(more.get("tags") or ()), more.get("project") or "", list(more.get("supersedes") or ()), f"{now:%H:%M}")
        self.store.append_text(f"journal/{now:%Y-%m-%d}.md", section)
        return {"superseded": superseded, "entities": len(more.get("entities", ())), "facts": len(more.get("facts", ()))}

    def supersede_fact(self, fact_id: str, reason: str) -> None:
        after = episodic.delete_fact({t: self.store.read(t) for t in ("episodes", "facts")}, fact_id, reason)
        for t, rows in after.items():
            self.store.write(t, rows)

    # Read path.
    def search(self, prompt: str, collection: str | list[str] | None = None, workspace: str | None = None) -> str:
        """The four tiers at once, each on its own thread and by itself: one that fails says so in its part, and in the log.

        Snippets: of each collection the nearest by vector and the best by words, fused by rank, then reranked; where the reranker
        fails, the order of the fusion stands.
        """
        known = [r["collection"] for r in self.collections().collect()]
        asked = retrieval.resolve_collections(collection, known, "default")
        candidates = [r[0] for r in self.spark.range(1).select(F.explode(T.symbol_candidates(F.lit(prompt)))).collect()]
        names = self.spark.createDataFrame([(c,) for c in candidates], "name string")
        vectors = self.store.read("vectors").withColumnRenamed("point_id", "id")
        query = self.embedder(prompt)
        tiers = {
            "symbols": lambda: [f"{r['query']}: {r['kind']} in {r['path']}:{r['line']} {r['signature']}".rstrip() for r in graph.find_definition(self.graph(), names).orderBy("query", "path", "line").limit(10).collect()]
            + [f"{r['query']}: {r['relation'].lower()} by {r['path']}:{r['line']}" for r in graph.impact_upstream(self.graph(), names).orderBy("query", "path", "line").limit(10).collect()],
            "facts": lambda: [r["text"] for r in episodic.search_facts(self.store.read("facts"), self.store.read("episodes"), prompt).orderBy("rank").collect()],
            "outline": lambda: [f"{r['path']}: {r['l0_summary']}\n{r['l1_architecture']}" for r in outline.search_outlines(self.store.read("outlines"), prompt, root=workspace).orderBy(F.desc("score"), "path").collect()],
            "snippets": lambda: self._snippets(vectors, query, prompt, asked),
        }

        def guarded(item):
            tier, run = item
            try:
                return run()
            except Exception as error:  # noqa: BLE001  one tier's failure is not the answer's
                LOG.exception("tier %s failed", tier)
                return [f"(no answer: {type(error).__name__})"]

        with ThreadPoolExecutor(len(tiers)) as pool:
            return self.format(dict(zip(tiers, pool.map(guarded, tiers.items()))))

    def _snippets(self, vectors: DataFrame, query: list[float], prompt: str, asked: list[str]) -> list[str]:
        own = vectors.where(F.col("collection").isin(*asked))
        dense, lexical = retrieval.dense_topk(own, query, within=["collection"]), retrieval.bm25_topk(own.select("id", "collection", "text"), prompt, within=["collection"])
        text = F.concat(F.lit("# Collection: "), "collection", F.lit("\n"), "text") if len(asked) > 1 else F.col("text")
        pooled = written(retrieval.fuse_ranks(dense, lexical, k=2 * retrieval.RETRIEVE * len(asked)).drop("rank").join(own.select("id", "collection", text.alias("text")), "id"), "snippets")
        try:
            found = retrieval.rerank(pooled, prompt, model=self.reranker).orderBy("rank").collect()
        except Exception:  # noqa: BLE001  a reranker may be out of reach
            LOG.exception("reranking failed")
            found = retrieval.rerank_fallback(pooled).orderBy("rank").collect()
        return [r["text"] for r in found]

    @staticmethod
    def format(found: dict[str, list[str]]) -> str:
        """The answer as Markdown; the symbols' part is left out if empty, the others say so."""
        parts = [("symbols", "Symbols", None), ("facts", "Facts", "No facts recorded."), ("outline", "Outline", "No outline matches."), ("snippets", "Snippets", "No snippets found.")]
        out = []
        for key, title, empty in parts:
            rows = found.get(key) or []
            if rows or empty:
                out.append(f"## {title}\n" + ("\n".join(f"- {r}" for r in rows) if rows else empty))
        return "\n\n".join(out)

    def trace_impact(self, symbol: str, direction: str = "upstream", depth: int = 3) -> dict:
        names = self.spark.createDataFrame([(symbol,)], "name string")
        g = self.graph()
        rows = (graph.impact_upstream if direction == "upstream" else graph.impact_downstream)(g, names)
        direct = [r.asDict() for r in rows.orderBy("relation", "path", "line").collect()]
        types = [r for r in direct if r["relation"] in ("IMPLEMENTS", "TYPE_OF")]
        edges = graph.dependency_edges(g["defined_in"], graph.uses(g))
        if direction != "upstream":
            edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        seeds = g["defined_in"].where(F.lower("symbol") == symbol.lower()).select(F.col("path").alias("node")).distinct()
        reach = [r.asDict() for r in graph.impact_transitive(edges, seeds, depth).where("depth > 0").orderBy("depth", "node").collect()]
        return {
            "symbol": symbol, "direction": direction, "max_depth": max(1, min(5, depth)), "definitions": [r.asDict() for r in graph.find_definition(g, names).collect()],
            "direct_impacts": [r for r in direct if r not in types], "type_hierarchies": types, "total_impacted_locations": len(direct), "transitive": reach,
        }

    def consolidate(self, purge: bool = False, stale: list[str] = (), invariants: list[dict] = (), project: str | None = None) -> dict[str, int]:
        """Archives and prunes episodes, finds subsystems, keeps invariants; what was done, in numbers.

        Archived rows are in the table ``archive`` before any leaves ``episodes``.  A report goes to reports/<time>.md.
        """
        episodes = self.store.read("episodes")
        own = episodes.where(F.col("project") == project) if project else episodes
        stay, archive = episodic.prune(own, list(stale), purge)
        done = {"archived": archive.count(), "active": stay.where(episodic.valid()).count()}
        self.store.upsert("archive", archive.withColumn("archived_at", F.current_timestamp()))
        self.store.write("episodes", stay.unionByName(episodes.where(~F.coalesce(F.col("project") == project, F.lit(False)))) if project else stay)
        g = self.graph()
        edges = graph.undirected(graph.dependency_edges(g["defined_in"], graph.uses(g)))
        members = consolidate.louvain(edges, g["files"].select(F.col("path").alias("node"))).select(F.col("node").alias("path"), "community").persist()
        systems = consolidate.subsystems(members, g["defined_in"])
        self.store.write("subsystems", systems)
        self.store.write("belongs_to", members.select("path", F.col("community").alias("subsystem")))
        done["subsystems"] = self.store.read("subsystems").count()
        members.unpersist()
        if invariants:
            rows = self.spark.createDataFrame([(i["rule"], i.get("domain", ""), i.get("rationale", "")) for i in invariants], "rule string, domain string, rationale string")
            self.store.upsert("invariants", rows.withColumn("updated_at", F.current_timestamp()))
        done["invariants"] = len(invariants)
        now = datetime.now()
        rows = self.store.read("subsystems").orderBy(F.desc("file_count"), "id").limit(100).collect()
        lines = [f"# Consolidation {now:%Y-%m-%d %H:%M}", "", *(f"- {k}: {v}" for k, v in done.items()), "", "## Subsystems", "", *(f"- {r['name']}: {r['description']}" for r in rows)]
        self.store.write_text(f"reports/{now:%Y-%m-%d-%H%M%S}.md", "\n".join(lines) + "\n")
        return done

    def watch(self, events: DataFrame, checkpoint: str, collection: str = "default", gap: str = "2 seconds", watermark: str = "10 seconds"):
        """Keeps the tables up to date with a stream of file events (see streaming.watch); a status goes to status.json.

        A micro-batch's changed files are read by path; one that is gone by then counts as removed.
        """

        def sync(paths: DataFrame) -> None:
            asked = [r["path"] for r in paths.collect()]  # of one micro-batch
            files = sources.read_files(self.spark, asked)
            n = self.sync(files, collection)
            self.store.write_text("status.json", json.dumps({"status": "watching", "last_sync": datetime.now().isoformat(timespec="seconds"), "last_files": asked[:20], "points": n}))

        return watch.watch(events, sync, self.remove, checkpoint, gap, watermark)

    def health(self) -> dict[str, str]:
        """Which tables can be read."""
        out = {}
        for name in schema.TABLES:
            try:
                self.store.read(name).limit(1).count()
                out[name] = "ok"
            except Exception as e:  # noqa: BLE001
                out[name] = f"error: {e}"[:200]
        return out

    def statistics(self) -> dict[str, int]:
        return graph.statistics(self.graph()).first().asDict() | ingest.cache_statistics(self.store.read("embedding_cache")).first().asDict()
