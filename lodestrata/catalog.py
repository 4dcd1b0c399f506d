"""Every operator as a query over the test tables, with its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .fixtures import prelude, table
from .functions import text as T
from .operators import chunking, consolidate, episodic, graph, guard, ingest, outline, retrieval, symbols
from .plans.engine import Engine
from .shared import written
from .sources import files as sources
from .store import delete_by, replace_by
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PROMPT = "where is the red widget of the economy with size 11"
LEX = "the of reand onthe eror thinre"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def words_sql(prompt: str) -> list[str]:
    return [t.replace("'", "''") for t in T.query_tokens(prompt)]


def score_sql(prompt: str, field: str, weight: int) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({field}), '{t}') THEN {weight} ELSE 0 END" for t in words_sql(prompt)) + ")"


# A. Scans, counts, caches.


@query(prelude("pages") + "SELECT page_id, path FROM pg WHERE NOT list_contains(string_split(path, '/'), 'de') AND lower(regexp_extract(path, '[^./]\\.([^./]+)$', 1)) = 'html'")
def scan_filter_ext(spark, sf):
    return X.pages(spark, sf).where((T.extension(F.col("path")) == "html") & ~T.excluded(F.col("path"), ["de", "*.pyc"])).select("page_id", "path")


@query(prelude("pages") + "SELECT page_id, path FROM pg WHERE NOT list_contains(string_split(path, '/'), 'fr') ORDER BY path, page_id LIMIT 300")
def workspace_scan_limit(spark, sf):
    return X.pages(spark, sf).where(~T.excluded(F.col("path"), ["fr"])).select("page_id", "path").orderBy("path", "page_id").limit(300)


@query(prelude("tok") + "SELECT lang, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM tok GROUP BY lang")
def token_count_by_lang(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(T.count_tokens(F.col("text"))).alias("tokens"))


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'markdown_section' WHEN doc_id % 4 = 1 THEN 'config_section' WHEN doc_id % 4 = 2 THEN 'ast_code' ELSE 'text_sentence' END AS chunk_type, count(*) AS n FROM documents GROUP BY 1")
def chunk_counts_by_type(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("markdown_section", "config_section", "ast_code", "text_sentence"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return ingest.chunk_counts(table(spark, sf, "documents").select(kind.alias("chunk_type")))


@query(
    prelude("pages", "links", "files", "named", "defs", "imps", "refs")
    + "SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM (SELECT symbol FROM defs UNION SELECT symbol FROM imps UNION SELECT symbol FROM refs)) AS n_symbols, (SELECT count(*) FROM files WHERE is_markdown) AS n_documents, "
    "(SELECT count(DISTINCT lang) FROM documents) AS n_tags, (SELECT count(*) FROM defs) AS n_defined_in, (SELECT count(*) FROM imps) AS n_imports, (SELECT count(*) FROM refs) AS n_references, (SELECT count(*) FROM links) AS n_links"
)
def graph_statistics(spark, sf):
    return graph.statistics(X.names(spark, sf))


@query("SELECT count(*) AS entries, sum(4 * len(embedding))::BIGINT AS total_bytes, round(sum(4 * len(embedding)) / (1024.0 * 1024.0), 2)::DOUBLE AS mb FROM embeddings")
def cache_stats(spark, sf):
    return ingest.cache_statistics(table(spark, sf, "embeddings"))


@query("SELECT label AS collection, count(*) AS points FROM embeddings GROUP BY label")
def collection_listing(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("collection")).agg(F.count(F.lit(1)).alias("points"))


HASH = r"sha256(regexp_replace(text, '^\s+|\s+$', '', 'g'))"


@query(f"WITH h AS (SELECT doc_id, {HASH} AS h FROM documents), c AS (SELECT DISTINCT h FROM h WHERE doc_id % 3 = 0) SELECT round(100.0 * count(c.h) / count(*), 1)::DOUBLE AS hit_rate FROM h LEFT JOIN c USING (h)")
def hit_rate(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))
    both = h.join(h.where("doc_id % 3 = 0").select(F.col("h").alias("c")).distinct(), F.col("h") == F.col("c"), "left")
    return both.agg(F.round(100.0 * F.count("c") / F.count(F.lit(1)), 1).alias("hit_rate"))


@query(f"SELECT {HASH} AS chunk_sha256, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedupe(spark, sf):
    return table(spark, sf, "documents").groupBy(T.content_hash(F.col("text")).alias("chunk_sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("kept")).where("n > 1")


@query(
    "WITH r AS (SELECT DISTINCT p_name AS label, 'symbol' AS kind, 0 AS p FROM part WHERE contains(lower(p_name), 're') UNION ALL SELECT DISTINCT s_name, 'file', 1 FROM supplier WHERE contains(lower(s_name), 're')), "
    "t AS (SELECT *, row_number() OVER (ORDER BY p, length(label), label)::INT AS rank FROM r) SELECT label, kind, rank FROM t WHERE rank <= 10"
)
def autocomplete_symbols(spark, sf):
    return graph.autocomplete(table(spark, sf, "part").select(F.col("p_name").alias("name")), table(spark, sf, "supplier").select(F.col("s_name").alias("path")), "Re")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'ERROR' WHEN o_orderstatus <> 'F' THEN 'STOPPED' WHEN o_custkey % 2 = 0 THEN 'RUNNING' ELSE 'DEAD_STALE_PID' END AS state FROM orders")
def watcher_status(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "RUNNING").otherwise("STOPPED")
    return o.select("o_orderkey", sources.watcher_state(status, F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 13 != 0).alias("state"))


# B. The graph.

DEFINITION = (
    prelude("pages", "files", "named", "defs", "q")
    + "SELECT DISTINCT query, symbol, path, kind, line, '' AS signature FROM defs JOIN q ON lower(symbol) = low "
    "UNION ALL SELECT DISTINCT query, coalesce(title, path), path, 'document', 1, '' FROM files JOIN q ON lower(title) = low OR ends_with(lower(path), low) WHERE is_markdown"
)


@query(DEFINITION)
def find_definition(spark, sf):
    return graph.find_definition(X.names(spark, sf), X.wanted(spark, sf))


@query(
    prelude("named", "imps", "refs", "pages", "q")
    + "SELECT query, 'import' AS what, path, symbol, line, module AS extra FROM imps JOIN q ON lower(symbol) = low UNION ALL SELECT query, 'reference', path, symbol, line, kind FROM refs JOIN q ON lower(symbol) = low"
)
def find_references(spark, sf):
    r = graph.find_references(X.names(spark, sf), X.wanted(spark, sf))
    one = lambda t, what, extra: r[t].select("query", F.lit(what).alias("what"), "path", "symbol", "line", F.col(extra).alias("extra"))
    return one("imports", "import", "module").unionByName(one("references", "reference", "kind"))


@query(prelude("pages", "links", "q") + "SELECT DISTINCT query, src, target, target AS label, 1 AS line, 'markdown_link' AS link_type FROM links JOIN q ON lower(target) = low")
def backlinks(spark, sf):
    return graph.backlinks(X.names(spark, sf), X.wanted(spark, sf))


@query(prelude("pages", "links") + "SELECT target, count(*) AS n FROM links GROUP BY target HAVING count(*) >= 3")
def concept_backlink_counts(spark, sf):
    return X.links(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(
    prelude("kdef", "kimp", "kref")
    + "SELECT DISTINCT d.path, d.symbol::VARCHAR AS symbol, i.path AS dependent, rel FROM kdef d JOIN (SELECT path, symbol, 'IMPORTS' AS rel FROM kimp UNION ALL SELECT path, symbol, 'REFERENCES' FROM kref) i USING (symbol) WHERE d.path <> i.path"
)
def file_impact_tree(spark, sf):
    d, i = X.keys(spark, sf)
    g = {"defined_in": d, "imports": i.withColumn("line", F.lit(1)), "references": X.key_references(spark, sf).withColumn("line", F.lit(1))}
    return graph.file_impact(g, d.select("path"))


@query(
    prelude("pages", "links", "named", "defs", "imps", "refs", "uses", "rels", "q")
    + ", homes AS (SELECT DISTINCT symbol, path, line FROM defs) SELECT DISTINCT query, rel AS relation, path, line FROM uses JOIN q ON lower(symbol) = low UNION SELECT query, 'LINKS_TO', src, 1 FROM links JOIN q ON lower(target) = low "
    "UNION SELECT query, r.rel, coalesce(h.path, 'unknown'), coalesce(h.line, 1) FROM rels r JOIN q ON lower(r.other) = low LEFT JOIN homes h ON h.symbol = r.symbol"
)
def impact_upstream(spark, sf):
    return graph.impact_upstream(X.names(spark, sf), X.wanted(spark, sf))


@query(
    prelude("pages", "links", "files", "named", "defs", "imps", "refs", "uses", "rels", "q")
    + ", homes AS (SELECT DISTINCT symbol, path, line FROM defs), own AS (SELECT DISTINCT query, path, symbol AS own FROM defs JOIN q ON lower(symbol) = low) "
    "SELECT DISTINCT query, rel AS relation, coalesce(h.path, 'unknown') AS path, coalesce(h.line, 1) AS line FROM own JOIN uses u USING (path) LEFT JOIN homes h ON h.symbol = u.symbol WHERE u.symbol <> own "
    "UNION SELECT query, 'LINKS_TO', l.target, 1 FROM files f JOIN q ON lower(title) = low OR ends_with(lower(f.path), low) JOIN links l ON l.src = f.path WHERE is_markdown "
    "UNION SELECT query, r.rel, coalesce(h.path, 'unknown'), coalesce(h.line, 1) FROM rels r JOIN q ON lower(r.symbol) = low LEFT JOIN homes h ON h.symbol = r.other"
)
def impact_downstream(spark, sf):
    g = X.names(spark, sf)
    g["defined_in"] = written(g["defined_in"].select("symbol", "path", "line").distinct(), "definitions")  # joined once, read several times
    return graph.impact_downstream(g, X.wanted(spark, sf))


SEED = "(SELECT min(s_suppkey)::VARCHAR FROM supplier)"


@query(
    prelude("kdef", "kimp", "kdep", recursive=True)
    + f", r AS (SELECT {SEED} AS node, 0 AS depth UNION SELECT src, depth + 1 FROM r JOIN kdep ON dst = node WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node"
)
def impact_transitive(spark, sf):
    d, i = X.keys(spark, sf)
    seed = table(spark, sf, "supplier").agg(F.min("s_suppkey").cast("string").alias("node"))
    return graph.impact_transitive(graph.dependency_edges(d, i), seed, 3)


@query(
    prelude("kdef", "kimp", "kdep", recursive=True)
    + f", r AS (SELECT {SEED} AS node, 0 AS depth UNION SELECT src, depth + 1 FROM r JOIN kdep ON dst = node WHERE depth < 3), n AS (SELECT node, min(depth)::INT AS depth FROM r GROUP BY node), "
    "d AS (SELECT dst AS node, count(DISTINCT src) AS dependents FROM kdep GROUP BY dst) SELECT node, depth, coalesce(dependents, 0)::BIGINT AS dependents, CASE WHEN coalesce(dependents, 0) > 5 THEN 'HIGH' WHEN coalesce(dependents, 0) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM n LEFT JOIN d USING (node)"
)
def blast_radius(spark, sf):
    """Who depends on the first supplier, directly and through others, and how risky a change of each is."""
    d, i = X.keys(spark, sf)
    edges = graph.dependency_edges(d, i)
    seed = table(spark, sf, "supplier").agg(F.min("s_suppkey").cast("string").alias("node"))
    direct = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("dependents"))
    rows = graph.impact_transitive(edges, seed, 3).join(direct, "node", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    return rows.withColumn("risk", graph.risk_of_file(F.col("dependents")))


@query(prelude("kdef", "kimp", "kdep") + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(n)::BIGINT AS weight FROM kdep GROUP BY 1, 2")
def file_dependency_matrix(spark, sf):
    d, i = X.keys(spark, sf)
    return graph.undirected(graph.dependency_edges(d, i))


VIEW_NODES = "SELECT 'symbol:' || symbol AS id, symbol AS label, 'symbol' AS grp FROM {symbols} UNION SELECT 'file:' || path, path, 'file' FROM files UNION SELECT 'tag:' || lang, lang, 'tag' FROM documents"


@query(prelude("pages", "files", "named", "defs", "imps", "refs") + ", s AS (SELECT symbol FROM defs UNION SELECT symbol FROM imps UNION SELECT symbol FROM refs) " + VIEW_NODES.format(symbols="s"))
def raw_graph_view(spark, sf):
    return graph.raw_view(X.names(spark, sf))[0]


@query(
    prelude("pages", "links", "named", "defs", "imps", "refs")
    + "SELECT 'symbol:' || symbol AS src, 'file:' || path AS dst, 'DEFINED_IN' AS rel FROM defs UNION SELECT 'file:' || path, 'symbol:' || symbol, 'IMPORTS' FROM imps WHERE symbol IN (SELECT symbol FROM defs) "
    "UNION SELECT 'file:' || path, 'symbol:' || symbol, 'REFERENCES' FROM refs WHERE symbol IN (SELECT symbol FROM defs) UNION SELECT 'file:' || source, 'tag:' || lang, 'HAS_TAG' FROM documents UNION SELECT 'file:' || src, 'concept:' || target, 'LINKS_TO' FROM links"
)
def clean_graph_view(spark, sf):
    return graph.clean_view(X.names(spark, sf))[1]


@query(
    prelude("kdef", "kimp", "kref")
    + "SELECT d.path, count(DISTINCT i.path) AS affected_files, count(DISTINCT d.symbol) AS symbols, CASE WHEN count(DISTINCT i.path) > 5 THEN 'HIGH' WHEN count(DISTINCT i.path) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM kdef d JOIN (SELECT path, symbol FROM kimp UNION ALL SELECT path, symbol FROM kref) i USING (symbol) WHERE d.path <> i.path GROUP BY d.path"
)
def impact_summary_risk(spark, sf):
    return graph.impact_summary(file_impact_tree(spark, sf))


@query(
    prelude("named", "defs", "imps", "refs", "uses")
    + ", d AS (SELECT symbol, count(DISTINCT path || rel) AS direct, count(DISTINCT path) AS nodes FROM uses GROUP BY symbol) SELECT symbol, direct, nodes, CASE WHEN direct > 4 THEN 'HIGH' WHEN nodes > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d"
)
def symbol_risk(spark, sf):
    rows = graph.uses(X.names(spark, sf)).groupBy("symbol").agg(F.countDistinct(F.concat("path", "rel")).alias("direct"), F.countDistinct("path").alias("nodes"))
    return rows.withColumn("risk", graph.risk_of_symbol(F.col("direct"), F.col("nodes")))


@query(prelude("pages", "files", "named", "defs", "q") + "SELECT query, count(*) AS n FROM (SELECT DISTINCT query, symbol, path, kind, line FROM defs JOIN q ON lower(symbol) = low) GROUP BY query")
def multi_name_lookup(spark, sf):
    return graph.find_definition(X.names(spark, sf), X.wanted(spark, sf)).where("kind <> 'document'").groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query(prelude("kdef", "kimp", "kdep") + "SELECT dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM kdep) WHERE k <= 10")
def per_parent_limit(spark, sf):
    d, i = X.keys(spark, sf)
    return graph.first_per_parent(graph.dependency_edges(d, i), "dst", ["src"], 10).select("dst", "src")


@query(
    "WITH r AS (SELECT 'r' || r_regionkey AS grp, 'world/' || r_name || '/' || n_name || '/' || s_name AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) "
    "SELECT grp, CASE WHEN count(DISTINCT string_split(path, '/')[3]) = 1 THEN array_to_string(string_split(min(path), '/')[1:3], '/') ELSE array_to_string(string_split(min(path), '/')[1:2], '/') END AS prefix FROM r GROUP BY grp"
)
def common_prefix_name(spark, sf):
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    path = F.concat_ws("/", F.lit("world"), "r_name", "n_name", "s_name")
    return consolidate.common_prefix(rows.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("grp"), path.alias("path")), "grp")


@query("WITH RECURSIVE up(node, ancestor, depth) AS (SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier UNION ALL SELECT node, 'r' || n_regionkey, 2 FROM up JOIN nation ON ancestor = 'n' || n_nationkey) SELECT ancestor, depth, count(*) AS n FROM up GROUP BY ALL")
def containment_depth(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    s.createOrReplaceTempView("_supplier")
    n.createOrReplaceTempView("_nation")
    return spark.sql(
        "WITH RECURSIVE up(node, ancestor, depth) AS (SELECT concat('s', s_suppkey), concat('n', s_nationkey), 1 FROM _supplier UNION ALL "
        "SELECT node, concat('r', n_regionkey), depth + 1 FROM up JOIN _nation ON ancestor = concat('n', n_nationkey)) SELECT ancestor, depth, count(*) AS n FROM up GROUP BY ALL"
    )


# C. Text.


@query(f"SELECT doc_id, {score_sql(LEX, 'text', 3)} AS score FROM documents WHERE {score_sql(LEX, 'text', 3)} > 0")
def keyword_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.keyword_score(T.query_tokens(LEX), F.col("text"), 3).alias("score")).where("score > 0")


OUTLINE = "o AS (SELECT 'docs/' || source || '/' || doc_id || '.txt' AS path, 'File: ' || doc_id || '.txt (' || len(string_split(text, chr(10))) || ' lines)' AS l0, array_to_string(string_split(text, chr(10))[1:30], chr(10)) AS l1 FROM documents)"


def _outlines(spark, sf):
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return outline.build_outlines(table(spark, sf, "documents").select(path.alias("path"), "text"))


@query(
    f"WITH {OUTLINE} SELECT path, {score_sql(LEX, 'path', 5)} + {score_sql(LEX, 'l0', 3)} + {score_sql(LEX, 'l1', 2)} AS score FROM o ORDER BY score DESC, path LIMIT 5"
)
def outline_search_topk(spark, sf):
    return outline.search_outlines(_outlines(spark, sf), LEX).select("path", "score")


@query(f"WITH {OUTLINE} SELECT path, l0 AS l0_summary, sha256(l1) AS l1, length(l1)::INT AS n FROM o")
def outline_plain_l1(spark, sf):
    return _outlines(spark, sf).select("path", "l0_summary", F.sha2("l1_architecture", 256).alias("l1"), F.length("l1_architecture").alias("n"))


@query(
    prelude("src")
    + "SELECT path, 'Defines: ' || name || ', test_' || lower(name) AS l0_summary, 'class ' || name || chr(10) || '    def size(self)' || chr(10) || '    def brand(self)' || chr(10) || 'def test_' || lower(name) || '()' AS l1_architecture FROM src"
)
def outline_code(spark, sf):
    return outline.build_outlines(X.sources(spark, sf)).select("path", "l0_summary", "l1_architecture")


@query()
def sentence_chunks(spark, sf):
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return chunking.chunk_documents(table(spark, sf, "documents").select(path.alias("path"), "text")).select("path", "chunk_no", "start_char", "end_char", F.length("text").alias("chars"))


@query(
    prelude("note")
    + "SELECT path, 0 AS chunk_no, lang_title || ' > ' || lang AS scope FROM (SELECT *, doc_id::VARCHAR AS lang_title FROM note) UNION ALL SELECT path, 1, doc_id || ' > ' || lang || ' > Part ' || (doc_id % 10) FROM note"
)
def markdown_sections(spark, sf):
    return chunking.chunk_documents(X.notes(spark, sf)).select("path", "chunk_no", "scope")


@query(
    prelude("note")
    + "SELECT path, lang AS name, 1 AS level, 1 AS line, lang AS heading_path, path || '#' || lang AS id FROM note UNION ALL SELECT path, 'Part ' || (doc_id % 10), 2, 5, lang || ' > Part ' || (doc_id % 10), path || '#Part-' || (doc_id % 10) FROM note"
)
def markdown_headings(spark, sf):
    n = symbols.extract_notes(X.notes(spark, sf))
    return n.select("path", F.explode("sections").alias("s")).select("path", "s.name", "s.level", "s.line", "s.heading_path", "s.id")


@query(
    prelude("note")
    + "SELECT path, 'wiki_link' AS link_type, lang || '/' || (doc_id - 1) AS target_name, 'before' AS label, 7 AS line FROM note UNION ALL SELECT path, 'markdown_link', './' || (doc_id + 1) || '.md', 'the next', 7 FROM note"
)
def wiki_links(spark, sf):
    n = symbols.extract_notes(X.notes(spark, sf))
    return n.select("path", F.explode("links").alias("l")).select("path", "l.link_type", "l.target_name", "l.label", "l.line")


@query(prelude("note") + "SELECT path, 'tag-' || source AS tag FROM note")
def inline_tags(spark, sf):
    return symbols.extract_notes(X.notes(spark, sf)).select("path", F.explode("tags").alias("tag"))


@query()
def config_sections(spark, sf):
    o = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 97).alias("k")).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), "o_orderstatus")))).alias("m"))
    return chunking.chunk_documents(o.select(F.concat(F.lit("conf/"), F.col("k").cast("string"), F.lit(".json")).alias("path"), F.to_json("m").alias("text"))).select("path", "chunk_no", "scope")


@query(
    "SELECT doc_id, '# File: ' || source || chr(10) || '# Scope: ' || lang || chr(10) || CASE WHEN quality IS NULL THEN '' ELSE '# Note: quality ' || quality || chr(10) END || chr(10) AS preamble FROM documents LEFT JOIN labels USING (doc_id)"
)
def preamble_lines(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", T.preamble(F.col("source"), scope=F.col("lang"), note=F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("preamble"))


@query(
    "WITH p AS (SELECT p_partkey, 'where is ' || upper(replace(p_name, ' ', '_')) || ' and `' || replace(p_brand, '#', '_') || '` or make_' || lower(p_type) || '()' AS s FROM part) "
    "SELECT p_partkey, array_to_string([regexp_extract(s, '`([^`]*)`', 1), regexp_extract(s, 'is ([A-Z_]+)', 1), regexp_extract(s, '(make_[a-z]+)', 1)], ',') AS candidates FROM p"
)
def symbol_candidates(spark, sf):
    p = table(spark, sf, "part")
    s = F.concat(F.lit("where is "), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(" and `"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("` or make_"), F.lower("p_type"), F.lit("()"))
    return p.select("p_partkey", F.array_join(T.symbol_candidates(s), ",").alias("candidates"))


@query(
    r"WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}\p{M}_]+'), lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))) AS w FROM documents), i AS (SELECT unnest(['the', 'and', 'thon', 'inre', 'zzz']) AS symbol) "
    "SELECT doc_id, coalesce(string_agg(symbol, ',' ORDER BY symbol), '') AS used FROM w LEFT JOIN i ON list_contains(w.w, symbol) AND symbol <> 'and' GROUP BY doc_id"
)
def dependency_resolution(spark, sf):
    imported = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit("m").alias("module")) for s in ("the", "and", "thon", "inre", "zzz")])
    used = T.dependencies(F.col("text"), imported, F.lit("and"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(used, lambda d: d["symbol"]), ",").alias("used"))


@query("SELECT p_partkey, upper(p_name[1]) || regexp_extract(p_name, '^\\w(\\w*)', 1) || p_partkey AS targets FROM part")
def test_targets(spark, sf):
    s = X.sources(spark, sf)
    known = F.array(F.lit("make_brand"), F.lit("os"), F.col("name"))
    body = F.regexp_extract("text", r"(?s)(def test_.*)", 1)
    return s.select("p_partkey", F.array_join(T.test_targets(F.concat(F.lit("test_"), F.lower("name")), body, F.col("path"), known), ",").alias("targets"))


@query(
    "WITH c AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1) SELECT n_regionkey, CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], ', ') || ', +' || (len(l) - 3) || ' more' ELSE array_to_string(l, ', ') END AS shown FROM c"
)
def more_n_truncation(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(T.shown(F.sort_array(F.collect_list("n_name")), 3).alias("shown"))


@query("SELECT doc_id, coalesce(quality::VARCHAR, 'untracked') AS commit_hash FROM documents LEFT JOIN labels USING (doc_id)")
def commit_metadata(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    commits = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"), F.col("quality").cast("string").alias("commit_hash"), F.lit("2024-01-01").alias("commit_date"), F.lit("m").alias("commit_msg"))
    return chunking.with_commits(chunks, commits).select("doc_id", "commit_hash")


@query("SELECT s_suppkey, array_to_string(list_transform(string_split(lower(s_name), '#'), lambda x: upper(x[1]) || x[2:]), '#') AS title FROM supplier")
def title_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", T.title_case(F.lower("s_name")).alias("title"))


# D. Retrieval.

TOP = prelude("vec") + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM vec) "


@query(TOP + "SELECT id, score, rank FROM r WHERE rank <= 30")
def dense_topk(spark, sf):
    return retrieval.dense_topk(X.vectors(spark, sf), X.vector(spark, sf)).select("id", "score", "rank")


def _bm25(name: str, where: str = "") -> str:
    asked = list(dict.fromkeys(LEX.split()))
    terms = ", ".join(f"('{t}')" for t in asked)
    return f"""{name} AS (
      SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (
        SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM (
          SELECT *, count(*) FILTER (WHERE tf > 0) OVER (PARTITION BY t) AS df, count(*) OVER (PARTITION BY t) AS n, avg(size) OVER (PARTITION BY t) AS mean FROM (
            SELECT doc_id, t, len(w) AS size, len(list_filter(w, lambda x: x = t)) AS tf FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents {where}), (VALUES {terms}) v(t)
          )) GROUP BY doc_id) WHERE score > 0)"""


@query("WITH " + _bm25("b") + " SELECT id, score, rank FROM b WHERE rank <= 30")
def bm25_topk(spark, sf):
    return retrieval.bm25_topk(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), LEX).select("id", "score", "rank")


FUSE = prelude("vec") + ", a AS (SELECT * FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vec) WHERE rank <= 30), " + _bm25("b0") + ", b AS (SELECT * FROM b0 WHERE rank <= 30) "


def _two(spark, sf):
    return retrieval.dense_topk(X.vectors(spark, sf), X.vector(spark, sf)), retrieval.bm25_topk(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), LEX)


@query(
    FUSE + ", f AS (SELECT id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 8)::DOUBLE AS score FROM a FULL JOIN b USING (id)) SELECT id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM f) WHERE rank <= 30"
)
def hybrid_rrf(spark, sf):
    return retrieval.fuse_ranks(*_two(spark, sf))


@query(
    FUSE + ", x AS (SELECT id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS s FROM a), "
    "y AS (SELECT id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS s FROM b), "
    "f AS (SELECT id, round(0.5 * coalesce(x.s, 0) + 0.5 * coalesce(y.s, 0), 6)::DOUBLE AS score FROM x FULL JOIN y USING (id)) SELECT id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM f) WHERE rank <= 30"
)
def hybrid_alpha(spark, sf):
    return retrieval.fuse_scores(*_two(spark, sf))


@query(
    prelude("vec")
    + "SELECT id, collection, score, rank, '# Collection: ' || collection || chr(10) || 'vector ' || id AS text FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, id)::INT AS rank FROM vec WHERE collection IN ('c1', 'c2', 'c3')) WHERE rank <= 30"
)
def federated_topk(spark, sf):
    own = retrieval.resolve_collections("c1, c2,c3", [], "c0")
    return retrieval.federated(X.vectors(spark, sf), X.vector(spark, sf), own).select("id", "collection", "score", "rank", "text")


@query(
    "WITH " + _bm25("b") + f", s AS (SELECT b.id, b.score, round({score_sql(LEX, 'text[1:1200]', 1)} / {len(set(T.query_tokens(LEX)))}.0, 6)::DOUBLE AS rerank_score FROM b JOIN documents d ON d.doc_id = b.id WHERE rank <= 30) "
    "SELECT id, rerank_score, rank FROM (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, score DESC, id)::INT AS rank FROM s) WHERE rank <= 5"
)
def rerank_lexical(spark, sf):
    pooled = retrieval.bm25_topk(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), LEX)
    return retrieval.rerank(pooled.drop("rank"), LEX).select("id", "rerank_score", "rank")


@query(
    prelude("vec")
    + ", p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, id) AS k FROM vec WHERE collection IN ('c2', 'c1')) WHERE k <= 30) SELECT id, collection, rank FROM (SELECT *, row_number() OVER (ORDER BY CASE collection WHEN 'c2' THEN 1 ELSE 2 END, score DESC, id)::INT AS rank FROM p) WHERE rank <= 5"
)
def rerank_fallback(spark, sf):
    pooled = retrieval.federated(X.vectors(spark, sf), X.vector(spark, sf), ["c2", "c1"])
    return retrieval.rerank_fallback(pooled.drop("rank"), collections=["c2", "c1"]).select("id", "collection", "rank")


@query()
def hashed_embeddings(spark, sf):
    rows = retrieval.embed(table(spark, sf, "benchmark").select("item_id", "text"))
    return rows.select("item_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")), 4).alias("norm"))


# E. Ingest.


@query(
    prelude("scan", "cach")
    + "SELECT coalesce(s.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted' WHEN abs(s.mtime - c.mtime) < 1e-4 THEN 'unchanged' WHEN s.sha = c.sha THEN 'touched' ELSE 'modified' END AS status FROM scan s FULL JOIN cach c ON s.path = c.path"
)
def change_classification(spark, sf):
    return ingest.classify(*X.snapshots(spark, sf)).select("path", "status")


@query(prelude("scan", "cach") + "SELECT path, point FROM cach ANTI JOIN scan USING (path)")
def purge_missing(spark, sf):
    scanned, cached = X.snapshots(spark, sf)
    return ingest.missing(cached, scanned).select("path", F.explode("point_ids").alias("point"))


@query(prelude("scan", "cach") + "SELECT path, s.mtime FROM scan s JOIN cach c USING (path) WHERE abs(s.mtime - c.mtime) >= 1e-4 AND s.sha = c.sha")
def mtime_touch_only(spark, sf):
    return ingest.classify(*X.snapshots(spark, sf)).where("status = 'touched'").select("path", "mtime")


PROBE = f"WITH h AS (SELECT doc_id AS idx, {HASH} AS h FROM documents), c AS (SELECT DISTINCT h FROM h WHERE idx % 3 = 0) "


def _probe(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")
    cache = ingest.cache_keys(texts.where("idx % 3 = 0"), "m").select("chunk_sha256", "model").distinct().withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    return ingest.probe(texts, cache, "m")


@query(PROBE + "SELECT idx, h AS chunk_sha256 FROM h SEMI JOIN c USING (h)")
def cache_probe_hits(spark, sf):
    return _probe(spark, sf)[0].select("idx", "chunk_sha256")


@query(PROBE + "SELECT idx, h AS chunk_sha256 FROM h ANTI JOIN c USING (h)")
def cache_probe_misses(spark, sf):
    return _probe(spark, sf)[1].select("idx", "chunk_sha256")


@query("SELECT source AS path, string_agg('p' || doc_id, ',' ORDER BY 'p' || doc_id) AS point_ids FROM documents GROUP BY source")
def file_to_point_ids(spark, sf):
    points = table(spark, sf, "documents").select(F.col("source").alias("path"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("point_id"))
    return ingest.file_points(points).select("path", F.array_join("point_ids", ",").alias("point_ids"))


@query(prelude("kdef", "kimp") + "SELECT path, symbol::VARCHAR AS symbol FROM kdef WHERE path NOT IN (SELECT path FROM kimp WHERE symbol % 2 = 0) UNION ALL SELECT path, symbol::VARCHAR FROM kimp WHERE symbol % 2 = 0")
def upsert_replace_file(spark, sf):
    d, i = X.keys(spark, sf)
    new = i.where("cast(symbol as long) % 2 = 0").select("path", "symbol")
    return replace_by(d.select("path", "symbol"), new, "path", new)


@query(prelude("kdef", "kimp") + "SELECT path, count(*) AS n FROM kdef WHERE path NOT IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY path")
def remove_file(spark, sf):
    d, _ = X.keys(spark, sf)
    gone = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("path"))
    return delete_by(d, "path", gone).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH f AS (SELECT DISTINCT 'notes/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.markdown' END AS path, doc_id FROM documents WHERE doc_id % 5 <> 0), l AS (SELECT doc_id, (doc_id + 1)::VARCHAR AS target FROM documents) "
    "SELECT 'notes/' || l.doc_id || '.md' AS src, target AS target_name, f.path AS target_path, f.path IS NOT NULL AS is_resolved FROM l LEFT JOIN f ON f.doc_id = l.doc_id + 1"
)
def link_target_priority(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    files = d.where("doc_id % 5 <> 0").select(F.concat(F.lit("notes/"), i, F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".markdown")).alias("path"))
    own = d.select(F.concat(F.lit("notes/"), i, F.lit(".md")).alias("src"), (F.col("doc_id") + 1).cast("string").alias("target_name"))
    return symbols.resolve_links(own, files)


# F. Episodes and facts.

FACT_TEXT = "source || ' HAS_BRAND ' || target || ': ' || fact"
EPISODE_TEXT = "'Episode ' || name || ': ' || content[1:200]"


def _facts_sql(prompt: str, limit: int, facts_where: str = "true") -> str:
    return (
        prelude("fcts", "eps")
        + f", r AS (SELECT {FACT_TEXT} AS text, 'fact' AS source, {score_sql(prompt, FACT_TEXT, 3)} AS score, to_timestamp(t) AS t FROM fcts WHERE NOT superseded AND {facts_where} "
        + f"UNION ALL SELECT {EPISODE_TEXT}, 'episode', {score_sql(prompt, 'concat_ws(chr(32), name, content, chr(32))', 2)}, to_timestamp(t) FROM eps WHERE NOT superseded), g AS (SELECT source, text, max(score) AS score, max(t) AS t FROM r WHERE score > 0 GROUP BY ALL) "
        + f"SELECT source, text, score, rank FROM (SELECT *, row_number() OVER (ORDER BY source DESC, score DESC, t DESC, text)::INT AS rank FROM g) WHERE rank <= {limit}"
    )


@query(_facts_sql(PROMPT, 5))
def fact_search(spark, sf):
    return episodic.search_facts(X.facts(spark, sf), X.episodes(spark, sf), PROMPT).select("source", "text", "score", "rank")


@query(_facts_sql("Brand#7 thinre", 40, "p_size_ok").replace("p_size_ok", "fact LIKE '% of size 7'"))
def episode_fillup(spark, sf):
    return episodic.search_facts(X.facts(spark, sf).where("fact like '% of size 7'"), X.episodes(spark, sf), "Brand#7 thinre", 40).select("source", "text", "score", "rank")


PATTERNS = [(0, "thinre", "a", "first"), (1, "the", "b", "second"), (2, "and", "c", "third")]


@query(
    prelude("eps")
    + ", m AS (SELECT *, CASE WHEN superseded THEN NULL WHEN contains(content, 'thinre') THEN 'a' WHEN contains(content, 'the') THEN 'b' WHEN contains(content, 'and') THEN 'c' END AS superseded_by FROM eps) SELECT superseded_by, count(*) AS n FROM m WHERE superseded_by IS NOT NULL GROUP BY 1"
)
def supersede_pattern_count(spark, sf):
    done = episodic.supersede(X.episodes(spark, sf), spark.createDataFrame(PATTERNS, "seq int, pattern string, by string, reason string"))
    return done.where("superseded_by is not null").groupBy("superseded_by").agg(F.count(F.lit(1)).alias("n"))


@query(prelude("fcts") + "SELECT fact, count(*) AS n, count(*) FILTER (WHERE superseded OR contains(fact, 'size 1')) AS gone FROM fcts GROUP BY fact")
def delete_fact(spark, sf):
    done = episodic.delete_fact({"episodes": X.episodes(spark, sf), "facts": X.facts(spark, sf)}, "size 1", "wrong")
    return done["facts"].groupBy("fact").agg(F.count(F.lit(1)).alias("n"), F.count_if("superseded").alias("gone"))


@query(prelude("eps") + "SELECT project, count(*) AS active FROM eps WHERE NOT superseded GROUP BY project")
def active_count(spark, sf):
    return X.episodes(spark, sf).where(episodic.valid()).groupBy("project").agg(F.count(F.lit(1)).alias("active"))


@query(prelude("eps") + "SELECT name, project FROM eps WHERE superseded OR name IN ('1:0', '2:1')")
def prune_archive(spark, sf):
    return episodic.prune(X.episodes(spark, sf), ["1:0", "2:1"], purge=True)[1].select("name", "project")


@query("SELECT DISTINCT text AS title FROM benchmark WHERE text NOT IN (SELECT text FROM conversations WHERE text IS NOT NULL)")
def journal_sync_missing(spark, sf):
    entries = table(spark, sf, "benchmark").select(F.col("text").alias("title")).distinct()
    return episodic.journal_missing(entries, X.episodes(spark, sf).withColumn("name", F.col("content")))


@query("SELECT conv_id::VARCHAR AS episode, role AS entity FROM conversations UNION SELECT conv_id::VARCHAR, 'reviewer' FROM conversations WHERE conv_id % 2 = 0")
def entity_mentions_upsert(spark, sf):
    from .store import upsert

    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("episode"), F.col("role").alias("entity"))
    new = c.where("cast(episode as long) % 2 = 0").select("episode", F.lit("reviewer").alias("entity")).unionByName(c.where("entity = 'user'"))
    return upsert(c.distinct(), new, ["episode", "entity"])


@query("SELECT DISTINCT conv_id, 'HAS_' || upper(replace(role || ' turn', ' ', '_')) AS relation FROM conversations")
def relation_names(spark, sf):
    relation = F.concat(F.lit("HAS_"), F.upper(F.replace(F.concat("role", F.lit(" turn")), F.lit(" "), F.lit("_"))))
    return table(spark, sf, "conversations").select("conv_id", relation.alias("relation")).distinct()


# G. Code and compiler indexes.


@query(
    prelude("src")
    + "SELECT path, unnest(['import', 'import', 'declaration', 'declaration', 'declaration', 'reference', 'reference', 'declaration', 'reference', 'reference']) AS relation, "
    "unnest(['make_brand', 'os', name, 'size', 'brand', 'make_brand', 'size', 'test_' || lower(name), name, 'size']) AS name, unnest(['', '', 'class', 'method', 'method', 'call', 'call', 'function', 'call', 'call']) AS kind, "
    "unnest([1, 2, 5, 8, 11, 12, 12, 15, 16, 17])::INT AS line, unnest([NULL, NULL, NULL, name, name, NULL, NULL, NULL, NULL, NULL]) AS parent FROM src"
)
def python_symbols(spark, sf):
    return symbols.extract_symbols(X.sources(spark, sf)).select("path", "relation", "name", "kind", "line", "parent")


@query(
    "SELECT 'src/Part' || p_partkey || '.rs' AS path, unnest(['import', 'declaration', 'declaration', 'reference']) AS relation, unnest(['Brand', 'Part' || p_partkey, 'size', 'check']) AS name, "
    "unnest(['', 'struct', 'method', 'call']) AS kind, unnest([1, 3, 8, 9])::INT AS line, unnest([NULL, NULL, 'Part' || p_partkey, NULL]) AS parent FROM part"
)
def lexical_symbols(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    text = F.concat(F.lit("use shop::Brand;\n\npub struct "), name, F.lit(" {\n    size: u32,\n}\n\nimpl "), name, F.lit(" {\n    pub fn size(&self) -> u32 {\n        Brand::check(self.size)\n    }\n}\n"))
    return symbols.extract_symbols(p.select(F.concat(F.lit("src/"), name, F.lit(".rs")).alias("path"), text.alias("text"))).select("path", "relation", "name", "kind", "line", "parent")


@query("SELECT p_partkey, 'make_' || lower(p_type) AS name, replace(p_brand, '#', '_') AS parent FROM part")
def scip_name_parent(spark, sf):
    p = table(spark, sf, "part")
    symbol = F.concat(F.lit("pip python shop 1.0 `shop.parts`/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("#make_"), F.lower("p_type"), F.lit("()."))
    return p.select("p_partkey", T.scip_name(symbol).alias("name"), T.scip_parent(symbol).alias("parent"))


@query("SELECT CASE WHEN p_size & 1 <> 0 THEN 'definition' WHEN p_size & 2 <> 0 THEN 'import' WHEN p_size & 4 <> 0 THEN 'write' ELSE 'call' END AS role, count(*) AS n FROM part GROUP BY 1")
def scip_occurrence_roles(spark, sf):
    return table(spark, sf, "part").groupBy(T.scip_role(F.col("p_size")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'rust' WHEN count(*) > 4 THEN 'python' ELSE 'unknown' END AS language FROM conversations GROUP BY conv_id")
def manifest_indexer(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("s"), F.count(F.lit(1)).alias("n"))
    files = F.filter(F.array(F.when(F.col("s"), "Cargo.toml"), F.when(F.col("n") > 4, "setup.py"), F.lit("README")), lambda x: x.isNotNull())
    return c.select("conv_id", sources.manifest_indexer(files).alias("language"))


@query(
    prelude("src")
    + "SELECT path, '# File: ' || path || chr(10) || '# Module: shop.tests.part' || k || chr(10) || '# Skeleton' || chr(10) || '# Imports: shop.brands, os' || chr(10) || 'class ' || name || '  # A part.' || chr(10) "
    "|| '    def size(self)' || chr(10) || '    def brand(self)' || chr(10) || 'def test_' || lower(name) || '()' AS text FROM src"
)
def skeleton_chunks(spark, sf):
    return chunking.chunk_documents(X.sources(spark, sf)).where("chunk_type = 'ast_skeleton'").select("path", "text")


@query(
    prelude("src")
    + "SELECT path, unnest([1, 2])::INT AS chunk_no, unnest([name, 'test_' || lower(name)]) AS scope, unnest([47, 173 + n + z])::INT AS start_char, unnest([171 + n + z, 223 + 3 * n + z])::INT AS end_char, NULL::VARCHAR AS parent_id FROM src"
)
def code_chunks(spark, sf):
    return chunking.chunk_documents(X.sources(spark, sf), limit=60, overlap=10, stub=30, coalesce=50).where("chunk_type = 'ast_code'").select("path", "chunk_no", "scope", "start_char", "end_char", "parent_id")


# H. Changes.


@query(
    prelude("ev")
    + ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, event_id) AS run FROM g) "
    "SELECT path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS event_type FROM s GROUP BY path, run"
)
def debounce_sessions(spark, sf):
    rows = watch.debounce(X.file_events(spark, sf), "2 hours")
    return rows.select("path", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n_events", "event_type")


@query(prelude("ev") + "SELECT path, arg_max(event_type, (ts, event_id)) AS event_type, epoch_us(max(ts)) AS last_us FROM ev GROUP BY path")
def last_event_wins(spark, sf):
    return watch.last_event(X.file_events(spark, sf)).select("path", "event_type", F.unix_micros("last_ts").alias("last_us"))


@query(prelude("ev") + "SELECT event_id, path, CASE event_type WHEN 'moved' THEN 'deleted' ELSE event_type END AS event_type FROM ev UNION ALL SELECT event_id, dest, 'modified' FROM ev WHERE event_type = 'moved'")
def move_expansion(spark, sf):
    return watch.expand_moves(X.file_events(spark, sf)).select("event_id", "path", "event_type")


@query(
    prelude("ev")
    + ", l AS (SELECT path, arg_max(event_type, (ts, event_id)) AS e FROM ev GROUP BY path) SELECT (SELECT count(*) FROM ev) AS total_processed, (SELECT epoch_us(max(ts)) FROM ev) AS last_us, (SELECT arg_max(path, (ts, event_id)) FROM ev) AS last_synced_file, (SELECT count(*) FROM l WHERE e <> 'deleted') AS pending_count"
)
def watch_telemetry(spark, sf):
    return watch.telemetry(X.file_events(spark, sf)).select("total_processed", F.unix_micros("last_event_time").alias("last_us"), "last_synced_file", "pending_count")


# I. Consolidation, guards, answers.


def _weighted(spark, sf):
    d, i = X.keys(spark, sf)
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("node"))
    return graph.undirected(graph.dependency_edges(d, i)), nodes


@query()
def louvain_communities(spark, sf):
    return consolidate.louvain(*_weighted(spark, sf))


@query()
def label_propagation(spark, sf):
    return consolidate.label_propagation(*_weighted(spark, sf))


@query(
    prelude("kdef", "kimp", "kdep", recursive=True)
    + ", u AS (SELECT src AS a, dst AS b FROM kdep UNION SELECT dst, src FROM kdep), r AS (SELECT s_suppkey::VARCHAR AS node, s_suppkey::VARCHAR AS other FROM supplier UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node"
)
def dependency_components(spark, sf):
    return consolidate.connected(*_weighted(spark, sf))


@query()
def subsystem_summary(spark, sf):
    edges, nodes = _weighted(spark, sf)
    d, _ = X.keys(spark, sf)
    members = consolidate.louvain(edges, nodes).select(F.col("node").alias("path"), "community")
    return consolidate.subsystems(members, d.withColumn("line", F.lit(1))).drop("updated_at")


@query("SELECT 'd' || item_id AS domain, 'rule ' || item_id AS rule, 'because ' || (item_id % 3) AS rationale FROM benchmark")
def invariant_parse(spark, sf):
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("# Invariants\n\n### [d"), i, F.lit("] title\n- **Rule**: rule "), i, F.lit("\n- **Rationale**: because "), (F.col("item_id") % 3).cast("string"), F.lit("\n"))
    return sources.invariants(table(spark, sf, "benchmark").select(text.alias("text")))


@query("SELECT '2024-01-02' AS date, 0 AS seq, 'Entry ' || item_id AS title, 'a,b' || (item_id % 4) AS tags, 'p' || (item_id % 2) AS project FROM benchmark")
def journal_parse(spark, sf):
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("# Day\n\n## 10:15 — Entry "), i, F.lit("\n\nDone.\n\n**Tags:** a, b"), (F.col("item_id") % 4).cast("string"), F.lit("\n**Project:** p"), (F.col("item_id") % 2).cast("string"), F.lit("\n"))
    rows = sources.journal_entries(table(spark, sf, "benchmark").select(F.lit("notes/2024-01-02.md").alias("path"), text.alias("text")))
    return rows.select("date", "seq", "title", F.array_join("tags", ",").alias("tags"), "project")


@query(
    "WITH c AS (SELECT conv_id::VARCHAR AS session, bool_or(contains(text, 'thinre')) AS modified, bool_or(contains(text, 'esthon')) AS recorded FROM conversations GROUP BY 1) SELECT *, CASE WHEN modified AND NOT recorded THEN 'continue' ELSE 'stop' END AS decision FROM c"
)
def stop_guard(spark, sf):
    calls = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("text").alias("name"))
    return guard.stop_decisions(calls, ("thinre",), ("esthon",))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1, 3) THEN 'ask' ELSE 'allow' END AS decision FROM orders")
def command_gate(spark, sf):
    commands = F.array(*map(F.lit, ("rm -rf /", "git reset --hard HEAD", "ls -la", "Docker System prune -a")))
    return table(spark, sf, "orders").select("o_orderkey", guard.command_decision(F.element_at(commands, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("decision"))


@query("SELECT conv_id, turn, turn % 10 = 0 AS reminds FROM conversations")
def reminder_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", guard.reminds(F.col("turn")).alias("reminds"))


@query()
def four_tier_context(spark, sf):
    """One answer of all tiers, formatted."""
    found = {
        "symbols": [f"{r['symbol']}: {r['path']}" for r in find_definition(spark, sf).orderBy("symbol", "path").limit(5).collect()],
        "facts": [r["text"] for r in fact_search(spark, sf).orderBy("rank").collect()],
        "outline": [r["path"] for r in outline_search_topk(spark, sf).orderBy(F.desc("score"), "path").collect()],
        "snippets": [str(r["id"]) for r in rerank_lexical(spark, sf).orderBy("rank").collect()],
    }
    return spark.createDataFrame([(Engine.format(found),)], "context string")


