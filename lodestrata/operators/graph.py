"""The property graph of symbols, files, notes: lookups, blast radius, statistics, views.

A graph is a dict of tables (see schema): files, defined_in, imports, references, links, sections, tags, relations.  Every
operator takes many names or paths at once, as a DataFrame; one name is a DataFrame of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

Graph = dict[str, DataFrame]


def _wanted(names: DataFrame) -> DataFrame:
    return names.select(F.col("name").alias("query"), F.lower("name").alias("low")).distinct()


def find_definition(g: Graph, names: DataFrame) -> DataFrame:
    """Names (name) -> query, symbol, path, kind, line, signature: symbols of that name, letters' case aside, and notes whose
    title it is or whose path ends with it."""
    q = _wanted(names)
    symbols = g["defined_in"].join(q, F.lower("symbol") == F.col("low")).select("query", "symbol", "path", F.coalesce("kind", F.lit("symbol")).alias("kind"), F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("signature", F.lit("")).alias("signature"))
    notes = _notes(g, q).select("query", F.coalesce("title", "path").alias("symbol"), "path").distinct()
    return symbols.distinct().unionByName(notes.select("query", "symbol", "path", F.lit("document").alias("kind"), F.lit(1).alias("line"), F.lit("").alias("signature")))


def _notes(g: Graph, q: DataFrame) -> DataFrame:
    """Notes whose title a wanted name is or whose path ends with it, with the column query."""
    notes = g["files"].where("is_markdown")
    return notes.join(q, F.lower("title") == F.col("low")).unionByName(_ending(notes, "path", q).select(*notes.columns, "query", "low"))


def _ending(rows: DataFrame, path: str, q: DataFrame) -> DataFrame:
    """Rows whose path ends with a wanted name, as an equality: of each path only tails of lengths that occur among the names are compared.

    The lengths are one row.
    """
    lengths = q.agg(F.collect_set(F.length("low")).alias("_lengths"))
    tails = rows.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length(path))
    return tails.withColumn("_tail", F.right(F.lower(path), F.col("_n"))).join(q, F.col("_tail") == F.col("low")).drop("_tail", "_n", "_lengths")


def find_references(g: Graph, names: DataFrame) -> dict[str, DataFrame]:
    """Names -> definitions, imports, references, backlinks, each with the column query."""
    q = _wanted(names)
    of = lambda t: g[t].join(q, F.lower("symbol") == F.col("low")).drop("low")
    return {
        "definitions": find_definition(g, names),
        "imports": of("imports").select("query", "path", "symbol", "module", "line"),
        "references": of("references").select("query", "path", "symbol", "line", "kind"),
        "backlinks": backlinks(g, names),
    }


def backlinks(g: Graph, names: DataFrame) -> DataFrame:
    """Links to notes by title or path's tail, and to concepts by name."""
    q = _wanted(names)
    to_file = g["links"].where("is_resolved").join(g["files"].select(F.col("path").alias("target"), "title"), "target", "left")
    by_title = to_file.join(q, F.lower("title") == F.col("low")).drop("low")
    by_path = _ending(to_file, "target", q).drop("low")
    concept = g["links"].where("not is_resolved").join(q, F.lower("target") == F.col("low")).drop("low").withColumn("title", F.lit(None).cast("string"))
    return by_title.unionByName(by_path).unionByName(concept).select("query", "src", "target", "label", "line", "link_type").distinct()


def uses(g: Graph) -> DataFrame:
    """path uses symbol, by import or reference."""
    return g["imports"].select("path", "symbol", F.lit("IMPORTS").alias("rel"), "line").unionByName(g["references"].select("path", "symbol", F.lit("REFERENCES").alias("rel"), "line"))


def file_impact(g: Graph, paths: DataFrame) -> DataFrame:
    """Files (path) -> path, symbol, dependent, rel: who uses what they define, themselves excepted."""
    own = g["defined_in"].join(paths.select("path").distinct(), "path").select("path", "symbol").distinct()
    return own.join(uses(g).select(F.col("path").alias("dependent"), "symbol", "rel"), "symbol").where("dependent <> path").select("path", "symbol", "dependent", "rel").distinct()


def impact_upstream(g: Graph, names: DataFrame) -> DataFrame:
    """Names -> query, relation, path, line: direct users, backlinks, and implementers or subtypes with their files, if known."""
    q = _wanted(names)
    direct = uses(g).join(q, F.lower("symbol") == F.col("low")).select("query", F.col("rel").alias("relation"), "path", "line")
    links = backlinks(g, names).select("query", F.lit("LINKS_TO").alias("relation"), F.col("src").alias("path"), "line")
    return direct.unionByName(links).unionByName(_types(g, q, "other", "symbol")).distinct()


def impact_downstream(g: Graph, names: DataFrame) -> DataFrame:
    """Names -> query, relation, path, line: what the files that define them use, link to, and the types they implement.

    A file counts once with all names that ask for it, and a symbol once with all names and relations that lead to it, so that
    symbols that many files define and use cost their rows, not files times uses times definitions.
    """
    q = _wanted(names)
    home = g["defined_in"].join(q, F.lower("symbol") == F.col("low")).groupBy("path").agg(F.sort_array(F.collect_set(F.struct("query", F.col("symbol").alias("own")))).alias("asks"))
    home = written(home, "impact-homes")
    own_uses = uses(g).select("path", "symbol", "rel").join(home.select("path"), "path", "left_semi")
    used = own_uses.join(home, "path").select("asks", "symbol", "rel").distinct().withColumn("ask", F.explode("asks")).where("symbol <> ask.own")
    targets = _located(g, used.select("ask.query", F.col("rel").alias("relation"), "symbol"))
    notes = _notes(g, q).select("query", "path").distinct()
    links = notes.join(g["links"].select(F.col("src").alias("path"), "target", "line"), "path").select("query", F.lit("LINKS_TO").alias("relation"), F.col("target").alias("path"), "line")
    return targets.unionByName(links).unionByName(_types(g, q, "symbol", "other")).distinct()


def _types(g: Graph, q: DataFrame, near: str, far: str) -> DataFrame:
    rel = g["relations"].join(q, F.lower(near) == F.col("low"))
    return _located(g, rel.select("query", F.col("rel").alias("relation"), F.col(far).alias("symbol")))


def _located(g: Graph, asked: DataFrame) -> DataFrame:
    """(query, relation, symbol) -> query, relation, path, line of the symbols' definitions, distinct; "unknown" and 1 for a symbol without any."""
    asked = written(asked.groupBy("symbol").agg(F.sort_array(F.collect_set(F.struct("query", "relation"))).alias("asks")), "asked-symbols")
    at = g["defined_in"].select("symbol", "path", "line")
    found = at.join(asked, "symbol").select("asks", "path", "line").distinct()
    known = at.select("symbol").join(asked.select("symbol"), "symbol", "left_semi").distinct()
    nowhere = asked.join(known, "symbol", "left_anti").select("asks", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"))
    rows = found.unionByName(nowhere).select(F.explode("asks").alias("ask"), F.coalesce("path", F.lit("unknown")).alias("path"), F.coalesce("line", F.lit(1)).alias("line"))
    return rows.select("ask.query", "ask.relation", "path", "line").distinct()


def dependency_edges(defined_in: DataFrame, used: DataFrame) -> DataFrame:
    """(src, dst, n): src uses symbols that dst defines, n times; a file's use of its own doesn't count.

    Uses and definitions are counted by (path, symbol) first, so that a name that many files use meets its definitions once
    for each file.
    """
    left = used.groupBy(F.col("path").alias("src"), "symbol").agg(F.count(F.lit(1)).alias("uses"))
    right = defined_in.groupBy(F.col("path").alias("dst"), "symbol").agg(F.count(F.lit(1)).alias("defs"))
    return left.join(right, "symbol").where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("uses") * F.col("defs")).alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: both directions' counts together."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").alias("weight"))


def impact_transitive(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Edges (src depends on dst), seeds (node) -> (node, depth): all that depend on a seed within ``depth`` hops, each at its
    least depth.  The depth is held between 1 and 5.  Each hop joins the new nodes only, drops what is known, and is a written
    table, so that a plan never holds the hops before; it ends when a hop finds nothing new."""
    edges = edges.select("src", "dst").distinct()
    seen = frontier = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "impact")
    for d in range(1, max(1, min(5, depth)) + 1):
        nxt = edges.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = written(nxt.withColumn("depth", F.lit(d)), "impact")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def risk_of_file(dependents: Column) -> Column:
    return F.when(dependents > 5, "HIGH").when(dependents >= 1, "MEDIUM").otherwise("LOW")


def risk_of_symbol(direct: Column, nodes: Column) -> Column:
    return F.when(direct > 4, "HIGH").when(nodes > 1, "MEDIUM").otherwise("LOW")


def impact_summary(impact: DataFrame) -> DataFrame:
    """file_impact's rows -> path, affected files, symbols, risk."""
    own = impact.groupBy("path").agg(F.countDistinct("dependent").alias("affected_files"), F.countDistinct("symbol").alias("symbols"))
    return own.withColumn("risk", risk_of_file(F.col("affected_files")))


def first_per_parent(rows: DataFrame, parent: str, order: list[str], n: int = 10) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def statistics(g: Graph) -> DataFrame:
    """One row: files, symbols, documents, tags; definitions, imports, references, links.  Symbols stay when files go."""
    symbols = g["defined_in"].select("symbol").unionByName(g["imports"].select("symbol")).unionByName(g["references"].select("symbol"))
    parts = [
        g["files"].select(F.lit("files").alias("k")), symbols.distinct().select(F.lit("symbols").alias("k")), g["files"].where("is_markdown").select(F.lit("documents").alias("k")),
        g["tags"].select("tag").distinct().select(F.lit("tags").alias("k")), *(g[t].select(F.lit(t).alias("k")) for t in ("defined_in", "imports", "references", "links")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = ["files", "symbols", "documents", "tags", "defined_in", "imports", "references", "links"]
    return out.agg(*[F.count_if(F.col("k") == n).alias(f"n_{n}") for n in names])


def raw_view(g: Graph) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, grp), edges (src, dst, rel) of everything."""
    s = lambda df, grp, col: df.select(F.concat(F.lit(f"{grp}:"), F.col(col)).alias("id"), F.col(col).alias("label"), F.lit(grp).alias("grp"))
    symbols = g["defined_in"].select("symbol").unionByName(g["imports"].select("symbol")).unionByName(g["references"].select("symbol")).distinct()
    nodes = s(symbols, "symbol", "symbol").unionByName(s(g["files"], "file", "path")).unionByName(s(g["tags"].select("tag").distinct(), "tag", "tag"))
    e = lambda df, a, x, b, y, rel: df.select(F.concat(F.lit(f"{a}:"), F.col(x)).alias("src"), F.concat(F.lit(f"{b}:"), F.col(y)).alias("dst"), F.lit(rel).alias("rel"))
    edges = (
        e(g["defined_in"], "symbol", "symbol", "file", "path", "DEFINED_IN").unionByName(e(g["imports"], "file", "path", "symbol", "symbol", "IMPORTS"))
        .unionByName(e(g["references"], "file", "path", "symbol", "symbol", "REFERENCES")).unionByName(e(g["tags"], "file", "path", "tag", "tag", "HAS_TAG"))
        .unionByName(g["links"].select(F.concat(F.lit("file:"), "src").alias("src"), F.concat(F.when(F.col("is_resolved"), "file:").otherwise("concept:"), "target").alias("dst"), F.lit("LINKS_TO").alias("rel")))
    )
    return nodes.distinct(), edges.distinct()


def clean_view(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The same with defined symbols only."""
    known = g["defined_in"].select("symbol").distinct()
    own = {**g, "imports": g["imports"].join(known, "symbol", "left_semi").select(*g["imports"].columns), "references": g["references"].join(known, "symbol", "left_semi").select(*g["references"].columns)}
    return raw_view(own)


def autocomplete(names: DataFrame, paths: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Symbols (name) that hold the text, shortest first, then files (path) to fill up: label, kind, rank."""
    low = prefix.lower()
    one = lambda df, col, kind, p: df.where(F.lower(col).contains(low)).select(F.col(col).alias("label"), F.lit(kind).alias("kind"), F.lit(p).alias("p")).distinct()
    rows = one(names, "name", "symbol", 0).unionByName(one(paths, "path", "file", 1))
    top = rows.orderBy("p", F.length("label"), "label").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("p", F.length("label"), "label"))).drop("p")
