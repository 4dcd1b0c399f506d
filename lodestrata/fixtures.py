"""The test tables in the shape of the engine's tables, each with its SQL twin.

Files are pages (notes with links) and suppliers (sources); a supplier defines the parts of its first order lines and imports those of
its second; orders refer to the rest.  ``names`` tells symbols apart by the part's name, ``keys`` by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = r"https?://[^/]+(/[^?#]*)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", PATH, 1).alias("path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "html")


def links(spark, sf) -> DataFrame:
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    rows = pages(spark, sf).select(F.col("path").alias("src"), href.alias("target")).distinct()
    return rows.select("src", "target", F.lit(False).alias("is_resolved"), F.col("target").alias("label"), F.lit(1).alias("line"), F.lit("markdown_link").alias("link_type"), F.col("target").alias("raw_target"))


def _lines(spark, sf, where: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(where).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")


def _named(spark, sf, where: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return _lines(spark, sf, where).join(part, "l_partkey").join(supplier, "l_suppkey")


def names(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    none = F.lit("")
    files = pages(spark, sf).groupBy("path").agg(F.min("title").alias("title")).withColumn("is_markdown", F.lit(True))
    files = files.unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("is_markdown")))
    return {
        "files": files,
        "defined_in": _named(spark, sf, "l_linenumber = 1").select(F.col("p_name").alias("symbol"), F.col("s_name").alias("path"), F.col("p_type").alias("kind"), F.col("l_linenumber").alias("line"), none.alias("signature"), none.alias("docstring"), F.col("p_brand").alias("parent")).distinct(),
        "imports": _named(spark, sf, "l_linenumber = 2").select(F.col("s_name").alias("path"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("module"), F.col("l_linenumber").alias("line")).distinct(),
        "references": _named(spark, sf, "l_linenumber >= 3").groupBy(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("p_name").alias("symbol"), F.col("l_linenumber").alias("line")).agg(F.min(F.when(F.col("l_returnflag") == "R", "call").otherwise("name")).alias("kind")),
        "links": links(spark, sf),
        "tags": table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("lang").alias("tag")).distinct(),
        "relations": table(spark, sf, "part").select(F.col("p_name").alias("symbol"), F.col("p_brand").alias("other"), F.when(F.col("p_size") % 2 == 0, "IMPLEMENTS").otherwise("TYPE_OF").alias("rel"), F.lit("").alias("scip_id")).distinct(),
    }


def keys(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(defined_in, imports) of parts by key and suppliers by key."""
    pair = lambda n: _lines(spark, sf, f"l_linenumber = {n}").select(F.col("l_partkey").cast("string").alias("symbol"), F.col("l_suppkey").cast("string").alias("path")).distinct()
    return pair(1), pair(2)


def key_references(spark: SparkSession, sf: str) -> DataFrame:
    """References to parts by key, from orders."""
    return _lines(spark, sf, "l_linenumber >= 3").select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_partkey").cast("string").alias("symbol")).distinct()


def wanted(spark: SparkSession, sf: str) -> DataFrame:
    """The names that lookups ask for: those of the first parts, a link target, a page's tail, a title."""
    own = table(spark, sf, "part").where("p_partkey < 3").select(F.upper("p_name").alias("name"))
    more = spark.createDataFrame([("/THE",), ("25",), ("/de",)], "name string")
    return own.unionByName(more).unionByName(pages(spark, sf).where("page_id = 1").select(F.col("title").alias("name"))).distinct()


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return c.select(
        name.alias("name"), F.col("text").alias("content"), F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"), F.col("role").alias("project"), F.lit("").alias("tags"),
        (F.col("conv_id") % 7 == 0).alias("superseded"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(None).cast("string").alias("superseded_reason"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.concat(F.col("p_type"), F.lit(" of size "), F.col("p_size").cast("string")).alias("fact"), F.lit("HAS_BRAND").alias("relation"),
        F.timestamp_seconds(F.col("p_partkey")).alias("created_at"), (F.col("p_partkey") % 5 == 0).alias("superseded"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(None).cast("string").alias("superseded_reason"),
    )


def file_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("case event_type when 'signup' then 'created' when 'error' then 'deleted' when 'purchase' then 'moved' else 'modified' end")
    return table(spark, sf, "events").select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("event_type"), F.concat(F.lit("v/"), F.col("user_id").cast("string")).alias("dest_path"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(scanned, cached) files of orders: some new, touched, modified, deleted."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    path, k = F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey")
    scanned = o.where("o_orderkey % 11 <> 0").select(path, F.col("o_custkey").cast("double").alias("mtime"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"))
    mtime = F.col("o_custkey").cast("double") + F.when((k % 5 == 0) | (k % 10 == 3), 1.0).otherwise(0.00001)
    sha = F.when(k % 5 == 0, F.sha2(F.concat(F.col("o_custkey").cast("string"), F.lit("x")), 256)).otherwise(F.sha2(F.col("o_custkey").cast("string"), 256))
    cached = o.where("o_orderkey % 7 <> 0").select(path, mtime.alias("mtime"), sha.alias("sha256"), F.array(F.concat(F.lit("p"), k.cast("string"))).alias("point_ids"))
    return scanned, cached


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), "embedding")


def vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown notes: a heading of the language, a tag of the source, a link to the document before."""
    text = F.concat(
        F.lit("# "), F.col("lang"), F.lit("\n\n#tag-"), F.col("source"), F.lit(" #123\n\n## Part "), (F.col("doc_id") % 10).cast("string"), F.lit("\n\nSee [["), F.col("lang"), F.lit("/"),
        (F.col("doc_id") - 1).cast("string"), F.lit("|before]] and [the next](./"), (F.col("doc_id") + 1).cast("string"), F.lit(".md).\n"),
    )
    return table(spark, sf, "documents").select(F.col("doc_id"), F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as Python sources: an import, a class with two methods, a test."""
    name = F.concat(F.initcap(F.regexp_extract("p_name", r"^(\w+)", 1)), F.col("p_partkey").cast("string"))
    text = F.concat(
        F.lit("from shop.brands import make_brand\nimport os\n\n\nclass "), name, F.lit(":\n    \"\"\"A part.\"\"\"\n\n    def size(self):\n        return "), F.col("p_size").cast("string"),
        F.lit("\n\n    def brand(self):\n        return make_brand(self.size())\n\n\ndef test_"), F.lower(name), F.lit("():\n    part = "), name, F.lit("()\n    assert part.size()\n"),
    )
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), F.concat(F.lit("shop/tests/part"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


# SQL of the same.
LINE = "lineitem"
SQL = {
    "pages": rf"pg AS (SELECT page_id, regexp_extract(url, '{PATH}', 1) AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html FROM pages)",
    "links": "links AS (SELECT DISTINCT path AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pg)",
    "files": "files AS (SELECT path, min(title) AS title, true AS is_markdown FROM pg GROUP BY path UNION ALL SELECT s_name, NULL, false FROM supplier)",
    "named": f"named AS (SELECT * FROM {LINE} l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)",
    "defs": "defs AS (SELECT DISTINCT p_name AS symbol, s_name AS path, p_type AS kind, l_linenumber AS line, p_brand AS parent FROM named WHERE l_linenumber = 1)",
    "imps": "imps AS (SELECT DISTINCT s_name AS path, p_name AS symbol, p_brand AS module, l_linenumber AS line FROM named WHERE l_linenumber = 2)",
    "refs": "refs AS (SELECT 'order/' || l_orderkey AS path, p_name AS symbol, l_linenumber AS line, min(CASE l_returnflag WHEN 'R' THEN 'call' ELSE 'name' END) AS kind FROM named WHERE l_linenumber >= 3 GROUP BY ALL)",
    "uses": "uses AS (SELECT path, symbol, 'IMPORTS' AS rel, line FROM imps UNION ALL SELECT path, symbol, 'REFERENCES', line FROM refs)",
    "rels": "rels AS (SELECT DISTINCT p_name AS symbol, p_brand AS other, CASE WHEN p_size % 2 = 0 THEN 'IMPLEMENTS' ELSE 'TYPE_OF' END AS rel FROM part)",
    "q": "q AS (SELECT DISTINCT name AS query, lower(name) AS low FROM (SELECT upper(p_name) AS name FROM part WHERE p_partkey < 3 UNION ALL VALUES ('/THE'), ('25'), ('/de') UNION ALL SELECT title FROM pg WHERE page_id = 1))",
    "kdef": f"kdef AS (SELECT DISTINCT l_partkey AS symbol, l_suppkey::VARCHAR AS path FROM {LINE} WHERE l_linenumber = 1)",
    "kimp": f"kimp AS (SELECT DISTINCT l_partkey AS symbol, l_suppkey::VARCHAR AS path FROM {LINE} WHERE l_linenumber = 2)",
    "kref": f"kref AS (SELECT DISTINCT 'order/' || l_orderkey AS path, l_partkey AS symbol FROM {LINE} WHERE l_linenumber >= 3)",
    "src": r"src AS (SELECT p_partkey AS k, p_size, upper(p_name[1]) || regexp_extract(p_name, '^\w(\w*)', 1) || p_partkey AS name, 'shop/tests/part' || p_partkey || '.py' AS path, len(regexp_extract(p_name, '^\w+') || p_partkey) AS n, len(p_size::VARCHAR) AS z FROM part)",
    "kdep": "kdep AS (SELECT i.path AS src, d.path AS dst, count(*) AS n FROM kimp i JOIN kdef d USING (symbol) WHERE i.path <> d.path GROUP BY ALL)",
    "eps": "eps AS (SELECT conv_id || ':' || turn AS name, text AS content, conv_id * 1000 + turn AS t, role AS project, conv_id % 7 = 0 AS superseded FROM conversations)",
    "fcts": "fcts AS (SELECT p_name AS source, p_brand AS target, p_type || ' of size ' || p_size AS fact, p_partkey AS t, p_partkey % 5 = 0 AS superseded FROM part)",
    "ev": "ev AS (SELECT 'u/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS event_type, 'v/' || user_id AS dest, ts, event_id FROM events)",
    "scan": "scan AS (SELECT 'o/' || o_orderkey AS path, o_custkey::DOUBLE AS mtime, sha256(o_custkey::VARCHAR) AS sha FROM orders WHERE o_orderkey % 11 <> 0)",
    "cach": "cach AS (SELECT 'o/' || o_orderkey AS path, o_custkey::DOUBLE + CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 10 = 3 THEN 1.0 ELSE 0.00001 END AS mtime, CASE WHEN o_orderkey % 5 = 0 THEN sha256(o_custkey || 'x') ELSE sha256(o_custkey::VARCHAR) END AS sha, 'p' || o_orderkey AS point FROM orders WHERE o_orderkey % 7 <> 0)",
    "tok": "tok AS (SELECT *, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents)",
    "note": r"""note AS (SELECT doc_id, lang, source, 'notes/' || doc_id || '.md' AS path FROM documents)""",
    "vec": "vec AS (SELECT e.vec_id AS id, 'c' || label AS collection, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)",
}


def prelude(*names_: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(SQL[n] for n in names_) + " "


