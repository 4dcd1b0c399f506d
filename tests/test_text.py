from pyspark.sql import functions as F

from lodestrata.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    for text, n in (("", 0), ("a", 1), ("abcd" * 3, 3), (None, 0), ("é" * 9, 2)):
        assert one(spark, T.count_tokens(F.lit(text).cast("string"))) == n


def test_symbol_candidates(spark):
    got = one(spark, T.symbol_candidates(F.lit("where is `run_all` and class SymbolGraph or make_it() in the file?")))
    assert got == ["run_all", "SymbolGraph", "make_it"]
    assert one(spark, T.symbol_candidates(F.lit(" handler "))) == ["handler"]
    assert one(spark, T.symbol_candidates(F.lit("is the a of"))) == []


def test_scip_names(spark):
    table = {
        "scip-python python shop 0.1.0 `shop.server`/trigger_mode().": ("trigger_mode", ""),
        "rust-analyzer cargo shop 0.1.0 Engine#execute().": ("execute", "Engine"),
        "rust-analyzer cargo shop 0.1.0 Engine#": ("Engine", "Engine"),
        "local 42": ("local:42", ""),
        "": ("anonymous", ""),
    }
    for symbol, (name, parent) in table.items():
        assert one(spark, T.scip_name(F.lit(symbol))) == name
        assert one(spark, T.scip_parent(F.lit(symbol))) == parent
    assert one(spark, T.scip_parent(F.lit("x y"), F.lit("a b 1 Outer#"))) == "Outer"


def test_titles_slugs_and_shown(spark):
    assert one(spark, T.title_of(F.lit("a/my-note_of.x.md"))) == "My Note Of.X"
    assert one(spark, T.slug(F.lit(" A & B! "))) == "A-B"
    assert one(spark, T.shown(F.array(*map(F.lit, "abcd")), 2)) == "a, b, +2 more"


def test_preamble(spark):
    deps = F.array(F.struct(F.lit("f").alias("symbol"), F.lit("m.n").alias("module")), F.struct(F.lit("g").alias("symbol"), F.lit("").alias("module")))
    got = one(spark, T.preamble(F.lit("a.py"), scope=F.lit("A.b"), docstring=F.lit(" x\ny "), dependencies=deps, note=F.lit(None).cast("string")))
    assert got == "# File: a.py\n# Scope: A.b\n# Docstring: x y\n# Depends On: f (m.n), g\n\n"


def test_tests_and_exclusion(spark):
    assert one(spark, T.is_test(F.lit("test_a"), F.lit("x/y.py")))
    assert one(spark, T.is_test(F.lit("a"), F.lit("tests/y.py")))
    assert not one(spark, T.is_test(F.lit("a"), F.lit("x/y.py")))
    assert one(spark, T.excluded(F.lit("a/node_modules/b.js"), ["node_modules"]))
    assert one(spark, T.excluded(F.lit("a/b.pyc"), ["*.pyc"]))
    assert not one(spark, T.excluded(F.lit("a/b.py"), ["*.pyc", "b"]))


def test_sql_functions(spark):
    T.register_functions(spark)
    row = spark.sql("SELECT count_tokens('abcdefgh') AS n, round(cosine_sim(array(1f, 0f), array(1f, 1f)), 4) AS c").first()
    assert (row["n"], row["c"]) == (2, 0.7071)
    rows = spark.sql("SELECT d.name FROM VALUES ('a.py', 'def run():\\n    go()\\n') AS t(path, text), LATERAL extract_symbols(path, text) d WHERE d.relation = 'declaration'").collect()
    assert [r["name"] for r in rows] == ["run"]
    assert spark.sql("SELECT c.chunk_type FROM VALUES ('a.md', '# T\\n\\nbody') AS t(path, text), LATERAL chunk_document(path, text) c").first()["chunk_type"] == "markdown_section"
    assert spark.sql("SELECT l.target_name FROM VALUES ('a.md', 'see [[B]]') AS t(path, text), LATERAL extract_links(path, text) l").first()["target_name"] == "B"
