import json
import time

import pytest
from pyspark.sql import functions as F

from lodestrata import schema
from lodestrata.operators import consolidate, episodic, graph, guard, ingest, retrieval
from lodestrata.plans.engine import Engine
from lodestrata.sources import files, scip
from lodestrata.store import Store, upsert
from lodestrata.streaming import watch


def empty(spark, *names):
    return {n: spark.createDataFrame([], schema.TABLES[n]) for n in names}


@pytest.fixture
def shop(spark):
    g = empty(spark, "files", "defined_in", "imports", "references", "links", "sections", "tags", "relations")
    g["files"] = spark.createDataFrame([("/app/auth.py", None, False), ("/app/login.py", None, False), ("/notes/guide.md", "Guide", True)], schema.FILES)
    g["defined_in"] = spark.createDataFrame([("AuthService", "/app/auth.py", "class", 10, "class AuthService:", "Auth.", ""), ("verify_token", "/app/auth.py", "function", 30, "", "", ""), ("login", "/app/login.py", "function", 5, "", "", "")], schema.DEFINED_IN)
    g["imports"] = spark.createDataFrame([("/app/login.py", "verify_token", "app.auth", 3)], schema.IMPORTS)
    g["references"] = spark.createDataFrame([("/app/login.py", "verify_token", 18, "call")], schema.REFERENCES)
    g["links"] = spark.createDataFrame([("/notes/other.md", "/notes/guide.md", True, "g", 1, "wiki_link", "guide"), ("/notes/other.md", "Idea", False, "i", 2, "wiki_link", "Idea")], schema.LINKS)
    g["relations"] = spark.createDataFrame([("FileAuth", "AuthService", "IMPLEMENTS", "s")], schema.RELATIONS)
    return g


def ask(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_lookups(spark, shop):
    d = graph.find_definition(shop, ask(spark, "authservice", "guide.md", "GUIDE")).collect()
    assert {(r["query"], r["path"], r["line"]) for r in d} == {("authservice", "/app/auth.py", 10), ("guide.md", "/notes/guide.md", 1), ("GUIDE", "/notes/guide.md", 1)}
    r = graph.find_references(shop, ask(spark, "verify_token"))
    assert r["imports"].first()["line"] == 3 and r["references"].first()["line"] == 18
    assert {x["target"] for x in graph.backlinks(shop, ask(spark, "guide", "idea")).collect()} == {"/notes/guide.md", "Idea"}


def test_impact(spark, shop):
    paths = shop["files"].where("path = '/app/auth.py'")
    assert {r["dependent"] for r in graph.file_impact(shop, paths).collect()} == {"/app/login.py"}
    up = {(r["relation"], r["path"]) for r in graph.impact_upstream(shop, ask(spark, "verify_token", "AuthService")).collect()}
    assert up == {("IMPORTS", "/app/login.py"), ("REFERENCES", "/app/login.py"), ("IMPLEMENTS", "unknown")}
    down = {(r["relation"], r["path"]) for r in graph.impact_downstream(shop, ask(spark, "login")).collect()}
    assert down == {("IMPORTS", "/app/auth.py"), ("REFERENCES", "/app/auth.py")}
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "src string, dst string")
    reach = {r["node"]: r["depth"] for r in graph.impact_transitive(edges, spark.createDataFrame([("a",)], "node string"), 9).collect()}
    assert reach == {"a": 0, "b": 1, "c": 2, "d": 3}
    s = graph.statistics(shop).first()
    assert (s["n_files"], s["n_documents"], s["n_symbols"], s["n_links"]) == (3, 1, 3, 2)
    nodes, edges = graph.clean_view(shop)
    assert nodes.where("grp = 'symbol'").count() == 3 and edges.where("rel = 'LINKS_TO'").count() == 2


def test_downstream_of_symbols_that_all_files_define(spark, shop):
    """Homes times uses times definitions would be 240 million rows here; the rows are those of the plain definition."""
    files, symbols, asked = 2000, 40, ("s0", "S1", "nowhere")
    every = spark.range(files).crossJoin(spark.range(symbols).toDF("k"))
    path, name = F.concat(F.lit("/f"), F.col("id").cast("string")), F.concat(F.lit("s"), F.col("k").cast("string"))
    defined = every.where("k <> 7").select(name.alias("symbol"), path.alias("path"), F.lit("def").alias("kind"), (F.col("k") % 2).cast("int").alias("line"), F.lit("").alias("signature"), F.lit("").alias("docstring"), F.lit("").alias("parent"))
    g = {**shop, "defined_in": defined, "imports": every.where("k in (0, 2, 7)").select(path.alias("path"), name.alias("symbol"), F.lit("m").alias("module"), F.lit(1).alias("line"))}
    g["references"] = every.where("k in (0, 1, 4)").select(path.alias("path"), name.alias("symbol"), F.lit(1).alias("line"), F.lit("call").alias("kind"))
    began = time.time()
    found = sorted(tuple(r) for r in graph.impact_downstream(g, ask(spark, *asked)).collect())
    want = []
    for query, own in (("s0", 0), ("S1", 1)):
        for rel, used in (("IMPORTS", {0, 2, 7} - {own}), ("REFERENCES", {0, 1, 4} - {own})):
            lines = {k % 2 for k in used - {7}}
            want += [(query, rel, f"/f{i}", line) for i in range(files) for line in lines] + [(query, rel, "unknown", 1)] * (7 in used)
    assert found == sorted(want)
    assert time.time() - began < 60


def test_scip(spark, tmp_path):
    def field(n, v):
        def number(x):
            out = b""
            while x > 127:
                out, x = out + bytes([x & 127 | 128]), x >> 7
            return out + bytes([x])

        return number(n << 3) + number(v) if isinstance(v, int) else number(n << 3 | 2) + number(len(v)) + v

    a, b = b"py python shop 1.0 `shop.a`/Engine#", b"py python shop 1.0 `shop.a`/Engine#run()."
    rel = field(4, field(1, b"py python shop 1.0 Base#") + field(3, 1))
    one = field(1, b"a.py") + field(3, field(1, a) + field(5, 7) + field(3, b"Doc") + rel) + field(3, field(1, b)) + field(2, field(1, bytes([4, 0, 3])) + field(2, a) + field(3, 1)) + field(2, field(1, bytes([9, 0, 3])) + field(2, b) + field(3, 1))
    two = field(1, b"b.py") + field(3, field(1, b"local 1")) + field(2, field(1, bytes([1, 0])) + field(2, a) + field(3, 2)) + field(2, field(1, bytes([2, 0])) + field(2, b)) + field(2, field(1, bytes([3, 0])) + field(2, b"local 1") + field(3, 1))
    (tmp_path / "index.scip").write_bytes(field(2, one) + field(2, two))
    docs = scip.read_index(spark, str(tmp_path / "index.scip"))
    assert scip.index_counts(docs).first().asDict() == {"documents": 2, "symbols": 3, "references": 1, "relationships": 1}
    t = scip.index_tables(docs)
    assert {(r["symbol"], r["kind"], r["line"], r["parent"]) for r in t["defined_in"].collect()} == {("Engine", "class", 5, "Engine"), ("run", "symbol", 10, "Engine"), ("local:1", "symbol", 4, "")}
    assert t["imports"].first()["symbol"] == "Engine" and t["references"].first()["symbol"] == "run"


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "path string, n int")
    once = upsert(old, new, ["path"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert(once, new, ["path"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("tags").count() == 0
    s.upsert("tags", spark.createDataFrame([("a", "x")], schema.TAGS))
    before = s.read("tags")
    s.replace_by("tags", spark.createDataFrame([("a", "y")], schema.TAGS), "path", spark.createDataFrame([("a",)], "path string"))
    assert before.first()["tag"] == "x" and s.read("tags").first()["tag"] == "y"
    assert s.vacuum("tags", 1) == 1 and s.clear("tags") == 1 and s.read("tags").count() == 0


def test_episodes(spark):
    t = empty(spark, "episodes", "entities", "mentions", "facts")
    t = episodic.record(t, "port decision", "The server listens on 8000.", ["net"], "shop", [{"name": "server", "type": "service"}], [{"source": "server", "relation": "listens on", "target": "port", "fact": "uses port 8000"}])
    t = {k: spark.createDataFrame(v.collect(), schema.TABLES[k]) for k, v in t.items()}
    assert "8000" in episodic.search_facts(t["facts"], t["episodes"], "which port is used").orderBy("rank").first()["text"]
    assert t["facts"].first()["relation"] == "LISTENS_ON"
    t = episodic.record(t, "port changed", "Now 9000.", supersedes=["port decision"])
    t = {k: spark.createDataFrame(v.collect(), schema.TABLES[k]) for k, v in t.items()}
    old = t["episodes"].where("name = 'port decision'").first()
    assert old["superseded"] and old["superseded_by"] == "port changed"
    again = episodic.record(t, "port decision", "Back to 8000.")["episodes"].where("name = 'port decision'").first()
    assert not again["superseded"] and again["superseded_by"] == "port changed"
    gone = episodic.delete_fact(t, "8000", "wrong")
    assert gone["facts"].first()["superseded"] and gone["facts"].first()["superseded_reason"] == "wrong"
    stay, archive = episodic.prune(t["episodes"], purge=True)
    assert stay.count() == 1 and archive.count() == 1


def test_notes_of_a_day(spark):
    text = "# Day\n\n" + episodic.journal_section("Port moved", "Body here.", ["net", "ops"], "shop", ["old one"], "10:15")
    row = files.journal_entries(spark.createDataFrame([("j/2024-05-06.md", text), ("j/readme.md", "## x\n")], "path string, text string")).collect()
    assert len(row) == 1 and (row[0]["date"], row[0]["title"], row[0]["tags"], row[0]["project"], row[0]["supersedes"]) == ("2024-05-06", "Port moved", ["net", "ops"], "shop", ["old one"])


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", " a b ", "d"])], "idx int, text string")
    cache = ingest.cache_keys(texts.where("idx = 0"), "m").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    hits, misses = ingest.probe(texts, cache, "m")
    assert {r["idx"] for r in hits.collect()} == {0, 2} and {r["idx"] for r in misses.collect()} == {1, 3}
    assert ingest.hit_rate(2, 4) == 50.0 and ingest.hit_rate(0, 0) == 0.0
    assert len(retrieval.hashed_embedding("a b c")) == 64


def test_collections_and_rerankers(spark):
    assert retrieval.resolve_collections(None, ["a"], "d") == ["d"] and retrieval.resolve_collections("ALL", ["a", "b"], "d") == ["a", "b"]
    assert retrieval.resolve_collections("a, b,a", [], "d") == ["a", "b"]
    pool = spark.createDataFrame([(1, "nothing", 0.9, "x"), (2, "blue port", 0.1, "y")], "id int, text string, score double, collection string")
    assert retrieval.rerank(pool, "which blue port", 1).first()["id"] == 2
    assert retrieval.rerank(pool, "q", 1, lambda q, t: t.str.len()).first()["id"] == 2
    assert retrieval.rerank_fallback(pool, 1).first()["id"] == 1 and retrieval.rerank_fallback(pool, 1, ["y", "x"]).first()["id"] == 2


def test_communities(spark):
    pairs = [(a, b, 3) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 1)]
    edges, nodes = spark.createDataFrame(pairs, "a string, b string, weight long"), spark.createDataFrame([(n,) for n in "abcxyzq"], "node string")
    found = consolidate.louvain(edges, nodes)
    assert {r["node"]: r["community"] for r in found.collect()} == dict(a="a", b="a", c="a", x="x", y="x", z="x", q="q")
    assert consolidate.modularity(edges, found) > consolidate.modularity(edges, nodes.withColumn("community", F.col("node")))
    spread = {r["node"]: r["community"] for r in consolidate.label_propagation(edges, nodes).collect()}
    assert spread["a"] == spread["b"] == spread["c"] and spread["q"] == "q"


def test_guards(spark, tmp_path):
    ask_ = lambda c: spark.range(1).select(guard.command_decision(F.lit(c)).alias("d")).first()["d"]
    assert [ask_(c) for c in ("rm -rf /tmp", "ls", "git reset --hard")] == ["ask", "allow", "ask"]
    lines = [{"tool_calls": [{"name": "write_to_file", "args": {"TargetFile": "a"}}]}, {"tool_calls": [{"name": "call", "args": {"ToolName": "record_system_outcome"}}]}]
    (tmp_path / "a.jsonl").write_text(json.dumps(lines[0]) + "\nnot json\n")
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r["session"].rsplit("/", 1)[1]: r["decision"] for r in guard.stop_decisions(guard.tool_calls(files.transcripts(spark, str(tmp_path)))).collect()}
    assert got == {"a.jsonl": "continue", "b.jsonl": "stop"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "modified", None, f"2024-01-01 00:00:0{i}", i) for i in (0, 1, 5)] + [("b", "moved", "c", "2024-01-01 00:00:02", 9), ("z", "created", None, "2025-01-01 00:00:00", 10)]
    events = spark.createDataFrame(rows, "path string, event_type string, dest_path string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.json(str(tmp_path / "in"))
    batch = {tuple(r) for r in watch.debounce(watch.expand_moves(events)).select("path", "event_type", "n_events").where("path <> 'z'").collect()}
    assert batch == {("a", "modified", 2), ("a", "modified", 1), ("b", "deleted", 1), ("c", "modified", 1)}
    removed, synced = set(), set()
    q = watch.watch(watch.read_events(spark, str(tmp_path / "in")), lambda d: synced.update(r["path"] for r in d.collect()), lambda d: removed.update(r["path"] for r in d.collect()), str(tmp_path / "cp"))
    until = time.time() + 90
    while time.time() < until and not (removed and synced >= {"a", "c"}):
        time.sleep(0.5)
    q.stop()
    assert removed == {"b"} and synced == {"a", "c"}


def test_engine(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "store.py").write_text('"""Keeps rows."""\n\n\nclass StorageEngine:\n    def put(self, row):\n        return row\n')
    (root / "session.py").write_text("from store import StorageEngine\n\n\ndef open_session():\n    return StorageEngine()\n")
    (root / "guide.md").write_text("# Guide\n\nUse [[store]] and the StorageEngine.\n")
    e = Engine(spark, str(tmp_path / "db"))
    assert e.index(str(root))["new"] == 3
    assert e.index(str(root))["unchanged"] == 3
    up = e.trace_impact("StorageEngine")
    assert any(r["path"].endswith("session.py") for r in up["direct_impacts"]) and up["definitions"][0]["line"] == 4
    e.record_outcome("choice", "The StorageEngine keeps rows.")
    answer = e.search("where is StorageEngine")
    assert "## Symbols" in answer and "store.py" in answer and "choice" in answer and "## Snippets" in answer
    (root / "session.py").unlink()
    assert e.index(str(root))["deleted"] == 1
    assert not e.trace_impact("StorageEngine")["direct_impacts"]
    e.record_outcome("choice two", "Rows are kept elsewhere.", supersedes=["choice"], tags=["db"], project="shop")
    done = e.consolidate(purge=True, invariants=[{"rule": "r"}])
    assert done["subsystems"] >= 1 and done["archived"] == 1
    assert [r["name"] for r in e.store.read("archive").collect()] == ["choice"] and [r["name"] for r in e.store.read("episodes").collect()] == ["choice two"]
    notes = files.journal_entries(files.whole_texts(spark, str(tmp_path / "db/journal"))).collect()
    assert {r["title"]: list(r["tags"]) for r in notes}["choice two"] == ["db"]
    assert len(list((tmp_path / "db/reports").glob("*.md"))) == 1
    assert set(e.health().values()) == {"ok"} and e.statistics()["n_files"] == 2


def test_engine_impact_commits_hybrid_and_plugins(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("from b import Base\n\n\nclass Api:\n    def run(self):\n        return Base()\n")
    (root / "b.py").write_text("from c import Core\n\n\nclass Base:\n    def go(self):\n        return Core()\n")
    (root / "c.py").write_text("class Core:\n    def xylophone(self):\n        return 1\n")
    e = Engine(spark, str(tmp_path / "db"), embedder=lambda t: [1.0, 0.0], extractor=lambda t: {"facts": [{"source": "a", "relation": "has", "target": "b", "fact": t}]})
    commits = spark.createDataFrame([(str(root / "a.py"), "abc123", "2024-01-01", "first")], "path string, commit_hash string, commit_date string, commit_msg string")
    e.index(str(root), commits=commits)
    chunks = {r["path"].rsplit("/", 1)[1]: r["commit_hash"] for r in e.store.read("chunks").select("path", "commit_hash").distinct().collect()}
    assert chunks == {"a.py": "abc123", "b.py": "untracked", "c.py": "untracked"}
    reach = lambda name, way: [r["node"].rsplit("/", 1)[1] for r in e.trace_impact(name, way)["transitive"]]
    assert reach("Core", "upstream") == ["b.py", "a.py"] and reach("Api", "downstream") == ["b.py", "c.py"] and reach("Core", "downstream") == []
    assert e.record_outcome("o", "The port is 1.")["facts"] == 1
    assert "xylophone" in e.search("xylophone").split("## Snippets")[1]  # all vectors are alike: found by words
    e.reranker = lambda q, t: 1 / 0
    assert "xylophone" in e.search("xylophone").split("## Snippets")[1]


def test_a_changed_file_rewrites_its_buckets_only(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    s.upsert("tags", spark.range(100).selectExpr("concat('p', id) as path", "'x' as tag"))
    before = s._folders("tags")
    one = spark.createDataFrame([("p7", "y")], schema.TAGS)
    s.replace_by("tags", one, "path", one)
    after = s._folders("tags")
    assert set(after) == set(before) and sum(before[b] != after[b] for b in before) == 1
    s.delete_by("tags", "path", spark.createDataFrame([("p7",), ("p8",)], "path string"))
    assert s.read("tags").count() == 98
    s.vacuum("tags", 1)
    assert s.read("tags").count() == 98 and s.read("tags").where("tag = 'y'").count() == 0


def test_stale_relations_go(spark, tmp_path, monkeypatch):
    e, made = Engine(spark, str(tmp_path)), "symbol string, other string, rel string, scip_id string"
    docs = spark.createDataFrame([("a.py",)], "relative_path string")
    tables = lambda rel: {
        "files": spark.createDataFrame([("a.py", None, False)], schema.FILES), "defined_in": spark.createDataFrame([("A", "a.py", "class", 1, "", "", "")], schema.DEFINED_IN),
        "imports": spark.createDataFrame([], schema.IMPORTS), "references": spark.createDataFrame([], schema.REFERENCES), "relations": spark.createDataFrame([("A", rel, "IMPLEMENTS", rel)], made),
    }
    monkeypatch.setattr(scip, "read_index", lambda *_: docs)
    monkeypatch.setattr(scip, "index_counts", lambda _: docs.selectExpr("1 as documents"))
    e.store.upsert("relations", spark.createDataFrame([("Z", "Other", "TYPE_OF", "z")], made))
    for rel in ("Old", "New"):
        monkeypatch.setattr(scip, "index_tables", lambda _, rel=rel: tables(rel))
        e.ingest_scip("x")
    assert {(r["symbol"], r["other"]) for r in e.store.read("relations").collect()} == {("A", "New"), ("Z", "Other")}


def test_engine_follows_a_stream(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "new.py").write_text("class Fresh:\n    pass\n")
    (root / "old.py").write_text("class Gone:\n    pass\n")
    e = Engine(spark, str(tmp_path / "db"))
    e.index(str(root))
    (root / "new.py").write_text("class Fresher:\n    pass\n")
    (root / "old.py").unlink()
    rows = [(str(root / "new.py"), "modified", None, "2024-01-01T00:00:00", 1), (str(root / "old.py"), "deleted", None, "2024-01-01T00:00:01", 2), ("/none", "created", None, "2025-01-01T00:00:00", 3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(dict(zip(("path", "event_type", "dest_path", "ts", "event_id"), r))) for r in rows))
    q = e.watch(watch.read_events(spark, str(tmp_path / "in")), str(tmp_path / "cp"))
    until, want = time.time() + 120, {"Fresher"}
    while time.time() < until and "new.py" not in e.store.read_text("status.json"):
        assert q.isActive
        time.sleep(1)
    q.stop()
    assert {r["symbol"] for r in e.store.read("defined_in").collect()} == want and "new.py" in e.store.read_text("status.json")


def test_sql_functions_are_the_expressions(spark):
    from lodestrata.functions import text as T

    T.register_functions(spark)
    asked = ["where is `StorageEngine` and open_session(", "HashMap", "callers of do_it", "  plain ", "the class Foo", ""]
    rows = spark.createDataFrame([(a,) for a in asked], "q string")
    for r in rows.select("q", F.expr("symbol_candidates(q)").alias("a"), T.symbol_candidates(F.col("q")).alias("b")).collect():
        assert r["a"] == r["b"], r
    names = ["", "local 3", "py python shop 1.0 `shop.a`/Engine#run().", "py python shop 1.0 `shop.a`/Engine#", "x"]
    rows = spark.createDataFrame([(a,) for a in names], "s string")
    for r in rows.select("s", F.expr("scip_name(s)").alias("a"), T.scip_name(F.col("s")).alias("b"), F.expr("scip_parent(s)").alias("c"), T.scip_parent(F.col("s")).alias("d")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["d"]), r
