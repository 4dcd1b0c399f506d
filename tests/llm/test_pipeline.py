import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestrata.llm import jaccard, packing, queries
from lodestrata.llm import lines as lines_module
from lodestrata.llm.common import materialize, tidy
from lodestrata.llm.tokens import default_tokenizer, encoder


def test_stages_against_their_twins(spark, data, tmp_path):
    """Every stage on what the one before kept: line dedup, near duplicates and decontamination against SQL, packing against the ids."""
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), {}
    extra = spark.createDataFrame([(9000, None, None, "x", 0), (9001, "12 345", "en", "x", 6)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    for name, stage in P.STAGES:
        before = docs
        docs = materialize(stage(spark, before, data), f"test-{name}")
        seen[name] = (before, docs)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(after.columns == columns for n, (_, after) in seen.items() if n != "packing")

    def twin(name, sql):
        con = duckdb.connect()
        frame = seen[name][0].toPandas()
        con.register("documents", frame)
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{data}/benchmark.parquet'")
        return con.sql(sql)

    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["language_id"]
    assert ids(before) - ids(after) == {9000, 9001}
    lines = {r[0]: r for r in twin("line_dedup", f"SELECT doc_id, kept_chars, kept_sha256 FROM ({queries.ORACLES['op3_line_dedup']})").fetchall()}
    import hashlib

    for r in seen["line_dedup"][1].collect():
        assert (r["n_chars"], hashlib.sha256(r["text"].encode()).hexdigest()) == (lines[r["doc_id"]][1], lines[r["doc_id"]][2])
    assert all(lines[d][1] < 60 for d in ids(seen["line_dedup"][0]) - ids(seen["line_dedup"][1]))
    near = twin("near_duplicates", f"SELECT doc_id FROM ({queries.ORACLES['op6_ngram_jaccard_join']}) WHERE doc_id = component_id").fetchall()
    assert ids(seen["near_duplicates"][1]) == {r[0] for r in near}
    clean = twin("decontamination", f"SELECT doc_id FROM ({queries.ORACLES['op10_benchmark_decontamination']}) WHERE NOT contaminated").fetchall()
    assert ids(seen["decontamination"][1]) == {r[0] for r in clean}
    coder, got, used = encoder(default_tokenizer()), Counter(), defaultdict(list)
    for r in seen["packing"][1].collect():
        got[r["doc_id"]] += r["length"]
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == {r["doc_id"]: len(coder.encode(r["text"])) // 4 + 1 for r in seen["packing"][0].collect()}
    assert all(sum(n for _, n in v) <= 2048 for v in used.values())


CLASH = ["score", "id", "removed", "words", "n_lines", "lang_pred", "t", "h", "matches", "hits", "found", "n_words", "gain", "carried", "kept", "Class", "node", "stays"]


def test_clashing_columns_repeats_ties_and_long_texts(spark, data):
    """Every stage on rows with every name that a stage uses inside, equal rows, equal ids, a long text and an unlearned language."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60 and lang is not null")
    word = lambda d, n: " ".join(f"wort{d}x{i}" for i in range(n))
    line = docs.where("length(text) > 300").orderBy("doc_id").first()["text"]
    line = " ".join(line.split()[:40])
    own = [(900, f"{line} {word(1, 9)}"), (900, f"{line} {word(1, 9)}"), (900, f"{line} {word(2, 40)}"), (901, f"{line} {word(3, 40)}"), (901, f"{line} {word(4, 40)}")]
    own += [(902, "αβγδ εζηθ ικλμ " * 20), (903, None), (904, " \n "), (None, f"{line} {word(5, 40)}"), (905, "\n".join(word(i, 10) for i in range(10, 4000)))]
    extra = spark.createDataFrame([(d, t, None, "own", 0) for d, t in own], docs.schema)
    docs = docs.unionByName(extra).withColumns({c: F.lit(f"value of {c}") for c in CLASH})
    columns, ids = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, data), f"test-{name}")
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(r[c] == f"value of {c}" for r in rows for c in CLASH), name
        ids[name] = Counter(r["doc_id"] for r in rows)
    assert {k: ids["language_id"][k] for k in (900, 901, 902, 903, 904, 905, None)} == {900: 3, 901: 2, 902: 0, 903: 0, 904: 0, 905: 1, None: 1}
    assert max(ids["near_duplicates"].values()) <= 2 and [ids["near_duplicates"][d] for d in (900, 901, 905, None)] == [2, 2, 1, 1]
    packed = P.packing(spark, docs, data).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    coder, want = encoder(default_tokenizer()), Counter()
    for r in rows:
        want[r["doc_id"]] += len(coder.encode(r["text"])) // 4 + 1
    assert {r["doc_id"]: r["n"] for r in packed} == want


def test_equal_rows_leave_one(spark, data):
    rows = spark.createDataFrame([(5, "one two three four five six", 1), (5, "one two three four five six", 2), (6, "one two three four five SIX", 3), (7, "other words here than those of it", 4), (None, "one two three four five six", 5), (None, None, 6), (8, " ", 7)], "doc_id long, text string, n int")
    got = {r["n"] for r in P.near_duplicates(spark, rows, data).collect()}
    assert len(got) == 4 and got - {1, 2} == {4, 6, 7}


def test_no_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0


def test_near_duplicates_against_five_words_and_four_fifths(spark, data):
    rng, rows = random.Random(3), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(6):
        base = rng.choices(words, k=120)
        for changes in (0, 1, 2, 3, 4, 6):
            own = base[:]
            for at in rng.sample(range(len(own)), changes):
                own[at] = "other" + own[at]
            rows.append((len(rows), " ".join(own)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(116)} for d, t in rows}
    least = {d: d for d in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[b] = min(least[a], least[b])
    got = {r["doc_id"] for r in P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), data).collect()}
    assert got == {d for d, m in least.items() if d == m}
    assert 6 <= len(got) < 36


def _nodes(plan: str) -> list[tuple[int, str]]:
    """(depth, name) of the nodes of a plan that isn't final yet."""
    found = [re.match(r"([ :+|-]*)(?:\*\(\d+\) )?(\w+)", line) for line in plan.splitlines()]
    return [(len(m[1]), m[2]) for m in found if m]


def test_a_task_has_one_python_worker(spark, data, monkeypatch):
    """No stage of a table that is written, or of a result, has two Python nodes one above the other, and no rows come from Python workers of RDDs."""
    plans = []

    def noted(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, tag)

    for module in (jaccard, lines_module, packing):
        monkeypatch.setattr(module, "materialize", noted)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name in ("line_dedup", "near_duplicates", "packing"):
        noted(dict(P.STAGES)[name](spark, docs, data), f"test-{name}")
    evaluated = 0
    for tag, plan in plans:
        assert "Scan ExistingRDD" not in plan, tag
        above: list[tuple[int, str]] = []
        for depth, name in _nodes(plan):
            above = [x for x in above if x[0] < depth]
            if re.search("Python|MapIn", name):
                evaluated += name == "ArrowEvalPython"
                stage = [n for _, n in above]
                cut = max((i for i, n in enumerate(stage) if "Exchange" in n), default=-1)
                assert not [n for n in stage[cut + 1 :] if re.search("Python|MapIn", n)], (tag, plan)
            above.append((depth, name))
    assert {"sets", "test-line_dedup", "test-packing"} <= {tag for tag, _ in plans} and evaluated >= 3


def test_other_work_forgets_encoders():
    first = encoder(default_tokenizer())
    assert list(tidy(iter, encodes=True)([1, 2])) == [1, 2] and encoder(default_tokenizer()) is first
    assert list(tidy(iter)([1, 2])) == [1, 2] and encoder(default_tokenizer()) is not first
