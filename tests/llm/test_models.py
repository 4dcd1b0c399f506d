import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import langid, licenses, search

FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_language_held_out(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = langid.identify(docs, keep=("doc_id", "lang")).withColumn("h", langid.held_out(F.col("doc_id"))).collect()
    out = [r for r in rows if r["h"]]
    assert 150 < len(out) < 350 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = spark.createDataFrame([(None, "the cat and " * 100_000, "en", 0.0), (1, None, "fr", 0.0), (2, "12 !?", None, 0.0), (3, "le chat " * 150_000, "fr", 0.0), (3, "le chat", "fr", 0.0)], "doc_id long, text string, lang string, score double")
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"] > 0.5) for r in langid.identify(rows).collect())
    assert got == [("1", "und", False), ("2", "und", False), ("3", "fr", True), ("3", "fr", True), ("None", "en", True)]
    assert langid.identify(rows.limit(0)).count() == 0
    nothing = langid.identify(rows.withColumn("lang", rows["lang"].substr(1, 0)).where("doc_id = 1")).collect()
    assert [r["lang_pred"] for r in nothing] == ["und"]


def brute_language(teach, texts, buckets, longest):
    """Counts of n-grams by dictionaries, a feature at a time."""
    def grams(text):
        c = [0, *[ord(x) if x.isalpha() else 0 for x in text.lower()], 0]
        c = [x for i, x in enumerate(c) if i == 0 or x or c[i - 1]]
        for n in range(1, longest + 1):
            for i in range(len(c) - n + 1):
                if n > 1 or c[i]:
                    h = 0
                    for k in range(n):
                        h = (h * 0x9E3779B97F4A7C15 + c[i + k] + k + 1) % 2**64
                    yield ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64 >> 40) % buckets

    counts = {}
    for text, lang in teach:
        counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for text in texts:
        own = list(grams(text))
        logs = {lang: sum(math.log((1 + c[g]) / (buckets + sum(c.values()))) for g in own) for lang, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), logs[best] / len(own) + math.log(buckets)))
    return out


def test_language_against_brute_force(spark):
    teach = [("The cat and the dog. É", "en"), ("le chat et le chien", "fr"), ("die Katze, der Hund", "de"), ("the end of it", "en")]
    texts = ["the dog", "chat", "Der Hund 12 und die Katze", "xyz qq", "漢字", "a", "le le le le le le le le le le le le"]
    names, matrix = langid.fit(spark.createDataFrame([(i, *x) for i, x in enumerate(teach)], "doc_id long, text string, lang string"), buckets=512)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("keep0", F.lit("clash"))
    got = sorted(langid.predict(rows, names, matrix, keep=("doc_id", "keep0")).collect())
    for g, (lang, score, gain) in zip(got, brute_language(teach, texts, 512, langid.LONGEST)):
        assert g["lang_pred"] == lang and abs(g["score"] - score) < 1e-4 and abs(g["gain"] - gain) < 1e-4


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = spark.range(400).selectExpr("cast(null as long) as doc_id", "concat('wort ', id) as text", "'de' as lang")
    for _, matrix in [langid.fit(rows, per_language=100, buckets=64)]:
        learned = 1 / math.exp(matrix.min())
        assert 64 + 100 < learned < 64 + 400 * 25 * 0.6


def test_search_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(900, None), (1000, ""), (1001, "Thé 1 thé"), (1001, "thé")]
    docs = [(d, Counter(WORDS.findall((t or "").translate(FOLD)))) for d, t in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = frame.where("doc_id % 50 = 0 or doc_id = 1001").selectExpr("doc_id as query_id", "text")
    found = search.top_k(search.build_index(frame), queries, 7, block_terms=600).collect()
    for q, own in [(d, c) for d, c in docs if d % 50 == 0]:
        scores = []
        for d, c in docs:
            size = sum(c.values())
            s = sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in own if w in c)
            if s > 0:
                scores.append((-round(s, 6), d))
        want = sorted(scores)[:7]
        got = sorted((r["rank"], r["doc_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [(g[1], round(g[2], 5)) for g in got] == [(d, round(-s, 5)) for s, d in want], q
    assert Counter(r["rank"] for r in found if r["query_id"] == 1001)[1] == 2  # two queries of one id
    assert search.top_k(search.build_index(frame.limit(0)), queries, 7).count() == 0


def test_search_is_exact_where_single_precision_is_not_and_starts_from_a_threshold():
    rng, k, n = np.random.default_rng(7), 5, 2500
    words = [f"w{i}" for i in range(60)] + [f"r{i}" for i in range(3000)]
    texts = [" ".join([*words[:60], *(words[60 + i] for i in rng.integers(0, 3000, 3)), *["filler"] * int(rng.integers(3000, 3040))]) for _ in range(40)]  # scores that differ by less than a float tells
    texts += [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(n - 80)] + [texts[3]] * 38 + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(n - 1), None], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    shards = [r for b in search._build(iter([batch])) for r in b.to_pylist()]
    assert [len(s["ids"]) for s in shards] == [2048, n - 2048]
    counts = [Counter((t or "").split()) for t in texts]
    df, mean = Counter(w for c in counts for w in c), sum(sum(c.values()) for c in counts) / n
    idf = {w: math.log(1 + (n - m + 0.5) / (m + 0.5)) for w, m in df.items()}
    queries = [*range(0, n, 50), 3, n - 2, n - 1]
    hashed = next(search._query_terms(iter([batch.take(pa.array(queries))])))["terms"].to_pylist()
    every = sorted(df)
    of = dict(zip((h for [h] in next(search._query_terms(iter([pa.RecordBatch.from_arrays([pa.array(range(len(every))), pa.array(every)], names=["q", "text"])])))["terms"].to_pylist()), every))
    weights = np.array([idf[of[h]] for terms in hashed for h in terms])
    wanted, place = np.unique(np.array([h for terms in hashed for h in terms]).view(np.uint64), return_inverse=True)
    block = SimpleNamespace(value=([(i, q) for i, q in enumerate(queries)], np.cumsum([0, *map(len, hashed)]), place, weights, wanted))

    def found(least, own):
        batches = (pa.RecordBatch.from_pylist([s], schema=search._SHARD) for s in own)
        rows = [tuple(r.values()) for b in search._search(block, SimpleNamespace(value=least), mean, k)(batches) for r in b.to_pylist()]
        return [[(-s, d) for number, _, d, s in rows if number == i] for i in range(len(queries))]

    want = []
    for q in queries:
        scores = [(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in counts[q] if w in c), d) for d, c in enumerate(counts)]
        want.append(sorted((-round(s, 6), d) for s, d in scores if s > 0)[:k])
    same = lambda got: [[d for _, d in g] for g in got] == [[d for _, d in x] for x in want] and all(abs(a - b) < 2e-6 for g, x in zip(got, want) for (a, _), (b, _) in zip(g, x))
    assert same(found(np.zeros(len(queries)), shards)) and same(found(np.zeros(len(queries)), shards[::-1]))
    first = found(np.zeros(len(queries)), shards[1:])
    least = np.array([-f[-1][0] if len(f) == k else 0.0 for f in first])
    rest = found(least, shards[:1])
    assert all(-s >= m * (1 - 1e-4) - 1e-4 for f, m in zip(rest, least) for s, _ in f)
    assert sum(map(len, rest)) < sum(map(len, found(np.zeros(len(queries)), shards[:1])))
    assert same([sorted(a + b)[:k] for a, b in zip(first, rest)])


def test_license_base_phrases_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows += [(900, None), (901, ""), (902, "Under-the MIT\nLicense. under the mit licenses; CC BY NC cc-by-nc ccbync"), (903, "x " * 60_000 + "Apache License, Version 2.0"), (None, "éunder the mit license under the mit license")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        words, want = WORDS.findall((t or "").translate(FOLD)), []
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            want += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        assert got[d]["n_words"] == len(words) and sorted((b["word"], b["label"]) for b in got[d]["base"]) == sorted(want), d
    assert [x["label"] for x in got[903]["detections"]] == ["apache-2"]


def brute_resolve(found):
    kept = []
    for p, s, e, label in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1], x[3])):
        if not any(a <= s and e <= b for a, b, _, _ in kept):
            kept.append((s, e, label, p))
    return sorted(kept)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 20), st.integers(1, 8), st.sampled_from("abc")), max_size=25))
def test_resolution_against_brute_force(found):
    found = [(p, s, s + n, label) for p, s, n, label in found]
    assert licenses.resolve(found) == brute_resolve(found)


NOTICES = [
    (b"licensed under the gnu general public license, version 3 or the gnu lesser general public license", ["gpl-3", "lgpl"]),
    (b"released under the mit licence", ["mit"]), (b"cc-by-nc 4.0", ["cc-by-nc"]), (b"gplv2", ["gpl-2"]), (b"apache-2.0 license", ["apache-2"]), (b"nothing here", []),
    (b"gnu general public license, v2 or (at your option) any later version", ["gpl-2-or-later"]), (b"copyright (c) 2012-2014 foo bar. all rights reserved.", ["copyright-line"]),
    (b"spdx-license-identifier: bsd-3-clause", ["bsd-3-clause"]), (b"under the licensed", []), (b"apache software licence ver. 2", ["apache-2"]),
]


def test_license_rules():
    assert len(licenses.rules()) > 400 and len({p.pattern for *_, p in licenses.rules()}) == len(licenses.rules())
    scan = licenses.Scanner().scan
    for text, want in NOTICES:
        assert [x[2] for x in scan(text)[1]] == want, text


def test_keywords_hide_no_match(documents):
    """All patterns on all texts, without the prefilter, find the same."""
    scan = licenses.Scanner().scan
    for text in [t for t, _ in NOTICES] + [r["text"].lower().encode() for r in documents.where("text is not null").limit(40).collect()]:
        text = text[:3000]
        assert scan(text)[1] == brute_resolve([(n, m.start(), m.end(), label) for label, n, _, p in licenses.rules() for m in p.finditer(text)])


def test_many_detections_ties_and_clashing_names(spark):
    notice = "Released under the MIT licence. Or: under the MIT License! Copyright 2010 A. GPLv3 or later; "
    rows = spark.createDataFrame([(1, notice * 3000), (1, notice), (2, "under the MIT license under the MIT license")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("base", "detections", "label", "n_words")})
    got = sorted(licenses.scan_licenses(rows).collect(), key=lambda r: r["n_words"])
    assert [len(r["base"]) for r in got] == [2, 1, 3000] and len(got[2]["detections"]) == 3000 * len(got[1]["detections"])
    assert {d["label"] for d in got[1]["detections"]} == {"mit", "copyright-line", "gpl-3-or-later"}
