import os
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import jaccard
from lodestrata.llm.decontam import find_passages, proximity_matches
from lodestrata.llm.jaccard import similar_components
from lodestrata.llm.lines import dedup_lines
from lodestrata.shared import shared_dir

FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_components(rows, percent=90):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and both and 100 * both >= percent * len(x | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_components_against_brute_force(spark):
    rng, rows = random.Random(9), []
    words = [f"w{i}" for i in range(4000)]
    for g in range(6):
        base = rng.choices(words, k=rng.choice((30, 60, 150)))
        for _ in range(25):
            own = base[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(own)))
    hot = rng.choices(words, k=40)
    rows += [(len(rows) + 10 + i, " ".join([*rng.choices(words, k=25), *hot])) for i in range(20)]
    rows += [(500, None), (501, " \n"), (502, "One two"), (503, "one TWO"), (504, "one"), (None, "one two three"), (505, "one  two\tthree"), (505, "other text of that id"), (506, "a a a a a a"), (507, "a a a a")]
    rows += [(508, " ".join(words * 5))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in similar_components(frame).collect())
    assert got == brute_components(rows)
    assert similar_components(frame.limit(0)).count() == 0


def test_shuffle_files_go_with_their_write(spark):
    """Shuffle files go with the write that made them."""
    from lodestrata.shared import written

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())) if f.startswith("shuffle_")}
    before = shuffled()
    assert written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "sums").count() == 10
    left = lambda: {f.split("_")[1] for f in shuffled() - before}
    until = time.time() + 10  # files go in the background
    while len(left()) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(left()) <= 1  # only what count() itself shuffled, a row a partition


def left_behind(spark, make):
    """Names of the written tables that are left when ``make`` returns, but those of components; and what it returns."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    made = make()
    return {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before} - {"components"}, made


def test_tables_that_no_result_reads_go_and_prefixes_are_written_once(spark, monkeypatch):
    rng, held, write = random.Random(4), [], jaccard.materialize
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, texts[3]), (91, texts[5] + " more")]

    def recorded(df, tag):
        out = write(df, tag)
        if "prefix" in out.columns:
            held.append((tag, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", recorded)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left, kept = left_behind(spark, lambda: jaccard.keep_first(frame, size=5, percent=80))
    assert left == {"copies"} and sorted(r["doc_id"] for r in kept.collect()) == list(range(30))
    assert dict(held)["prefixes"] == 32 and sum(n for tag, n in held if tag != "prefixes") <= 3
    left, found = left_behind(spark, lambda: similar_components(frame, size=5, percent=80))
    assert left == {"rows", "classes"} and {r["doc_id"]: r["component_id"] for r in found.collect()} == {**{i: i for i in range(30)}, 90: 3, 91: 5}
    left, lines = left_behind(spark, lambda: dedup_lines(frame))
    assert left == {"line-gone"} and {r["doc_id"] for r in lines.collect() if r["removed"]} == {90}


def test_members_of_long_lists_share_a_part():
    rng = np.random.default_rng(4)
    for percent in (80, 90, 95, 100):
        for _ in range(300):
            x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
            most = (100 - percent) * 2 * len(x) // (100 + percent)
            y = x[rng.integers(0, most // 2 + 1) :]
            y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, rng.integers(0, most // 2 + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both < percent * (len(x) + len(y) - both):
                continue
            ours = [{int(h) for k in (c, c + 1) for h in jaccard.parts_of(s, k, percent)} for s in (x, y) for c in [jaccard.size_class(len(s), percent)]]
            assert ours[0] & ours[1]
            assert sum(int(v).bit_count() for v in (jaccard.parities(x) ^ jaccard.parities(y)).view(np.uint64)) <= len(x) + len(y) - 2 * both


def test_long_lists_stay_linear_and_whole(spark, monkeypatch):
    """Documents that share one rare phrase and nothing else are written once each, not by pairs; those that also are alike are found."""
    rng, made, keep = random.Random(5), {}, jaccard.materialize

    def count(df, tag):
        out = keep(df, tag)
        if tag in ("long-lists", "rest", "star"):
            made[tag] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", count)
    phrase = " ".join(f"p{i}" for i in range(10))
    rows = [(d, " ".join(rng.choices("abcd", k=40)) + f" {phrase}" * (d % 4 == 0)) for d in range(400)]
    rows += [(400 + d, rows[4 * d][1].replace(" a b c ", " a b d ", 1)) for d in range(20)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect())
    assert got == brute_components(rows, 80)
    assert made["long-lists"] >= 100 and made["rest"] <= 2 * len(rows) and made["star"] <= 2 * len(rows)


def brute_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    out = []
    for d, t in docs:
        w, hits, ids = words(t), set(), set()
        for i, s in items:
            v = words(s)
            n = min(window, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hits |= set(range(b, b + n))
                        ids.add(str(i))
        out.append((str(d), len(w), sorted(hits), ",".join(sorted(ids))))
    return sorted(out)


def test_passages_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(60)] + ["the", "of"] * 40
    items = [(i, " ".join(rng.choices(words, k=rng.choice((3, 9, 10, 11, 30))))) for i in range(12)] + [(20, None), (21, ""), (22, "the"), (23, "of of of of of of of of of of of of"), (5, "Same id, other words here"), (5, "Same id, other words here")]
    docs = []
    for d in range(40):
        own = rng.choices(words, k=50)
        if d % 2:
            v = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(v) - 5))
            own[20:20] = v[a : a + rng.choice((9, 10, 14, 40))]
        docs.append((d, " ".join(own)))
    docs += [(100, None), (101, ""), (7, "THE-of " * 9), (None, "of " * 30), (102, "zz " * 20_000 + items[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = find_passages(frame, bench, keep=("term",)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], sorted(r["hits"]), ",".join(sorted({m["item_id"] for m in r["matches"]}))) for r in rows)
    assert got == brute_hits(docs, items) and {r["term"] for r in rows} == {"clash"}
    assert find_passages(frame.limit(0), bench).count() == 0
    assert all(not r["hits"] for r in find_passages(frame, bench.limit(0)).collect())


def brute_near(docs, items, window=10, slop=2):
    """Of every document: items with a window all of whose words stand within slop of their places, for a shift that one of its two rarest words gives."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    count = Counter(w for _, t in docs for w in words(t))
    out = {}
    for d, t in docs:
        w, out[d] = words(t), set()
        for i, s in items:
            v = words(s)
            n, rare = min(window, len(v)), set()
            starts = range(len(v) - n + 1) if v else ()
            for a in starts:
                if all(count[x] for x in v[a : a + n]):
                    rare |= set(sorted(range(a, a + n), key=lambda k: (count[v[k]], k))[:2])
            at = {(p, b) for p in rare for b in range(len(w)) if w[b] == v[p]}
            shifts = {b - p for p, b in at if n == 1 or any(q != p and abs((c - q) - (b - p)) <= slop for q, c in at)}
            for shift in shifts:
                mark = ["2" if 0 <= shift + k < len(w) and w[shift + k] == x else "1" if x in w[max(0, shift + k - slop) : max(0, shift + k + slop + 1)] else "0" for k, x in enumerate(v)]
                out[d] |= {str(i) for a in starts if "0" not in mark[a : a + n] and "1" in mark[a : a + n]}
    return {d: sorted(x) for d, x in out.items()}


def test_proximity_against_brute_force(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item.replace("epsilon", "epsilon extra")), (2, item), (3, "nothing of it"), (4, item.replace("alpha", "alpha x")), (5, item.replace("iota kappa", "kappa iota")), (6, item.replace("zeta", "zeta a b c d")), (7, None), (8, " ".join(reversed(item.split())))]
    docs += [(9, "alpha alpha alpha kappa " * 50), (10, "Beta, " + item.replace("gamma", "gamma and").upper())]
    rng = random.Random(3)
    for d in range(20, 60):
        own = item.split()
        for _ in range(rng.randrange(4)):
            own.insert(rng.randrange(11), rng.choice(["x", "y", "beta"]))
        docs.append((d, " ".join([*rng.choices("pqrs", k=5), *own])))
    items = [(1, item), (2, None), (3, "kappa x y"), (4, "zz qq"), (5, "alpha")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("near", "close", "_words", "id")})
    got = {r["doc_id"]: list(r["near"]) for r in proximity_matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert "1" in got[1] and "1" in got[4] and "1" in got[5] and "1" in got[10]
    assert all("1" not in got[d] for d in (2, 3, 6, 7, 8))
    assert got == brute_near(docs, items)
    assert proximity_matches(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
