import re

from lodestrata.llm.spans import op7_substring_dedup, remove_repeated_spans


def brute(rows, min_sentences=2, min_words=20, long_words=40):
    """The same by dictionaries of word tuples."""
    cut = {}
    for doc, text in rows:
        parts = []
        for m in re.finditer(r"[^ \t-\r]+[ \t-\r]*", text or ""):
            last = parts[-1][-1] if parts else ""
            if not parts or "\n" in last[len(last.rstrip(" \t\n\r\v\f")):] or last.rstrip(" \t\n\r\v\f")[-1] in ".!?":
                parts.append([m.group()])
            else:
                parts[-1].append(m.group())
        cut[doc] = parts
    fold = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w.strip())
    places = {}
    for doc, parts in cut.items():
        n = [len(p) for p in parts]
        found = set()
        for i in range(len(parts)):
            for j in range(i + min_sentences, len(parts) + 1):
                if sum(n[i:j]) >= min_words:
                    found.add((i, j))
                    break
        for j in range(len(parts), 0, -1):
            for i in range(j - min_sentences, -1, -1):
                if sum(n[i:j]) >= min_words:
                    found.add((i, j))
                    break
        found |= {(i, i + 1) for i in range(len(parts)) if n[i] >= long_words}
        for i, j in found:
            places.setdefault(tuple(fold(w) for p in parts[i:j] for w in p), []).append((doc, i, j))
    gone = {doc: set() for doc in cut}
    for own in places.values():
        for doc, i, j in sorted(own)[1:]:
            gone[doc] |= set(range(i, j))
    return {doc: (len(parts), sorted(gone[doc]), "".join(w for k, p in enumerate(parts) if k not in gone[doc] for w in p)) for doc, parts in cut.items()}


def check(spark, rows):
    got = {r["doc_id"]: (r["n_sentences"], list(r["removed"]), r["text"] or "") for r in remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    for doc, _ in rows:
        text = dict(rows)[doc] or ""
        head = text[: len(text) - len(text.lstrip(" \t\n\r\v\f"))]
        n, gone, kept = want[doc]
        assert got[doc] == (n, gone, head + kept if n else text), doc


def test_against_brute_force(spark, documents):
    check(spark, [(r["doc_id"], r["text"]) for r in documents.limit(200).select("doc_id", "text").collect()])


def test_passage_in_two_documents_and_edges(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve! Alpha beta gamma delta epsilon zeta eta. A b c d e f g h i j."
    rows = [(1, f"Own words start here. {passage} And end."), (2, f"Other words. {passage.upper()}"), (3, None), (4, ""), (5, "Short. Text."), (6, "Short. Text."), (7, " lead " + "w " * 30000)]
    check(spark, rows)


def test_null_ids_repeats_and_other_columns(spark):
    text = " ".join(f"w{i}." if i % 9 == 8 else f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 3)], "doc_id long, text string, h int")
    got = sorted((r["doc_id"] is None, len(r["removed"])) for r in remove_repeated_spans(rows).collect())
    assert got == [(False, 7), (False, 7), (True, 0)]
    assert remove_repeated_spans(rows.limit(0)).count() == 0


def brute_passages(rows, size):
    """Texts without the words that lie in a run of ``size`` words with an earlier place, by dictionaries of word tuples."""
    first, out = {}, {}
    fold = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w.strip())
    for doc, text in sorted(rows):
        parts = re.findall(r"[^ \t-\r]+[ \t-\r]*", text)
        gone = set()
        for i in range(len(parts) - size + 1):
            d, j = first.setdefault(tuple(map(fold, parts[i : i + size])), (doc, i))
            if (d, j) != (doc, i):
                gone |= set(range(max(i, j + size) if d == doc else i, i + size))
        out[doc] = "".join(p for k, p in enumerate(parts) if k not in gone)
    return out


def test_passages_that_are_not_aligned_to_sentences(spark):
    word = lambda name, n: [f"{name}{i}" for i in range(n)]
    cut = " ".join([*word("a", 30)[:-1], "a29.", *word("b", 30)])  # 60 words, the ends of two sentences
    one = " ".join([*word("c", 15)[:-1], "c14.", *word("d", 30)[:-1], "d29.", *word("e", 9)])  # one whole sentence of 30 words
    none = " ".join(word("f", 50))
    rows = [
        (1, f"Start here {cut} and on. Then {one} so it goes. And {none} of it."), (2, f"Other words {cut.upper()} but not this. Next {one} is new. Or {none} ended."),
        (3, f"More {cut}"), (4, "w " * 300), (5, " ".join(word("g", 60) * 3)), (6, "Short. Text."),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeated_spans(frame, min_words=10**6, long_words=10**6, passage_words=51).collect()}
    assert {d: r["text"] for d, r in got.items()} == brute_passages(rows, 51)
    assert got[2]["text"] == f"Other words but not this. Next is new. Or {none} ended."
    assert (list(got[2]["removed"]), list(got[2]["cut"])) == ([3], [0, 1, 2, 4])


def test_query_takes_passages_of_over_50_words(spark, tmp_path):
    passage = " ".join(f"p{i}" + "." * (i == 25) for i in range(51))
    spark.createDataFrame([(1, f"First {passage} ends."), (2, f"Second {passage} stays.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7_substring_dedup(spark, str(tmp_path)).collect()}
    assert (got[1]["kept_chars"], got[1]["n_cut"]) == (len(f"First {passage} ends."), 0)
    assert (got[2]["kept_chars"], got[2]["n_removed"], got[2]["cut"]) == (len("Second stays."), 0, "0,1")
