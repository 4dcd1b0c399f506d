import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import lines
from lodestrata.llm.edits import _table, within
from lodestrata.llm.lines import dedup_lines


@settings(max_examples=500, deadline=None)
@given(st.binary(max_size=14), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 14), st.integers(0, 3)), max_size=5), st.integers(0, 4))
def test_bounded_distance(a, changes, k):
    a, b = bytes(x % 4 for x in a), bytearray(x % 4 for x in a)
    for kind, at, value in changes:
        if kind == 0:
            b.insert(at, value)
        elif b:
            b[at % len(b) : at % len(b) + 1] = [value] if kind == 1 else []
    assert within(a, bytes(b), k) == (_table(a, bytes(b)) <= k)


def test_pairs_of_bytes_bound_the_edits():
    """A pair of lines with few edits is never held back; one with several edits far apart seldom reaches the edit distance."""
    rng, held = random.Random(9), 0
    for trial in range(400):
        line = bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(20, 400)))
        edits, other = trial % 7, bytearray(line)
        for _ in range(edits):
            at, kind = rng.randrange(len(other)), rng.randrange(3)
            other[at : at + 1] = b"" if kind == 0 else bytes([rng.choice(b"xyz")]) if kind == 1 else bytes([other[at]]) + b"q"
        odd = [lines._odd(np.frombuffer(bytes(x), dtype=np.uint8)) for x in (line, other)]
        apart = int((odd[0] ^ odd[1]).sum())
        assert apart <= 4 * edits
        held += edits == 6 and apart > 8
    assert held >= 50  # of 57


def brute(rows):
    lines = [(d, i, s.encode()) for d, t in rows for i, s in enumerate((t or "").split("\n") if t else [])]
    lines = [(d, i, s) for d, i, s in lines if s.strip(b" \t\n\v\f\r")]
    texts = list(dict.fromkeys(s for _, _, s in sorted(lines)))
    group = {s: s for s in texts}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    for i, x in enumerate(texts):
        for y in texts[i + 1 :]:
            t = min(2, min(len(x), len(y)) // 20)
            if abs(len(x) - len(y)) <= t and _table(x, y) <= t:
                group[root(y)] = root(x)
    seen, gone = set(), {}
    for d, i, s in sorted(lines):
        if root(s) in seen:
            gone.setdefault(d, []).append(i)
        seen.add(root(s))
    return gone


def test_against_brute_force(spark):
    rng, rows = random.Random(4), []
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (20, 25, 39, 40, 41, 60, 61, 90)]
    for d in range(60):
        own = []
        for s in rng.sample(base, 4):
            s = list(s)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                at, kind = rng.randrange(len(s)), rng.randrange(3)
                s[at : at + 1] = [] if kind == 0 else [rng.choice("xyz")] if kind == 1 else [s[at], "q"]
            own.append("".join(s))
        rows.append((d, "\n".join([*own, rng.choice(("short", "shirt", "other")), "", " \t"])))
    rows += [(100, None), (101, ""), (102, "é" * 30 + "\n" + "é" * 29 + "è"), (103, "z" * 70_000)]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    for d, t in rows:
        gone = want.get(d, [])
        assert list(got[d]["removed"]) == gone, d
        if t is not None:
            assert got[d]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    assert got[100]["text"] is None


def test_null_ids_repeats_and_kept_columns(spark):
    line = "the very same line of this text"
    clash = ("id", "t", "node", "component", "key", "kept_too", "gone", "h1", "line", "Place")
    rows = spark.createDataFrame([(None, line, 1), (2, line, 2), (2, line, 3), (3, f"{line}!", 4)], "doc_id long, text string, n int").withColumns({c: F.lit(c) for c in clash})
    got = dedup_lines(rows, keep=("n", *clash)).collect()
    assert sorted((r["n"], list(r["removed"])) for r in got) == [(1, []), (2, [0]), (3, [0]), (4, [0])]
    assert all(r[c] == c for r in got for c in clash)
    assert dedup_lines(rows.limit(0)).count() == 0


def test_a_list_of_unlinked_lines_stays_linear(spark, monkeypatch):
    """Lines that share a third but nothing else: what is written of them grows with their number, not with its square."""
    rng, made = random.Random(6), {}

    def count(df, tag):
        out = keep(df, tag)
        if tag in ("line-lists", "line-rest", "line-star"):
            made[tag] = out.count()
        return out

    keep = lines.materialize
    monkeypatch.setattr(lines, "materialize", count)
    rows = [(d, "x" * 30 + "".join(rng.choice("abcdefghijklmnop") for _ in range(60))) for d in range(300)]
    assert all(not r["removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert made["line-lists"] >= 300 and made["line-rest"] <= 300 and made["line-star"] <= 300


def test_second_hashes_are_of_wanted_lines_only(monkeypatch):
    """What is gathered again equals what all lines give, and no other line's bytes are hashed twice; blank lines are none."""
    texts = ["first line\n \t\n  indented\n\nlast", None, "", "\n", " x\n\u00e9t\u00e9", "first line"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(range(6), pa.int64()), pa.array(texts)], names=["id", "t", "text"])
    (whole,) = lines._lines()(iter([batch]))
    assert [(r["id"], r["place"], r["n"]) for r in whole.to_pylist()] == [(0, 0, 10), (0, 2, 10), (0, 4, 4), (4, 0, 2), (4, 1, 5), (5, 0, 10)]
    again, taken, made = whole["h1"].to_pylist()[0], [], lines._Hashes
    monkeypatch.setattr(lines, "may_hold", lambda _, h: h.view(np.int64) == again)
    monkeypatch.setattr(lines, "_Hashes", lambda data, which: taken.append((which, len(data))) or made(data, which))
    (found,) = lines._lines(SimpleNamespace(value=None))(iter([batch]))
    assert found.to_pylist() == [{k: v for k, v in r.items() if k != "n"} for r in whole.to_pylist() if r["h1"] == again]
    assert [n for which, n in taken if which == 1] == [20]
