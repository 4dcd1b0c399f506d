"""Substring deduplication by sliding sentence spans.

A sentence ends at a line break or at white space after one of ``. ! ?``.  From each sentence forward, and from each
backward, the shortest run of at least ``min_sentences`` sentences and ``min_words`` words is a span; a sentence of
``long_words`` words is one by itself.  Spans are hashed by their words (A to Z folded) with 64 bits, and joined
over all documents.  A span's first place (smallest doc_id, then text, then place) stays; sentences that any other
place covers are removed, with the white space behind them.

With ``passage_words``, every run of so many words is found too, wherever sentences end in it: words that any but its
first place covers are removed, and where copies overlap in one text the first one stays whole.  A run is looked for by
its smallest run of ``GRAM_WORDS`` words (by hash; the first of equal ones), its anchor: equal runs have equal anchors, so
that only runs whose anchor has another place are hashed.  Neighbours with one anchor are a segment, which is joined as
a whole; runs are joined one by one only in segments that have no earlier place.

Skew: the first place of a hash is a grouped minimum with map-side combining; the join back has one row a
hash on one side, so that Spark can split the other.

Defined cases: null texts have no sentences and stay null; rows with equal doc_id and text are the same document;
rows with null doc_id come first; texts below the limits have no spans and stay as they are; other columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, U, _powers, chunks, hashes, mix, spans
from .common import in_sketch, materialize, sketch, small_batches

MIN_SENTENCES, MIN_WORDS, LONG_WORDS = 2, 20, 40
#: Passages of over 50 words; the words of an anchor.
PASSAGE_WORDS, GRAM_WORDS = 51, 20
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x21, 0x2E, 0x3F]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words (starts, ends) of many texts, and sentences (first word, row) of them."""
    starts, ends, rows = spans(data, offsets, NOT_SPACE)
    if not len(starts):
        return starts, ends, starts, rows
    breaks = np.cumsum(data == 0x0A)
    begins = np.ones(len(starts), dtype=bool)
    begins[1:] = (rows[1:] != rows[:-1]) | _STOP[data[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1] - 1])
    first = np.flatnonzero(begins)
    return starts, ends, first, rows[first]


def runs(first: np.ndarray, rows: np.ndarray, words: int, min_sentences: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, sentence after the last) of all spans."""
    n = len(first)
    each = np.arange(n)
    after = np.append(first[1:], words)  # word after each sentence
    last = np.maximum(each + min_sentences - 1, np.searchsorted(after, first + min_words))
    ok = last < n
    ok[ok] = rows[last[ok]] == rows[each[ok]]
    begin = np.minimum(each - min_sentences + 1, np.searchsorted(first, after - min_words, side="right") - 1)
    back = begin >= 0
    back[back] = rows[begin[back]] == rows[each[back]]
    alone = after - first >= long_words
    a = np.concatenate([each[ok], begin[back], each[alone]])
    b = np.concatenate([last[ok], each[back], each[alone]]) + 1
    both = np.unique(a * (n + 1) + b)
    return both // (n + 1), both % (n + 1)


def _sums(words: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return sums


def _run_hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words from a to before b."""
    _, down = _powers(len(sums))
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def passages(sums: np.ndarray, rows: np.ndarray, passage_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, first word of the anchor, hash of the anchor) of all runs of ``passage_words`` words of one text."""
    gram = min(GRAM_WORDS, passage_words)
    n, width, have = len(rows) - passage_words + 1, passage_words - gram + 1, 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.arange(len(rows) - gram + 1)
    least = _run_hashes(sums, at, at + gram)
    while have < width:  # smallest of ``have`` neighbours
        step = min(have, width - have)
        right = least[step:] < least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    first = np.flatnonzero(rows[:n] == rows[passage_words - 1 :])
    return first, at[first], least[first]


def _anchors(passage_words: int):
    schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("h", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for row, data, offsets in chunks(batch.column(2)):
                starts, ends, rows = spans(data, offsets, NOT_SPACE)
                _, at, h = passages(_sums(hashes(data, starts, ends)), rows, passage_words)
                at, keep = np.unique(at, return_index=True)
                doc = rows[at]
                take = pa.array(row + doc)
                own = at - np.searchsorted(rows, doc)
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(h[keep].view(np.int64)), pa.array(own.astype(np.int32))], schema=schema)

    return run


def _segments(passage_words: int):
    schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("runs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, anchors = batch.column(0), batch.column(1), batch.column(3).to_pylist()
            for row, data, offsets in chunks(batch.column(2)):
                starts, ends, rows = spans(data, offsets, NOT_SPACE)
                sums = _sums(hashes(data, starts, ends))
                wanted = np.zeros(len(rows), dtype=bool)
                base = np.searchsorted(rows, np.arange(len(offsets) - 1))
                for i in range(len(offsets) - 1):
                    wanted[base[i] + np.array(anchors[row + i], dtype=np.int64)] = True
                first, at, _ = passages(sums, rows, passage_words)
                first, at = first[wanted[at]], at[wanted[at]]
                if not len(first):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1), [True]]))
                a, b = first[edge[:-1]], first[edge[1:] - 1] + passage_words
                take = pa.array(row + rows[a])
                runs = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(_run_hashes(sums, first, first + passage_words).view(np.int64)))
                h, own = _run_hashes(sums, a, b).view(np.int64), (a - base[rows[a]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(h), pa.array(own), runs], schema=schema)

    return run


def _spans(min_sentences: int, min_words: int, long_words: int):
    schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for row, data, offsets in chunks(batch.column(2)):
                starts, ends, first, rows = sentences(data, offsets)
                if not len(first):
                    continue
                a, b = runs(first, rows, len(starts), min_sentences, min_words, long_words)
                edge = np.append(first, len(starts))
                h = _run_hashes(_sums(hashes(data, starts, ends)), edge[a], edge[b])
                doc = rows[a]
                own = a - np.searchsorted(rows, doc)
                take = pa.array(row + doc)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(h.view(np.int64)), pa.array(own.astype(np.int32)), pa.array((b - a).astype(np.int32))], schema=schema
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("removed", places), ("cut", places)])
    for batch in batches:
        out, n, gone, part = [], [], [], []
        of, covered = pc.list_parent_indices(batch.column(2)).to_numpy(), pc.list_flatten(batch.column(2))
        by_word, start, size = (covered.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        for row, data, offsets in chunks(batch.column(1)):
            starts, _, first, rows = sentences(data, offsets)
            at = np.searchsorted(rows, np.arange(len(offsets)))
            edge = np.append(first, len(starts))
            own = slice(*np.searchsorted(of, [row, row + len(offsets) - 1]))
            word, begin, long, base = by_word[own], start[own].astype(np.int64), size[own], at[of[own] - row]
            a, b = edge[base] + begin, edge[base] + begin + long
            a[~word], b[~word] = edge[(base + begin)[~word]], edge[(base + begin + long)[~word]]
            steps = np.bincount(a, minlength=len(starts) + 1) - np.bincount(b, minlength=len(starts) + 1)
            drop = np.cumsum(steps)[: len(starts)] > 0
            lost = np.diff(np.append(0, np.cumsum(drop))[edge])
            for i in range(len(offsets) - 1):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                less = lost[at[i] : at[i + 1]]
                if less.any():
                    words = slice(edge[at[i]], edge[at[i + 1]])
                    cuts = np.append(starts[words] - offsets[i], len(text))
                    turns = np.diff(np.concatenate([[1], drop[words], [1]]).astype(np.int8))
                    kept = [text[cuts[x] : cuts[y]] for x, y in zip(np.flatnonzero(turns < 0), np.flatnonzero(turns > 0))]
                    text = text[: cuts[0]] + b"".join(kept)
                out.append(text.decode("utf-8"))
                n.append(len(less))
                whole = less == np.diff(edge[at[i] : at[i + 1] + 1])
                gone.append(np.flatnonzero(whole).astype(np.int32))
                part.append(np.flatnonzero((less > 0) & ~whole).astype(np.int32))
        null = batch.column(1).is_null().to_pylist()
        texts = pa.array([None if z else t for z, t in zip(null, out)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(n, pa.int64()), pa.array(gone, places), pa.array(part, places)], schema=schema)


def _first(places: DataFrame, tag: str) -> DataFrame:
    """(h, first) of each hash with several places."""
    place = F.struct("id", "t", "start")
    first = places.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    return materialize(first, tag)  # joined as a table of its own, so that Spark can split the places of one hash


def _later(places: DataFrame, tag: str) -> DataFrame:
    """The places of each hash but the first, with ``first``."""
    return places.join(_first(places, tag), "h").where(~F.struct("id", "t", "start").eqNullSafe(F.col("first")))


def _later_passages(rows: DataFrame, passage_words: int) -> DataFrame:
    """(id, t, start, size) of the words of repeated passages, but the first ones."""
    anchors = rows.mapInArrow(_anchors(passage_words), "id long, t long, h long, start int")
    place = F.struct("id", "t", "start")
    often = anchors.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h")
    often = materialize(often, "repeated-anchors")
    found = anchors.join(often, "h").groupBy("id", "t").agg(F.collect_set("start").alias("anchors"))
    found = materialize(found, "anchors")
    held = in_sketch(rows.sparkSession, sketch(found.select("t")))(F.col("t"))
    joined = rows.where(held).alias("r").join(found.alias("f"), F.expr("r.id <=> f.id and r.t = f.t")).select("r.id", "r.t", "text", "anchors")
    segments = materialize(joined.mapInArrow(_segments(passage_words), "id long, t long, h long, start int, runs array<long>"), "segments")
    segments = segments.join(_first(segments, "repeated-segments"), "h", "left")
    again = F.col("first").isNotNull() & ~F.struct("id", "t", "start").eqNullSafe(F.col("first"))
    segments = segments.select("id", "t", "start", "first", F.size("runs").alias("n"), F.when(~again, F.col("runs")).alias("runs"))
    segments = materialize(segments, "segments-joined")
    runs = segments.where("runs is not null").select("id", "t", "start", F.posexplode("runs").alias("k", "h")).select("id", "t", "h", (F.col("start") + F.col("k")).alias("start"))
    runs = materialize(_later(runs, "repeated-passages").select("id", "t", "start", "first", F.lit(1).alias("n")), "later-passages")
    later = segments.where("runs is null").select("id", "t", "start", "first", "n").unionByName(runs)
    begin = F.when(F.expr("id <=> first.id and t = first.t"), F.greatest("start", F.col("first.start") + passage_words)).otherwise(F.col("start"))
    return later.select("id", "t", begin.alias("start"), (F.col("start") + F.col("n") - 1 + passage_words - begin).alias("size"))


def remove_repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, passage_words: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, text without repeated spans, n_sentences (before), removed and cut (places of sentences that lose all or some words)."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text.isNull(), text).alias("t"), text.alias("text"))
    places = rows.mapInArrow(_spans(min_sentences, min_words, long_words), "id long, t long, h long, start int, size int")
    later = _later(places, "repeated-spans").select("id", "t", F.lit(False).alias("by_word"), "start", "size")
    if passage_words:
        later = materialize(later, "later-spans")
        later = later.unionByName(_later_passages(rows, passage_words).withColumn("by_word", F.lit(True)))
    later = materialize(later.groupBy("id", "t").agg(F.collect_set(F.struct("by_word", "start", "size")).alias("covered")), "covered")
    touched = in_sketch(docs.sparkSession, sketch(later.select("t")))(F.col("t"))  # other texts stay where they are
    joined = rows.where(touched).alias("r").join(later.alias("l"), F.expr("r.id <=> l.id and r.t = l.t"), "left").select("r.id", "text", "covered")
    joined = joined.unionByName(rows.where(~touched).select("id", "text", F.lit(None).cast(later.schema["covered"].dataType).alias("covered")))
    return joined.mapInArrow(_cut, "doc_id long, text string, n_sentences long, removed array<int>, cut array<int>")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: sentences, how many and which are removed, length and digest of what stays, which are cut."""
    found = remove_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage_words=PASSAGE_WORDS)
    return found.select(
        "doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
        F.size("cut").cast("long").alias("n_cut"), F.array_join(F.transform("cut", lambda x: x.cast("string")), ",").alias("cut"),
    )
