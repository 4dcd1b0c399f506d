"""Benchmark decontamination with a positional inverted index, in DataFrame expressions only.

A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one
window.  Method:

1. Count, over all documents, the terms that items have.
2. Of each window take the two rarest terms; windows with a term that no document has can't occur.
3. Store the postings (term, document, position) of these terms.
4. Shift each posting by its term's place in the item: lists of one item that agree on document and
   shifted position intersect; one group-by with map-side minima and maxima finds where two places agree.
   Proximity matches begin with postings whose shifts differ by a few places instead.
5. Compare the item's words with the document's at these alignments, which finds every window exactly.

Skew: a frequent term is never a rarest one unless a window has no other; postings are grouped by
(item, document, place), never by term, and a document's text is joined by its own key.
The item side is broadcast by Spark where its written size is below the session's threshold, else shuffled.

Defined cases: null texts have no words; rows with equal or null doc_id are told apart by their text and each
gives a row; equal item rows count once, a null item_id is the empty string; no items: nothing is hit; no
documents: no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 10
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def _documents(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) with a key that holds for null and repeated ids, and the columns ``keep``."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.col("doc_id").isNull(), text).alias("h"),
        *keep,
    )


def _items(items: DataFrame, window: int) -> DataFrame:
    """(item, item_id, words, width) of every item with words."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    return rows.withColumn("width", F.least(F.size("words"), F.lit(window)))


def build_index(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, places, postings): what is stored for a search.

    places: (item, term, place) of the two rarest terms of each window; postings: (term, id, h, position) of these terms.
    """
    documents = _documents(docs)
    entries = materialize(_items(items, window), "items")
    terms = materialize(entries.select(F.explode("words").alias("term")).distinct(), "item-terms")
    counts = materialize(documents.select(F.explode(words_of(F.col("text"))).alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    at = entries.select("item", "width", F.size("words").alias("n_words"), F.posexplode("words").alias("place", "term")).join(counts, "term")
    first = F.greatest(F.col("place") - F.col("width") + 1, F.lit(0))
    last = F.least(F.col("place"), F.col("n_words") - F.col("width"))
    windows = (
        at.select("item", "width", "term", "place", "n", F.explode(F.sequence(first, last)).alias("start"))
        .groupBy("item", "start", "width")
        .agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("terms"))
        .where("size(terms) = width")
    )
    places = materialize(windows.select("item", F.explode(F.slice("terms", 1, 2)).alias("t")).select("item", "t.term", "t.place").distinct(), "item-places")
    wanted = materialize(places.select("term").distinct(), "rarest-terms")
    postings = documents.select("id", "h", F.posexplode(words_of(F.col("text"))).alias("position", "term")).join(wanted, "term")
    return entries, places, materialize(postings.select("term", "id", "h", "position"), "postings")


def alignments(entries: DataFrame, places: DataFrame, postings: DataFrame) -> DataFrame:
    """(item, id, h, shift): where the offset-adjusted postings of two places of an item agree (of one, if it has one word)."""
    shifted = postings.join(places, "term").select("item", "id", "h", "place", (F.col("position") - F.col("place")).alias("shift"))
    agreed = shifted.groupBy("item", "id", "h", "shift").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    return agreed.join(entries.select("item", "width"), "item").where("low < high or width = 1").select("item", "id", "h", "shift")


def proximity_candidates(entries: DataFrame, places: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """(item, id, h, shift): postings of an item's rare places that have one of another place within ``slop``.

    A window that occurs with words put in, left out or moved by at most ``slop`` has its two rarest terms there, at shifts that
    differ by at most ``slop`` from that of either: every such posting is found in bands of shifts, two to a posting, by
    grouped minima and maxima, so that a frequent term makes no pairs.
    """
    shifted = postings.join(places, "term").select("item", "id", "h", "place", (F.col("position") - F.col("place")).alias("shift"))
    band = F.floor(F.col("shift") / (slop + 1))
    banded = shifted.withColumn("band", F.explode(F.array(band, band - 1)))
    agreed = banded.groupBy("item", "id", "h", "band").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("shift").alias("shifts"))
    agreed = agreed.join(entries.select("item", "width"), "item").where("low < high or width = 1")
    return agreed.select("item", "id", "h", F.explode("shifts").alias("shift")).distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """Every document with the items that it holds loosely: doc_id, text, n_near, near.

    near: sorted distinct item_ids with a window that doesn't occur, and each of whose words stands within ``slop`` places of where
    the window would have it, if it began where one of its rare words says.  Items whose windows occur as they are aren't in it for those windows.
    """
    entries, places, postings = build_index(docs, items, window)
    return _near(_documents(docs), entries, places, postings, slop).select("doc_id", "text", F.size("near").alias("n_near"), "near")


def _near(documents: DataFrame, entries: DataFrame, places: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    found = proximity_candidates(entries, places, postings, slop).join(entries, "item")
    found = found.groupBy("id", "h").agg(F.collect_list(F.struct("item_id", "shift", "words", "width")).alias("close"))
    rows = documents.join(found, ["id", "h"], "left").withColumn("_words", F.explode(F.array(words_of(F.col("text")))))

    def loose(a: Column) -> Column:
        def place(w: Column, i: Column) -> Column:
            at = a["shift"] + i
            around = F.exists(F.sequence(F.lit(-slop), F.lit(slop)), lambda d: F.get("_words", at + d) == w)
            return F.when(F.get("_words", at) == w, F.lit("2")).when(around, F.lit("1")).otherwise(F.lit("0"))

        marks = F.array_join(F.transform(a["words"], place), "")
        windows = F.transform(F.sequence(F.lit(0), F.size(a["words"]) - a["width"]), lambda i: F.substring(marks, i + 1, a["width"]))
        return F.exists(windows, lambda m: ~m.contains("0") & m.contains("1"))

    near = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("close", F.array().cast(found.schema["close"].dataType)), loose), lambda a: a["item_id"])))
    return rows.withColumn("near", near).drop("_words", "close")


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its exact matches: doc_id, text, the columns ``keep``, n_words, matches, hits.  For loose ones see proximity_matches.

    matches: array of (item_id, start): each occurrence of a window, by its first word; hits: the
    document's words inside any of them, as distinct positions.
    """
    entries, places, postings = build_index(docs, items, window)
    found = alignments(entries, places, postings).join(entries, "item")
    found = found.groupBy("id", "h").agg(F.collect_list(F.struct("item_id", "shift", "words", "width")).alias("found"))
    # A generated column: a filter on the matches can't be pushed below it, where it would split the text for every word again.
    one_list = F.explode(F.array(words_of(F.col("text"))))
    rows = _documents(docs, keep).join(found, ["id", "h"], "left").select("doc_id", "text", *keep, one_list.alias("words"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))

    def occurrences(a: Column) -> Column:
        same = F.array_join(F.transform(a["words"], lambda w, i: F.when(F.get("words", a["shift"] + i) == w, F.lit("1")).otherwise(F.lit("0"))), "")
        starts = F.filter(F.sequence(F.lit(0), F.size(a["words"]) - a["width"]), lambda i: F.substring(same, i + 1, a["width"]) == F.repeat(F.lit("1"), a["width"]))
        return F.transform(starts, lambda i: F.struct(a["item_id"].alias("item_id"), (a["shift"] + i).alias("start"), a["width"].alias("width")))

    rows = rows.select("doc_id", "text", *keep, F.size("words").alias("n_words"), F.flatten(F.transform("found", occurrences)).alias("matches"))
    covered = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["width"] - 1))))
    return rows.withColumn("hits", covered)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document lie in windows of benchmark items, and of which."""
    found = find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"), ids.alias("ids")).select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS width FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, width, array_to_string(w[s:s + width - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS s FROM i)),
dw AS (SELECT doc_id, s, width, array_to_string(w[s:s + width - 1], ' ') AS phrase
  FROM (SELECT d.doc_id, d.w, l.width, unnest(range(1, len(d.w) - l.width + 2)) AS s FROM d, (SELECT DISTINCT width FROM i) l WHERE len(d.w) >= l.width)),
m AS (SELECT dw.doc_id, dw.s, dw.width, iw.item_id FROM dw JOIN iw USING (width, phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
