"""Exact top-k search by BM25: an inverted index, searched shard by shard with thresholds.

Words are runs of letters, digits and all beyond ASCII, A to Z folded, by 64-bit hash.  A shard's index holds, for
each term, its postings (document, frequency) in document order.  Lists that hold a good part of a shard's documents
are kept as rows of a matrix: one product in single precision gives their share of every document's score for many queries
at once.  All postings of the other lists are added, so that every document has a score with a known bound of its error.
Where that score, with the error added, can't reach a query's k-th best so far the document is left; the others are
scored again in double precision.  The k-th best is carried from shard to shard of a task, and begins with that of
the shards that are searched first, of every ``SEED`` about one.

Scores use counts of the whole corpus (documents, their mean length, document frequencies), so that the best of
the shards' best are the best of all.  Ranks: score rounded to 6 places, then doc_id (nulls last).

Queries come in blocks of bounded size, each broadcast and run against all shards without a shuffle.

Defined cases: a null text has no words and is found by nothing, as a query it finds nothing; rows with
equal ids are documents, or queries, of their own; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import ALNUM, chunks, hashes, spans
from .common import gathered, materialize, records_a_batch, small_batches

K1, B = 1.2, 0.75
SHARD_DOCS = 2048
#: Terms of all queries of one block: 12 bytes each are broadcast.
BLOCK_TERMS = 2_000_000
#: Queries are searched by groups of like vocabulary: so many groups, told by so many of the commonest terms, learnt from so many queries.
GROUPS, COMMON, LEARN = 8, 128, 4096
MARGIN = 1e-5
#: A list with more than this share of a shard's documents is kept as a matrix row; queries that are multiplied at a time; the cost of a cell
#: of a product in postings: a row that has less of them, times the queries that ask for it, isn't multiplied.
DENSE, BATCH, PRODUCT = 1 / 32, 512, 2e-3
#: Terms of the queries that are multiplied at a time, one query at least, and postings that are summed at a time.
BATCH_TERMS, POSTINGS = 200_000, 1 << 16
#: One shard of so many is searched first; the others only for what reaches its k-th best.
SEED = 32

_SHARD = pa.schema([("seed", pa.bool_()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary())])


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, dtype=kind).tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), dtype=kind)


def _shard(ids: list, sizes: list[int], docs: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
    doc, word = np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(words or [np.zeros(0, np.uint64)])
    order = np.argsort(word, kind="stable")  # documents ascend already
    doc, word = doc[order], word[order]
    new = np.ones(len(word), dtype=bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(word)))
    terms, counts = np.unique(word[at], return_counts=True)
    packed = _pack(terms, "<u8")
    columns = [[zlib.crc32(packed) % SEED == 0], [ids], [sizes], [packed], [_pack(counts, "<u4")], [_pack(doc[at], "<u2")], [_pack(tf, "<u4")]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARD)], schema=_SHARD)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sizes, docs, words, held = [], [], [], [], 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for row, data, offsets in chunks(batch.column(1)):
            starts, ends, rows = spans(data, offsets, ALNUM)
            h, n = hashes(data, starts, ends), len(offsets) - 1
            size = np.bincount(rows, minlength=n)
            at = 0
            while at < n:
                take = min(n - at, SHARD_DOCS - len(ids))
                lo, hi = np.searchsorted(rows, (at, at + take))
                docs.append(rows[lo:hi] - at + len(ids))
                words.append(h[lo:hi])
                ids += names[row + at : row + at + take]
                sizes += size[at : at + take].tolist()
                held, at = held + hi - lo, at + take
                if len(ids) == SHARD_DOCS or held > 4_000_000:
                    yield _shard(ids, sizes, docs, words)
                    ids, sizes, docs, words, held = [], [], [], [], 0
    if ids:
        yield _shard(ids, sizes, docs, words)


def build_index(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the index: a row for each shard of at most SHARD_DOCS documents; written once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_build, "seed boolean, ids array<long>, sizes array<int>, terms binary, counts binary, docs binary, tfs binary"), "search-index")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(_unpack(terms, "<i8")), pa.array(_unpack(counts, "<u4").astype(np.int64))], names=["term", "n"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = []
        for _, data, offsets in chunks(batch.column(1)):
            starts, ends, rows = spans(data, offsets, ALNUM)
            h = hashes(data, starts, ends)
            cuts = np.searchsorted(rows, np.arange(len(offsets)))
            terms += [np.unique(h[a:b]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["query", "terms"])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    size = ends - starts
    before = np.cumsum(size) - size
    at = np.repeat(starts - before, size)
    at += np.arange(len(at))
    return at


def _runs(sizes: np.ndarray, most: int, rows: int = 1 << 62) -> Iterator[slice]:
    """Runs of rows whose sizes sum up to ``most`` at most, or of one row; of ``rows`` rows at most."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = min(max(first + 1, int(np.searchsorted(ends, before + most, side="right"))), first + rows)
        yield slice(first, last)
        first = last


class Shard:
    """A shard's postings of those terms that a block of queries has: frequent terms as a matrix, the others as lists."""

    def __init__(self, row: dict, wanted: np.ndarray, mean_size: float):
        sizes = np.array(row["sizes"], dtype=np.float64)
        self.ids = np.array([2**63 - 1 if i is None else i for i in row["ids"]], dtype=np.int64)
        self.null = np.array([i is None for i in row["ids"]], dtype=bool)
        terms, counts = _unpack(row["terms"], "<u8"), _unpack(row["counts"], "<u4").astype(np.int64)
        docs, tfs = _unpack(row["docs"], "<u2"), _unpack(row["tfs"], "<u4")
        starts = np.cumsum(counts) - counts
        place = np.searchsorted(terms, wanted)
        place[place == len(terms)] = 0
        has = terms[place] == wanted if len(terms) else np.zeros(len(wanted), dtype=bool)
        has = np.flatnonzero(has)
        has = has[np.argsort(-counts[place[has]], kind="stable")]
        order = place[has]
        # The number of a wanted term among the lists, the longest first; -1: not there.
        self.number = np.full(len(wanted), -1, dtype=np.int32)
        self.number[has] = np.arange(len(has))
        self.size = counts[order]
        self.start = np.cumsum(self.size) - self.size
        at = _ranges(starts[order], starts[order] + self.size)
        self.docs, tf = docs[at].astype(np.int32), tfs[at].astype(np.float64)
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.docs] / mean_size)) if len(at) else np.zeros(0)
        rows = int(np.searchsorted(-self.size, -DENSE * len(self.ids)))
        own = slice(0, int(self.size[:rows].sum()))
        self.parts = np.zeros((len(self.ids), rows))
        self.parts[self.docs[own], np.repeat(np.arange(rows), self.size[:rows])] = self.part[own]
        self.rough = np.ascontiguousarray(self.parts.T, dtype=np.float32)

    def scores(self, n: int, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ``n`` queries, given as (owner, term, weight) by owner, and every document: the score in single precision, and what of it isn't from
        the product; the rows of the product by term, -1: none."""
        number = self.number[terms]
        rows, has = len(self.rough), np.flatnonzero(number >= 0)
        asked = np.bincount(number[has], minlength=rows)[:rows]
        used = np.append(asked * self.size[:rows] > n * len(self.ids) * PRODUCT, np.zeros(len(self.size) - rows, dtype=bool))
        inside, outside = has[used[number[has]]], has[~used[number[has]]]
        row = np.full(len(terms), -1)
        row[inside] = number[inside]
        used = np.flatnonzero(used)
        column = np.zeros(rows, dtype=np.int64)
        column[used] = np.arange(len(used))
        w = np.zeros((n, len(used)), dtype=np.float32)
        w[owner[inside], column[number[inside]]] = weights[inside]
        rough = w @ (self.rough[used] if len(used) < rows else self.rough)
        number, owner, weights = number[outside], owner[outside], weights[outside]
        size, rest = self.size[number], np.empty(rough.shape)
        lo, cuts = self.start[number], np.searchsorted(owner, np.arange(n + 1))
        for some in _runs(np.diff(np.append(0, np.cumsum(size))[cuts]), POSTINGS):  # few enough to stay in the processor's cache
            own, width = slice(cuts[some.start], cuts[some.stop]), (some.stop - some.start) * len(self.ids)
            at = _ranges(lo[own], lo[own] + size[own])
            cell, part = np.repeat((owner[own] - some.start) * len(self.ids), size[own]), np.repeat(weights[own], size[own])
            cell += self.docs.take(at)
            part *= self.part.take(at)
            rest[some] = np.bincount(cell, weights=part, minlength=width).reshape(-1, len(self.ids))
            rough[some] += rest[some]
        return rough, rest, row

    def exact(self, cuts: np.ndarray, row: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The scores of (owner, document) pairs in double precision; the terms of query q are those from cuts[q] to cuts[q + 1]."""
        often = row >= 0
        cuts = np.append(0, np.cumsum(often))[cuts]
        row, weights = row[often], weights[often]
        scores, size = rest[owner, docs], cuts[owner + 1] - cuts[owner]
        for own in _runs(size, POSTINGS):
            at = _ranges(cuts[owner[own]], cuts[owner[own] + 1])
            pair = np.repeat(np.arange(own.stop - own.start), size[own])
            scores[own] += np.bincount(pair, weights=self.parts[docs[own][pair], row[at]] * weights[at], minlength=own.stop - own.start)
        return scores


class Best:
    """The k best documents so far of each of some queries, and the least score that may still be one of them."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.score = np.full((len(least), k), -1.0)  # -1: none
        self.null, self.ids = np.zeros(self.score.shape, dtype=bool), np.zeros(self.score.shape, dtype=np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """``query`` ascends."""
        some = query[np.append(True, query[1:] != query[:-1])] if len(query) else query
        old = self.score[some] >= 0
        query, score = np.append(np.repeat(some, old.sum(axis=1)), query), np.append(self.score[some][old], score)
        null, ids = np.append(self.null[some][old], null), np.append(self.ids[some][old], ids)
        order = np.lexsort((ids, null, -score, query))
        sorted_query = query[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.score[some] = -1
        at = query[order], rank
        self.score[at], self.null[at], self.ids[at] = score[order], null[order], ids[order]
        self.least[some] = np.maximum(self.least[some], self.score[some, -1])


def _candidates(rough: np.ndarray, least: np.ndarray, error: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, document) of all scores that may be among the k best and reach ``least``; single precision differs from the score by that relative ``error`` at most."""
    floor = lambda least, error: np.maximum((least - MARGIN) * (1 - error), np.finfo(np.float32).tiny).astype(np.float32)
    reach = floor(least, error)
    hit = rough >= reach[:, None]
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * k)
    if len(many):  # no score is known yet, or a low one: only what may be among the shard's own k best
        own = np.partition(rough[many], rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        hit[many] = rough[many] >= np.maximum(reach[many], floor(own * (1 - error[many]), error[many]))[:, None]
    return np.divmod(np.flatnonzero(hit), rough.shape[1])


def _like(cuts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """An order of queries in which those with like vocabulary stand together, by size: a product then has fewer rows.  Results don't depend on it."""
    n, (known, first) = len(cuts) - 1, np.unique(terms, return_index=True)
    common = np.full(len(known), -1)
    common[np.argsort(weights[first], kind="stable")[:COMMON]] = np.arange(min(COMMON, len(known)))

    def has(queries: np.ndarray) -> np.ndarray:
        at = _ranges(cuts[queries], cuts[queries + 1])
        place, row = common[np.searchsorted(known, terms[at])], np.repeat(np.arange(len(queries)), cuts[queries + 1] - cuts[queries])
        x = np.zeros((len(queries), COMMON), dtype=np.float32)
        x[row[place >= 0], place[place >= 0]] = 1
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)

    some = has(np.unique(np.linspace(0, n - 1, min(n, LEARN)).astype(np.int64)))
    centers = some[np.linspace(0, len(some) - 1, GROUPS).astype(np.int64)]
    for _ in range(8):
        group = (some @ centers.T).argmax(axis=1)
        sums = np.stack([some[group == g].sum(axis=0) if (group == g).any() else centers[g] for g in range(GROUPS)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    group = np.concatenate([(has(np.arange(i, min(i + LEARN, n))) @ centers.T).argmax(axis=1) for i in range(0, n, LEARN)])
    return np.lexsort((np.diff(cuts), group))


def _search(block, least, mean_size: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, cuts, terms, weights, wanted = block.value
        best = Best(least.value, k)
        size = np.diff(cuts)
        error = (size + 8) * 2.0**-24 * 1.01  # of a sum of so many products of single precision, none of them negative
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, wanted, mean_size)
                for some in _runs(size, BATCH_TERMS, BATCH):
                    own = slice(cuts[some.start], cuts[some.stop])
                    owner = np.repeat(np.arange(some.stop - some.start), size[some])
                    rough, rest, rows = shard.scores(some.stop - some.start, owner, terms[own], weights[own])
                    query, docs = _candidates(rough, best.least[some], error[some], k)
                    if len(query):
                        scores = shard.exact(cuts[some.start : some.stop + 1] - cuts[some.start], rows, weights[own], query, docs, rest)
                        best.add(query + some.start, np.array([round(x, 6) for x in scores.tolist()]), shard.null[docs], shard.ids[docs])
        query, place = np.nonzero(best.score >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[q][0] for q in query.tolist()], pa.int64()), pa.array([names[q][1] for q in query.tolist()], pa.int64()), pa.array(best.ids[query, place], mask=best.null[query, place]), pa.array(best.score[query, place])],
            names=["number", "query_id", "doc_id", "score"],
        )

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Queries (query_id, text) against an index: query_id, rank from 1, doc_id, score, the k best of each query."""
    spark = index.sparkSession
    total = index.select(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("words")).first()
    schema = "query_id long, rank int, doc_id long, score double"
    if not total["n"] or not total["words"]:
        return spark.createDataFrame([], schema)
    asked = queries.select(F.struct(F.col("query_id").cast("long").alias("query_id"), F.monotonically_increasing_id().alias("number")).alias("query"), F.col("text").cast("string").alias("text"))
    asked = materialize(asked.mapInArrow(_query_terms, "query struct<query_id: long, number: long>, terms array<long>"), "queries")
    flat = asked.select("query", F.explode("terms").alias("term"))
    df = index.select("terms", "counts").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    idf = F.log(1 + (F.lit(float(total["n"])) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighted = flat.join(df, "term").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("t"))
    weighted = weighted.select("query", F.size("t").alias("size"), F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    weighted = materialize(weighted.withColumn("part", F.spark_partition_id()), "weighted-queries")
    sizes = weighted.groupBy("part").agg(F.sum("size").alias("size"))  # a row a partition
    sizes = sizes.withColumn("block", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / block_terms))
    numbered = weighted.join(F.broadcast(sizes.select("part", "block")), "part")
    best, found = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()), []
    for (number,) in sizes.select("block").distinct().orderBy("block").collect():
        rows = numbered.where(F.col("block") == number).select("query", "terms", "idf").orderBy("query.number").toLocalIterator()
        names, terms, weights = [], [], []
        for r in rows:
            names.append((r["query"]["number"], r["query"]["query_id"]))
            terms.append(np.array(r["terms"], dtype=np.int64).view(np.uint64))
            weights.append(np.array(r["idf"]))
        order = _like(np.cumsum([0, *map(len, terms)]), np.concatenate(terms), np.concatenate(weights)).tolist()
        names, terms, weights = [names[q] for q in order], [terms[q] for q in order], [weights[q] for q in order]
        cuts = np.cumsum([0, *map(len, terms)])
        wanted, place = np.unique(np.concatenate(terms), return_inverse=True)
        block = spark.sparkContext.broadcast((names, cuts, place.astype(np.int32), np.concatenate(weights), wanted))
        least, number_of = np.zeros(len(names)), {number: q for q, (number, _) in enumerate(names)}
        for first in (True, False):
            sent = spark.sparkContext.broadcast(least)
            with records_a_batch(spark, 1):  # a row of the index is a shard
                found.append(materialize(index.where(F.col("seed") == first).mapInArrow(_search(block, sent, total["words"] / total["n"], k), "number long, query_id long, doc_id long, score double"), "found"))
            sent.unpersist()
            if first:  # a score for each query of the block
                for r in gathered(found[-1].withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("number", "score")):
                    least[number_of[r["number"]]] = r["score"]
        block.unpersist()
    if not found:
        return spark.createDataFrame([], schema)
    merged = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "doc_id", "score")


def op5_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every document whose id is divisible by 100; its whole text is the query."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return top_k(build_index(docs), docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT doc_id, size, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS t FROM w) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
r AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.size / s.mean)) ORDER BY q.t), 6) AS score
  FROM (SELECT doc_id, t FROM p WHERE doc_id % 100 = 0) q JOIN p d USING (t) JOIN f USING (t), s GROUP BY 1, 2
)
SELECT query_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10
"""
