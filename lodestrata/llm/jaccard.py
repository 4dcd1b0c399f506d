"""Exact Jaccard self-join of shingle sets by a grouped prefix join, and its components.

1. Documents with equal sets are one node (by size and a 128-bit fingerprint).
2. Shingles are ordered from rare to frequent by a counting sketch over all documents (a table of fixed
   size; any one order gives the same links, a good one gives short lists).  Two sets whose similarity
   reaches the threshold share one of the first ``n - ceil(t n) + 1`` shingles of each: their prefixes.
3. Nodes with one size and one prefix (by a 128-bit fingerprint) are a group; groups that share a prefix shingle are candidates,
   filtered by size and by the places of the shingle in both.
4. In each list of groups the one with the earliest place is the hub; hub and other are verified, and a group's
   first member with its others.  The links give components.
5. Lists that still hold several components are completed: their members are paired across components only, and
   verified.  Pairs inside a component need no check, so that a group of copies costs its size, not its square.
6. In a list of over ``SHORT`` members (a phrase that many documents have and nothing else) members are paired by parts: a set is
   dealt into k + 1 parts by hash, where k is the largest symmetric difference that the threshold allows at its size, so
   that two sets that reach it have a part in common.  Such a list costs the size of its sets, not the square of its length.
7. Before a pair is verified, the parities of 512 counters of both sets are compared: they differ in at most as many
   places as the sets do.  Pairs that can't reach the threshold by that bound are never written.

All links between different sets that could join two components are verified exactly on whole sets.
Texts are read again, and shuffled, only where the document's id passes a sketch of fixed size (common.sketch).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import U, mix, sets
from .common import components, discard, gathered, in_sketch, materialize, may_hold, sketch, small_batches, tidy, unused

#: Counters of the sketch and the rows they are sent in; 4 MB whatever the input.
COUNTERS, BLOCKS = 1 << 20, 64
#: Members up to which a list's members are compared one by one; parities of a set, in numbers of 64.
SHORT, SIGNS = 64, 8


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            held = []
            for _, own in sets(batch.column(0), size):
                held.append(own)
            if held:
                total += np.bincount((np.concatenate(held) % U(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(total, BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    return run


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"], batch["counts"]):
            own = np.frombuffer(zlib.decompress(counts), dtype=np.uint32).astype(np.uint64)
            total[block] = total[block] + own if block in total else own
    if total:
        # Order is all that matters: counts are kept as 32-bit numbers, the largest alike.
        small = [zlib.compress(np.minimum(v, U(0xFFFFFFFF)).astype(np.uint32).tobytes(), 1) for v in total.values()]
        yield pd.DataFrame({"block": list(total), "counts": small})


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' shingles fall on each of COUNTERS counters."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(tidy(_count(size)), "block int, counts binary")
    summed = parts.repartition(BLOCKS, "block").mapInPandas(_add, "block int, counts binary")
    total = np.zeros(COUNTERS, dtype=np.uint32)
    for row in gathered(summed):  # BLOCKS rows, 4 MB
        step = COUNTERS // BLOCKS
        total[row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(zlib.decompress(bytes(row["counts"])), dtype=np.uint32)
    return total


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of a set's elements, mixed in two ways."""
    a = mix(own + U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = mix(own * U(0xD1342543DE82EF95) + U(1)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's elements falls on each of 64 * SIGNS counters, as SIGNS numbers."""
    at = (mix(own ^ U(0x632BE59BD9B4E019)) >> U(20)).astype(np.int64) % (64 * SIGNS)
    return np.packbits(np.bincount(at, minlength=64 * SIGNS) & 1).view(np.int64)


def _prefixes(size: int, percent: int, counts):
    fields = [("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64())]
    schema = pa.schema([*fields, ("p1", pa.int64()), ("p2", pa.int64()), ("sign", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            n, f1, f2, p1, p2, sign, prefix = [], [], [], [], [], [], []
            for _, own in sets(batch.column(2), size):
                keep = len(own) - (percent * len(own) + 99) // 100 + 1 if len(own) else 0
                rank = np.lexsort((own, order[(own % U(COUNTERS)).astype(np.int64)]))
                a, b = fingerprint(own)
                n.append(len(own))
                f1.append(a)
                f2.append(b)
                sign.append(parities(own))
                first = own[rank[:keep]]
                a, b = fingerprint(first)
                p1.append(a)
                p2.append(b)
                prefix.append(_as_long(first))
            arrays = [pa.array(v, f.type) for v, f in zip((n, f1, f2, p1, p2, sign, prefix), list(schema)[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], schema=schema)

    return run


def _places(bits, but=None):
    """The places of shingles that ``bits`` may hold; with ``but``, of rows only whose hash, a fifth column, it doesn't hold."""
    schema = pa.schema([("shingle", pa.int64()), ("hub", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("members", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if but is not None:
                batch = batch.filter(pa.array(~may_hold(but.value, batch.column(4).to_numpy())))
            prefix = batch.column(3)
            shingle = prefix.flatten().to_numpy()
            size = prefix.value_lengths().to_numpy()
            of, at = np.repeat(np.arange(len(size)), size), np.arange(len(shingle)) - np.repeat(np.cumsum(size) - size, size)
            kept = np.flatnonzero(may_hold(bits.value, shingle))
            of = pa.array(of[kept])
            yield pa.RecordBatch.from_arrays([pa.array(shingle[kept]), batch.column(0).take(of), batch.column(1).take(of), pa.array(at[kept].astype(np.int32)), batch.column(2).take(of)], schema=schema)

    return run


def size_class(n: int, percent: int) -> int:
    """Sizes of one class are at most 100 / percent apart, so that a partner's class is the same or a neighbour."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9)) if percent < 100 else n


def parts_of(own: np.ndarray, kind: int, percent: int) -> np.ndarray:
    """Hashes of the parts of a set among sets whose larger is of class ``kind``: two that reach the threshold share one."""
    largest = int(np.floor((100 / percent) ** (kind + 1) * (1 + 1e-6))) + 1 if percent < 100 else kind
    count = (100 - percent) * 2 * largest // (100 + percent) + 1
    total = np.zeros(count, dtype=np.uint64)
    np.add.at(total, (mix(own + U(0xA0761D6478BD642F)) % U(count)).astype(np.int64), mix(own ^ U(0xE7037ED1A0B428DB)))
    return mix(total + mix(np.arange(count, dtype=np.uint64) + np.array([kind + 2], dtype=np.uint64) * U(0x8EBC6AF09C88C6E3)))


def _parts(percent: int):
    schema = pa.schema([("node", pa.int64()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = own.values.to_numpy().view(np.uint64)
                kind = size_class(len(own), percent)
                found = np.concatenate([parts_of(own, k, percent) for k in (kind, kind + 1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(_as_long(found))], schema=schema)

    return run


def _whole_sets(size: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("node", "f1", "f2")}
            node, found = [], []
            for i, own in sets(batch.column("text"), size):
                # An id may have several texts, and rows with equal id and text are often in one task.
                if cols["node"][i] not in seen and fingerprint(own) == (cols["f1"][i], cols["f2"][i]):
                    seen.add(cols["node"][i])
                    node.append(cols["node"][i])
                    found.append(_as_long(own))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return run


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n, f1, f2) of every row (t: a hash of its text) and (n, f1, f2, class, component_id) of every set that isn't empty."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text.isNull(), text).alias("t"), text.alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(docs, size))
    schema = "doc_id long, t long, n int, f1 long, f2 long, p1 long, p2 long, sign array<long>, prefix array<long>"
    rows = materialize(docs.mapInArrow(tidy(_prefixes(size, percent, counts)), schema).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    # Prefixes are most of what is written: they stay in this one table.  A set is named by one of its rows, a group by one of its sets.
    key = ["n", "f1", "f2"]
    own_rows = materialize(rows.select("doc_id", "t", *key), "rows")
    some = rows.where("n > 0")
    nodes = some.groupBy(*key).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("p1", "p2", "sign")])
    nodes = materialize(nodes, "nodes")
    groups = materialize(nodes.groupBy("n", "p1", "p2").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")), "groups")
    many = groups.where("members > 1").select("n", "p1", "p2", "hub")
    members = materialize(nodes.join(many, ["n", "p1", "p2"]).select("hub", "node"), "members")
    # Most rows are the only one of their group; others, and what the sketch takes for them, are looked up.
    alone = groups.where("members = 1").select(F.col("hub").alias("row"))
    but = sketch(some.select("row").join(alone, "row", "left_anti").select(F.xxhash64("row")))
    other = in_sketch(spark, but)(F.xxhash64("row"))
    hubs = some.where(other).join(groups.select(F.col("hub").alias("row"), "members").hint("merge"), "row")
    hubs = materialize(hubs.select(F.col("row").alias("hub"), "n", "members", "prefix"), "hubs")
    discard(groups)

    # Most shingles are one set's alone: they are counted in rows of their own, and places are written for the others only.
    each = some.where(~other).select(F.lit(1).cast("long").alias("members"), "prefix").unionByName(hubs.select("members", "prefix"))
    shared = each.select("members", F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.sum("members").alias("total")).where("total > 1").select("shingle")
    shared = materialize(shared, "shared-shingles")
    bits, but = spark.sparkContext.broadcast(sketch(shared)), spark.sparkContext.broadcast(but)
    schema = "shingle long, hub long, n int, at int, members long"
    places = some.select("row", "n", F.lit(1).cast("long"), "prefix", F.xxhash64("row")).mapInArrow(tidy(_places(bits, but)), schema)
    places = materialize(places.unionByName(hubs.mapInArrow(tidy(_places(bits)), schema)), "places")
    discard(rows, hubs, shared)
    first = places.groupBy("shingle").agg(F.min(F.struct("at", "n", "hub")).alias("first"), F.sum("members").alias("total")).where("total > 1").select("shingle", "first")
    lists = materialize(places.join(first, "shingle").select("shingle", "hub", "n", "at", "members", "first"), "lists")
    discard(places)
    fits = "100 * least({a}.n, {b}.n) >= {p} * greatest({a}.n, {b}.n) and (100 + {p}) * least({a}.n - {a}.at, {b}.n - {b}.at) >= {p} * ({a}.n + {b}.n)"
    star = lists.where("hub <> first.hub").where(fits.format(a="lists", b="first", p=percent).replace("lists.", "")).select(F.col("first.hub").alias("a"), F.col("hub").alias("b"))
    star = star.unionByName(members.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    signs = nodes.select("node", "n", "sign")
    x, y = signs.toDF("a", "n", "sign").alias("x"), signs.toDF("b", "n", "sign").alias("y")
    star = materialize(star.join(x, "a").join(y, "b").where(_near("x", "y", percent)).select("a", "b"), "star")
    linked = _verified(docs, nodes, star, size, percent)

    label = components(linked)
    own = lists.select("shingle", "hub", "n", "at").join(members, "hub", "left").select("shingle", F.coalesce("node", "hub").alias("id"), "n", "at")
    own = own.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = own.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high and size > 2")
    left = materialize(own.join(mixed.select("shingle", "size"), "shingle"), "mixed-lists")
    short = left.where(F.col("size") <= SHORT).join(signs.select(F.col("node").alias("id"), "sign"), "id")
    x, y = short.alias("x"), short.alias("y")
    rest = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where("x.id < y.id and x.component <> y.component").where(fits.format(a="x", b="y", p=percent)).where(_near("x", "y", percent))
    rest = rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    long = materialize(left.where(F.col("size") > SHORT).select(F.col("id").alias("node"), "component").distinct(), "long-lists")
    whole = _sets(docs, nodes, long.select("node"), size)
    split = whole.mapInArrow(tidy(_parts(percent)), "node long, part long")
    parts = materialize(split.join(long, "node").join(signs, "node"), "parts")
    x, y = parts.alias("x"), parts.alias("y")
    far = x.join(y, F.col("x.part") == F.col("y.part")).where("x.node < y.node and x.component <> y.component")
    far = far.where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)").where(_near("x", "y", percent))
    rest = rest.unionByName(far.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).distinct().join(star, ["a", "b"], "left_anti")
    rest = materialize(rest, "rest")
    discard(whole, parts, long, left, lists, members, star)
    more = _verified(docs, nodes, rest, size, percent)
    label = materialize(components(linked.unionByName(more)).withColumnRenamed("id", "node"), "labels")
    named = nodes.select("node", "least", *key).join(label, "node", "left")
    smallest = materialize(named.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = named.join(smallest, "component", "left")
    named = materialize(named.select(*key, F.coalesce("component", "node").alias("class"), F.coalesce("component_id", "least").alias("component_id")), "classes")
    discard(rest, linked, more, nodes, label, smallest)
    return own_rows, named


def similar_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id) for every row.

    Words: runs of anything but ASCII white space, A to Z folded.  A set: distinct runs of ``size`` words; with
    fewer words, the whole as one.  Two documents link if 100 * intersection >= percent * union.  component_id: the
    smallest doc_id that links reach.  Null or blank texts have the empty set and are linked with nothing; null
    doc_ids count for no minimum (a component of such rows alone has null); repeated ids are rows of their own;
    other columns are ignored; no rows give no rows.
    """
    rows, named = _classes(docs, size, percent)
    found = rows.join(named, ["n", "f1", "f2"], "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs``, all columns, of which no earlier one is in the same component (see similar_components).

    Earlier: smaller doc_id (nulls last), then hash of the text; of rows with equal doc_id and text any one stays.  Rows
    with null or blank texts are linked with nothing and all stay.  Columns may have any names.
    """
    spark = docs.sparkSession
    rows, named = _classes(docs, size, percent)
    found = rows.where("n > 0").join(named, ["n", "f1", "f2"]).groupBy("class", "doc_id", "t").agg(F.count(F.lit(1)).alias("times"))
    found = materialize(found, "class-rows")
    discard(rows, named)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t")
    first = materialize(found.groupBy("class").agg(F.min(order).alias("first"), F.sum("times").alias("total")).where("total > 1").select("class", "first"), "class-first")
    copies = materialize(found.join(first, "class").select("doc_id", "t", "times", order.eqNullSafe(F.col("first")).alias("stays")), "copies")
    discard(found, first)
    kept, text = unused("kept", docs), F.col("text").cast("string")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text.isNull(), text).alias("t"), F.struct(*docs.columns).alias(kept))
    touched = in_sketch(spark, sketch(copies.select("t")))(F.col("t"))
    joined = whole.where(touched).alias("d").join(copies.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.t = f.t"), "left")
    once = joined.where("f.t is null or (f.stays and f.times = 1)").select(f"d.{kept}")
    again = joined.where("f.stays and f.times > 1").select("d.doc_id", "d.t", f"d.{kept}").dropDuplicates(["doc_id", "t"]).select(kept)
    return whole.where(~touched).select(kept).unionByName(once).unionByName(again).select(f"{kept}.*")


def _near(a: str, b: str, percent: int) -> str:
    """SQL for a bound: the parities of two sets differ in at most as many places as the sets do."""
    differ = " + ".join(f"bit_count({a}.sign[{k}] ^ {b}.sign[{k}])" for k in range(SIGNS))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * ({a}.n + {b}.n)"


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted nodes; a table.  Rows with equal id and text that no task sees together may give a node again."""
    wanted = materialize(nodes.join(wanted, "node").select("node", F.col("least").alias("id"), "f1", "f2"), "wanted-sets")
    held = in_sketch(docs.sparkSession, sketch(wanted.select(F.xxhash64("id"))))(F.xxhash64("doc_id"))
    texts = docs.where(held).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "f1", "f2", "text")
    found = materialize(texts.mapInArrow(tidy(_whole_sets(size)), "node long, shingles array<long>"), "sets")
    discard(wanted)
    return found


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    whole = _sets(docs, nodes, wanted, size)
    a, b = whole.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), whole.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    ok = pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    found = materialize(ok.select("a", "b").distinct(), "links")
    discard(whole)
    return found


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents: 3-word shingles, similarity 0.9."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
