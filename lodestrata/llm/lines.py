"""Line deduplication by a segment-partition edit join.

Two lines are alike if they are equal, or if at most t edits of bytes turn one into the other, t = min(max_edits, bytes of the
shorter // per_edit); lines of less than ``min_bytes`` bytes are alike only if equal.  Blank lines (no byte but ASCII white space)
are left alone.  Classes are the components of alike lines; of each class the first line (smallest doc_id, then text, then
place) stays.

1. Equal lines are one node, by a 128-bit hash.
2. A line is split into t + 1 segments: at most t edits leave one of them as it is.  Segments are indexed by
   (length, number, hash); a line probes, for each length that it may have a partner of, the substrings at the
   places that few enough edits on both sides can shift a segment to.  A task sends the keys of a line that it has just met
   only once, so that a line that stands everywhere costs a row a task.  Index and probes meet in one shuffle.
3. In each list of one key the first node is the hub of the others; pairs that pass a bound on the difference
   of their byte counts are verified by a banded bit-parallel edit distance, and give components.
4. Lists that still hold several components are completed across components.  t edits change the counts of at most 2 t byte
   values, so that of 2 t + 1 groups of byte values one is counted alike in both lines: only members of a list that share such a
   group's counts are compared, and only pairs that are near as characters leave the join; that is asked of those alone whose pairs of neighbouring bytes allow it.  A list of m lines, alike or not, so costs about m comparisons, not the square, and no link that
   joins components is lost.

Texts are read again for few lines only: those whose hash passes a sketch of fixed size (common.sketch).

Defined cases: null texts have no lines; rows with equal doc_id and text are the same document; null doc_ids come
first; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, U, _powers, chunks, mix
from .common import Seen, components, discard, in_sketch, materialize, may_hold, sketch, small_batches, unused
from .edits import within

MAX_EDITS, PER_EDIT, MIN_BYTES = 2, 20, 20
_VALUES = np.random.default_rng(77003).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * U(2) + U(1)
#: Bytes are counted in 14 classes, seven to a number, each in its own eight bits.
LANES = 7
_CLASS = np.random.default_rng(5501).integers(0, 2 * LANES, 256)
_UNITS = np.stack([np.where(_CLASS // LANES == half, U(1) << (U(8) * (_CLASS % LANES).astype(np.uint64)), U(0)) for half in range(2)], axis=1)
_MASK = U((1 << 8 * LANES) - 1)
_BIAS = sum(128 << 8 * k for k in range(LANES))
#: Pairs of neighbouring bytes fall into 256 classes; a line has a bit for each: whether it has an odd number of them.
_PAIRS = np.random.default_rng(40127).integers(0, 256, 1 << 16).astype(np.uint8)
ODD = ("o1", "o2", "o3", "o4")


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows, numbers) of all lines of many texts; a text without bytes has none."""
    rows = np.flatnonzero(offsets[1:] > offsets[:-1])
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([offsets[:-1][rows], breaks + 1])
    ends = np.concatenate([offsets[1:][rows], breaks])
    of = np.concatenate([rows, np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    ends = np.sort(ends)
    return starts, ends, of, np.arange(len(of)) - np.searchsorted(of, of)


def edits_allowed(n: np.ndarray, max_edits: int, per_edit: int) -> np.ndarray:
    return np.minimum(max_edits, n // per_edit)


class _Hashes:
    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some lines, one after another, and where each starts and ends in them."""
    size = ends - starts
    last = np.cumsum(size)
    return data[np.arange(int(size.sum())) + np.repeat(starts - (last - size), size)], last - size, last


def _not_blank(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which lines have a byte that isn't ASCII white space; most have one at their start."""
    own = ends > starts
    own[own] = NOT_SPACE[data[starts[own]]]
    rest = np.flatnonzero(~own & (ends > starts))
    if len(rest):
        packed, first, _ = _packed(data, starts[rest], ends[rest])
        own[rest] = np.logical_or.reduceat(NOT_SPACE[packed], first)
    return own


def _lines(wanted=None):
    """Of every line that isn't blank: id, t, place, h1, h2, n; with ``wanted`` of those only whose h1 it may hold, without n."""
    names = ["id", "t", "place", "h1", "h2"] + ["n"] * (wanted is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(2)):
                starts, ends, rows, numbers = split_lines(data, offsets)
                first = _Hashes(data, 0).of(starts, ends)
                # What meets a wanted hash is joined with both hashes of lines that aren't blank.
                own = _not_blank(data, starts, ends) if wanted is None else may_hold(wanted.value, first)
                starts, ends, rows, numbers, first = starts[own], ends[own], rows[own], numbers[own], first[own]
                take = pa.array(row + rows)
                arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers.astype(np.int32)), pa.array(first.view(np.int64))]
                if wanted is None:
                    arrays += [pa.array(_Hashes(data, 1).of(starts, ends).view(np.int64)), pa.array((ends - starts).astype(np.int32))]
                else:
                    packed, starts, ends = _packed(data, starts, ends)
                    arrays.append(pa.array(_Hashes(packed, 1).of(starts, ends).view(np.int64)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _keys(max_edits: int, per_edit: int, min_bytes: int):
    schema = pa.schema([("key", pa.int64()), ("line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                starts, ends, _, _ = split_lines(data, offsets)
                long = ends - starts >= min_bytes
                starts, ends = starts[long], ends[long]
                h = _Hashes(data, 0)
                line = h.of(starts, ends)
                line, keep = np.unique(line, return_index=True)
                fresh = seen.new(line)
                line, keep = line[fresh], keep[fresh]
                starts, n = starts[keep], (ends - starts)[keep]
                line &= ~U(1)
                keys, lines = [], []
                for less in range(max_edits + 1):
                    size = n - less  # of the indexed line
                    allowed = edits_allowed(size, max_edits, per_edit)
                    for t in range(less, max_edits + 1):
                        own = np.flatnonzero((allowed == t) & (size >= min_bytes))
                        if not len(own):
                            continue
                        base, more = size[own] // (t + 1), size[own] % (t + 1)
                        begin = np.zeros(len(own), dtype=np.int64)
                        for i in range(t + 1):
                            width = base + (i >= t + 1 - more)
                            for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                                # Of two lines of one length each probes the other: up to two edits shift by 0 or 1, and one of both sees it as 1.
                                if less == 0 and shift < 0 and t <= 2:
                                    continue
                                flag = U(less == 0 and shift == 0)
                                at = begin + shift
                                ok = (at >= 0) & (at + width <= n[own])
                                s = starts[own][ok] + at[ok]
                                tag = size[own][ok].astype(np.uint64) * U(64) + U(i)
                                keys.append(mix(h.of(s, s + width[ok]) + mix(tag + U(1))))
                                lines.append(line[own][ok] | flag)
                            begin = begin + width
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(lines).view(np.int64))], schema=schema)

    return run


def _odd(line: np.ndarray) -> np.ndarray:
    """Of each class of pairs of neighbouring bytes, whether the line has an odd number of them."""
    pairs = _PAIRS[(line[:-1].astype(np.uint16) << 8) | line[1:]]
    return (np.bincount(pairs, minlength=256) & 1).astype(bool)


def _texts(min_bytes: int, groups: int, wanted):
    """(h1, h2, c1, c2, line, parts, ODD) of the lines that may be wanted; c1, c2: its byte counts by class; parts: a hash for each group of byte values of how often each stands in the line."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("line", pa.binary()), ("parts", pa.list_(pa.int64())), *((c, pa.int64()) for c in ODD)])
    group = np.random.default_rng(9029).permutation(256) % groups
    weight = np.zeros((256, groups), dtype=np.uint64)
    weight[np.arange(256), group] = mix(np.arange(1, 257, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                starts, ends, _, _ = split_lines(data, offsets)
                long = ends - starts >= min_bytes
                starts, ends = starts[long], ends[long]
                h, keep = np.unique(_Hashes(data, 0).of(starts, ends), return_index=True)
                own = may_hold(wanted.value, h)
                h, keep = h[own], keep[own]
                fresh = seen.new(h)
                h, starts, ends = h[fresh], starts[keep[fresh]], ends[keep[fresh]]
                if not len(h):
                    continue
                lines = [data[a:b] for a, b in zip(starts, ends)]
                held = np.array([np.bincount(x, minlength=256).astype(np.uint64) for x in lines])
                # Carries between the classes don't matter: differences of two lines' sums have none.
                classes = ((held @ _UNITS) & _MASK).view(np.int64)
                parts = held @ weight
                parts = mix(parts + mix(np.arange(1, groups + 1, dtype=np.uint64))).view(np.int64)
                odd = np.packbits(np.array([_odd(x) for x in lines]), axis=1).view(np.int64)
                cuts = pa.array(np.arange(0, groups * len(h) + 1, groups).astype(np.int32))
                packed, starts, ends = _packed(data, starts, ends)
                second = _Hashes(packed, 1).of(starts, ends)
                arrays = [pa.array(h.view(np.int64)), pa.array(second.view(np.int64)), *(pa.array(np.ascontiguousarray(classes[:, k])) for k in range(2)), pa.array([x.tobytes() for x in lines], pa.binary())]
                arrays += [pa.ListArray.from_arrays(cuts, pa.array(parts.ravel())), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(len(ODD)))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _verify(max_edits: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [within(x, y, min(max_edits, min(len(x), len(y)) // per_edit)) for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, n, gone = [], [], []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = text.split("\n") if text else []
            drop = sorted(drop or ())
            if drop:
                without = set(drop)
                text = "\n".join(x for k, x in enumerate(own) if k not in without)
            out.append(text)
            n.append(len(own))
            gone.append(drop)
        arrays = [batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.list_(pa.int32()))]
        names = ["id", "text", "n_lines", "removed", *batch.schema.names[3:]]
        yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[3:]], names=names)


def _close(a: str, b: str, max_edits: int) -> str:
    """SQL for a bound: t edits change the counts of byte classes by 2 t at most.

    The difference of two sums has the classes' differences as its digits, from -128 to 127, if they are small.
    """
    digits = [f"abs((shiftright({a}.{c} - {b}.{c} + {_BIAS}L, {8 * k}) & 255) - 128)" for c in ("c1", "c2") for k in range(LANES)]
    return f"abs({a}.n - {b}.n) <= {max_edits} and ({' + '.join(digits)}) <= {2 * max_edits}"


def _paired(a: str, b: str, max_edits: int) -> str:
    """SQL for a bound: an edit replaces two pairs of neighbouring bytes by two others at most."""
    return f"{' + '.join(f'bit_count({a}.{c} ^ {b}.{c})' for c in ODD)} <= {4 * max_edits}"


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, per_edit: int = PER_EDIT, min_bytes: int = MIN_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> doc_id, text without the lines that are alike an earlier one, n_lines (before), removed (places), and the columns ``keep``.

    A column of ``keep`` may have any name but those of the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    kept_too = unused("kept_too", docs)
    rest = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text.isNull(), text).alias("t"), text.alias("text"), rest.alias(kept_too))
    docs = whole.select("id", "t", "text")
    columns = "id long, t long, place int, h1 long, h2 long"
    place = F.struct("id", "t", "place")
    lines = docs.mapInArrow(_lines(), columns + ", n int")
    nodes = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("n").alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "line-nodes")

    keys = docs.select("text").mapInArrow(_keys(max_edits, per_edit, min_bytes), "key long, line long")
    same, line = Window.partitionBy("key"), F.shiftright("line", 1)
    lists = keys.withColumns({"low": F.min(line).over(same), "high": F.max(line).over(same), "indexed": F.max(F.col("line").bitwiseAND(1)).over(same)})
    lists = materialize(lists.where("low < high and indexed = 1").select("key", line.alias("line"), F.col("line").bitwiseAND(1).alias("index")).distinct(), "line-lists")
    found = nodes.where(F.col("n") >= min_bytes).withColumn("line", F.shiftright("h1", 1)).join(lists.select("line").distinct(), "line")
    found = materialize(found.select("line", "node", "h1", "h2", "first", "n"), "line-candidates")
    wanted = spark.sparkContext.broadcast(sketch(found.select("h1")))
    texts = docs.select("text").mapInArrow(_texts(min_bytes, 2 * max_edits + 1, wanted), "h1 long, h2 long, c1 long, c2 long, line binary, parts array<long>, " + ", ".join(f"{c} long" for c in ODD))
    texts = materialize(texts.join(found.select("h1", "h2", "node"), ["h1", "h2"]).dropDuplicates(["node"]).select("node", "c1", "c2", "line", "parts", *ODD), "line-texts")
    joined = lists.join(found.select("line", "node", "n"), "line").join(texts.select("node", "c1", "c2"), "node").groupBy("key", "node", "n", "c1", "c2").agg(F.max("index").alias("index"))
    raw, lists = lists, materialize(joined, "line-lists")
    discard(raw)

    hubs = lists.groupBy("key").agg(F.min(F.struct("node", "n", "c1", "c2")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    star = lists.alias("x").join(hubs.select("key", "hub.*").alias("y"), "key").where("x.node <> y.node").where(_close("x", "y", max_edits))
    star = materialize(star.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct(), "line-star")
    verify = _verify(max_edits, per_edit)
    near = _verified(texts, star, verify)
    label = components(near)
    own = lists.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high and size > 2")
    own = own.join(mixed.select("key"), "key").join(texts.drop("c1", "c2").withColumn("line", F.col("line").cast("string")), "node")
    own = own.select("key", "node", "n", "c1", "c2", "index", "component", "line", *ODD, F.posexplode("parts").alias("group", "counts"))
    own = materialize(own.withColumn("key", F.xxhash64("key", "group", "counts")), "line-mixed")
    rest = own.alias("x").join(own.alias("y"), "key").where("x.node < y.node and x.component <> y.component and (x.index = 1 or y.index = 1)").where(_close("x", "y", max_edits)).where(_paired("x", "y", max_edits))
    # An edit of a byte edits one character at most: pairs that are too far apart as characters never leave the join.
    rest = rest.where(F.levenshtein("x.line", "y.line", max_edits) >= 0)
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    rest = materialize(rest, "line-rest")
    more = _verified(texts, rest, verify)
    discard(own, lists, texts, star, rest)
    label = materialize(components(near.unionByName(more)).withColumnRenamed("id", "node"), "line-labels")
    discard(near, more)

    linked = found.select("node", "h1", "h2", "first").join(label, "node")
    kept = linked.groupBy("component").agg(F.min("first").alias("kept"))
    linked = materialize(linked.join(kept, "component").select("h1", "h2", "kept"), "line-linked")
    again = nodes.where("first <> last").select("h1", "h2", F.col("first").alias("kept")).join(linked, ["h1", "h2"], "left_anti")
    named = materialize(again.unionByName(linked), "line-kept")
    wanted = spark.sparkContext.broadcast(sketch(named.select("h1")))
    gone = docs.mapInArrow(_lines(wanted), columns).join(named, ["h1", "h2"]).where(~place.eqNullSafe(F.col("kept")))
    gone = materialize(gone.groupBy("id", "t").agg(F.collect_set("place").alias("gone")), "line-gone")
    discard(nodes, found, label, linked, named)

    touched = in_sketch(spark, sketch(gone.select("t")))(F.col("t"))
    done = whole.where(touched).alias("d").join(gone.hint("merge").alias("g"), F.expr("d.id <=> g.id and d.t = g.t"), "left").select("d.id", "d.text", "g.gone", f"d.{kept_too}")
    done = done.mapInArrow(_rebuild, f"id long, text string, n_lines long, removed array<int>, {kept_too} {whole.schema[kept_too].dataType.simpleString()}")
    n_lines = F.when(F.col("text") != "", F.length("text") - F.length(F.translate("text", "\n", "")) + 1).otherwise(0).cast("long")
    same = whole.where(~touched).select("id", "text", F.coalesce(n_lines, F.lit(0).cast("long")).alias("n_lines"), F.array().cast("array<int>").alias("removed"), kept_too)
    return done.unionByName(same).select(F.col("id").alias("doc_id"), "text", "n_lines", "removed", *[F.col(kept_too)[c].alias(c) for c in keep])


def _verified(texts: DataFrame, pairs: DataFrame, verify) -> DataFrame:
    """The pairs (a, b) of nodes whose lines are alike."""
    a, b = texts.select(F.col("node").alias("a"), F.col("line").alias("x")), texts.select(F.col("node").alias("b"), F.col("line").alias("y"))
    return materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "line-links")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: lines, how many and which are removed, length and digest of what stays."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP3_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents WHERE text <> ''
), u AS (SELECT s, strlen(s) AS n, row_number() OVER (ORDER BY min(doc_id), s) AS k FROM l WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY s),
v AS (SELECT * FROM u WHERE n >= {MIN_BYTES}),
e AS (
  SELECT a.k AS a, b.k AS b FROM (SELECT *, unnest(range(n - {MAX_EDITS}, n + {MAX_EDITS + 1})) AS m FROM v) a JOIN v b ON b.n = a.m AND a.k <> b.k
  WHERE levenshtein(a.s, b.s) <= least({MAX_EDITS}, least(a.n, b.n) // {PER_EDIT})
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT u.s, least(u.k, coalesce(m.b, u.k)) AS c FROM u LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = u.k),
o AS (SELECT l.*, c.c IS NOT NULL AND row_number() OVER (PARTITION BY c.c ORDER BY doc_id, p) > 1 AS gone FROM l LEFT JOIN c USING (s)),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(p::VARCHAR, ',' ORDER BY p) FILTER (WHERE gone), '') AS removed,
    coalesce(string_agg(s, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM o GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
  length(coalesce(kept, ''))::BIGINT AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""
