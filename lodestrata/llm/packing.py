"""Best-fit packing of token sequences by linear grouping.

Pieces are packed by their lengths alone, and there are at most ``capacity`` different lengths, so
the plan is made from the histogram on the driver, whatever the number of documents:

1. Large lengths, from the longest down, are split into groups of equal cardinality; each length
   counts as the longest of its group.
2. The few sizes that this leaves are packed by configurations (how many of each size a sequence
   holds): a linear program over all configurations, by column generation with a knapsack, rounded down.
3. Actual pieces take the places of their groups, so that a sequence has more room than planned.
4. What is left over (small pieces and those that the rounding left) goes best-fit, longest first,
   into the fullest sequence that has room, or else into a new one.
5. The emptiest sequences are taken apart and their pieces go best-fit once more, in rounds from a few sequences to all
   that have room; a round that needs more sequences is undone.  Where the bound (all ids by the capacity) isn't met by then, plain
   best-fit by decreasing length is improved in the same way, and the better of the two is taken.

The plan is a list of runs: pieces ``rank .. rank + count - 1`` of a length take ``offset`` in the sequences
``sequence .. sequence + count - 1``.  Its size depends on capacity and number of groups only.
Documents find their places by their rank among the pieces of their length: the tasks number
their own pieces, and sums over tasks give where each task's numbers begin.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, small_batches, tidy
from .tokens import default_tokenizer, encoder

CAPACITY = 2048


def _groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int, int]]]:
    """(length, count), longest first -> groups of equal cardinality of (length, first rank, count)."""
    total = sum(c for _, c in large)
    size = max(1, -(-total // groups))
    out, room = [[]], size
    for length, count in large:
        rank = 0
        while count:
            if not room:
                out.append([])
                room = size
            take = min(count, room)
            out[-1].append((length, rank, take))
            rank, count, room = rank + take, count - take, room - take
    return [g for g in out if g]


class _Knapsack:
    """The most valuable multiset of sizes that fits: dynamic programming by the number of items."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity, self.items = sizes, capacity, capacity // int(sizes.min())
        places = np.arange(capacity + 1)[None, :] - sizes[:, None]
        self.fits, self.places = places >= 0, np.maximum(places, 0)

    def best(self, prices: np.ndarray) -> tuple[float, np.ndarray]:
        value, picks = np.zeros(self.capacity + 1), []
        for _ in range(self.items):
            got = np.where(self.fits, value[self.places] + prices[:, None], -1.0)
            k = got.argmax(axis=0)
            most = got[k, np.arange(self.capacity + 1)]
            picks.append(np.where(most > value + 1e-12, k, -1))
            value = np.maximum(value, most)
        config, c = np.zeros(len(self.sizes), dtype=int), self.capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                config[pick[c]] += 1
                c -= int(self.sizes[pick[c]])
        return float(value[self.capacity]), config


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 1500) -> list[tuple[tuple[int, ...], float]]:
    """An optimal (or, after so many rounds, near-optimal) fractional packing: (configuration, how often)."""
    size, need = np.array(sizes), np.array(counts, dtype=float)
    columns = [np.eye(len(size), dtype=int)[i] * (capacity // s) for i, s in enumerate(size)]
    inverse = np.diag([1.0 / (capacity // s) for s in size])
    level = inverse @ need
    knapsack = _Knapsack(size, capacity)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        best, config = knapsack.best(np.maximum(prices, 0))
        if best <= 1 + 1e-7:
            break
        way = inverse @ config
        ratio = np.where(way > 1e-9, level / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
        columns[out] = config
        level = np.maximum(inverse @ need, 0)
    return [(tuple(int(n) for n in c), float(x)) for c, x in zip(columns, level) if x > 0]


class _Sequences:
    """Sequences as stacks: ``count`` sequences alike, whose i-th holds piece ``rank + i`` of each (length, rank) in ``holds``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
        self.rooms: list[int] = []

    def keep(self, room: int, count: int, holds: list[tuple[int, int]]) -> None:
        if count:
            if room not in self.by_room:
                self.by_room[room] = []
                insort(self.rooms, room)
            self.by_room[room].append((count, holds))

    def made(self) -> int:
        return sum(count for own in self.by_room.values() for count, _ in own)

    def best_fit(self, pieces: list[tuple[int, int, int]]) -> None:
        """(length, first rank, count), longest first: each into the fullest sequence that has room."""
        for length, rank, count in sorted(pieces, reverse=True):
            while count:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    self.keep(self.capacity, -(-count // (self.capacity // length)), [])
                    continue
                room = self.rooms[at]
                have, holds = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room]
                    self.rooms.pop(at)
                each = min(room // length, count)
                use = min(have, max(1, count // each))
                self.keep(room - each * length, use, holds + [(length, rank + use * k) for k in range(each)])
                rank, count = rank + use * each, count - use * each
                self.keep(room, have - use, [(n, r + use) for n, r in holds])

    def empty(self, most: int) -> list[tuple[int, int, int]]:
        """Takes the sequences with the most room apart, ``most`` at most: their pieces (length, first rank, count)."""
        out: list[tuple[int, int, int]] = []
        while self.rooms and self.rooms[-1] and most:
            room = self.rooms[-1]
            have, holds = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.pop()
            use = min(have, most)
            out += [(n, r, use) for n, r in holds]
            self.keep(room, have - use, [(n, r + use) for n, r in holds])
            most -= use
        return out

    def runs(self) -> list[tuple[int, int, int, int, int]]:
        out, first = [], 0
        for own in self.by_room.values():
            for count, holds in own:
                offset = 0
                for length, rank in holds:
                    out.append((length, rank, count, first, offset))
                    offset += length
                first += count
        return out


def _grouped(lengths: list[tuple[int, int]], capacity: int, groups: int, small: int) -> _Sequences:
    """Linear grouping: configurations of the groups' sizes, actual pieces in their places, the rest best-fit."""
    made = _Sequences(capacity)
    queues: dict[int, list[tuple[int, int, int]]] = {}  # groups whose longest are equal are one size
    for group in _groups([x for x in lengths if x[0] > small], groups):
        queues.setdefault(group[0][0], []).extend(group)
    order = list(queues)
    for config, often in configurations(order, [sum(c for *_, c in queues[s]) for s in order], capacity) if order else []:
        count = int(often + 1e-6)
        if not count:
            continue
        stacks: list[tuple[int, int, list[tuple[int, int]]]] = [(count, capacity, [])]
        for s, times in zip(order, config):
            for _ in range(times):
                after = []
                for n, room, holds in stacks:
                    while n and queues[s]:
                        length, rank, have = queues[s][0]
                        take = min(n, have)
                        after.append((take, room - length, [*holds, (length, rank)]))
                        if take == have:
                            queues[s].pop(0)
                        else:
                            queues[s][0] = (length, rank + take, have - take)
                        n, holds = n - take, [(k, r + take) for k, r in holds]
                    if n:
                        after.append((n, room, holds))
                stacks = after
        for n, room, holds in stacks:
            if holds:
                made.keep(room, n, holds)
    made.best_fit([x for s in order for x in queues[s]] + [(n, 0, c) for n, c in lengths if n <= small])
    return made


def _improved(best: _Sequences, bound: int, rounds: int) -> _Sequences:
    """Takes the emptiest sequences apart and packs their pieces again, from a few to all that have room."""
    for k in range(rounds):
        if best.made() <= bound:
            break
        again = deepcopy(best)
        again.best_fit(again.empty(max(2, best.made() >> (rounds - 1 - k))))
        if again.made() <= best.made():
            best = again
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 128, small: int | None = None, rounds: int = 12) -> list[tuple[int, int, int, int, int]]:
    """{length: count} -> runs of (length, first rank, count, first sequence, offset).

    Lengths are 1 to capacity; those up to ``small`` (default: a quarter of capacity) count as small.  Never more sequences
    than best-fit by decreasing length makes.
    """
    small = capacity // 4 if small is None else small
    lengths = sorted(((n, c) for n, c in histogram.items() if c), reverse=True)
    if any(n < 1 or n > capacity for n, _ in lengths):
        raise ValueError("lengths must be from 1 to the capacity")
    full = [(n, c) for n, c in lengths if n == capacity]
    lengths = [x for x in lengths if x[0] < capacity]
    bound = -(-sum(n * c for n, c in lengths) // capacity)  # no packing has fewer
    best = _improved(_grouped(lengths, capacity, groups, small), bound, rounds)
    if best.made() > bound:
        plain = _Sequences(capacity)
        plain.best_fit([(n, 0, c) for n, c in lengths])
        best = min(best, _improved(plain, bound, rounds), key=_Sequences.made)
    for n, c in full:
        best.keep(0, c, [(n, 0)])
    return best.runs()


def _pieces(tokenizer: str, end_id: int, capacity: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("number", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, end, task = encoder(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode_all(text.as_py() for text in batch.column(1))):
                ids += end
                total = len(ids) // 4
                start, n = 0, total % capacity or min(total, capacity)
                for piece in range(-(-total // capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    kept = np.frombuffer(part, dtype="<u4")
                    kept = zlib.compress(kept.astype("<u2").tobytes() if kept.max() < 65536 else part, 1)
                    rows.append((doc, piece, start, n, kept, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
                    start, n = start + n, capacity
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return run


def unpack_ids(ids: bytes, length: int) -> np.ndarray:
    """The token ids of a piece from its column ``ids``: deflated, of 16 bits where that many hold them."""
    raw = zlib.decompress(ids)
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * length else "<u4")


def cut_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> pieces of at most ``capacity`` ids, the first the shorter; written once.

    Columns: doc_id, piece, start, length, ids (see unpack_ids), ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), and task and number: the piece is the number-th of its length that this task made.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = tidy(_pieces(tokenizer or default_tokenizer(), end_id, capacity), encodes=True)
    return materialize(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, task long, number long"), "pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = 128) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length, task and number (see cut_documents).

    A length that a third of all pieces have is no hot key: ranks come from sums by (length, task), and the
    runs, whose number depends on capacity and groups alone, are broadcast once counted.  They go to Spark in Arrow format:
    rows of Python would be unpacked by Python workers of their own kind, which stay beside the others.
    """
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = plan(histogram, capacity, groups)
    names = ("length", "first", "count", "sequence", "offset")
    table = spark.createDataFrame(pa.table({name: pa.array([run[k] for run in runs], pa.int64()) for k, name in enumerate(names)}))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("number"))
    found = ranked.join(bounded(table, 200_000), "length").where("rank >= first and rank < first + count")
    return found.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).drop(
        "task", "number", "base", "rank", "first", "count", "sequence"
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, groups: int = 128) -> DataFrame:
    """Packs all documents (doc_id, text): a row for each piece with its ids and its place in a sequence.

    Null text: the end id alone.  Null or repeated doc_ids: every row is packed.  No rows: none.
    Other columns are ignored.  Long documents are cut into pieces of ``capacity``, the first the shorter.
    """
    return place(cut_documents(docs, tokenizer, end_id, capacity), capacity, groups)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 ids."""
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
