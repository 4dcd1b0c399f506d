"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their keys:

    block*  index  bloom  footer

* block: entries ``shared u16 | rest u16 | key bytes | n_ids u32`` with keys prefix-compressed
  against the entry before, then the block's ids one after another (16-bit if all are below
  65536, else 32-bit), all deflated; header ``raw_len u32 | n_entries u32 | entries_len u32 | width u8``.
* index: for each block ``offset u64 | length u32 | docs before u64 | ids before u64 | first key``:
  sparse, one entry a block; a lookup bisects it and reads one block.
* bloom: ``k u32 | bits`` over all keys of the shard.
* footer (fixed size): offsets of index and bloom, numbers of blocks, documents and ids, magic.

Shards are as many as the session's shuffle partitions, or more where a shard would get over ``SHARD_BYTES`` of text.  A reader
takes footer, index and blocks by ranges from any file that can seek: no file is ever in memory as a whole, and a lookup
reads the footer, the index, the filter and one block.

A key is the document's id as eight big-endian bytes with the sign bit flipped, so that byte
order is number order; a null id is the empty key and comes first.  Rows with equal ids are all
kept, ordered by their ids' bytes.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches
from .tokens import default_tokenizer, encoder

MAGIC = b"SSTTOK01"
FOOTER = struct.Struct("<QQIQQ8s")
HEAD = struct.Struct("<IIIB")
ENTRY = struct.Struct("<HHI")
SPOT = struct.Struct("<QIQQH")
BLOOM_BITS, BLOOM_HASHES = 10, 7
SHARD_BYTES = 256 << 20
MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (int(doc_id) + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class ShardWriter:
    """Writes one shard to a binary file object, block by block; holds one block and the keys."""

    def __init__(self, out, block_bytes: int = 256 * 1024):
        self.out, self.block_bytes = out, block_bytes
        self.at = self.docs = self.ids = 0
        self.spots: list[bytes] = []
        self.keys: list[bytes] = []
        self._fresh()

    def _fresh(self) -> None:
        self.entries, self.values, self.held, self.last, self.first, self.count = [], [], 0, b"", None, 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.first is None:
            self.first = key
        shared = common_prefix(self.last, key)
        self.entries.append(ENTRY.pack(shared, len(key) - shared, len(ids) // 4) + key[shared:])
        self.values.append(ids)
        self.keys.append(key)
        self.last, self.held, self.count = key, self.held + len(ids) + 16, self.count + 1
        if self.held >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.first is None:
            return
        entries, values = b"".join(self.entries), np.frombuffer(b"".join(self.values), dtype="<u4")
        n, width = len(values), 2 if not len(values) or values.max() < 65536 else 4
        raw = entries + values.astype(f"<u{width}").tobytes()
        block = HEAD.pack(len(raw), self.count, len(entries), width) + zlib.compress(raw, 1)
        self.out.write(block)
        self.spots.append(SPOT.pack(self.at, len(block), self.docs, self.ids, len(self.first)) + self.first)
        self.at, self.docs, self.ids = self.at + len(block), self.docs + self.count, self.ids + n
        self._fresh()

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(bits // 8 + 1)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.spots)
        self.out.write(index)
        self.out.write(struct.pack("<I", bits) + bytes(bloom))
        self.out.write(FOOTER.pack(self.at, self.at + len(index), len(self.spots), self.docs, self.ids, MAGIC))


class ShardReader:
    """Reads a shard from its bytes or from a file that can seek: all entries in order, or one key by binary search."""

    def __init__(self, source):
        if not hasattr(source, "seek"):
            source = pa.BufferReader(source)
        self.source = source
        size = source.seek(0, 2) if not hasattr(source, "size") else source.size()
        if size < FOOTER.size:
            raise ValueError("not a shard of this format")
        index, self.bloom_at, n, self.docs, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom_size = size - FOOTER.size - self.bloom_at
        self.spots, self.firsts, at = [], [], 0
        spots = self._read(index, self.bloom_at - index)
        for _ in range(n):
            offset, length, docs, ids, size = SPOT.unpack_from(spots, at)
            at += SPOT.size
            self.spots.append((offset, length, docs, ids))
            self.firsts.append(spots[at : at + size])
            at += size
        self.bloom = None

    def _read(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of each entry of block i."""
        offset, length, _, before = self.spots[i]
        held = self._read(offset, length)
        _, count, entries, width = HEAD.unpack_from(held)
        raw = zlib.decompress(held[HEAD.size :])
        values = np.frombuffer(raw, dtype=f"<u{width}", offset=entries).astype("<u4")
        at, start, key = 0, 0, b""
        for _ in range(count):
            shared, rest, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, before + start, values[start : start + n]
            start += n

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for i in range(len(self.spots)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            held = self._read(self.bloom_at, self.bloom_size)
            (self.bits,), self.bloom = struct.unpack_from("<I", held), held[4:]
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row with that document id; most often one."""
        key = key_of(doc_id)
        if not self.spots or not self.may_hold(key):
            return []
        out, i = [], max(0, bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key:
            i -= 1
        while i < len(self.spots) and self.firsts[i] <= key:
            out += [ids for k, _, ids in self.block(i) if k == key]
            i += 1
        return out


def _writer(folder: str, block_bytes: int, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        coder, end = encoder(tokenizer), struct.pack("<I", end_id)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        # A name of its own for every attempt: what a lost or repeated task leaves is in no manifest.
        name, low, high = f"{uuid.uuid4().hex}.sst", head.column("doc_id")[0].as_py(), None
        with store.open_output_stream(f"{root}/{name}") as out:
            shard = ShardWriter(out, block_bytes)
            for batch in itertools.chain([head], batches):
                for high, ids in zip(batch.column("doc_id").to_pylist(), coder.encode_all(text.as_py() for text in batch.column("text"))):
                    shard.add(key_of(high), ids + end)
            shard.close()
        row = [TaskContext.get().partitionId(), name, shard.docs, shard.ids, low, high]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, MANIFEST.types)], schema=MANIFEST)

    return run


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None, block_bytes: int = 256 * 1024
) -> DataFrame:
    """Encode (doc_id, text) and write shards in ascending doc_id order; returns the manifest.

    The manifest has a row for each shard: shard (order), file, docs, ids, low, high (ids of its first and
    last document).  Null text: no ids but the end id.  Null doc_id: first.  Equal doc_ids: all kept.
    The one shuffle deals ranges of (doc_id, hash of text), so that a repeated doc_id can be split; a task
    then encodes its range and streams it into its shard.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if shards is None:
        held = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    run = _writer(folder, block_bytes, tokenizer or default_tokenizer(), end_id)
    return materialize(placed.mapInArrow(run, "shard long, file string, docs long, ids long, low long, high long"), "sst-manifest")


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for listed in batches:
            for name, before in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    rows, held = [], 0
                    for key, start, ids in ShardReader(source):
                        rows.append((id_of(key), before + start, len(ids), ids.tobytes()))
                        held += 4 * len(ids)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return run


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the manifest's shards, read from the files block by block.

    ids are little-endian unsigned 32-bit bytes.  ``start`` adds the ids of the shards before, from the manifest,
    which has one row a shard.
    """
    listed, total = [], 0
    for row in manifest.orderBy("shard").select("file", "ids").collect():
        listed.append((len(listed), row["file"], total))
        total += row["ids"]
    files = spark.createDataFrame(listed, "place long, file string, before long").repartitionByRange(max(1, len(listed)), "place")
    return files.select("file", "before").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids binary")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "sst")
    manifest = write_shards(docs, folder)
    return read_shards(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
