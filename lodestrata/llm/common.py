"""What the operators share beside lodestrata.shared: broadcasts of a checked size, batches, sketches of fixed size."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import components, discard, gathered, scratch, setting  # noqa: F401  used by the operators
from ..shared import written as materialize  # noqa: F401
from .tokens import forget


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which are counted; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def records_a_batch(spark: SparkSession, records: int) -> Iterator[None]:
    """So many rows an Arrow batch for what runs inside, then as before."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(records)):
        yield


def tidy(run: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; when a task is over its worker, which waits for others, gives freed memory back to the system.

    Encoders that earlier tasks have left in the worker go before it begins, unless it ``encodes`` itself.
    """

    def whole(batches: Iterator) -> Iterator:
        if not encodes:
            forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return whole


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Arrow batches that stay small where documents are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bits of a membership sketch and the rows they are sent in; 8 MB whatever the input.
SKETCH_BITS, SKETCH_BLOCKS = 1 << 26, 64


def _places(h: np.ndarray) -> np.ndarray:
    h = np.ascontiguousarray(h).view(np.uint64)
    return np.stack([h & np.uint64(SKETCH_BITS - 1), (h >> np.uint64(32)) & np.uint64(SKETCH_BITS - 1)]).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(SKETCH_BITS // 8, dtype=np.uint8)
    for batch in batches:
        at = _places(batch.column(0).to_numpy()).ravel()
        np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    for block, own in enumerate(np.split(bits, SKETCH_BLOCKS)):
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["block", "bits"])


def _either(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch["block"], batch["bits"]):
            own = np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
            total[block] = total[block] | own if block in total else own
    if total:
        yield pd.DataFrame({"block": list(total), "bits": [zlib.compress(v.tobytes(), 1) for v in total.values()]})


def sketch(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over one column of 64-bit hashes, as packed bits.

    It spares a shuffle rows that can't have a partner; a row that passes is still joined, so that results never
    depend on it.  However many hashes there are, the driver gets and sends SKETCH_BITS; with more hashes than it can tell apart,
    more rows pass.
    """
    parts = hashes.mapInArrow(_mark, "block int, bits binary").repartition(SKETCH_BLOCKS, "block").mapInPandas(_either, "block int, bits binary")
    total = np.zeros(SKETCH_BITS // 8, dtype=np.uint8)
    for row in gathered(parts):  # SKETCH_BLOCKS rows
        step = SKETCH_BITS // 8 // SKETCH_BLOCKS
        total[row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(zlib.decompress(bytes(row["bits"])), dtype=np.uint8)
    return total


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _places(h)
    return ((bits[a >> 3] >> (7 - (a & 7))) & (bits[b >> 3] >> (7 - (b & 7))) & 1).astype(bool)


def in_sketch(spark: SparkSession, bits: np.ndarray) -> Callable[[Column], Column]:
    """A column function: whether a 64-bit hash may be among those of ``bits``.  Only the hashes go to Python.

    If the rows that pass go through mapInArrow later, a shuffle has to lie between (a join with a table that is hinted ``merge``):
    in one stage each task would need two Python workers, and all of them stay.
    """
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(sent.value, h.to_numpy(dtype=np.int64)))

    return found


class Seen:
    """Remembers some of the hashes that a task has met, in a table of fixed size."""

    def __init__(self, size: int = 1 << 18):
        self.slots, self.used = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=bool)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Which of these distinct hashes aren't known to have been met; all count as met from now on, or until their slot is needed."""
        at = (h >> np.uint64(24)).astype(np.int64) & (len(self.slots) - 1)
        fresh = ~self.used[at] | (self.slots[at] != h)
        self.slots[at], self.used[at] = h, True
        return fresh


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores behind it until no frame has a column of that name in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
