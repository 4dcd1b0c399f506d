"""Snapshot tables: every write makes a new version of a table and then points to it.

A table lies in ``buckets`` folders by the hash of one column (schema.BUCKET_BY).  A version is a list of the folder of each
bucket that has rows; a write that replaces rows by that column reads and writes the buckets of the rows it touches, and takes the
others over as they are, so that one changed file costs its buckets and not the table.

A reader sees the version that was current when it began; a failed write leaves the pointer as it was.  Pointers and
versions go through Spark's own file systems, so that the store can live wherever Spark writes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; of equal keys in ``new`` one row stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_by(old: DataFrame, new: DataFrame, key: str, changed: DataFrame) -> DataFrame:
    """All rows of the keys in ``changed`` go, and the new ones come: how a file's symbols are saved again."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_by(old: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Texts: reports, journals, status.
    def read_text(self, name: str) -> str:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return ""
        stream = self._fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def append_text(self, name: str, text: str) -> None:
        """Many file systems can't append; the file is written again."""
        self.write_text(name, self.read_text(name) + text)

    # Tables.
    def _versions(self, name: str) -> list[str]:
        folder = self._path(f"{self.root}/{name}/_current")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder))

    def _folders(self, name: str, version: str | None = None) -> dict[int, str]:
        """bucket -> folder of the current version."""
        versions = self._versions(name)
        if not versions:
            return {}
        lines = self.read_text(f"{name}/_current/{version or versions[-1]}").split()
        return {int(folder.rsplit("=", 1)[1]): folder for folder in lines}

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(schema.BUCKET_BY.get(name, schema.KEYS.get(name, ["path"])[0])), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        ddl = schema.TABLES[name]
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.root}/{name}/{f}" for f in folders])

    def read(self, name: str) -> DataFrame:
        """The current version; a table without one is empty."""
        return self._read(name, list(self._folders(name).values()))

    def _write(self, name: str, rows: DataFrame, rest: dict[int, str]) -> None:
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        fields = self.spark.createDataFrame([], schema.TABLES[name]).schema
        held = {c.lower() for c in rows.columns}
        rows = rows.select([(F.col(f"`{f.name}`") if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        rows.withColumn("bucket", self._bucket(name)).write.partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")
        own = {}
        for status in self._fs.listStatus(self._path(f"{self.root}/{name}/{version}")):
            folder = status.getPath().getName()
            if folder.startswith("bucket="):
                own[int(folder.rsplit("=", 1)[1])] = f"{version}/{folder}"
        self.write_text(f"{name}/_current/{version}", "\n".join((rest | own).values()))

    def write(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, {})

    def _change(self, name: str, column: str, touching: list[DataFrame], change: Callable[[DataFrame], DataFrame]) -> None:
        """Writes the buckets anew that rows of ``touching`` (with ``column``) are in; all, if the table isn't dealt by that column."""
        folders = self._folders(name)
        if column == schema.BUCKET_BY.get(name, schema.KEYS[name][0]):
            asked = touching[0].select(self._bucket(name).alias("b"))
            for rows in touching[1:]:
                asked = asked.unionByName(rows.select(self._bucket(name).alias("b")))
            touched = {r["b"] for r in asked.distinct().collect()}  # at most as many as there are buckets
        else:
            touched = set(range(self.buckets))
        if touched:
            self._write(name, change(self._read(name, [f for b, f in folders.items() if b in touched])), {b: f for b, f in folders.items() if b not in touched})

    def upsert(self, name: str, rows: DataFrame) -> None:
        self._change(name, self._home(name), [rows], lambda old: upsert(old, rows, schema.KEYS[name]))

    def insert_if_absent(self, name: str, rows: DataFrame) -> None:
        self._change(name, self._home(name), [rows], lambda old: insert_if_absent(old, rows, schema.KEYS[name]))

    def _home(self, name: str) -> str:
        """The bucket column if the table's keys have it."""
        column = schema.BUCKET_BY.get(name, schema.KEYS[name][0])
        return column if column in schema.KEYS[name] else ""

    def replace_by(self, name: str, rows: DataFrame, key: str, changed: DataFrame) -> None:
        self._change(name, key, [rows, changed], lambda old: replace_by(old, rows.dropDuplicates(schema.KEYS[name]), key, changed))

    def delete_by(self, name: str, key: str, gone: DataFrame) -> None:
        self._change(name, key, [gone], lambda old: delete_by(old, key, gone))

    def clear(self, name: str) -> int:
        """Empties a table; how many rows it had."""
        n = self.read(name).count()
        self.write(name, self.spark.createDataFrame([], schema.TABLES[name]))
        return n

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Forgets all versions but the last ``keep``, and drops the folders that none of these needs; how many versions."""
        versions = self._versions(name)
        old = versions[:-keep]
        needed = {f for v in versions[-keep:] for f in self._folders(name, v).values()}
        for version in old:
            self._fs.delete(self._path(f"{self.root}/{name}/_current/{version}"), False)
            folder = self._path(f"{self.root}/{name}/{version}")
            if not any(f.startswith(f"{version}/") for f in needed):
                self._fs.delete(folder, True)
            elif self._fs.exists(folder):
                for status in self._fs.listStatus(folder):
                    if f"{version}/{status.getPath().getName()}" not in needed:
                        self._fs.delete(status.getPath(), True)
        return len(old)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
