"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes one separator; n-grams of 1 to ``longest``
characters are hashed to ``buckets`` features.  The model is fitted on a bounded sample: of each language the
documents whose hashes (of id and text) fall under a threshold that ``per_language`` documents are expected to pass.  Counts
are summed in Spark; the matrix of log-probabilities (languages x buckets) is broadcast.  Batches are scored in numpy as sparse
rows: the n-grams of many documents in one list, with where each document's begin; the model's columns are gathered once for
all and summed by document.

Besides the posterior, which is close to 0 or 1 for any text of some length, a prediction has ``gain``: by how much an n-gram of
the text is likelier under its language than if all features were equally likely, as the mean of logarithms.  It doesn't grow
with the text.  Texts of a learned language gain; texts in another alphabet, of an unlearned language or of junk lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

PER_LANGUAGE = 3000
BUCKETS = 1 << 16
LONGEST = 3
UNKNOWN = "und"
#: Characters scored at a time.
PIECE = 1 << 17

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def code_points(text: str) -> np.ndarray:
    """Lower-cased, every run of other characters than letters a single 0, with a 0 at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(letters()[c], c, 0)
    c = np.concatenate([[0], c, [0]]).astype(np.uint64)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def features(c: np.ndarray, buckets: int, longest: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of all n-grams of what code_points returns, one text or several (``rows``: of each code point).

    N-grams of separators alone and those that reach over two texts are left out.
    """
    rows = np.zeros(len(c), dtype=np.int64) if rows is None else rows
    out, of, h = [], [], np.zeros(len(c), dtype=np.uint64)
    for n in range(1, longest + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        own = c != 0 if n == 1 else rows[: len(h)] == rows[n - 1 :]
        out.append(((mixed >> np.uint64(40)).astype(np.int64) % buckets)[own])
        of.append(rows[: len(h)][own])
    return np.concatenate(out), np.concatenate(of)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, code points) of all texts that have letters; a very long text in several pieces that overlap by n-grams."""
    for i, text in enumerate(texts):
        if text:
            c = code_points(text)
            if len(c) > 2:
                for at in range(0, len(c), PIECE):
                    yield i, c[at : at + PIECE + LONGEST - 1]


def blocks(texts: list[str | None], buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, row) of all n-grams of many texts, about PIECE code points at a time."""
    held, rows, size = [], [], 0
    for i, c in pieces(texts):
        held.append(c)
        rows.append(i)
        size += len(c)
        if size >= PIECE:
            yield features(np.concatenate(held), buckets, longest, np.repeat(rows, [len(c) for c in held]))
            held, rows, size = [], [], 0
    if held:
        yield features(np.concatenate(held), buckets, longest, np.repeat(rows, [len(c) for c in held]))


def _counts(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            names = sorted(set(lang))
            kind = np.array([names.index(x) for x in lang])
            for f, rows in blocks(batch.column(1).to_pylist(), buckets, longest):
                for k in np.unique(kind[rows]):
                    own = np.bincount(f[kind[rows] == k], minlength=buckets)
                    total[names[k]] = total[names[k]] + own if names[k] in total else own
        for name, own in total.items():
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(own[found], pa.int64())], names=["lang", "bucket", "n"])

    return run


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[list[str], np.ndarray]:
    """(doc_id, text, lang) -> languages, sorted, and the matrix of log-probabilities (float32).

    Null langs and texts teach nothing.  One row a language, and languages x buckets counts, reach the driver.
    Without anything to learn from there are no languages.
    """
    known = rows.where("lang is not null and text is not null")
    shares = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    share = F.create_map(*[x for r in shares.collect() for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["docs"])))]) if known.limit(1).count() else None
    if share is None:
        return [], np.zeros((0, buckets), dtype=np.float32)
    # By id and text, so that rows with null or equal ids are drawn one by one; equal rows are one example, drawn together.
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(draw < share[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(tidy(_counts(buckets, longest)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    matrix = np.ones((len(names), buckets))
    np.add.at(matrix, (counts["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(dtype=int), counts["bucket"].to_numpy()), counts["n"].to_numpy())
    return names, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(model, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = model.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sums, size = np.zeros((len(texts), max(1, len(names)))), np.zeros(len(texts))
            for f, rows in blocks(texts, matrix.shape[1], longest):
                size += np.bincount(rows, minlength=len(texts))
                for k in range(len(names)):
                    sums[:, k] += np.bincount(rows, weights=matrix[k, f], minlength=len(texts))
            odds = np.exp(sums - sums.max(axis=1, keepdims=True))
            best, seen = sums.argmax(axis=1), size > 0
            lang = [names[b] if s and names else UNKNOWN for b, s in zip(best, seen)]
            score = np.where(seen & bool(names), 1.0 / odds.sum(axis=1), 0.0)
            gain = pa.array(sums.max(axis=1) / np.maximum(size, 1) + np.log(matrix.shape[1]), mask=~(seen & bool(names)))
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lang, pa.string()), pa.array(score, pa.float64()), gain], names=[*batch.schema.names[:-1], "lang_pred", "score", "gain"])

    return run


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, longest: int = LONGEST, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the posterior probability, equal priors) and gain to the columns ``keep``, from ``text`` alone.

    ``und`` with score 0 and gain null: null texts and texts without letters.  Ties go to the first language by name.  A
    column of ``keep`` may have any name but those of the result.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((names, matrix))
    own = [f"keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(o) for c, o in zip(keep, own)], F.col(text).cast("string").alias("text"))
    schema = ", ".join([f"{o} {rows.schema[o].dataType.simpleString()}" for o in own] + ["lang_pred string", "score double", "gain double"])
    found = rows.mapInArrow(tidy(_score(model, longest)), schema)
    return found.select(*[F.col(o).alias(c) for c, o in zip(keep, own)], "lang_pred", "score", "gain")


def held_out(doc_id: Column) -> Column:
    """Documents that never teach: crc32 of the id as text, modulo 4, is 2.  A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fits on the documents that aren't held out and predicts all; repeated rows are rows of their own."""
    names, matrix = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("string").alias("text"), "lang"))
    return predict(docs, names, matrix, keep=keep)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
