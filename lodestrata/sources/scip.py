"""Compiler indexes (protobuf) decoded from their wire format, and turned into symbol tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Field numbers of the format's messages, by what they hold.
INDEX_DOCUMENT, DOC_PATH, DOC_OCCURRENCE, DOC_SYMBOL = 2, 1, 2, 3
OCC_RANGE, OCC_SYMBOL, OCC_ROLES, OCC_SINGLE_LINE, OCC_MULTI_LINE = 1, 2, 3, 8, 9
SYM_SYMBOL, SYM_DOCUMENTATION, SYM_RELATIONSHIP, SYM_KIND, SYM_NAME, SYM_ENCLOSING = 1, 3, 4, 5, 6, 8
REL_SYMBOL, REL_IMPLEMENTATION, REL_TYPE = 1, 3, 4
KINDS = {7: "class", 8: "constant", 9: "constructor", 11: "enum", 15: "field", 17: "function", 21: "interface", 26: "method", 29: "module", 30: "namespace", 37: "parameter", 41: "property", 49: "struct", 53: "trait", 54: "type", 61: "variable"}

DOCUMENTS = (
    "relative_path string, symbols array<struct<symbol:string,kind:string,display_name:string,enclosing_symbol:string,documentation:array<string>,"
    "relationships:array<struct<symbol:string,is_implementation:boolean,is_type_definition:boolean>>>>, "
    "occurrences array<struct<line:int,symbol:string,symbol_roles:int>>"
)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, number or bytes) of a message."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < end:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def packed(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, n, shift = [], 0, 0
    for b in value:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def decode(content: bytes) -> Iterator[dict]:
    text = lambda v: v.decode("utf-8", "replace")
    for number, document in fields(content):
        if number != INDEX_DOCUMENT:
            continue
        path, symbols, occurrences = "", [], []
        for n, v in fields(document):
            if n == DOC_PATH:
                path = text(v)
            elif n == DOC_SYMBOL:
                s = {"symbol": "", "kind": "symbol", "display_name": "", "enclosing_symbol": "", "documentation": [], "relationships": []}
                for m, w in fields(v):
                    if m == SYM_RELATIONSHIP:
                        r = dict(fields(w))
                        s["relationships"].append({"symbol": text(r.get(REL_SYMBOL, b"")), "is_implementation": bool(r.get(REL_IMPLEMENTATION)), "is_type_definition": bool(r.get(REL_TYPE))})
                    elif m == SYM_DOCUMENTATION:
                        s["documentation"].append(text(w))
                    elif m == SYM_KIND:
                        s["kind"] = KINDS.get(w, "symbol")
                    elif m in (SYM_SYMBOL, SYM_NAME, SYM_ENCLOSING):
                        s[{SYM_SYMBOL: "symbol", SYM_NAME: "display_name", SYM_ENCLOSING: "enclosing_symbol"}[m]] = text(w)
                symbols.append(s)
            elif n == DOC_OCCURRENCE:
                o, places = {"line": 1, "symbol": "", "symbol_roles": 0}, []
                for m, w in fields(v):
                    if m == OCC_RANGE:
                        places += packed(w)
                    elif m in (OCC_SINGLE_LINE, OCC_MULTI_LINE):  # the newer, typed ranges
                        places = places or [dict(fields(w)).get(1, 0)]
                    elif m == OCC_SYMBOL:
                        o["symbol"] = text(w)
                    elif m == OCC_ROLES:
                        o["symbol_roles"] = w
                o["line"] = places[0] + 1 if places else 1
                occurrences.append(o)
        yield {"relative_path": path, "symbols": symbols, "occurrences": occurrences}


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            for doc in decode(bytes(content)):
                yield pd.DataFrame([doc])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_decode, DOCUMENTS)


def index_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """Documents of an index -> defined_in, imports, references, relations, files; roles decide, definitions first."""
    infos = documents.select("relative_path", F.explode("symbols").alias("s")).select("relative_path", "s.*")
    infos = infos.select(
        "relative_path", "symbol", "kind", F.when(F.length("display_name") > 0, F.col("display_name")).otherwise(T.scip_name(F.col("symbol"))).alias("name"),
        F.substring(F.array_join("documentation", "\n"), 1, 500).alias("docstring"), T.scip_parent(F.col("symbol"), F.col("enclosing_symbol")).alias("parent"), "relationships",
    )
    occ = documents.select("relative_path", F.posexplode("occurrences").alias("seq", "o")).select("relative_path", "seq", "o.*").where("symbol <> ''")
    occ = occ.join(infos.drop("relationships").dropDuplicates(["relative_path", "symbol"]), ["relative_path", "symbol"], "left").select(
        F.col("relative_path").alias("path"), "seq", "line", F.col("symbol").alias("scip_id"), T.scip_role(F.col("symbol_roles")).alias("role"),
        F.coalesce("name", T.scip_name(F.col("symbol"))).alias("symbol"), F.coalesce("kind", F.lit("symbol")).alias("kind"),
        F.coalesce("docstring", F.lit("")).alias("docstring"), F.coalesce("parent", T.scip_parent(F.col("symbol"))).alias("parent"),
    )
    first = occ.where(F.col("role").isin("write", "call")).groupBy("path", "symbol", "line").agg(F.min_by("role", "seq").alias("kind"))
    rel = infos.select(F.col("name").alias("symbol"), F.explode("relationships").alias("r")).select("symbol", T.scip_name(F.col("r.symbol")).alias("other"), F.col("r.symbol").alias("scip_id"), "r.is_implementation", "r.is_type_definition")
    rel = rel.withColumn("rel", F.explode(F.filter(F.array(F.when(F.col("is_implementation"), "IMPLEMENTS"), F.when(F.col("is_type_definition"), "TYPE_OF")), lambda x: x.isNotNull())))
    return {
        "files": documents.select(F.col("relative_path").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("is_markdown")).distinct(),
        "defined_in": occ.where("role = 'definition'").select("symbol", "path", "kind", "line", F.lit("").alias("signature"), "docstring", "parent").distinct(),
        "imports": occ.where("role = 'import'").select("path", "symbol", F.lit("").alias("module"), "line").distinct(),
        "references": first.select("path", "symbol", "line", "kind"),
        "relations": rel.select("symbol", "other", "rel", "scip_id").distinct(),
    }


def index_counts(documents: DataFrame) -> DataFrame:
    """documents, symbols (definitions), references, relationships of an index, in one row."""
    t = index_tables(documents)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(documents, "documents").crossJoin(one(t["defined_in"], "symbols")).crossJoin(one(t["references"], "references")).crossJoin(one(t["relations"], "relationships"))
