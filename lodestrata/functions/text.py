"""Text expressions: tokens, candidates, scores, names.  All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# They decide the results.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
INTENTS = "where is|what is|find|class|def|function|method|symbol|references to|callers of|calls to"
STOP_WORDS = (
    "is", "where", "what", "find", "class", "def", "function", "method", "symbol", "references", "to", "of", "in", "and", "or", "not", "for", "the", "a", "an",
    "self", "true", "false", "none", "return", "import", "from", "async", "await", "query", "test", "code", "file", "line",
)
NOT_TARGETS = ("assert", "assertTrue", "assertEqual", "pytest", "print", "len", "range", "list", "dict", "set", "int", "str", "float", "bool", "super")
CODE_EXTS = ("py", "js", "jsx", "ts", "tsx", "rs", "go", "c", "h", "cpp", "hpp", "cc", "cxx", "java", "kt", "kts", "swift", "cs")
CONFIG_EXTS = ("yaml", "yml", "json", "toml")
DOC_EXTS = ("md", "markdown", "txt")


def count_tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least, 0 for no text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(trimmed(text), 256)


def query_tokens(query: str) -> list[str]:
    """Words of more than two characters, lower-cased, punctuation and repeats kept."""
    return [t for t in query.lower().split() if len(t) > 2]


def keyword_score(tokens: Sequence[str], field: Column, weight: int) -> Column:
    """``weight`` for each token that the field holds, letters' case aside."""
    low = F.lower(F.coalesce(field, F.lit("")))
    score = F.lit(0)
    for t in tokens:
        score = score + F.when(low.contains(t), weight).otherwise(0)
    return score


def symbol_candidates(query: Column, limit: int = 5) -> Column:
    """Identifiers that a question may mean, by kind of evidence, without stop words, short ones and repeats."""
    one = lambda pattern: F.regexp_extract_all(query, F.lit(pattern), F.lit(1))
    clean = trimmed(query)
    found = F.concat(
        one(f"`({IDENTIFIER})`"),
        one(rf"(?i)(?:{INTENTS})\s+({IDENTIFIER})"),
        one(rf"\b({IDENTIFIER})\s*\("),
        one(r"\b([A-Z][a-zA-Z0-9]*[a-z][A-Za-z0-9]*)\b"),
        one(r"\b([a-z][a-z0-9]*_[a-z0-9_]+)\b"),
        F.when(clean.rlike(f"^{IDENTIFIER}$"), F.array(clean)).otherwise(F.array().cast("array<string>")),
    )
    kept = F.filter(found, lambda c: (F.length(c) >= 3) & ~F.lower(c).isin(*STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, whatever stands before it."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), F.initcap), "")


def title_of(path: Column) -> Column:
    return title_case(F.regexp_replace(stem(path), "[-_]", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9_\-]+", "-"), "^-+|-+$", "")


def excluded(path: Column, parts: Sequence[str]) -> Column:
    """Whether a directory of the path, or the file, is on the list or starts with a dot, or matches a ``*.ext`` entry."""
    own = F.split(path, "/")
    exact = [p.strip("/") for p in parts if "*" not in p]
    tails = [p.lstrip("*") for p in parts if p.startswith("*")]
    out = F.arrays_overlap(own, F.array(*map(F.lit, exact))) if exact else F.lit(False)
    for t in tails:
        out = out | F.endswith(path, F.lit(t))
    return F.coalesce(out, F.lit(False))


def supported(path: Column) -> Column:
    return extension(path).isin(*CODE_EXTS, *CONFIG_EXTS, *DOC_EXTS)


def is_test(name: Column, path: Column) -> Column:
    own = F.split(path, "/")
    return name.startswith("test_") | name.endswith("_test") | name.startswith("Test") | F.array_contains(own, "test") | F.array_contains(own, "tests")


def dependencies(text: Column, imported: Column, own_name: Column) -> Column:
    """Imports (array of symbol, module) whose symbols the text uses, sorted, without the definition itself."""
    used = F.regexp_extract_all(text, F.lit(rf"\b({IDENTIFIER})\b"), F.lit(1))
    return F.array_sort(F.filter(imported, lambda d: F.array_contains(used, d["symbol"]) & ~d["symbol"].eqNullSafe(own_name)))


def test_targets(name: Column, text: Column, path: Column, known: Column) -> Column:
    """Of a test: the first four known names that it calls, sorted, without helpers and other tests."""
    called = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({IDENTIFIER})\s*\("), F.lit(1)))
    good = F.filter(F.array_intersect(F.array_sort(called), known), lambda c: ~c.startswith("test_") & ~c.isin(*NOT_TARGETS))
    return F.when(is_test(name, path), F.slice(good, 1, 4)).otherwise(F.array().cast("array<string>"))


def preamble(path: Column, module=None, scope=None, signature=None, docstring=None, dependencies=None, test_targets=None, commit_date=None, commit_hash=None, commit_msg=None, note=None) -> Column:
    """The header lines of a chunk; lines without a value are left out."""
    none = F.lit(None).cast("string")
    line = lambda label, c: none if c is None else F.when(F.length(c) > 0, F.concat(F.lit(f"# {label}: "), c))
    deps = none
    if dependencies is not None:
        shown = F.transform(F.slice(dependencies, 1, 6), lambda d: F.when(F.length(d["module"]) > 0, F.concat(d["symbol"], F.lit(" ("), d["module"], F.lit(")"))).otherwise(d["symbol"]))
        deps = F.array_join(shown, ", ")
    tests = none if test_targets is None else F.array_join(F.slice(test_targets, 1, 4), ", ")
    when = none
    if commit_date is not None:
        when = F.concat(F.lit("# Last Modified: "), commit_date, F.lit(" ("), commit_hash, F.lit(") - "), F.substring(commit_msg, 1, 50))
    doc = None if docstring is None else trimmed(F.regexp_replace(docstring, "\n", " "))
    lines = [
        F.concat(F.lit("# File: "), path), line("Module", module), line("Scope", scope), line("Signature", signature), line("Docstring", doc),
        line("Depends On", deps), line("Tests Target", tests), when, line("Note", note),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def scip_name(symbol: Column) -> Column:
    """The readable name in a compiler-index symbol."""
    tokens = F.split(F.regexp_replace(symbol, r"[/#().:$!]+$", ""), r"[\s/#`]+")
    name = F.regexp_replace(F.element_at(tokens, -1), r"^[`().#]+|[`().#]+$", "")
    return (
        F.when(F.coalesce(symbol, F.lit("")) == "", F.lit("anonymous"))
        .when(symbol.startswith("local "), F.regexp_replace(symbol, " ", ":"))
        .otherwise(F.when(F.length(name) > 0, name).otherwise(symbol))
    )


def scip_parent(symbol: Column, enclosing: Column | None = None) -> Column:
    head = F.substring_index(symbol, "#", 1)
    tokens = F.split(F.regexp_replace(head, r"[/#().:$!]+$", ""), r"[\s/#`]+")
    own = F.when(symbol.contains("#") & (F.length(head) > 0), F.regexp_replace(F.element_at(tokens, -1), r"^[`().#]+|[`().#]+$", "")).otherwise(F.lit(""))
    return own if enclosing is None else F.when(F.length(enclosing) > 0, scip_name(enclosing)).otherwise(own)


def scip_role(roles: Column) -> Column:
    """Bits 1 definition, 2 import, 4 write; else a call."""
    has = lambda bit: roles.bitwiseAND(bit) != 0
    return F.when(has(1), "definition").when(has(2), "import").when(has(4), "write").otherwise("call")


def shown(items: Column, limit: int) -> Column:
    """The first items, then how many more there are."""
    return F.when(F.size(items) > limit, F.concat(F.array_join(F.slice(items, 1, limit), ", "), F.lit(", +"), (F.size(items) - limit).cast("string"), F.lit(" more"))).otherwise(F.array_join(items, ", "))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def register_functions(spark: SparkSession) -> None:
    """The expressions above as SQL functions, and the table functions."""
    from ..operators.chunking import chunk_document_udtf
    from ..operators.symbols import extract_links_udtf, extract_symbols_udtf

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION count_tokens(t STRING) RETURNS INT RETURN CASE WHEN coalesce(length(t), 0) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(t) / 4) AS INT)) END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN "
        "try_divide(aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, v) -> s + v), "
        "sqrt(aggregate(a, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)))"
    )
    last = r"element_at(split(regexp_replace({0}, '[/#().:$!]+$', ''), '[\\s/#`]+'), -1)"
    name = r"regexp_replace({0}, '^[`().#]+|[`().#]+$', '')"
    named = name.format(last.format("s"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION scip_name(s STRING) RETURNS STRING RETURN CASE WHEN coalesce(s, '') = '' THEN 'anonymous' "
        rf"WHEN startswith(s, 'local ') THEN regexp_replace(s, ' ', ':') WHEN length({named}) > 0 THEN {named} ELSE s END"
    )
    head = "substring_index(s, '#', 1)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION scip_parent(s STRING) RETURNS STRING RETURN CASE WHEN contains(s, '#') AND length({head}) > 0 THEN {name.format(last.format(head))} ELSE '' END")
    parts = [rf"`({IDENTIFIER})`", rf"(?i)(?:{INTENTS})\s+({IDENTIFIER})", rf"\b({IDENTIFIER})\s*\(", r"\b([A-Z][a-zA-Z0-9]*[a-z][A-Za-z0-9]*)\b", r"\b([a-z][a-z0-9]*_[a-z0-9_]+)\b"]
    found = ", ".join("regexp_extract_all(q, '{}', 1)".format(p.replace("\\", "\\\\")) for p in parts)
    clean = r"regexp_replace(q, '^\\s+|\\s+$', '')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION symbol_candidates(q STRING) RETURNS ARRAY<STRING> RETURN slice(array_distinct(filter(concat({found}, "
        f"CASE WHEN {clean} RLIKE '^{IDENTIFIER}$' THEN array({clean}) ELSE array() END), c -> length(c) >= 3 AND lower(c) NOT IN ({stop}))), 1, 5)"
    )
    spark.udtf.register("chunk_document", chunk_document_udtf())
    spark.udtf.register("extract_symbols", extract_symbols_udtf())
    spark.udtf.register("extract_links", extract_links_udtf())
