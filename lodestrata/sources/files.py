"""Scans of file trees, notes, journals, invariants and transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EXCLUDED = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build", "target", "*.pyc")
TOOL_CALL = "array<struct<name:string,tool_name:string,args:map<string,string>>>"


def scan_files(spark: SparkSession, root: str, exts: Sequence[str] | None = None, excludes: Sequence[str] = EXCLUDED, limit: int | None = None) -> DataFrame:
    """All files under ``root`` with one of the extensions: path, text (bad bytes replaced), mtime, ext, sha256.

    A limit takes the first by path.  Bytes are read only for the files that pass.
    """
    exts = tuple(e.lstrip(".") for e in exts or (*T.CODE_EXTS, *T.CONFIG_EXTS, *T.DOC_EXTS))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    rows = rows.withColumn("path", path).where(T.extension(F.col("path")).isin(*exts) & ~T.excluded(F.col("path"), excludes))
    if limit is not None:
        rows = rows.join(F.broadcast(rows.select("path").orderBy("path").limit(limit)), "path", "left_semi")
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").cast("double").alias("mtime"), T.extension(F.col("path")).alias("ext"), F.sha2("content", 256).alias("sha256"))


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files of these paths that exist, with the columns of scan_files."""
    fs = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [p for p in paths if fs(spark._jvm.org.apache.hadoop.fs.Path(p)).isFile(spark._jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return spark.createDataFrame([], "path string, text string, mtime double, ext string, sha256 string")
    rows = spark.read.format("binaryFile").load(there)
    path = F.regexp_replace("path", r"^file:/*", "/")
    return rows.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").cast("double").alias("mtime"), T.extension(path).alias("ext"), F.sha2("content", 256).alias("sha256"))


def whole_texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/").alias("path"), F.col("value").alias("text"))


def journal_entries(notes: DataFrame) -> DataFrame:
    """Daily notes (path, text) -> date, seq, title, body, tags, project, supersedes: a row for each dated section."""
    sections = F.slice(F.split("text", r"(?m)^##\s+"), 2, 1 << 30)
    rows = notes.select(F.regexp_extract(T.basename(F.col("path")), r"^(\d{4}-\d{2}-\d{2})\.md$", 1).alias("date"), F.posexplode(sections).alias("seq", "s"))
    head = F.trim(F.substring_index("s", "\n", 1))
    rest = F.when(F.col("s").contains("\n"), F.expr("substring(s, locate('\n', s) + 1)")).otherwise("")
    title = F.regexp_extract(head, r"^(?:\d{2}:\d{2}\s*[—\-]\s*|Episode:\s*)(.+)$", 1)
    field = lambda name: F.trim(F.regexp_extract("body", rf"\*\*{name}:\*\*[ \t]*([^\n]*)", 1))
    many = lambda c: F.filter(F.transform(F.split(c, ","), lambda t: F.trim(F.regexp_replace(t, "[`#]", ""))), lambda t: F.length(t) > 0)
    rows = rows.where("date <> ''").select("date", "seq", F.when(F.length(title) > 0, F.trim(title)).otherwise(head).alias("title"), T.trimmed(rest).alias("body"))
    return rows.select("*", many(field("Tags")).alias("tags"), field("Project").alias("project"), many(field("Supersedes")).alias("supersedes"))


def invariants(notes: DataFrame) -> DataFrame:
    """Notes (text) -> domain, rule, rationale of blocks ``### [domain]`` / ``- **Rule**:`` / ``- **Rationale**:``."""
    block = r"###\s*\[([^\]]+)\][^\n]*\n(?:\s*\n)*-\s*\*\*Rule\*\*:\s*([^\n]+)\n-\s*\*\*Rationale\*\*:\s*([^\n]+)"
    part = lambda i: F.regexp_extract_all(F.col("text"), F.lit(block), F.lit(i))
    rows = notes.select(F.explode(F.arrays_zip(part(1).alias("domain"), part(2).alias("rule"), part(3).alias("rationale"))).alias("b"))
    return rows.select(*[F.trim(F.col(f"b.{c}")).alias(c) for c in ("domain", "rule", "rationale")])


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Steps of transcripts in JSON lines, with their tool calls; lines that aren't JSON are skipped."""
    rows = spark.read.schema(f"tool_calls {TOOL_CALL}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("session"), "tool_calls", "_bad")
    return rows.where("_bad is null").drop("_bad")


def manifest_indexer(names: Column) -> Column:
    """The language whose indexer fits a root that has these files: rust, typescript, python, go, unknown."""
    has = lambda *own: F.arrays_overlap(names, F.array(*map(F.lit, own)))
    return (
        F.when(has("Cargo.toml"), "rust").when(has("package.json", "tsconfig.json"), "typescript")
        .when(has("pyproject.toml", "setup.py", "requirements.txt"), "python").when(has("go.mod"), "go").otherwise("unknown")
    )


def watcher_state(status: Column, pid_alive: Column, readable: Column) -> Column:
    """RUNNING, STOPPED, DEAD_STALE_PID or ERROR."""
    return F.when(~readable, "ERROR").when(status != "RUNNING", "STOPPED").when(pid_alive, "RUNNING").otherwise("DEAD_STALE_PID")
