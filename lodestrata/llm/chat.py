"""Chat formatting with DataFrame expressions only.

Turns of a conversation are collected as structs, sorted, merged where neighbours have one role,
and joined by a template:

    <|start|>role<|text|>text<|next|>text<|end|>...

``<|next|>`` stands between merged turns, so that every turn can be read back.  Control strings inside
roles and texts are escaped reversibly: a backslash is put after the first character of what would be a
control string, and of what has backslashes there already; so an escaped text holds no control string.

Defined cases: turns are ordered by turn, role, text (nulls first), repeated rows stay; null texts
and roles are empty; a null conv_id is a conversation of its own; no rows give no rows; other columns are ignored.
A conversation is one row of the result, so that it has to fit into a row: it is the unit of the
output, not a group that could be dealt out.  Turns are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: What follows the first character, ``<`` or ``[``, of a control string: this template's and those of common models.
AFTER = r"\|(?:start|text|next|end|im_start|im_end|endoftext)\||/?s>|/?INST\]"
#: Turns whose lengths are added up in one go.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={AFTER})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={AFTER})", r"$1$2")


def _prefix_sums(sizes: Column) -> Column:
    """For each place of an array of longs, the sum of what stands before it; sums of blocks keep it from being quadratic."""
    add = lambda a, b: a + b
    zero = F.lit(0).cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")),
        lambda k: F.aggregate(F.slice(sizes, k * BLOCK + 1, BLOCK), zero, add),
    )
    return F.transform(
        sizes,
        lambda _, i: F.aggregate(F.slice(blocks, 1, F.floor(i / BLOCK).cast("int")), zero, add)
        + F.aggregate(F.slice(sizes, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), zero, add),
    )


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_spans.

    loss_spans: array of (start, length), in characters of ``formatted``, of the escaped texts of the roles to train on.
    """
    empty = F.lit("")
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        escape(F.coalesce(F.col("role").cast("string"), empty)).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), empty)).alias("text"),
    )
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # What stands before each text: the same role as before goes on, another opens.
    opened = F.transform(
        "turns",
        lambda t, i: F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(NEXT)).otherwise(
            F.concat(F.when(i > 0, F.lit(END)).otherwise(empty), F.lit(START), t["role"], F.lit(TEXT))
        ),
    )
    pieces = turns.select("conv_id", "turns", opened.alias("before"))
    sizes = F.zip_with("before", "turns", lambda b, t: (F.length(b) + F.length(t["text"])).cast("long"))
    placed = pieces.select(
        "conv_id", "turns", "before", _prefix_sums(sizes).alias("at"),
        F.concat(F.array_join(F.zip_with("before", "turns", lambda b, t: F.concat(b, t["text"])), ""), F.lit(END)).alias("formatted"),
    )
    spans = F.transform(
        F.filter(F.arrays_zip("turns", "before", "at"), lambda x: x["turns"]["role"].isin(*loss_roles)),
        lambda x: F.struct((x["at"] + F.length(x["before"])).alias("start"), F.length(x["turns"]["text"]).cast("long").alias("length")),
    )
    return placed.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    literal = lambda s: s.replace("|", r"\|")
    blocks = F.split(F.substring(formatted, 1, F.length(formatted) - len(END)), literal(END))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, TEXT, -1), literal(NEXT), -1),
                lambda x: F.struct(
                    unescape(F.substring(F.substring_index(b, TEXT, 1), len(START) + 1, 1 << 30)).alias("role"), unescape(x).alias("text")
                ),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation's turns and loss text, read back from the formatted strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    done = format_conversations(rows.unionByName(planted))
    read = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_AFTER_SQL = r"(\|(?:start|text|next|end|im_start|im_end|endoftext)\||/?s>|/?INST\])"

OP1_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
    length(regexp_replace(text, '([<\[])(\\*){_AFTER_SQL}', '\1\\\2\3', 'g')) AS chars
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + {len(END)} + sum(CASE WHEN prior IS NULL THEN {len(START) + len(TEXT)} + length(role)
    WHEN prior = role THEN {len(NEXT)} ELSE {len(START) + len(TEXT) + len(END)} + length(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
