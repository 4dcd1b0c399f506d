from pyspark.sql import functions as F

from lodestrata.llm.chat import END, NEXT, START, TEXT, escape, format_conversations, read_loss, read_turns, unescape

HARD = ["", "</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST]", START + TEXT + NEXT + END, "<|end|", "<<|end|>", "a\nb", "é😀 <s", "x" * 50_000, "\\<s>"]


def test_escape_is_reversible_and_hides_control_strings(spark):
    rows = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in rows.withColumn("back", unescape(F.col("e"))).collect():
        assert r["back"] == r["t"]
        assert not any(c in r["e"] for c in (START, TEXT, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]"))


def test_round_trip_and_loss(spark):
    turns = [(1, i, ("user", "assistant", "assistant", "system", None)[i % 5], t) for i, t in enumerate(HARD * 60)]
    turns += [(2, 5, "assistant", None), (2, 5, "assistant", None), (2, 1, "user", "q"), (None, 0, "assistant", "x"), (3, 0, "user", "only")]
    rows = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    done = format_conversations(rows)
    got = {r["conv_id"]: r for r in done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert [tuple(x) for x in got[conv]["t"]] == [x[1:] for x in own]
        assert got[conv]["loss"] == "".join(x[2] for x in own if x[1] == "assistant")
    assert got[2]["formatted"].count(NEXT) == 1 and got[2]["formatted"].count(START) == 2
    assert format_conversations(rows.limit(0)).count() == 0
