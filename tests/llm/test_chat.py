import random

from pyspark.sql import functions as F

from tablesense.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def text(t):
    return [("text", t, None, None)]


def test_round_trip_of_texts_made_of_control_strings(spark):
    rng = random.Random(3)
    bits = ["### ", "</turn>", "\n", "\\", "<|", "|>", "#", "<", "/turn>", "assistant: ", "a", "😀", " ", "image 1|>", "\\\\"]
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "a:b", "x\\:", "### r: "]), text("".join(rng.choice(bits) for _ in range(rng.randrange(9)))))
            for i in range(400)]
    out = chat.chat_format(spark.createDataFrame(rows, SCHEMA))
    got = out.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(x.role, x.text) for x in r.t] == [(x[2], x[3][0][1]) for x in mine]
        assert r.m == "".join(x[3][0][1] for x in mine if x[2] == "assistant")


def test_parts_are_numbered_and_counted_in_order(spark):
    rows = [(1, 1, "assistant", [("text", "see", None, None), ("audio", None, "r2", 10), ("text", "two words", None, None)]),
            (1, 0, "user", [("image", None, "r1", 2), ("text", "what is it", None, None), ("document", None, "r0", None), ("video", None, "r9", 3)])]
    r = chat.chat_format(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == ("### user: <|image 1|><|+|>what is it<|+|><|document 2|><|+|><|file 3|></turn>\n"
                           "### assistant: see<|+|><|audio 4|><|+|>two words</turn>\n")
    assert [(a.n, a.kind, a.ref, a.turn_no, a.tokens) for a in r.attachments] == [
        (1, "image", "r1", 1, 512), (2, "document", "r0", 1, 700), (3, "file", "r9", 1, 300), (4, "audio", "r2", 2, 250)]
    assert r.n_tokens == 512 + 3 + 700 + 300 + 1 + 250 + 2
    assert [r.formatted[s.start - 1:s.start - 1 + s.length] for s in r.loss_spans] == ["see", "two words"]


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(None, None, None, None, "c"), (None, 0, "user", text(None), "c"), (2, 1, "user", text("b"), "c"), (2, 1, "user", text("a"), "c"),
            (2, 1, "user", text("a"), "c"), (2, 0, "assistant", [], "c")]
    df = spark.createDataFrame(rows, SCHEMA + ", formatted string")
    got = {r.conv_id: r for r in chat.chat_format(df).collect()}
    assert got[None].formatted == "### : </turn>\n### user: </turn>\n" and got[None].n_turns == 2
    assert got[2].formatted == "### assistant: </turn>\n### user: a</turn>\n### user: a</turn>\n### user: b</turn>\n"
    assert got[2].loss_spans == []


def test_empty_table_and_very_long_conversation(spark):
    assert chat.chat_format(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, i, "assistant" if i % 2 else "user", text(f"turn {i} " * 50)) for i in range(600)]
    out = chat.chat_format(spark.createDataFrame(rows, SCHEMA))
    r = out.select(chat.parse(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    assert [x.text for x in r.t] == [x[3][0][1] for x in rows]
    assert r.m == "".join(x[3][0][1] for x in rows if x[2] == "assistant")


def test_one_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", text("a"))], SCHEMA)
    plan = chat.chat_format(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange ") == 1
