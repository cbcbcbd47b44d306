import re

from pyspark.sql import functions as F

from prefops.llm import chat

PARTS = f"array<{chat.PART}>"
TEXTS = ["", "a <|end|>\n<|start|>", "</s>[INST] ok [/INST]", "<\\ [\\ \\< \\\\", "<<|sep|>>", "é中😀 <", "line\nline\n", "\u0000", "x" * 50_000]


def part(kind, text=None, ref=None, tokens=None):
    return (kind, text, ref, tokens)


def table(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}")


def test_texts_come_back_and_no_mark_stays_in_them(spark):
    rows = [(c, k, ["user", "assistant", "</s><|sep|>"][(c + k) % 3], [part("text", t)]) for c in range(3) for k, t in enumerate(TEXTS)]
    out = chat.format_chats(table(spark, rows).repartition(3)).withColumns({"turns": chat.read_turns("formatted"), "loss": chat.read_loss("formatted")})
    for r in out.collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3][0][1]) for x in mine]
        assert r.loss == "".join(x[3][0][1] for x in mine if x[2] == "assistant")
        assert r.n_turns == len(mine)
        assert not re.search(r"</?s>|\[/?INST\]", r.formatted) and r.formatted.count("<|start|>") == len(mine)
        for s, x in zip(r.loss_spans, (x for x in mine if x[2] == "assistant"), strict=True):
            assert r.formatted[s.start : s.end].replace("<\\", "<").replace("[\\", "[") == x[3][0][1]


def test_attachments(spark):
    parts = [part("text", "see "), part("image", ref="i1"), part("audio", ref="a1", tokens=7), None, part(None, "<b>"), part("video", ref="v"), part("document", "ignored", "d")]
    r = chat.format_chats(table(spark, [(1, 1, "assistant", [part("image", ref="i2")]), (1, 0, "user", parts)])).first()
    assert r.formatted == "<|start|>user<|sep|>see <|image|><|audio|><\\b><|other|><|document|><|end|>\n<|start|>assistant<|sep|><|image|><|end|>\n"
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (0, 1, "image", "i1", 256), (0, 2, "audio", "a1", 7), (0, 5, "video", "v", 1), (0, 6, "document", "d", 512), (1, 0, "image", "i2", 256),
    ]
    assert r.attachment_tokens == 256 + 7 + 1 + 512 + 256


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, None, None, None), (None, 0, "user", [part("text", None)]), (4, 1, "user", [part("text", "b")]), (4, 1, "user", [part("text", "a")]), (4, 1, "user", [part("text", "a")])]
    df = table(spark, rows).withColumns({"id": F.lit(1), "n": F.lit(2), "formatted": F.lit("x")})
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("turns", chat.read_turns("formatted")).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("user", "")]
    assert [t.text for t in got[4].turns] == ["a", "a", "b"]
    assert chat.format_chats(table(spark, [])).count() == 0


def test_no_python_runs(spark, sf_dir):
    from prefops.llm.queries import QUERIES

    plan = QUERIES["op2_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_long_conversation(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), chat.text_part(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("parts"))
    r = chat.format_chats(df).withColumn("loss", chat.read_loss("formatted")).first()
    assert r.n_turns == 20_000 and r.loss == "".join(f"t{i}" for i in range(20_000))
