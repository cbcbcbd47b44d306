import pytest
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import text as X
from prefops.operators import steps

CONV = "array<struct<role:string,content:string>>"


def conv(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def value(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_strip_removes_what_python_strips(spark):
    blanks = "".join(chr(c) for c in range(0x110000) if not chr(c).strip() and c)
    assert set(blanks) == set(K.PY_SPACE)
    texts = [f"{b}a{b}b{b}" for b in K.PY_SPACE] + ["", K.PY_SPACE, " x​ "]
    assert value(spark, [(t,) for t in texts], "t string", X.strip("t")) == [t.strip() for t in texts]


def test_render_turns_follows_index_not_role(spark):
    rows = [
        (conv(("user", "Why?")),),
        (conv(("assistant", "a"), ("user", "b"), ("user", "c")),),
        ([],),
    ]
    assert value(spark, rows, f"c {CONV}", X.render_turns("c")) == [
        "\n\n<turn> user\n Why?\n",
        "\n\n<turn> user\n a\n<turn> assistant\n b\n<turn> user\n c\n",
        "\n\n",
    ]


def test_pairwise_prompt_has_blanks_around_its_parts(spark):
    text = X.pairwise_prompt_text(F.lit("\n\n<turn> user\n Q\n"), F.lit("first"), F.lit("second"))
    assert value(spark, [(1,)], "i int", text) == [
        "[CONTEXT] \n\n<turn> user\n Q\n [RESPONSE A] first [RESPONSE B] second \n"
    ]


def test_context_and_last(spark):
    rows = [(conv(("user", "a"), ("assistant", "b")),), ([],)]
    df = spark.createDataFrame(rows, f"c {CONV}")
    got = df.select(F.size(X.context_of("c")), X.last_content("c")).collect()
    assert [tuple(r) for r in got] == [(1, "b"), (0, None)]


@pytest.mark.parametrize(
    ("text", "turns"),
    [
        ("only\n\n", [("user", "only")]),
        ("q\n<extra_id_1>Assistant\na\n\n<extra_id_1>User\nb\n", [("user", "q"), ("assistant", "a"), ("user", "b")]),
        ("q<extra_id_1>Other\nx", [("user", "q"), ("user", "x")]),
        ("q<extra_id_1>Assistant", [("user", "q"), ("assistant", None)]),
        ("q\n<extra_id_1>Assistant\nl1\nl2\n", [("user", "q"), ("assistant", "l1\nl2")]),
        ("", [("user", "")]),
    ],
)
def test_parse_multiturn(spark, text, turns):
    (got,) = value(spark, [(text,)], "t string", X.parse_multiturn("t"))
    assert [(m["role"], m["content"]) for m in got] == turns


def test_parse_multiturn_strict_fails_without_newline(spark):
    with pytest.raises(Exception, match="no newline"):
        value(spark, [("q<extra_id_1>Assistant",)], "t string", X.parse_multiturn("t", strict=True))


@pytest.mark.parametrize(
    ("said", "verdict"),
    [
        ("API-ERROR", "API-ERROR"),
        (" \tA\n", "A"),
        ("*_ a", "A"),
        ("A great pair", "A"),
        ("Answer", "FORMAT-ERROR"),
        ("", "FORMAT-ERROR"),
        (" \n\t ", "FORMAT-ERROR"),
        ("**B** is", "FORMAT-ERROR"),
        ("__b is better", "B"),
        ("b", "B"),
        ("A\tthen", "FORMAT-ERROR"),
    ],
)
def test_parse_verdict(spark, said, verdict):
    assert value(spark, [(said,)], "t string", X.parse_verdict("t")) == [verdict]


def test_judge_prompt_strips_the_conversation_and_swaps(spark):
    rows = [(conv(("user", "hi \n"), ("system", " x ")), "one", "two")]
    df = spark.createDataFrame(rows, f"c {CONV}, a string, b string")
    first, second = df.select(
        X.judge_prompt("c", "a", "b"), X.judge_prompt("c", "a", "b", swapped=True)
    ).first()
    body = "### Conversation\n<|USER|>\nhi \n\n<|ASSISTANT|>\n x\n\n### Response A\n"
    assert first.endswith(body + "one\n\n### Response B\ntwo")
    assert second.endswith(body + "two\n\n### Response B\none")


def test_render_chat_removes_bos_everywhere(spark):
    rows = [(conv(("user", "a<s>b"), ("assistant", "c")),)]
    text = X.render_chat("c", {"user": "U:", "assistant": "A:"}, "|", "<s>")
    assert value(spark, rows, f"c {CONV}", text) == ["U:ab|A:c|"]


@pytest.mark.parametrize(
    ("answer", "kind", "parts"),
    [
        ("a ки\nb ки", "Mistral", ["a", "b ки"]),
        ("a ки\nb ки\n", "Mistral", ["a", "b", ""]),
        ("plain", "Mistral", ["plain"]),
        ("", "Mistral", [""]),
        (" a\n\n\n\nb ", "Deepseek", ["a", "", "b"]),
    ],
)
def test_split_steps(spark, answer, kind, parts):
    assert value(spark, [(answer,)], "t string", X.split_steps("t", kind)) == [parts]


def test_step_dialogue(spark):
    """Seven steps become fourteen turns; the prompt stands before the first."""
    answer = "\n\n".join(f"step {i}" for i in range(7))
    (got,) = value(spark, [("Q.", answer)], "p string, a string", X.prm_dialogue("p", X.split_steps("a", "Deepseek")))
    assert [(m["role"], m["content"]) for m in got[:4]] == [
        ("user", "Q. step 0"),
        ("assistant", "+"),
        ("user", "step 1"),
        ("assistant", "+"),
    ]
    assert len(got) == 14
    (whole,) = value(spark, [("Q.", answer)], "p string, a string", X.orm_dialogue("p", "a", "Deepseek"))
    assert [(m["role"], m["content"]) for m in whole] == [("user", f"Q. {answer}"), ("assistant", "+")]


def test_prefixes_grow_by_one_step(spark):
    df = spark.createDataFrame([(1, 0, "Q.", "a ки\nb ки\nc")], "q_id int, ans_idx int, prompt string, answer string")
    got = {r["step"]: [m["content"] for m in r["dialogue"]] for r in steps.prefix_dialogues(df).collect()}
    assert got == {0: ["Q. a", "+"], 1: ["Q. a", "+", "b", "+"], 2: ["Q. a", "+", "b", "+", "c", "+"]}


def test_orm_dialogue_drops_the_step_tag(spark):
    (got,) = value(spark, [("a ки\nb ки",)], "t string", X.orm_dialogue(F.lit("Q"), "t"))
    assert got[0]["content"] == "Q a\nb"


@pytest.mark.parametrize(
    ("ids", "at"),
    [([2, 3, 0, 2, 3], 3), ([2, 3, 1], 0), ([1, 2], None), ([2], None), ([], None), ([0, 2, 3], 1), ([2, 2, 3], 1)],
)
def test_last_subsequence(spark, ids, at):
    assert value(spark, [(ids,)], "ids array<int>", X.last_subsequence("ids", [2, 3])) == [at]


def test_last_subsequence_strict(spark):
    for family in K.PROMPT_END_TOKENS.values():
        ids = [1, *family, 7, *family, 9]
        assert value(spark, [(ids,)], "ids array<int>", X.last_subsequence("ids", family, strict=True)) == [7]
    with pytest.raises(Exception, match="not found"):
        value(spark, [([1],)], "ids array<int>", X.last_subsequence("ids", [2, 3], strict=True))


@pytest.mark.parametrize(("n", "kept"), [(2, [3, 4]), (4, [1, 2, 3, 4]), (9, [1, 2, 3, 4])])
def test_truncate_left(spark, n, kept):
    assert value(spark, [([1, 2, 3, 4],)], "ids array<int>", X.truncate_left("ids", n)) == [kept]


def test_token_length_with_and_without_tokenizer(spark):
    rows = [("a  b\nc ",), ("",), (None,)]
    assert value(spark, rows, "t string", X.token_length("t")) == [3, 0, None]
    assert value(spark, rows, "t string", X.token_length("t", lambda: list)) == [7, 0, None]


def test_orm_training_row(spark):
    def rows(text, sign):
        return [(1, conv(("user", text), ("assistant", sign)))]

    text = "Q " + "".join(f"Step {i}: s{i} " for i in range(1, 12))
    df = spark.createDataFrame(rows(text, "+"), f"id int, conversations {CONV}")
    got = steps.orm_training_row(df).first()
    assert (got["question"], got["label"]) == ("Q ", 1)
    assert got["answer"].endswith("Step 9: s9 ")
    assert steps.orm_training_row(df, exact=True).first()["answer"].endswith("Step 11: s11 ")
    bad_sign = spark.createDataFrame(rows("Q Step 1: x", "?"), f"id int, conversations {CONV}")
    no_step = spark.createDataFrame(rows("Q", "-"), f"id int, conversations {CONV}")
    assert steps.orm_training_row(bad_sign, strict=False).first()["label"] is None
    assert steps.orm_training_row(no_step, strict=False).first()["answer"] is None
    for df in (bad_sign, no_step):
        with pytest.raises(Exception, match="sign must be|no step marker"):
            steps.orm_training_row(df).collect()
