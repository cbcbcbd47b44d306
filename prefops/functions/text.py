"""Rendering and parsing of conversations, prompts, verdicts and step texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prefops import constants as K


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Python's str.strip(): every Unicode blank, not only spaces."""
    return F.btrim(_col(c), F.lit(K.PY_SPACE))


def _needed(c: Column, what: str) -> Column:
    """The text, or an error where it is null: a conversation is never rendered shorter than it is."""
    return F.coalesce(c, F.raise_error(F.lit(what)).cast("string"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_assistant(user: Column, assistant: Column) -> Column:
    """A two-turn conversation."""
    return F.array(message("user", user), message("assistant", assistant))


def render_turns(conv: str | Column) -> Column:
    """Plain turn template; the side of a message follows its index, not its role.

    A message without content is an error.
    """
    turns = F.transform(
        _col(conv),
        lambda m, i: F.concat(
            F.when(i % 2 == 0, F.lit(K.TURN_USER)).otherwise(F.lit(K.TURN_ASSISTANT)),
            _needed(m["content"], "message without content"),
        ),
    )
    return F.concat(F.lit(K.TURN_OPEN), F.array_join(turns, ""), F.lit(K.TURN_CLOSE))


def context_of(conv: str | Column) -> Column:
    """All but the last message."""
    c = _col(conv)
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))


def last_content(conv: str | Column) -> Column:
    c = _col(conv)
    return F.get(c, F.size(c) - 1)["content"]


def pairwise_prompt_text(context: Column, a: Column, b: Column) -> Column:
    """Prompt with blanks around its parts, used for fresh pairs."""
    return F.concat(
        F.lit(K.MARK_CONTEXT + " "), context,
        F.lit(f" {K.MARK_A} "), a,
        F.lit(f" {K.MARK_B} "), b, F.lit(" \n"),
    )


def joined_prompt_text(context: Column, a: Column, b: Column) -> Column:
    """Prompt without added blanks, used for parts that already carry them."""
    return F.concat(F.lit(K.MARK_CONTEXT), context, F.lit(K.MARK_A), a, F.lit(K.MARK_B), b)


def prompt_parts(text: str | Column) -> Column:
    """Non-empty pieces of a pairwise prompt between its three markers."""
    marks = "|".join(re.escape(m) for m in (K.MARK_CONTEXT, K.MARK_A, K.MARK_B))
    return F.filter(F.split(_col(text), marks, -1), lambda x: x != "")


def parse_multiturn(text: str | Column, strict: bool = False) -> Column:
    """Marked text to a conversation.

    Turn 0 is the user's. A later part is `role\\ncontent`; a part without a
    newline has no content: null, or an error when `strict`.
    """
    nl = F.lit("\n")
    missing = (
        F.raise_error(F.lit("multi-turn part has no newline")).cast("string")
        if strict
        else F.lit(None).cast("string")
    )

    def turn(part: Column, i: Column) -> Column:
        first_nl = F.instr(part, nl)
        body = F.when(first_nl > 0, F.rtrim(F.substr(part, first_nl + 1), nl)).otherwise(missing)
        role = F.when(
            (i > 0) & (F.substring_index(part, "\n", 1) == "Assistant"), F.lit("assistant")
        ).otherwise(F.lit("user"))
        content = F.when(i == 0, F.rtrim(part, nl)).otherwise(body)
        return F.struct(role.alias("role"), content.alias("content"))

    return F.transform(F.split(_col(text), re.escape(K.MULTITURN_MARK), -1), turn)


def judge_prompt(conv: str | Column, response_1: str | Column, response_2: str | Column, swapped: bool = False) -> Column:
    """Judge instruction for two responses, in the given or the swapped order.

    A message without content is an error.
    """
    first, second = _col(response_1), _col(response_2)
    if swapped:
        first, second = second, first
    turns = F.transform(
        _col(conv),
        lambda m: F.concat(
            F.when(m["role"] == "user", F.lit(K.JUDGE_USER)).otherwise(F.lit(K.JUDGE_ASSISTANT)),
            _needed(m["content"], "message without content"),
        ),
    )
    fill = {"conversation": strip(F.array_join(turns, "")), "response_1": first, "response_2": second}
    pieces = re.split(r"\{(\w+)\}", K.JUDGE_TEMPLATE)
    return F.concat(*[fill[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])


def parse_verdict(text: str | Column) -> Column:
    """A, B, FORMAT-ERROR or API-ERROR from a judge's raw answer."""
    raw = _col(text)
    said = F.ltrim(F.lower(strip(raw)), F.lit("*_ "))

    def names(letter: str) -> Column:
        return (said == letter) | said.startswith(letter + " ")

    return (
        F.when(raw == K.API_ERROR, F.lit(K.API_ERROR))
        .when(names("a"), F.lit("A"))
        .when(names("b"), F.lit("B"))
        .otherwise(F.lit(K.FORMAT_ERROR))
    )


def render_chat(conv: str | Column, prefix_by_role: Mapping[str, str], suffix: str = "", bos: str = "") -> Column:
    """A model's chat template given as parameters; `bos` is removed wherever it occurs.

    A message without content, or whose role has no prefix, is an error.
    """
    prefixes = F.create_map(*[F.lit(x) for kv in prefix_by_role.items() for x in kv])
    turns = F.transform(
        _col(conv),
        lambda m: F.concat(
            _needed(F.try_element_at(prefixes, m["role"]), "role without a prefix"),
            _needed(m["content"], "message without content"),
            F.lit(suffix),
        ),
    )
    text = F.concat(F.lit(bos), F.array_join(turns, ""))
    return F.replace(text, F.lit(bos), F.lit("")) if bos else text


def split_steps(answer: str | Column, model_type: str = "Mistral") -> Column:
    """Step texts of an answer, stripped; empty steps are kept."""
    return F.transform(F.split(_col(answer), K.STEP_SEPARATOR[model_type], -1), strip)


def prm_dialogue(prompt: str | Column, steps: str | Column) -> Column:
    """One user turn per step, each answered by "+"; the first one carries the prompt."""
    p, s = _col(prompt), _col(steps)
    return F.flatten(
        F.transform(
            s,
            lambda t, i: user_assistant(
                F.when(i == 0, F.concat(p, F.lit(" "), t)).otherwise(t), F.lit("+")
            ),
        )
    )


def orm_dialogue(prompt: str | Column, answer: str | Column, model_type: str = "Mistral") -> Column:
    """The whole answer as a single user turn, answered by "+"."""
    a = _col(answer)
    if model_type == "Mistral":
        a = F.replace(a, F.lit(K.STEP_TAG), F.lit(""))
    return user_assistant(F.concat(_col(prompt), F.lit(" "), a), F.lit("+"))


def parse_sign(text: str | Column, strict: bool = False) -> Column:
    """1 for "+", 0 for "-", else null, or an error when `strict`."""
    t = _col(text)
    other = (
        F.raise_error(F.lit("sign must be + or -")).cast("int") if strict else F.lit(None).cast("int")
    )
    return F.when(t == "+", F.lit(1)).when(t == "-", F.lit(0)).otherwise(other)


def truncate_left(ids: str | Column, max_len: int) -> Column:
    """The last `max_len` tokens."""
    c = _col(ids)
    return F.slice(c, F.greatest(F.size(c) - max_len + 1, F.lit(1)), F.lit(max_len))


def last_subsequence(ids: str | Column, pattern: Iterable[int], strict: bool = False) -> Column:
    """0-based start of the last place where `pattern` occurs, else null (or an error)."""
    c, pat = _col(ids), list(pattern)

    def starts_here(x: Column, i: Column) -> Column:
        hit = x == pat[0]
        for k, token in enumerate(pat[1:], start=1):
            hit = hit & (F.get(c, i + k) == token)
        return F.when(hit, i)

    at = F.array_max(F.transform(c, starts_here))
    if strict:
        return F.coalesce(at, F.raise_error(F.lit("token pattern not found")).cast("int"))
    return at


def token_length(text: str | Column, tokenizer: Callable[[], Callable[[str], list]] | None = None) -> Column:
    """Number of tokens: blank-separated words, or those of a tokenizer.

    `tokenizer` makes the encode function; it is called once per batch of rows
    inside the task, so a factory that caches its vocabulary loads it once per
    Python worker.
    """
    if tokenizer is None:
        return F.regexp_count(_col(text), F.lit(r"\S++"))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = tokenizer()
        return texts.map(lambda t: len(encode(t)), na_action="ignore").astype("Int32")

    return count(_col(text))
