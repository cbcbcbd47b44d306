"""Chat formatting: conversations of typed content parts as one text each.

A turn's parts are visited in order. Text parts go into the text, escaped; image,
audio, document and other parts leave a placeholder there and are listed with
their reference and the number of tokens that they will take. Turns stand between
marks. Every mark and placeholder begins with `<|`; in texts and roles each `<`
and `[` gets a backslash after it, so that neither these nor other templates'
control strings can occur there, and taking the backslash away again gives the
text back.

Expressions only: one shuffle by conversation, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"
#: Tokens of a part that doesn't tell its own number, by type.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
OTHER_TOKENS = 1

PART = "struct<type:string,text:string,ref:string,tokens:long>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))


def text_part(text: str | Column) -> Column:
    """A list of one text part."""
    text = F.col(text) if isinstance(text, str) else text
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("tokens")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def flatten(parts: Column) -> Column:
    """The parts as one text: escaped texts, and placeholders of all others."""
    kind = lambda p: F.when(p["type"].isin(*PART_TOKENS), p["type"]).otherwise("other")
    one = lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit("|>")))
    return F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), one), ""), F.lit(""))


def attachments(parts: Column, turn: Column) -> Column:
    """The parts that aren't text: turn, place among the turn's parts, type, reference and tokens."""
    tokens = F.lit(OTHER_TOKENS)
    one = lambda p, i: F.struct(
        turn.cast("long").alias("turn"),
        i.cast("long").alias("part"),
        p["type"].alias("type"),
        p["ref"].alias("ref"),
        F.coalesce(p["tokens"], *(F.when(p["type"] == k, F.lit(n)) for k, n in PART_TOKENS.items()), tokens).cast("long").alias("tokens"),
    )
    found = F.filter(F.transform(parts, lambda p, i: F.when(p.isNotNull() & ~_is_text(p), one(p, i))), lambda a: a.isNotNull())
    return F.coalesce(found, F.array().cast("array<struct<turn:long,part:long,type:string,ref:string,tokens:long>>"))


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation, from one row per turn.

    `parts` is a list of struct(type, text, ref, tokens). Returns the
    conversation's id, formatted (the text), n_turns, loss_spans (code points of
    the contents of turns of the `learned` roles, end exclusive), attachments in
    order and attachment_tokens, their sum.

    Turns go by their number, those without one first; equal numbers go by role
    and content, and repeated rows are turns of their own. A null list of parts,
    a null part and a null text are empty, a null role is an empty one; a part
    without a type is text. Rows with a null id are one conversation. An empty
    table gives an empty one; other columns are not looked at. A conversation is
    one record: its text must fit a row.
    """
    cells = turns.select(
        F.col(conversation).alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts")
    ).withColumns({"content": flatten(F.col("parts"))})
    in_order = Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "role", "content", F.to_json("parts"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    placed = (
        cells.withColumns({"n": F.row_number().over(in_order), "piece": F.concat(head, "content", F.lit(END)), "head": F.char_length(head)})
        .withColumns({"before": F.sum(F.char_length("piece").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("piece")})
        .withColumns({"start": F.col("before") + F.col("head"), "listed": attachments(F.col("parts"), F.col("n") - 1)})
    )
    span = F.when(F.col("role").isin(*learned), F.struct("start", (F.col("start") + F.char_length("content")).alias("end")))
    gathered = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", span.alias("span"), "listed"))).alias("turns"))
    out = gathered.select(
        "id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("turns.listed")).alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return out.withColumn("attachment_tokens", total).withColumnRenamed("id", conversation)


def read_turns(formatted: str | Column) -> Column:
    """The turns (role, text) of a formatted text; placeholders stay in the text."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.slice(F.split(formatted, r"\Q" + START + r"\E", -1), 2, 1_000_000_000)
    quoted = lambda s: r"\Q" + s + r"\E"

    def one(piece):
        halves = F.split(piece, quoted(SEP), 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(F.regexp_replace(halves[1], quoted(END) + r"\z", "")).alias("text"))

    return F.transform(pieces, one)


def read_loss(formatted: str | Column, spans: str | Column = "loss_spans") -> Column:
    """The text under the loss mask, unescaped, as one text."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
