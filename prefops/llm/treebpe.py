"""BPE with word ends over texts of any length, by tree concatenation.

A long text is cut into segments that are encoded in parallel, each as if its text
stood alone. Then neighbours are joined in a tree: a window around the joint is
encoded again and grows until it agrees with both sides. Two facts make the result
exact. Where a word begins depends on a few characters around that place. And a
list of tokens is the BPE of a word if every two neighbours of it are, since the
first merge across a border would also happen to the two tokens alone. So where
the outer tokens of the window are those of the halves, all tokens of the
left half before them, those of the window and all of the right half after them
are what the whole text gives.

A word that goes on beyond a segment is encoded with an open end: by the same
merges, but its last letter doesn't bear the mark of a word's end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.llm import text as tx
from prefops.llm.frames import bounded_batches, quoted, without
from prefops.llm.secrets import local_file, vocabulary_file

#: Characters of a segment; a text of so many at most is encoded in one go.
SEGMENT = 1 << 14
#: Bytes around a place that decide whether a word begins there: four characters.
CONTEXT = 16
#: Characters that are normalised at once.
SLICE = 1 << 16
#: Characters of words that a worker remembers with their ids, and of the longest such word.
KNOWN_CHARS, KNOWN_WORD = 4 << 20, 40
#: Below this code point no character combines with others.
FIRST_MARK = 0x300

_BEYOND = re.compile(f"[{chr(FIRST_MARK)}-\U0010ffff]")
_ASCII = re.compile("[\0-\x7f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_LETTERS = {b: ord(c) for b, c in enumerate(byte_letters())}


def as_letters(word: str) -> str:
    return word.encode().decode("latin-1").translate(_LETTERS)


class Part(NamedTuple):
    """A piece of text, its ids as if it stood alone, and the byte where each begins."""

    text: bytes
    ids: np.ndarray
    starts: np.ndarray


class WordBpe:
    """The tokenizer of a file, by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.closed, self.open = self.tok.model, models.BPE(vocab=model["vocab"], merges=merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        top = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.strings: list[str | None] = [None] * top
        self.closes = np.zeros(top, bool)
        for s, i in model["vocab"].items():
            self.strings[i], self.closes[i] = s, s.endswith(self.end)
        for s, i in self.special.items():
            self.strings[i] = s
        self.bytes = np.array([len((s or "").removesuffix(self.end) if c else s or "") for s, c in zip(self.strings, self.closes.tolist(), strict=True)], np.int64)
        self.pattern = re.compile(self._pattern())
        self.known: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def _pattern(self) -> str:
        """The pre-token pattern for characters below FIRST_MARK, whose classes the library's own pattern tells."""
        cut = lambda s: len(self.tok.pre_tokenizer.pre_tokenize_str(s))
        every = [chr(c) for c in range(FIRST_MARK)]
        letters = [c for c in every if cut("a" + c + "a") == 1]
        spaces = [c for c in every if cut(c) == 0]
        digits = [c for c in every if c not in letters and c not in spaces and cut("!" + c + "!") == 3]
        some = lambda chars: "".join(map(re.escape, chars))
        return f"'(?:s|t|re|ve|m|ll|d)|[{some(letters)}]+|[{some(digits)}]|[^{some(letters + digits + spaces)}]+"

    def normal(self, text: str) -> Iterator[str]:
        """A text's normal form, in slices that end before an ASCII character, which combines with none before it."""
        if _BEYOND.search(text) is None:
            # Nothing combines, and the lower case of one such character doesn't depend on others.
            yield text.lower()
            return
        lo = 0
        while lo < len(text):
            edge = _ASCII.search(text, lo + SLICE)
            hi = edge.start() if edge else len(text)
            yield self.tok.normalizer.normalize_str(text[lo:hi])
            lo = hi

    def words(self, text: str) -> Iterator[tuple[int, str]]:
        """(first character, word) of the words of a text in normal form."""
        if _BEYOND.search(text) is None:
            for m in self.pattern.finditer(text):
                yield m.start(), m[0]
        else:
            for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text):
                yield a, text[a:b]

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            ids = tuple(t.id for t in self.closed.tokenize(as_letters(word)))
            if len(word) <= KNOWN_WORD:
                if self.chars > KNOWN_CHARS:
                    self.known, self.chars = {}, 0
                self.known[word] = ids
                self.chars += len(word)
        return ids

    def part(self, text: str, goes_on: bool) -> Part:
        """A piece in normal form by itself; if it goes on, a word at its end is left open."""
        raw, n = text.encode(), len(text)
        begins, runs = [], []
        for a, word in self.words(text):
            begins.append(a)
            runs.append([t.id for t in self.open.tokenize(as_letters(word))] if goes_on and a + len(word) == n else self.word(word))
        flat = tx.runs_of(runs)
        at = np.array(begins, np.int64)
        if len(raw) != n:
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[at] if len(at) else at
        # Tokens of a word follow each other; every word begins at its own byte.
        sizes = self.bytes[flat.values]
        ends = np.append(0, np.cumsum(sizes))
        first = np.append(0, flat.ends[:-1]).astype(np.int64)[: len(at)]
        starts = ends[:-1] + np.repeat(at - ends[first], np.diff(flat.ends, prepend=0)) if len(at) else np.zeros(0, np.int64)
        return Part(raw, flat.values, starts)

    def join(self, a: Part, b: Part, goes_on: bool) -> Part:
        """The tokens of two neighbouring pieces as one."""
        raw, mid = a.text + b.text, len(a.text)
        a_ends, b_ends = a.starts + self.bytes[a.ids], b.starts + self.bytes[b.ids]
        reach = 4 * CONTEXT
        while True:
            x = int(np.searchsorted(a.starts, mid - reach, side="right")) - 1
            while x > 0 and raw[a.starts[x]] & 0xC0 == 0x80:
                x -= 1
            y = int(np.searchsorted(b_ends, reach))
            while y < len(b.ids) - 1 and mid + b_ends[y] < len(raw) and raw[mid + b_ends[y]] & 0xC0 == 0x80:
                y += 1
            x, y = max(x, 0), min(y, len(b.ids) - 1)
            whole_left, whole_right = x == 0, y >= len(b.ids) - 1
            lo = 0 if whole_left else int(a.starts[x])
            hi = len(raw) if whole_right else mid + int(b_ends[y])
            # The window ends within a word if the last token doesn't close one.
            within = goes_on if whole_right else not self.closes[b.ids[y]]
            w = self.part(raw[lo:hi].decode(), within)
            w_starts = w.starts + lo
            w_ends = w_starts + self.bytes[w.ids]
            left = whole_left or (
                a.starts[x] + 2 * CONTEXT <= mid and _same(a.starts[x:], a.ids[x:], w_starts, w.ids, lambda s: s < lo + CONTEXT)
            )
            right = whole_right or (
                b_ends[y] >= 2 * CONTEXT and _same(b_ends[: y + 1] + mid, b.ids[: y + 1], w_ends, w.ids, lambda e: e > hi - CONTEXT)
            )
            if left and right:
                head = 0 if whole_left else x
                tail = len(b.ids) if whole_right else y + 1
                ids = np.concatenate([a.ids[:head], w.ids, b.ids[tail:]])
                return Part(raw, ids, np.concatenate([a.starts[:head], w_starts, b.starts[tail:] + mid]))
            reach *= 4

    def tree(self, parts: list[Part], goes_on: bool = False) -> Part:
        """Successive pieces as one, halves first."""
        if len(parts) == 1:
            return parts[0]
        half = len(parts) // 2
        return self.join(self.tree(parts[:half], True), self.tree(parts[half:], goes_on), goes_on)

    def pieces(self, text: str) -> Iterator[tuple[int | None, str]]:
        """The ids of special tokens in a text, and the text between."""
        for i, piece in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                yield self.special[piece], ""
            elif piece:
                yield None, piece

    def short(self, text: str) -> list[int]:
        """The ids of a text in one go."""
        ids: list[int] = []
        for special, piece in self.pieces(text):
            if special is not None:
                ids.append(special)
            else:
                for _, word in self.words("".join(self.normal(piece))):
                    ids += self.word(word)
        return ids


def _same(at: np.ndarray, ids: np.ndarray, w_at: np.ndarray, w_ids: np.ndarray, edge: Callable[[np.ndarray], np.ndarray]) -> bool:
    """Whether two lists of tokens have the same ones, and some, at the edge of a window."""
    mine, theirs = edge(at), edge(w_at)
    return bool(mine.any()) and np.array_equal(at[mine], w_at[theirs]) and np.array_equal(ids[mine], w_ids[theirs])


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _segments(bpe: WordBpe, text: str, size: int) -> Iterator[tuple[int | None, str, bool]]:
    """(special id, text in normal form, whether it goes on) of the segments of a text."""
    for special, piece in bpe.pieces(text):
        if special is not None:
            yield special, "", False
            continue
        held = ""
        for more in bpe.normal(piece):
            held += more
            while len(held) > size:
                yield None, held[:size], True
                held = held[size:]
        yield None, held, False


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(key, n_tokens, ids) of every row of df, without special tokens around it.

    `tokenizer` is the path of a tokenizer file: BPE over bytes with a mark at
    the end of words, normal form and lower case first. Strings of its special
    tokens within a text are those tokens, as its library has it.

    A null or empty text has no ids. Repeated rows and keys, and null keys, give a
    row each. An empty table gives an empty one. Other columns are not looked at.
    Texts of more than `segment` characters are dealt out by segment; all ids of a
    text meet in the task that returns them. Rows that may come in another order
    when they are read again should be written first.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    name = vocabulary_file(spark, tokenizer)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    is_long = F.coalesce(F.char_length("text") > segment, F.lit(False))
    out_type = f"key {kind}, n_tokens long, ids array<int>"

    def whole(batches):
        bpe = word_bpe(local_file(name))
        for batch in batches:
            for lo, hi in tx.pieces(batch.column(1)):
                runs = tx.runs_of([bpe.short(t.as_py() or "") for t in batch.column(1).slice(lo, hi - lo)])
                yield _lists(batch.column(0).slice(lo, hi - lo), runs)
        tx.release()

    def cut(batches):
        bpe = word_bpe(local_file(name))
        task, row = TaskContext.get().partitionId(), 0
        names = ["row", "seq", "key", "special", "text", "goes_on"]
        for batch in batches:
            for k in range(batch.num_rows):
                row += 1
                for seq, (special, piece, goes_on) in enumerate(_segments(bpe, batch.column(1)[k].as_py(), segment)):
                    columns = [[(task << 33) + row], [seq], None, [special], [piece], [goes_on]]
                    types = [pa.int64(), pa.int32(), None, pa.int32(), pa.string(), pa.bool_()]
                    arrays = [batch.column(0).slice(k, 1) if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)
        tx.release()

    def halves(batches):
        bpe = word_bpe(local_file(name))
        for batch in batches:
            ids, starts = [], []
            for special, piece, goes_on in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
                part = bpe.part(piece, goes_on) if special is None else Part(b"", np.array([special], np.int32), np.zeros(1, np.int64))
                ids.append(part.ids.astype("<i4").tobytes())
                # Where tokens begin grows by a few bytes from one to the next.
                starts.append(np.diff(part.starts, prepend=0).astype("<u2" if len(part.text) < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(starts, pa.binary())], [*batch.schema.names, "ids", "starts"])
        tx.release()

    def joined(table: pa.Table) -> pa.Table:
        bpe = word_bpe(local_file(name))
        table = table.sort_by("seq")
        out, run = [], []
        columns = [table[c].to_pylist() for c in ("special", "text", "goes_on", "ids", "starts")]
        for special, piece, goes_on, ids, starts in zip(*columns, strict=True):
            tokens = np.frombuffer(ids, "<i4")
            if special is not None:
                out.append(tokens)
                continue
            raw = piece.encode()
            run.append(Part(raw, tokens, np.cumsum(np.frombuffer(starts, "<u2" if len(raw) < 1 << 16 else "<u4"), dtype=np.int64)))
            if not goes_on:
                out.append(bpe.tree(run).ids)
                run = []
        flat = np.concatenate([*out, np.zeros(0, np.int32)]).astype(np.int32)
        return pa.Table.from_batches([_lists(table["key"].slice(0, 1).combine_chunks(), tx.Runs(flat, np.array([len(flat)])))])

    short = rows.where(~is_long).mapInArrow(whole, out_type)
    schema = f"row long, seq int, key {kind}, special int, text string, goes_on boolean"
    dealt = rows.where(is_long).mapInArrow(cut, schema).repartition("row", "seq")
    tokens = dealt.mapInArrow(halves, schema + ", ids binary, starts binary")
    long = tokens.groupBy("row").applyInArrow(joined, out_type)
    return short.union(long).withColumnRenamed("key", key)


def _lists(keys: pa.Array, runs: tx.Runs) -> pa.RecordBatch:
    ends = np.append(0, runs.ends).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.asarray(runs.values, np.int32)))
    return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(ends)), lists], ["key", "n_tokens", "ids"])


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The rows of df with the text of their ids (decoded), and the ids as little-endian 32-bit numbers (packed).

    As the tokenizer file names no decoder, the text is the tokens' strings with
    blanks between, special tokens included; null and unknown ids have no string,
    and no place in `packed` if null. A null list decodes to null. Columns of df
    that have the name of an added one are replaced.
    """
    bounded_batches(df.sparkSession)
    name = vocabulary_file(df.sparkSession, tokenizer)
    kept = without(df.columns if keep is None else keep, ["decoded", "packed"])
    source = df.select(*(F.col(quoted(c)) for c in kept), F.col(quoted(ids)).cast("array<int>").alias("__ids"))
    n = len(kept)
    types = source.select(*kept).schema.add("decoded", "string").add("packed", "binary")

    def run(batches):
        strings = word_bpe(local_file(name)).strings
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                cut = batch.slice(lo, 64)
                decoded, raw = [], []
                for one in cut.column(n):
                    numbers = None if not one.is_valid else one.values.drop_null().to_numpy()
                    known = None if numbers is None else numbers[(numbers >= 0) & (numbers < len(strings))].tolist()
                    decoded.append(None if known is None else " ".join([s for i in known if (s := strings[i]) is not None]))
                    raw.append(None if numbers is None else numbers.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*(cut.column(i) for i in range(n)), pa.array(decoded, pa.string()), pa.array(raw, pa.binary())], types.fieldNames())
        tx.release()

    return source.mapInArrow(run, types)
