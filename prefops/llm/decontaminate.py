"""Benchmark decontamination with a suffix automaton of the test items.

All items become one generalised suffix automaton over word numbers. The words
of a text are streamed through it; the automaton's state and the length of the
longest match that ends at a word tell whether a window of `window` item words
ends there and which items hold it. Words that lie in such a window are hit.

Two lookups come before the automaton and change no result: a match of two or
more words only holds pairs of words that occur in an item, so only runs of
such pairs that are long enough are streamed.

Items are taken in blocks of bounded size, each with an automaton of its own and
one pass over the texts that moves no row.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefops.llm import text as tx
from prefops.llm.frames import TEXT, bounded_batches, quoted, without

WINDOW = 10
#: A text of which more than this share of words is hit isn't kept.
MAX_COVERAGE = 0.5
#: Bytes of item text in one automaton: some 10 MB as it is sent to the tasks.
BLOCK_BYTES = 2_000_000

ADDED = "n_words long, n_hit long, items array<string>, hit_spans array<struct<start:long,end:long>>, clean_text string, contaminated boolean, kept boolean"


class Automaton(NamedTuple):
    vocabulary: np.ndarray  # sorted hashes of the item words; a word's place is its number
    sieve: np.ndarray  # whether some item word's hash has these top bits
    pairs: np.ndarray  # sorted numbers of neighbouring words
    shortest: int  # words of the shortest window
    steps: list[dict[int, int]]  # of each state, by word
    link: list[int]
    length: list[int]
    window_state: list[int]  # the suffix of `window` words of a state's words, or -1
    items: dict[int, tuple[str, ...]]  # of the states of whole windows
    short_state: list[int]  # the nearest state among the suffixes that is a short item, or -1
    short_items: dict[int, tuple[str, ...]]


SIEVE_BITS = 22


def automaton(items: list[tuple[str, str | None]], window: int) -> Automaton | None:
    """The automaton of (id, text) pairs; None when no item has a word."""
    column = pa.array([t for _, t in items], pa.string())
    texts = tx.texts_of(column)
    words = tx.words_of(texts, tx.WORD_BYTES)
    vocabulary, numbers = np.unique(tx.hash_spans(texts.data, words.starts, words.ends, fold=True), return_inverse=True)
    lists = [numbers[words.first[i] : words.first[i + 1]].tolist() for i in range(len(items))]
    if not len(vocabulary):
        return None
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def new(state_length: int, copy: dict[int, int], to: int) -> int:
        steps.append(dict(copy))
        link.append(to)
        length.append(state_length)
        return len(steps) - 1

    def extended(last: int, word: int) -> int:
        """The state of the words of `last` and one more."""
        have = steps[last].get(word)
        if have is not None:
            return have if length[have] == length[last] + 1 else split(last, word, have)
        state, p = new(length[last] + 1, {}, 0), last
        while p >= 0 and word not in steps[p]:
            steps[p][word] = state
            p = link[p]
        if p >= 0:
            q = steps[p][word]
            link[state] = q if length[q] == length[p] + 1 else split(p, word, q)
        return state

    def split(p: int, word: int, q: int) -> int:
        clone = new(length[p] + 1, steps[q], link[q])
        link[q] = clone
        while p >= 0 and steps[p].get(word) == q:
            steps[p][word] = clone
            p = link[p]
        return clone

    for numbers_of in lists:
        last = 0
        for w in numbers_of:
            last = extended(last, w)

    order = sorted(range(1, len(steps)), key=length.__getitem__)
    window_state = [-1] * len(steps)
    for s in order:
        if length[s] >= window:
            window_state[s] = s if length[link[s]] < window else window_state[link[s]]
    held: dict[int, set[str]] = {}
    short: dict[int, set[str]] = {}
    for (name, _), numbers_of in zip(items, lists, strict=True):
        s = 0
        for k, w in enumerate(numbers_of):
            s = steps[s][w]
            if k + 1 >= window:
                held.setdefault(window_state[s], set()).add(name)
        if 0 < len(numbers_of) < window:
            short.setdefault(s, set()).add(name)
    short_state = [-1] * len(steps)
    for s in order:
        short_state[s] = s if s in short else short_state[link[s]] if link[s] > 0 else -1
    sizes = [len(x) for x in lists if x]
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[vocabulary >> np.uint64(64 - SIEVE_BITS)] = True
    pairs = np.unique(np.array([a * len(vocabulary) + b for x in lists for a, b in zip(x, x[1:], strict=False)], np.int64))
    return Automaton(
        vocabulary, sieve, pairs, min(window, *sizes) if sizes else window, steps, link, length, window_state,
        {k: tuple(v) for k, v in held.items()}, short_state, {k: tuple(v) for k, v in short.items()},
    )


def _numbers(auto: Automaton, hashes: np.ndarray) -> np.ndarray:
    """The number of each word, -1 for one that no item has."""
    out = np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(auto.sieve[hashes >> np.uint64(64 - SIEVE_BITS)])
    at = np.searchsorted(auto.vocabulary, hashes[maybe])
    at[at == len(auto.vocabulary)] = 0
    out[maybe] = np.where(auto.vocabulary[at] == hashes[maybe], at, -1)
    return out


def matches(auto: Automaton, hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
    """Windows found, as ranges of words, and the items found in each text.

    `hashes` are those of the words of all texts, text i from first[i] on.
    """
    spans: list[tuple[int, int]] = []
    found: dict[int, set[str]] = {}
    numbers = _numbers(auto, hashes)
    known = numbers >= 0
    joined = np.zeros(len(numbers) + 1, bool)  # word i goes on from word i - 1
    joined[1:-1] = known[1:] & known[:-1]
    joined[first] = False
    at = np.flatnonzero(joined)
    if len(auto.pairs):
        key = numbers[at - 1] * len(auto.vocabulary) + numbers[at]
        place = np.minimum(np.searchsorted(auto.pairs, key), len(auto.pairs) - 1)
        joined[at] = auto.pairs[place] == key
    else:
        joined[at] = False
    starts = np.flatnonzero(known & ~joined[:-1])
    ends = np.flatnonzero(known & ~joined[1:]) + 1
    long = ends - starts >= auto.shortest
    owner = np.searchsorted(first, starts[long], side="right") - 1
    steps, link, length = auto.steps, auto.link, auto.length
    for lo, hi, doc in zip(starts[long].tolist(), ends[long].tolist(), owner.tolist(), strict=True):
        state = matched = 0
        for at_word, word in enumerate(numbers[lo:hi].tolist(), lo):
            to = steps[state].get(word)
            while to is None and state > 0:
                state = link[state]
                matched = length[state]
                to = steps[state].get(word)
            state, matched = (to, matched + 1) if to is not None else (0, 0)
            if matched >= window:
                spans.append((at_word + 1 - window, at_word + 1))
                found.setdefault(doc, set()).update(auto.items[auto.window_state[state]])
            s = auto.short_state[state]
            if s == state and matched < length[s]:
                s = auto.short_state[link[s]] if link[s] > 0 else -1
            while s > 0:
                spans.append((at_word + 1 - length[s], at_word + 1))
                found.setdefault(doc, set()).update(auto.short_items[s])
                s = auto.short_state[link[s]] if link[s] > 0 else -1
    return spans, found


def decontaminate(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of df with what they share with the items.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z
    as a-z. A window is `window` successive words of an item; an item of fewer
    words, but not none, is one window. Adds n_words, n_hit (words in a window),
    items (ids of items with a window in the text, in order of their strings),
    hit_spans (ranges of code points, of successive hit words), clean_text (the
    text without these spans), contaminated (n_hit > 0) and kept (no more than
    `max_coverage` of the words is hit).

    A null text has no words and a null clean text. Items without a word have no
    window; an item without an id is found under the id ''. Items with the same
    id count once. An empty table of items hits nothing. Columns of df that have
    the name of an added one are replaced.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    added = T.StructType.fromDDL(ADDED)
    kept = without(df.columns if keep is None else keep, added.fieldNames())
    pairs = items.select(F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit("")).alias("id"), F.col(quoted(item_text)).cast("string").alias("text"))
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    # Found so far: ranges of words, two 32-bit numbers each, and the items' ids.
    rows = df.select(*(F.col(quoted(c)) for c in kept), F.col(quoted(text)).cast("string").alias(TEXT), F.lit(None).cast("binary").alias("__hits"), F.lit(None).cast("array<string>").alias("__items"))
    n = len(kept)
    for block in range(blocks):
        mine = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        auto = spark.sparkContext.broadcast(automaton([(r.id, r.text) for r in mine.distinct().collect()], window))
        last = block == blocks - 1
        types = T.StructType([*rows.schema.fields[:n], *added.fields]) if last else rows.schema  # the text goes on to the next block

        def run(batches, auto=auto, last=last, names=types.fieldNames()):
            for batch in batches:
                for lo, hi in tx.pieces(batch.column(n)):
                    cut = batch.slice(lo, hi - lo)
                    new = _scan(auto.value, *(cut.column(n + k) for k in range(3)), window, max_coverage, last)
                    yield pa.RecordBatch.from_arrays([*(cut.column(i) for i in range(n if last else n + 1)), *new], names)

        rows = rows.mapInArrow(run, types)
    return rows


def _scan(auto, column, hits_before, items_before, window, max_coverage, last) -> list[pa.Array]:
    texts = tx.texts_of(column)
    words = tx.words_of(texts, tx.WORD_BYTES)
    first, n_texts = words.first, len(column)
    spans, found = ([], {}) if auto is None else matches(auto, tx.hash_spans(texts.data, words.starts, words.ends, fold=True), first, window)
    edge = np.zeros(len(words.starts) + 1, np.int64)
    for lo, hi in spans:
        edge[lo] += 1
        edge[hi] -= 1
    for i in np.flatnonzero(np.asarray(hits_before.is_valid())).tolist():
        before = np.frombuffer(hits_before[i].as_py(), np.int32) + first[i]
        np.add.at(edge, before[0::2], 1)
        np.subtract.at(edge, before[1::2], 1)
        found.setdefault(i, set()).update(items_before[i].as_py())
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    # A range of hit words ends with its text, though the next text may begin with one.
    begins, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    edges = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hit))] if len(hit) else first[:0]
    inner = np.unique(edges[hit[edges] & hit[edges - 1]]) if len(edges) else edges
    begins, ends = np.sort(np.append(begins, inner)), np.sort(np.append(ends, inner))
    owner = np.searchsorted(first, begins, side="right") - 1
    ranges: dict[int, list[tuple[int, int]]] = {}
    for doc, lo, hi in zip(owner.tolist(), begins.tolist(), ends.tolist(), strict=True):
        ranges.setdefault(doc, []).append((lo, hi))
    if not last:
        hits = [np.array([w - first[i] for r in ranges[i] for w in r], np.int32).tobytes() if i in ranges else None for i in range(n_texts)]
        return [pa.array(hits, pa.binary()), pa.array([sorted(found[i]) if i in found else None for i in range(n_texts)], pa.list_(pa.string()))]
    n_words, n_hit = np.diff(first), tx.sums_by_text(hit, first)
    char_spans: list[list[dict]] = [[] for _ in range(n_texts)]
    clean = column
    if ranges:
        cleaned = column.to_pylist()
        for i, found_ranges in ranges.items():
            raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
            at, out, chars = 0, [], 0
            for lo, hi in found_ranges:
                a, b = int(words.starts[lo] - texts.offsets[i]), int(words.ends[hi - 1] - texts.offsets[i])
                before, inside = raw[at:a].decode(), raw[a:b].decode()
                char_spans[i].append({"start": chars + len(before), "end": chars + len(before) + len(inside)})
                chars += len(before) + len(inside)
                out.append(before)
                at = b
            cleaned[i] = "".join(out) + raw[at:].decode()
        clean = pa.array(cleaned, pa.string())
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [
        pa.array(n_words), pa.array(n_hit), pa.array([sorted(found.get(i, ())) for i in range(n_texts)], pa.list_(pa.string())),
        pa.array(char_spans, span_type), clean, pa.array(n_hit > 0), pa.array(n_hit <= max_coverage * n_words),
    ]
