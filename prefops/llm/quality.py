"""Quality rules: is a text more like the trusted texts than like the corpus?

Hashed n-grams of bytes are counted over all trusted texts and over all texts of
the corpus. A text's score is the mean, over its n-grams, of the logarithm of
the ratio of the two multinomials, so its length plays no part. Every text is
held against the same threshold; nothing is drawn at random.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.llm import text as tx
from prefops.llm.counts import total_counts
from prefops.llm.frames import map_texts, quoted

GRAM = 3
BUCKETS = 1 << 16
SMOOTHING = 1.0
MILLION = 1_000_000
THRESHOLD = -0.3

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

_SYMBOLS = tx.class_table(lambda b: chr(b) in "#*$%&|<>" and b < 128)
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def gram_buckets(texts: tx.Texts, gram: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of bytes, and for each text where its n-grams begin."""
    data, offsets = texts
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(gram):
        key = key * np.uint64(257) + data[k : k + n]
    whole = np.ones(len(data), bool)
    for k in range(1, gram):
        edge = offsets[1:] - k
        whole[edge[edge >= offsets[:-1]]] = False
    at = np.flatnonzero(whole[:n])
    bucket = (key[at] * np.uint64(tx.BASE)) >> np.uint64(64 - (buckets - 1).bit_length())
    return bucket.astype(np.int64), np.searchsorted(at, offsets)


def gram_counts(df: DataFrame, text: str, gram: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of df."""

    def count(batch, totals):
        total = totals.setdefault("", np.zeros(buckets, np.int64))
        for lo, hi in tx.pieces(batch.column(0)):
            total += np.bincount(gram_buckets(tx.texts_of(batch.column(0).slice(lo, hi - lo)), gram, buckets)[0], minlength=buckets)

    return total_counts(df.select(F.col(quoted(text)).cast("string")), buckets, count).get("", np.zeros(buckets, np.int64))


def log_ratios(target: np.ndarray, corpus: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(bucket | target) / p(bucket | corpus), in millionths; 0 everywhere without any target text.

    As integers they add up to the same sum in any order.
    """
    if not target.sum():
        return np.zeros(len(target), np.int64)
    p, q = target + smoothing, corpus + smoothing
    return np.rint((np.log(p / p.sum()) - np.log(q / q.sum())) * MILLION).astype(np.int64)


def base_counts(texts: tx.Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = texts
    words = tx.words_of(texts, tx.NOT_SPACE)
    in_word = tx.NOT_SPACE[data]
    chars = tx.sums_by_text(in_word & ((data & 0xC0) != 0x80), offsets)
    symbols = tx.sums_by_text(_SYMBOLS[data], offsets)

    lines = tx.words_of(texts, tx.NOT_NEWLINE)
    has_word = np.append(0, np.cumsum(in_word))
    full = has_word[lines.ends] > has_word[lines.starts]
    of = lines.text_of()[full]
    keys = tx.mix(tx.hash_spans(data, lines.starts, lines.ends)[full] + tx.mix(of.astype(np.uint64)))
    _, first_at = np.unique(keys, return_index=True)
    n = len(offsets) - 1
    dup_lines = np.bincount(of, minlength=n) - np.bincount(of[first_at], minlength=n)

    hashes = tx.hash_spans(data, words.starts, words.ends)
    found, at = tx.windows(hashes, words.first, REPEAT_WINDOW)
    owner = words.text_of()[at]
    twice = at[tx.repeated(tx.mix(found + tx.mix(owner.astype(np.uint64))))]
    repeat = tx.sums_by_text(tx.covered(twice, REPEAT_WINDOW, len(hashes)), words.first)
    return [np.diff(words.first), chars, symbols, dup_lines, repeat]


def score_quality(
    df: DataFrame,
    trusted: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    gram: int = GRAM,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of df with word counts, base rules, the score and the verdict.

    `trusted` holds the texts to be like, in the column `text`. Adds n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams,
    llr and kept. `keep` names the columns of df to return, by default all.

    A null text is an empty one; a text without an n-gram has llr 0, and fails
    the base rules anyway. Equal texts get equal scores. Without trusted texts
    every llr is 0, so only the base rules decide. An empty table gives an empty
    one. Columns of df that have the name of an added one are replaced.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    spark = df.sparkSession
    ratios = log_ratios(gram_counts(trusted, text, gram, buckets), gram_counts(df, text, gram, buckets))
    model = spark.sparkContext.broadcast(ratios)

    def make(column: pa.Array) -> list[pa.Array]:
        texts = tx.texts_of(column)
        counts = base_counts(texts)
        n_words, n_repeat = counts[0], counts[4]
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
        found, first = gram_buckets(texts, gram, buckets)
        n_grams = np.diff(first)
        llr = tx.sums_by_text(model.value[found], first) / (np.maximum(n_grams, 1) * MILLION)
        return [*map(pa.array, counts), pa.array(failed), pa.array(n_grams), pa.array(llr), pa.array(~failed & (llr >= threshold))]

    return map_texts(df, text, BASE_SCHEMA + ", base_failed boolean, n_grams long, llr double, kept boolean", make, keep)
