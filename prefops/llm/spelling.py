"""Spelling variants: words at one edit from each other, and the frequent form that each belongs to.

The letters of a word with their multiplicity are a set (a binary vector over
letter and copy). One inserted or deleted letter changes one element of it, a
replaced one two. So words at one edit have vectors at a Hamming distance of two
at most, and PartEnum signatures find them: the elements are dealt into parts, and
every choice of all parts but two is a signature; two elements touch two parts at
most, so the two words share the signature of the rest. Words at one edit also
share their first or their last letters, as many as half of the shortest word,
so each signature is taken twice, with either end. Words that share a signature
meet in an equi-join and are compared there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.llm import text as tx
from prefops.llm.frames import bounded_batches, quoted
from prefops.sources import io

#: Parts that the letters are dealt into, and how many of them a signature leaves out.
PARTS, LEFT_OUT = 6, 2
#: A task hands its counts on when it holds so many different words.
MOST_WORDS = 200_000
#: Words whose signatures are made at once.
BLOCK = 1 << 13


def planted_change(key: str | None, word: str) -> str:
    """The word without one letter where 199 divides the checksum of `key:word`; without a key, the word."""
    if key is None:
        return word
    h = zlib.crc32(f"{key}:{word}".encode())
    return word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word


def word_counts(
    df: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = 6, min_count: int = 5, change: Callable[[str | None, str], str] | None = None
) -> DataFrame:
    r"""(word, n): words of all texts with `min_length` letters and `min_count` occurrences in all.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower
    case. `change` may give another word for a key and a word. A null text has no
    words; repeated rows count each; an empty table gives no words.
    """
    bounded_batches(df.sparkSession)
    # A shorter run gives no word: `change` takes letters away at most.
    pattern = re.compile(f"[a-zÀ-ÿ]{{{max(min_length, 1)},}}")

    def counts(batches) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for owner, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not raw.is_valid:
                    continue
                # Bytes are put in lower case, so that only A-Z change.
                own: dict[str, int] = {}
                for found in pattern.finditer(raw.as_buffer().to_pybytes().lower().decode()):
                    word = found[0]
                    own[word] = own.get(word, 0) + 1
                for word, n in own.items():
                    if change is not None:
                        word = change(owner, word)
                        if len(word) < min_length:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > MOST_WORDS:
                    yield handed()
        yield handed()
        tx.release()

    rows = df.select(F.col(quoted(key)).cast("string"), F.col(quoted(text)).cast("string"))
    each = rows.mapInArrow(counts, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def subsets(parts: int, left_out: int) -> list[tuple[int, ...]]:
    return list(combinations(range(parts), parts - left_out))


def signatures(words: list[str], ends: int, parts: int = PARTS, left_out: int = LEFT_OUT) -> np.ndarray:
    """A row of signatures per word: for its first and for its last `ends` letters, one per choice of parts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), sizes)
    # The copies of a letter within its word are neighbours in this order and are numbered.
    order = np.lexsort((letters, owner))
    same = (owner[order] << np.uint64(32)) | letters[order]
    first = np.append(True, same[1:] != same[:-1]) if len(same) else np.zeros(0, bool)
    place = np.arange(len(same))
    copy = place - np.maximum.accumulate(np.where(first, place, 0)) if len(same) else place
    element = tx.mix((same & np.uint64(0xFFFFFFFF)) | (copy.astype(np.uint64) << np.uint64(32)))
    sums = np.zeros((len(words), parts), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, (owner[order].astype(np.int64), (element % np.uint64(parts)).astype(np.int64)), tx.mix(element))
        kept = [tx.mix(sums[:, list(s)].sum(axis=1, dtype=np.uint64) + np.uint64(k + 1)) for k, s in enumerate(subsets(parts, left_out))]
        if not ends:
            return np.stack(kept, axis=1)
        out = []
        for side, cut in enumerate((slice(None, ends), slice(-ends, None))):
            edge = np.fromiter((zlib.crc32(w[cut].encode()) for w in words), np.uint64, len(words))
            out += [tx.mix(k ^ tx.mix(edge + np.uint64(side << 32))) for k in kept]
    return np.stack(out, axis=1)


def signature_rows(words: DataFrame, min_length: int, parts: int = PARTS, left_out: int = LEFT_OUT) -> DataFrame:
    """(sig, word, n): every signature of every word."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                cut = batch.slice(lo, BLOCK)
                sig = signatures(cut.column(0).to_pylist(), min_length // 2, parts, left_out)
                again = pa.array(np.repeat(np.arange(cut.num_rows), sig.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(sig.ravel().view(np.int64)), cut.column(0).take(again), cut.column(1).take(again)], ["sig", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "sig long, word string, n long")


def near_pairs(words: DataFrame, min_length: int = 6, parts: int = PARTS, left_out: int = LEFT_OUT) -> DataFrame:
    """(a, b, a_n, b_n): the pairs a < b of words that differ by one inserted, deleted or replaced letter.

    `words` are (word, n), each word once and of `min_length` letters at least. A
    pair that shares several signatures comes once. The comparison is a part of
    the join, so that only near words leave it.
    """
    if left_out < 2 or parts <= left_out:
        raise ValueError("one replaced letter changes two elements: leave out two parts or more, and keep some")
    sig = signature_rows(words, min_length, parts, left_out)
    a = sig.select("sig", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = sig.select(F.col("sig").alias("b_sig"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = (F.col("sig") == F.col("b_sig")) & (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    # Its size is estimated by that of the words, of which each has many signatures: it must not be broadcast.
    return a.join(b.hint("merge"), near).select("a", "b", "a_n", "b_n").distinct()


def spelling_variants(words: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n).

    A word's form is its most frequent near word (of equally frequent ones the
    smallest), if that is `ratio` times as frequent or more, else null. The root is the
    last of the forms that follow from a word, the word itself if it has none. No
    words give no rows.
    """
    words = io.written(words.select("word", "n"), "words")
    pairs = near_pairs(words, min_length)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    # Tables of words are small as files and large as broadcast rows.
    found = words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    found = io.written(found, "forms")
    # Every step multiplies the count by `ratio`, which bounds the steps; every round doubles those taken.
    most, steps = words.agg(F.max("n")).first()[0] or 0, 0
    while min_count * ratio ** (steps + 1) <= most:
        steps += 1
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range((steps - 1).bit_length() if steps else 0):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = io.written(roots.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
