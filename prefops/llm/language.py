"""Language identification by word, smoothed over the words of a text.

Every word gets a score per language, from hashed n-grams of its letters counted
over all labelled texts. The scripts of its letters narrow the languages that it
may be in. A Viterbi path over the words, with a penalty for each change of
language, labels spans of mixed text; the text's language is that of most of its
letters.
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
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
#: A language is a candidate for the words of a script if so much of its letters is in it.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
MOST_LANGUAGES = 500

# First and last code point of the main blocks of each script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x137F),),
    "khmer": ((0x1780, 0x17FF),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
}
N_SCRIPTS = len(SCRIPTS) + 1  # the last is any other


def _script_starts() -> tuple[np.ndarray, np.ndarray]:
    edges = sorted((lo, hi, k) for k, ranges in enumerate(SCRIPTS.values()) for lo, hi in ranges)
    starts, script = [0], [len(SCRIPTS)]
    for lo, hi, k in edges:
        starts += [lo, hi + 1]
        script += [k, len(SCRIPTS)]
    return np.array(starts), np.array(script)


_STARTS, _SCRIPT = _script_starts()


class LetterWords:
    """Runs of letters of some texts: byte spans, number of letters, script of the first letter, text and place in it."""

    def __init__(self, texts: tx.Texts):
        data, offsets = texts
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = data if len(lead) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.searchsorted(lead, offsets)
        letter = tx._char_classes()[points] == tx.LETTER
        before, after = np.zeros(len(letter), bool), np.zeros(len(letter), bool)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        full = at[1:] > at[:-1]
        before[at[:-1][full]] = False
        after[at[1:][full] - 1] = False
        starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
        byte_at = np.append(lead, len(data))
        self.starts, self.ends, self.first = byte_at[starts], byte_at[ends], np.searchsorted(starts, at)
        self.letters = ends - starts
        self.script = _SCRIPT[np.searchsorted(_STARTS, points[starts], side="right") - 1] if len(starts) else starts
        #: Code points from the start of the text.
        self.place = starts - np.repeat(at[:-1], np.diff(self.first))


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def word_grams(data: np.ndarray, words: LetterWords) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every word with a mark before and after it; the number of n-grams of each word."""
    sizes = words.ends - words.starts
    # Each word's bytes between two marks (byte 0), all words in one run.
    ends = np.cumsum(sizes + 2)
    run = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    into = np.arange(int(sizes.sum())) + np.repeat(ends - sizes - 1 - np.append(0, np.cumsum(sizes)[:-1]), sizes) if len(sizes) else np.zeros(0, np.int64)
    inside = np.arange(int(sizes.sum())) + np.repeat(words.starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) if len(sizes) else into
    run[into] = _LOWER[data[inside]]
    n = len(run) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = key * np.uint64(257) + run[k : k + n]
    whole = np.ones(len(run), bool)
    for k in range(1, GRAM):
        whole[ends - k] = False
    # A word of a byte has one n-gram, of the byte and both marks.
    bucket = ((key * np.uint64(tx.BASE)) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
    return bucket[whole[:n]], sizes + 3 - GRAM


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray, allowed: np.ndarray):
        self.languages = languages
        self.log_p = log_p  # by bucket and language
        self.allowed = allowed  # by script and language


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows of df with a language; none is left out or sampled."""

    def count(batch, totals):
        for lo, hi in tx.pieces(batch.column(0)):
            texts = tx.texts_of(batch.column(0).slice(lo, hi - lo))
            words = LetterWords(texts)
            grams, sizes = word_grams(texts.data, words)
            langs = np.array(batch.column(1).slice(lo, hi - lo).to_pylist())
            owner = np.repeat(np.arange(hi - lo), np.diff(words.first))
            of_gram = np.repeat(owner, sizes)
            for name in np.unique(langs).tolist():
                mine = langs == name
                total = totals.setdefault(name, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                total[:BUCKETS] += np.bincount(grams[mine[of_gram]], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(words.script[mine[owner]], words.letters[mine[owner]], N_SCRIPTS).astype(np.int64)

    rows = df.where(F.col(quoted(lang)).isNotNull()).select(F.col(quoted(text)).cast("string"), F.col(quoted(lang)).cast("string"))
    names = [r[0] for r in rows.select(F.col(quoted(lang))).distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    totals = total_counts(rows, BUCKETS + N_SCRIPTS, count)
    languages = sorted(totals)
    counts = np.array([totals[x] for x in languages]).reshape(len(languages), BUCKETS + N_SCRIPTS)
    p = counts[:, :BUCKETS] + SMOOTHING
    scripts = counts[:, BUCKETS:]
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T
    allowed[~allowed.any(axis=1)] = True
    # In whole millionths, so that a text's sums don't depend on its neighbours.
    return Model(languages, np.rint(np.log(p / p.sum(axis=1, keepdims=True)).T * 1e6).astype(np.int64), allowed)


IMPOSSIBLE = -(1 << 50)


def word_scores(model: Model, data: np.ndarray, words: LetterWords) -> np.ndarray:
    """By word and language, in millionths of a nat."""
    grams, sizes = word_grams(data, words)
    total = np.zeros((len(grams) + 1, len(model.languages)), np.int64)
    np.cumsum(model.log_p[grams], axis=0, out=total[1:])
    ends = np.append(0, np.cumsum(sizes))
    scores = total[ends[1:]] - total[ends[:-1]]
    scores[~model.allowed[words.script]] = IMPOSSIBLE
    return scores


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: int) -> np.ndarray:
    """The language of every word on each text's best path; ties go to the earlier language.

    A text stays in one language all along if no stretch of words gains half as much
    in another as one change costs: a path of j stretches, none in that language,
    changes j - 1 times, so one of them gains (j - 1) / j of a change. The paths of
    the others step on together, word by word.
    """
    n_texts, n = len(first) - 1, len(scores)
    path = np.zeros(n, np.int64)
    if not n:
        return path
    counts = np.diff(first)
    total = np.zeros((n + 1, scores.shape[1]), np.int64)
    np.cumsum(np.maximum(scores, IMPOSSIBLE // max(1, int(counts.max()))), axis=0, out=total[1:])
    best = np.argmax(total[first[1:]] - total[first[:-1]], axis=1)
    owner = np.repeat(np.arange(n_texts), counts)
    path[:] = best[owner]
    changes = np.zeros(n_texts, bool)
    here = scores[np.arange(n), path]
    for lang in range(scores.shape[1]):
        # What each word gains, cut off where it makes no difference to the question.
        gain = np.clip(scores[:, lang] - here, -10 * penalty, 2 * penalty)
        upto = np.cumsum(gain)
        before = upto - gain
        # Texts lie so far below each other that the least value so far is one of the same text.
        apart = owner * (int(upto.max() - before.min()) + 1 + 10 * penalty)
        least = np.minimum.accumulate(before - apart)
        changes[owner[2 * (upto - apart - least) >= penalty]] = True
    todo = sorted(np.flatnonzero(changes).tolist(), key=lambda i: -counts[i])
    if not todo:
        return path
    begins, sizes = first[todo], counts[todo]
    longest, k, width = int(sizes[0]), len(todo), scores.shape[1]
    value = scores[begins].copy()
    came = [np.zeros((k, width), np.int16)]
    here = np.arange(width)
    for t in range(1, longest):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        top = value[:k].argmax(axis=1)
        moved = value[np.arange(k), top] - penalty
        stay = value[:k] >= moved[:, None]
        came.append(np.where(stay, here, top[:, None]).astype(np.int16))
        value[:k] = np.where(stay, value[:k], moved[:, None]) + scores[begins[:k] + t]
    at = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = int(np.searchsorted(-sizes, -t, side="left")) if t else len(todo)
        path[begins[:k] + t] = at[:k]
        at[:k] = came[t][np.arange(k), at[:k]] if t else at[:k]
    return path


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of df with the language of their texts.

    Adds lang_pred, score (the share of the letters that are in words of that
    language) and lang_spans (lang, start and end in code points, of successive
    words in one language).

    A null text and one without a letter are `und`, with score 0 and no spans, and
    so is every text when the model has no language. Ties go to the language that
    comes first. Columns of df that have the name of an added one are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(column: pa.Array) -> list[pa.Array]:
        model = shared.value
        texts = tx.texts_of(column)
        words = LetterWords(texts)
        n, names = len(column), model.languages
        if not names or not len(words.starts):
            return [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([[]] * n, span_type)]
        path = viterbi(word_scores(model, texts.data, words), words.first, int(penalty * 1e6))
        owner = np.repeat(np.arange(n), np.diff(words.first))
        letters = np.bincount(owner * len(names) + path, words.letters, n * len(names)).reshape(n, len(names))
        best, total = letters.argmax(axis=1), letters.sum(axis=1)
        has = total > 0
        pred = [names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        score = np.where(has, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
        new = np.ones(len(path), bool)
        new[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(path)) - 1
        flat = pa.StructArray.from_arrays([pa.array(np.array(names, object)[path[at]], pa.string()), pa.array(words.place[at]), pa.array(words.place[last] + words.letters[last])], ["lang", "start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[at], np.arange(n + 1)).astype(np.int32)), flat)
        return [pa.array(pred, pa.string()), pa.array(score), spans.cast(span_type)]

    return map_texts(df, text, "lang_pred string, score double, lang_spans array<struct<lang:string,start:long,end:long>>", make, keep)
