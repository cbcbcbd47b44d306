"""Toxicity as ordered grades: cumulative-link regression on the words of a text.

The chance of a grade above g is the logistic function of a weighted sum of the
words that a text holds, less a threshold of g. All grades share the weights;
only the ordered thresholds differ. A text's severity is its expected grade.

Weights are for exact words and beginnings of words, chosen by how their presence differs between grades,
so that a long text doesn't become toxic by the collisions of its many words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.llm import text as tx
from prefops.llm.frames import map_texts, quoted

#: Labelled rows that a model is fitted on, those of the smallest hashes of their ids.
MAX_ROWS = 10_000
MAX_FEATURES = 1024
#: Words also count by their first so many bytes, for families of words and for inflected ones.
BEGINNINGS = (5, 6, 8)
#: A word counts if it is in so many of these rows, and its share differs between grades by so many standard errors.
MIN_ROWS = 3
MIN_Z = 4.0
L2 = 0.5
STEPS = 600
MILLION = 1_000_000


class Model:
    def __init__(self, grades: list[int], words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.grades = grades  # in order
        self.words = words  # hashes in order
        self.weights = weights  # in millionths
        self.thresholds = thresholds  # one less than grades
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[words >> np.uint64(48)] = True

    def at_most(self, total: np.ndarray) -> np.ndarray:
        """The chance of no more than each grade but the last."""
        return 1 / (1 + np.exp(np.clip(total[:, None] - self.thresholds, -700, 700)))


def held_words(texts: tx.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of letters and of their beginnings, A-Z as a-z, and the text of each."""
    words = tx.words_of(texts, tx.LETTER_BYTES)
    owner = words.text_of()
    hashes, owners = [tx.hash_spans(texts.data, words.starts, words.ends, fold=True)], [owner]
    for size in BEGINNINGS:
        longer = words.ends - words.starts > size
        hashes.append(tx.hash_spans(texts.data, words.starts[longer], words.starts[longer] + size, fold=True))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def labelled_words(docs: DataFrame, labels: DataFrame, key: str, text: str, grade: str, max_rows: int) -> DataFrame:
    """(grade, words) of a bounded sample of labelled texts; rows that repeat an id count with their highest grade."""
    known = labels.where(F.col(quoted(grade)).isNotNull() & F.col(quoted(key)).isNotNull()).groupBy(F.col(quoted(key)).alias("__key")).agg(F.max(quoted(grade)).cast("int").alias("grade"))
    sample = known.orderBy(F.xxhash64("__key"), "__key").limit(max_rows)
    # No more than max_rows rows are broadcast.
    rows = docs.select(F.col(quoted(key)).alias("__key"), F.col(quoted(text)).alias("text")).join(F.broadcast(sample), "__key")

    def make(column: pa.Array) -> list[pa.Array]:
        hashes, owner = held_words(tx.texts_of(column))
        order = np.argsort(owner, kind="stable")
        parts = np.split(hashes[order], np.searchsorted(owner[order], np.arange(1, len(column))))
        return [pa.array([np.unique(x).tobytes() for x in parts], pa.binary())]

    return map_texts(rows, "text", "words binary", make, keep=["grade"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", max_rows: int = MAX_ROWS) -> Model:
    """The model of a bounded sample of labelled texts.

    `labels` has an integer grade per key; null grades and keys are left out.
    """
    sample = labelled_words(docs, labels, key, text, grade, max_rows).toArrow()
    return fit_words(np.array(sample["grade"].to_pylist(), np.int64), [np.frombuffer(w, np.uint64) for w in sample["words"].to_pylist()])


def fit_words(grades: np.ndarray, words: list[np.ndarray]) -> Model:
    levels = np.unique(grades)
    if len(levels) < 2:
        return Model(levels.tolist(), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
    # The same order of rows however they came, so that sums round alike.
    order = sorted(range(len(words)), key=lambda i: (int(grades[i]), words[i].tobytes()))
    words, y = [words[i] for i in order], np.searchsorted(levels, grades[order])
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    vocabulary, code = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
    held = np.bincount(code, minlength=len(vocabulary))
    z = np.zeros(len(vocabulary))
    for k in range(1, len(levels)):
        above = y >= k
        z = np.maximum(z, _root_g2(np.bincount(code[above[row]], minlength=len(vocabulary)), held, int(above.sum()), len(y)))
    z[held < MIN_ROWS] = 0
    best = np.lexsort((vocabulary, -z))[:MAX_FEATURES]
    chosen = np.sort(best[z[best] >= MIN_Z])
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(words), len(chosen)))
    inside = place[code] >= 0
    x[row[inside], place[code[inside]]] = 1
    weights, thresholds = _cumulative_link(x, y, len(levels))
    return Model(levels.tolist(), vocabulary[chosen], np.rint(weights * MILLION).astype(np.int64), thresholds)


def _root_g2(a: np.ndarray, held: np.ndarray, above: int, n: int) -> np.ndarray:
    """Root of the likelihood ratio statistic of words in `a` of `above` rows and in `held` of all n."""
    total = np.zeros(len(a))
    for seen, rows in ((a, above), (held - a, n - above)):
        for count, share in ((seen, held / n), (rows - seen, 1 - held / n)):
            total += count * np.log(np.maximum(count, 1e-9) / np.maximum(rows * share, 1e-9))
    return np.sqrt(np.maximum(2 * total, 0))


def _cumulative_link(x: np.ndarray, y: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the least penalised loss, by Adam on the whole sample.

    The first threshold is free, the others follow it by positive gaps.
    """
    n, m = x.shape
    share = np.cumsum(np.bincount(y, minlength=levels))[:-1] / n
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for step in range(1, STEPS + 1):
        w, theta = p[:m], np.cumsum(np.append(p[m], np.exp(p[m + 1 :])))
        c = np.zeros((n, levels + 1))
        c[:, 1:-1] = 1 / (1 + np.exp(np.clip((x @ w)[:, None] - theta, -700, 700)))
        c[:, -1] = 1
        hi, lo = c[rows, y + 1], c[rows, y]
        likelihood = np.maximum(hi - lo, 1e-12)
        slope = np.zeros((n, levels + 1))
        slope[rows, y + 1] += hi * (1 - hi) / likelihood
        slope[rows, y] -= lo * (1 - lo) / likelihood
        by_theta = slope[:, 1:-1].sum(axis=0)
        # A threshold moves all that follow it.
        later = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([x.T @ (hi + lo - 1) - L2 * w, later[:1], later[1:] * np.exp(p[m + 1 :])]) / n
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        p += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-12)
    return p[:m], np.cumsum(np.append(p[m], np.exp(p[m + 1 :])))


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, toxic_from: int = 1) -> DataFrame:
    """The rows of df with severity (the expected grade), grade (the likeliest), p_toxic and toxic.

    p_toxic is the chance of a grade of `toxic_from` or more; toxic says that it
    is a half or more. A null text is an empty one and has the chances of a text
    without any of the model's words. A model of one grade gives that grade, one
    of none 0. Ties go to the lower grade. Columns of df that have the name of an
    added one are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(column: pa.Array) -> list[pa.Array]:
        model = shared.value
        n = len(column)
        hashes, owner = held_words(tx.texts_of(column))
        at = np.flatnonzero(model.sieve[hashes >> np.uint64(48)])
        place = np.searchsorted(model.words, hashes[at])
        good = place < len(model.words)
        at, place = at[good], place[good]
        same = model.words[place] == hashes[at]
        at, place = at[same], place[same]
        pairs = np.unique(owner[at] * max(1, len(model.words)) + place)
        total = np.bincount(pairs // max(1, len(model.words)), model.weights[pairs % max(1, len(model.words))] if len(pairs) else None, n) / MILLION
        grades = np.array(model.grades or [0])
        chance = np.diff(np.concatenate([np.zeros((n, 1)), model.at_most(total), np.ones((n, 1))], axis=1), axis=1)
        p_toxic = chance[:, grades >= toxic_from].sum(axis=1)
        return [pa.array(chance @ grades.astype(float)), pa.array(grades[chance.argmax(axis=1)].astype(np.int64)), pa.array(p_toxic), pa.array(p_toxic >= 0.5)]

    return map_texts(df, text, "severity double, grade long, p_toxic double, toxic boolean", make, keep)
