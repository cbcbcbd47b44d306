"""Inputs that every operator must take, and small helpers."""

import random

from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=None):
    """A documents table of some texts; `extra` adds a column of that name."""
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENT)
    for name in extra or ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def random_texts(seed, n, vocabulary=12, longest=60):
    """Texts over few words, so that everything repeats."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["Ab", "aB", "é", "x,y", "中文"]
    gaps = [" ", "  ", "\n", "\t", " . "]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, longest)):
            parts += [rng.choice(words), rng.choice(gaps)]
        out.append("".join(parts))
    return out


EDGE_TEXTS = [None, "", " ", "\n\n", "word", "Zoë zoë ZOË", "a" * 5000, "same text here", "same text here", "\u0000x", "𝒳 y \U0001f600"]


def _mirrored(n):
    letters = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return [letters, letters.translate(str.maketrans("ab", "ba"))]


#: Two words, each the other with a and b changed, alike under any sum of bytes times powers of an odd number.
MIRRORED = _mirrored(1 << 11)
