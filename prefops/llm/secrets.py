"""Secret scans: known shapes of secrets, and strings that a vocabulary can't shorten.

Three shapes are looked for as they are: assignments to a name such as
`password`, access keys, and long runs of hexadecimal digits. Then every other
unbroken string of 16 characters or more is encoded with a public vocabulary. Words and names take few tokens; a string that needs a token
for every two characters or so is random. Digests of the usual lengths, UUIDs and
plain numbers identify things and open nothing, so they are left out.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from prefops.llm import text as tx
from prefops.llm.frames import map_texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

#: Strings of MIN_LENGTH to LONG characters must have fewer characters a token: long words of some languages come close.
MIN_LENGTH, LONG = 16, 20
MAX_CHARS_PER_TOKEN, MAX_CHARS_PER_TOKEN_SHORT = 2.2, 1.7
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(rf"(?:0x)?(?:{'|'.join(f'[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}' for n in DIGEST_LENGTHS)})")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

_HEX = tx.class_table(lambda b: chr(b) in "0123456789abcdef")
_STRING = tx.class_table(lambda b: b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-"))
_SIGN = tx.class_table(lambda b: chr(b) in ":=")

ADDED = "n_assign long, n_access long, n_hex long, n_random long, spans array<struct<kind:string,start:long,end:long>>, clean_text string"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary_file(spark, path: str) -> str:
    """Send the file at `path` to the tasks, once; the name under which `local_file` finds it."""
    name = path.rpartition("/")[2]
    if name not in {f.rpartition("/")[2] for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return name


def local_file(name: str) -> str:
    return SparkFiles.get(name)


def identifies(s: str) -> bool:
    """Whether a string is a digest, a UUID or a number."""
    return s.isdigit() or bool(_UUID.fullmatch(s) or _DIGEST.fullmatch(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of assignments and access keys."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return found


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with every stretch of spans, in order of their starts, replaced."""
    out, at = [], 0
    for k, (start, end) in enumerate(spans):
        if start > at or k == 0:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(
    df: DataFrame,
    ranks: str,
    pattern: str,
    text: str = "text",
    keep: list[str] | None = None,
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
    max_chars_short: float = MAX_CHARS_PER_TOKEN_SHORT,
    mask: str = "[SECRET]",
) -> DataFrame:
    """The rows of df with the secrets in their texts.

    `ranks` is the path of a rank file, `pattern` its pre-token pattern. Adds
    n_assign, n_access, n_hex, n_random, spans (kind, start and end in code
    points, end exclusive, by start and then kind) and clean_text, in which every
    stretch of spans is replaced by `mask`.

    A string is random if it has fewer than `max_chars_per_token` characters a
    token, one below 20 characters `max_chars_short`.

    Spans of different base kinds may overlap; a random string within a base span
    isn't listed again. Repeated rows are returned each, an empty table gives an
    empty one. A null text has no spans and a null clean text. Columns
    of df that have the name of an added one are replaced.
    """
    name = vocabulary_file(df.sparkSession, ranks)

    def make(column: pa.Array) -> list[pa.Array]:
        texts = tx.texts_of(column)
        data, offsets = texts
        raw = data.tobytes()
        spans: dict[int, list[tuple[int, int, int]]] = {}
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))

        def place(words: tx.Words, chosen: np.ndarray):
            owner = np.searchsorted(offsets, words.starts[chosen], side="right") - 1
            begin = chars[offsets[owner]]
            return zip(owner.tolist(), words.starts[chosen].tolist(), words.ends[chosen].tolist(), (chars[words.starts[chosen]] - begin).tolist(), (chars[words.ends[chosen]] - begin).tolist(), strict=True)

        signs = tx.sums_by_text(_SIGN[data], offsets) > 0
        access = np.zeros(len(column), bool)
        at = raw.find(b"AKIA")
        while at >= 0:
            access[np.searchsorted(offsets, at, side="right") - 1] = True
            at = raw.find(b"AKIA", at + 4)
        for i in np.flatnonzero(signs | access).tolist():
            if found := base_spans(raw[offsets[i] : offsets[i + 1]].decode()):
                spans[i] = found
        hexes = tx.words_of(texts, _HEX)
        for i, _, _, start, end in place(hexes, np.flatnonzero(hexes.ends - hexes.starts >= HEX_LENGTH)):
            spans.setdefault(i, []).append((start, 2, end))

        strings = tx.words_of(texts, _STRING)
        for i, a, b, start, end in place(strings, np.flatnonzero(strings.ends - strings.starts >= MIN_LENGTH)):
            string = raw[a:b].decode()
            if identifies(string.strip("=-_+/")) or any(s <= start and end <= e for s, _, e in spans.get(i, ())):
                continue
            tokens = encoding(local_file(name), pattern).encode_ordinary(string)
            if len(string) < (max_chars_per_token if len(string) >= LONG else max_chars_short) * len(tokens):
                spans.setdefault(i, []).append((start, 3, end))

        counts = np.zeros((len(KINDS), len(column)), np.int64)
        lists: list[list[dict]] = [[] for _ in range(len(column))]
        clean = column.to_pylist() if spans else None
        for i, found in spans.items():
            found.sort()
            lists[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]
            for _, k, _ in found:
                counts[k, i] += 1
            clean[i] = masked(clean[i], [(s, e) for s, _, e in found], mask)
        return [*map(pa.array, counts), pa.array(lists, _SPANS), column if clean is None else pa.array(clean, pa.string())]

    return map_texts(df, text, ADDED, make, keep)
