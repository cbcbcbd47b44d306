"""Words, pre-tokens and hashes of many texts at once, as numpy arrays over their bytes.

An Arrow batch holds its texts as one run of bytes with offsets. Everything here
works on that run: no Python object is made for a word unless it is asked for.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WORD64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def class_table(is_member) -> np.ndarray:
    """For each byte, whether it belongs."""
    return np.array([bool(is_member(b)) for b in range(256)])


#: Bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters, digits and every byte of a character beyond ASCII.
WORD_BYTES = class_table(lambda b: b >= 0x80 or chr(b).isalnum())
LETTER_BYTES = class_table(lambda b: b >= 0x80 or chr(b).isalpha())
NOT_NEWLINE = class_table(lambda b: b != 0x0A)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)


def release() -> None:
    """Give memory that this worker no longer uses back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        library = ctypes.CDLL("libc.so.6")
        return library if hasattr(library, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


class Texts(NamedTuple):
    """The bytes of some texts: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Word j is data[starts[j]:ends[j]]; the words of text i are first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column; null is an empty text."""
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    _, at, data = column.buffers()
    if n == 0 or at is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(everything[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes of text, or one longer text."""
    offsets = texts_of(column).offsets
    n, lo = len(column), 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words_of(texts: Texts, members: np.ndarray) -> Words:
    """Maximal runs of member bytes within each text."""
    data, offsets = texts
    inside = members[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


#: Bytes of a span that are hashed in steps of eight; a longer one is hashed in one go by itself.
LONG_SPAN = 512
_PARTS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def _eights(data: np.ndarray) -> np.ndarray:
    """At every byte the number that it and the seven after it make, with zeros beyond the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes, with A-Z taken as a-z if `fold`.

    Eight bytes after eight go through a mixing function, so that the result isn't
    a sum over the bytes: sums are alike for texts that mirror each other.
    """
    if not len(starts):
        return np.zeros(0, U64)
    lo = int(starts[0])
    data = data[lo : int(ends[-1])]
    data, starts, sizes = _LOWER[data] if fold else data, starts - lo, ends - starts
    eights = _eights(data)
    out = mix(sizes.astype(U64) + U64(BASE))
    rows = np.flatnonzero(sizes <= LONG_SPAN)
    for at in range(0, LONG_SPAN, 8):
        rows = rows[sizes[rows] > at] if at else rows
        if not len(rows):
            break
        part = eights[starts[rows] + at] & _PARTS[np.minimum(sizes[rows] - at, 8)]
        out[rows] = mix((out[rows] ^ part) * U64(BASE))
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        raw = data[starts[i] : starts[i] + sizes[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether span i of the bytes a is, byte by byte, span i of the bytes b."""
    sizes = a_ends - a_starts
    same = sizes == b_ends - b_starts
    rows = np.flatnonzero(same & (sizes <= LONG_SPAN))
    a8, b8 = _eights(a), _eights(b)
    for at in range(0, LONG_SPAN, 8):
        rows = rows[sizes[rows] > at]
        if not len(rows):
            break
        differ = ((a8[a_starts[rows] + at] ^ b8[b_starts[rows] + at]) & _PARTS[np.minimum(sizes[rows] - at, 8)]) != 0
        same[rows[differ]] = False
        rows = rows[~differ]
    for i in np.flatnonzero(same & (sizes > LONG_SPAN)).tolist():
        same[i] = np.array_equal(a[a_starts[i] : a_ends[i]], b[b_starts[i] : b_ends[i]])
    return same


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` successive words within a text, and the number of the first word of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for k in range(size):
        total += hashes[k : k + n] * U64(pow(BASE, 2 * k + 1, 1 << 64))
    # The last words of a text start no window; a mask over them is cheaper than the owner of every word.
    start = np.ones(len(hashes), bool)
    for k in range(1, size):
        edge = first[1:] - k
        start[edge[edge >= first[:-1]]] = False
    at = np.flatnonzero(start[:n])
    return mix(total[at]), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the values of each text."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether each of n words lies in a window of `size` words that starts at one of `at`, all different."""
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + size] -= 1
    return np.cumsum(edge[:-1]) > 0


# Pre-tokens of the byte-level vocabularies.

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _char_classes() -> np.ndarray:
    """The class of every code point, from the character properties that the pattern names."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    # A run of the joined string never spans the gap of the surrogates.
    out[0xD800:0xE000] = OTHER
    return out


def pretokens(texts: Texts) -> Words:
    """The matches of the pre-token pattern of the byte-level vocabularies, as byte spans.

    The pattern `'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+` cuts
    where the class of character changes. One blank before a run goes with the
    run, so the last blank of several starts a new match, and an apostrophe that
    starts a match takes the letters of a contraction with it.
    """
    data, offsets = texts
    if not len(data):
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(len(offsets), np.int64))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):
        points, at = data, offsets
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.searchsorted(lead, offsets)
    kind = _char_classes()[points]
    n = len(points)
    cut = np.zeros(n + 4, bool)
    text_edge = np.zeros(n + 4, bool)
    text_edge[at] = True
    blank, space = points == 0x20, kind == SPACE
    cut[1:n] = (kind[1:] != kind[:-1]) & (space[1:] | ~blank[:-1])
    # The last white space before a run, unless the text ends there.
    last = space.copy()
    last[:-1] &= ~space[1:] & ~text_edge[1:n]
    last[-1] = False
    cut[:n] |= last
    cut |= text_edge
    mark = np.flatnonzero(cut[:n] & (np.append(points, 0)[:n] == 0x27))
    if len(mark):
        ahead = np.zeros(n + 4, np.uint32)
        ahead[:n] = points
        one = np.isin(ahead[mark + 1], [ord(c) for c in "stmd"]) & ~text_edge[mark + 1]
        pair = (ahead[mark + 1].astype(np.uint64) << U64(32)) | ahead[mark + 2]
        two = np.isin(pair, [np.uint64(ord(p[0]) << 32 | ord(p[1])) for p in ("re", "ve", "ll")])
        two &= ~text_edge[mark + 1] & ~text_edge[mark + 2]
        for taken, length in ((one, 2), (two, 3)):
            cut[mark[taken] + 1] = False
            cut[mark[taken] + length] = True
    starts = np.flatnonzero(cut[:n])
    first = np.searchsorted(starts, at)
    starts = lead[starts] if len(lead) != len(data) else starts
    return Words(starts, np.append(starts[1:], len(data)), first)


class Distinct(NamedTuple):
    """The different words of some texts by their hashes, in order: where each first occurs, and which each word is."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray


def distinct_words(data: np.ndarray, words: Words) -> Distinct:
    """Words are the same if their bytes are; one that only shares the hash of another gets a hash of its own."""
    hashes = hash_spans(data, words.starts, words.ends)
    found, at, codes = np.unique(hashes, return_index=True, return_inverse=True)
    once = at[codes]
    other = np.flatnonzero(~equal_spans(data, words.starts, words.ends, data, words.starts[once], words.ends[once]))
    if len(other):
        for i, raw in zip(other.tolist(), spans_of(data, words.starts[other], words.ends[other]), strict=True):
            hashes[i] = int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")
        found, at, codes = np.unique(hashes, return_index=True, return_inverse=True)
    return Distinct(found, words.starts[at], words.ends[at], codes)


def spans_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Runs(NamedTuple):
    """Number lists laid end to end: list i is values[ends[i - 1]:ends[i]]."""

    values: np.ndarray
    ends: np.ndarray


def runs_of(lists: list, dtype=np.int32) -> Runs:
    ends = np.cumsum([len(x) for x in lists], dtype=np.int64) if lists else np.zeros(0, np.int64)
    flat = np.fromiter((v for x in lists for v in x), dtype, int(ends[-1]) if len(ends) else 0)
    return Runs(flat, ends)


def take_runs(runs: Runs, which: np.ndarray) -> Runs:
    """The lists `which`, in that order."""
    starts = np.append(0, runs.ends[:-1])[which] if len(which) else np.zeros(0, np.int64)
    sizes = (runs.ends[which] - starts) if len(which) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return Runs(runs.values[index], ends)
