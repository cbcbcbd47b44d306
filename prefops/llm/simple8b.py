"""Simple-8b: as many numbers per 64-bit word as fit, told by four bits of the word.

Numbers are coded in blocks of BLOCK. A word's top four bits select how many
numbers of how many bits it holds, lowest first. A number of more than 60 bits is
an escape: its word holds a place in a list of whole numbers. The last word of a
block may have room left. The word at which each block begins is kept, so that
blocks decode on their own and all of them at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 4096
#: (numbers, bits) of selectors 1 to 14; 15 is an escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
COUNTS = np.array([0, *(c for c, _ in SELECTORS), 1])
_PAD = 60
_WIDTH = BLOCK + _PAD


class Coded(NamedTuple):
    n: int
    words: np.ndarray  # 64-bit
    offsets: np.ndarray  # the first word of each block
    escaped: np.ndarray  # 64-bit numbers of more than 60 bits


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each number takes, at least 1."""
    out = np.ones(values.shape, np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        big = values >= (np.uint64(1) << np.uint64(shift))
        out[big] += shift
        values = np.where(big, values >> np.uint64(shift), values)
    return out


def encode(values: np.ndarray) -> Coded:
    values = np.asarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return Coded(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), values)
    rows = np.zeros((blocks, _WIDTH), np.uint64)
    whole = np.zeros(blocks * BLOCK, np.uint64)
    whole[:n] = values
    rows[:, :BLOCK] = whole.reshape(blocks, BLOCK)
    flat = rows.ravel()
    bits = _bits(flat)
    # The most bits among the numbers from each place on, for spans of powers of two.
    most = {1: bits}
    size = 1
    while size < 32:
        longer = most[size].copy()
        np.maximum(longer[:-size], most[size][size:], out=longer[:-size])
        most[2 * size] = longer
        size *= 2
    selector = np.where(bits > 60, ESCAPE, 14).astype(np.uint8)
    for k in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[k]
        span = 1 << (count.bit_length() - 1)
        fits = most[span] <= width
        if count > span:
            fits[: span - count] &= fits[count - span :]
        selector[fits] = k + 1
    # All blocks step on together, a word at a time.
    step = COUNTS[selector]
    base = np.arange(blocks) * _WIDTH
    end = base + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    at = base.copy()
    begins = np.zeros(len(flat), bool)
    while len(at):
        begins[at] = True
        at = at + step[at]
        going = at < end
        at, end = at[going], end[going]
    starts = np.flatnonzero(begins)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == k + 1)
        place = np.arange(count)
        if len(mine):
            words[mine] |= np.bitwise_or.reduce(flat[starts[mine][:, None] + place] << (place * width).astype(np.uint64), axis=1)
    out = np.flatnonzero(chosen == ESCAPE)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    return Coded(n, words, np.searchsorted(starts, base), flat[starts[out]])


def decode(coded: Coded) -> np.ndarray:
    n, words, offsets, escaped = coded
    blocks = len(offsets)
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    before = np.append(0, np.cumsum(counts))[:-1]
    sizes = np.diff(np.append(offsets, len(words)))
    # Each word's first number, in rows with room for what the last word of a block has too much.
    starts = before + np.repeat(np.arange(blocks) * _WIDTH - before[offsets], sizes)
    flat = np.zeros(blocks * _WIDTH, np.uint64)
    for k, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == k + 1)
        place = np.arange(count)
        if len(mine):
            flat[starts[mine][:, None] + place] = (words[mine][:, None] >> (place * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
    out = chosen == ESCAPE
    flat[starts[out]] = escaped[(words[out] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return flat.reshape(blocks, _WIDTH)[:, :BLOCK].ravel()[:n]
