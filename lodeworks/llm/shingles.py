"""Words and word shingles of whole texts as 64-bit hashes, computed over Arrow buffers with numpy.

A word is a run of bytes other than the white space 0x20 and 0x09-0x0D, A-Z counted as a-z. Its hash is a polynomial in
a random table of its bytes, taken from one running sum over the block and freed of its place, then mixed. Equal words
have equal hashes everywhere; different ones collide with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; the arrays on the way take some 50 bytes a byte. A longer text is handled in pieces cut at white space.
BLOCK = 1 << 18
WIDTH = 5


def _tables():
    rng = np.random.default_rng(20240229)
    t = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[65:91] = t[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return t, space, rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


TABLE, SPACE, PLACE = _tables()
P = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n at least."""
    size = max(BLOCK + 64, 1 << max(n - 1, 1).bit_length())
    if size not in _powers:
        _powers.clear()

        def up(p: int) -> np.ndarray:
            x = np.full(size, p, np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        _powers[size] = up(P), up(pow(P, -1, 1 << 64))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hash_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after) of each word of data; words also end at the places ``cuts``."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~SPACE[data]
    edge = np.empty(len(data), bool)
    edge[0], edge[1:] = True, ~word[:-1]
    edge[cuts[cuts < len(data)]] = True
    first = np.flatnonzero(word & edge)
    edge[:-1], edge[-1] = ~word[1:], True
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    edge[inner - 1] = True
    last = np.flatnonzero(word & edge) + 1
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[last] - total[first]) * down[first]), first, last


def word_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of a string column: (first row, words of each row, hashes, first bytes, bytes after).

    Bytes count from the start of the row's text. Null rows have no words.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        if end == row + 1 and hi - lo > BLOCK:
            found, at = [], lo
            while at < hi:
                stop = min(hi, at + BLOCK)
                while stop < hi and not SPACE[data[stop]]:
                    stop += 1
                h, a, b = hash_words(data[at:stop], np.empty(0, np.int64))
                found.append((h, a + (at - lo), b + (at - lo)))
                at = stop
            h, a, b = (np.concatenate(x) for x in zip(*found))
            yield row, np.array([len(h)]), h, a, b
        else:
            starts = offsets[row:end] - lo
            h, a, b = hash_words(data[lo:hi], starts)
            counts = np.diff(np.append(np.searchsorted(a, starts, "left"), len(a)))
            shift = np.repeat(starts, counts)
            yield row, counts, h, a - shift, b - shift
        row = end


def shingle(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of the runs of ``width`` words, in order; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, width)
    total = words[: n - k + 1] * PLACE[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * PLACE[j]
    return mix(total + np.uint64(k))


def shingle_rows(counts: np.ndarray, words: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The shingles of each row in turn: one pass over the block, then views."""
    if len(words) >= width:
        total = words[: len(words) - width + 1] * PLACE[0]
        for j in range(1, width):
            total += words[j : len(words) - width + 1 + j] * PLACE[j]
        total = mix(total + np.uint64(width))
    at = 0
    for c in counts.tolist():
        yield total[at : at + c - width + 1] if c >= width else shingle(words[at : at + c], width)
        at += c
