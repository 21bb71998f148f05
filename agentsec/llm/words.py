"""Word hashing inside Python tasks, over whole Arrow batches at once.

A word is `[^\\x20\\x09-\\x0D]+` of the UTF-8 text. Its hash is a polynomial over its bytes modulo 2^64, with random
64-bit values for the bytes, then mixed: prefix sums over the batch's own text buffer give every word's hash
without making a Python object for any word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once; longer texts are cut at white space.
RANGE = 1 << 20
SPACES = b"\t\n\x0b\x0c\r "
#: Bytes as they are; A to Z to lower case; as that, with other ASCII characters than letters and digits as spaces.
SAME = bytes(range(256))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser; another seed gives another order."""
    h = h + np.uint64((int(seed) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, RANGE + 1), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
    return got[:n]


def _words(data: np.ndarray, begins: np.ndarray, fold: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word in `data`; a word also ends where a document begins."""
    n = len(data)
    values = mix(np.frombuffer(fold, np.uint8).astype(np.uint64), 3)
    space = np.isin(np.frombuffer(fold, np.uint8), np.frombuffer(SPACES, np.uint8))
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < n]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, n), out=sums[1:])
    back = _power(pow(_BASE, -1, 1 << 64), n)
    return starts, mix((sums[ends] - sums[starts]) * back[starts], 4)


def _long(data: np.ndarray, fold: bytes) -> np.ndarray:
    """Word hashes of one text longer than RANGE."""
    space, parts, at = np.isin(np.frombuffer(fold, np.uint8), np.frombuffer(SPACES, np.uint8)), [], 0
    while at < len(data):
        end = at + RANGE
        while end < len(data):
            gaps = np.flatnonzero(space[data[end : end + RANGE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += RANGE
        parts.append(_words(data[at : min(end, len(data))], np.zeros(1, np.int64), fold)[1])
        at = end
    return np.concatenate(parts)


def hashed(column: pa.Array, fold: bytes = SAME) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, word bounds) of runs of rows: row k of a run has words bounds[k] to bounds[k+1]; a null has none."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RANGE, "right")) - 1)
        text = data[offsets[row] : offsets[stop]]
        if len(text) > RANGE:
            h = _long(text, fold)
            yield h, np.array([0, len(h)])
        else:
            begins = offsets[row : stop + 1] - offsets[row]
            starts, h = _words(text, begins[:-1], fold) if len(text) else (np.empty(0, np.int64), np.empty(0, np.uint64))
            yield h, np.searchsorted(starts, begins)
        row = stop


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= np.uint64(_BASE)
        out += h[j : j + m]
    return mix(out, int(n))


def row_grams(column: pa.Array, n: int, fold: bytes = SAME) -> Iterator[np.ndarray]:
    """The hashes of all runs of n words of each row."""
    for h, at in hashed(column, fold):
        g = grams(h, n)
        for lo, hi in zip(at[:-1], at[1:]):
            yield g[lo : max(lo, hi - n + 1)]


def row_shingles(column: pa.Array, n: int = 5, fold: bytes = LOWER) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row; with fewer words the whole sequence is one; none without words."""
    for h, at in hashed(column, fold):
        g = grams(h, n)
        for lo, hi in zip(at[:-1], at[1:]):
            if 0 < hi - lo < n:
                yield grams(h[lo:hi], hi - lo)
            else:
                yield np.unique(g[lo : max(lo, hi - n + 1)])
