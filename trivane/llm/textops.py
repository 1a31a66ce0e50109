"""Vectorised word hashing of whole Arrow string columns with NumPy.

A column's bytes are hashed at once: prefix sums of a polynomial modulo 2^64 give the hash of any byte
range, so a word costs a few array operations and no Python object. Word hashes are mixed, and an
n-gram's hash is a mixed weighted sum of its words' hashes; it does not depend on what separates the
words. Columns are cut into chunks of about half a megabyte (a longer text is a chunk of its own), which
bounds memory whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_P = U(0x9E3779B97F4A7C15 | 1)
_PINV = U(pow(int(_P), -1, 1 << 64))
_C = _rng.integers(1, 1 << 64, 64, dtype=np.uint64, endpoint=False) | U(1)
#: A second, independent table: two 64-bit hashes make one of 128 bits.
_BYTE_2 = _rng.integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)

#: Bytes that belong to words: anything but ASCII white space; letters, digits and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, p in enumerate((_P, _PINV)):
            a = np.full(n, p, U)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=U)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (a public finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bufs = column.buffers()
    if not len(column):
        return
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = np.zeros(len(data) + 2, bool)
    m[1:-1] = word[data]
    inside = m[1:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first = inside & ~m[:-2]
    first[cut] = inside[cut]
    last = inside & ~m[2:]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, second: bool = False) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U)
    power, inverse = _powers(len(data) + 1)
    table = _BYTE_2 if second else _BYTE
    table = table[FOLD] if fold else table
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * power[: len(data)], dtype=U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie in one row, and each row's first n-gram."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    if not at[-1]:
        return np.zeros(0, U), at
    total = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        total += words[k : k + len(total)] * _C[k]
    begin = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    return mix(total[begin]), at


def whole(words: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than an n-gram, told apart from those of other lengths."""
    h = U(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = mix(h * _P + w)
    return h


def gram_sets(data: np.ndarray, off: np.ndarray, n: int, word: np.ndarray = NOT_SPACE, fold: bool = True) -> list[np.ndarray]:
    """Each row's distinct n-gram hashes, sorted; the whole sequence as one if it has fewer words."""
    starts, ends, first = word_spans(data, off, word)
    words = word_hashes(data, starts, ends, fold)
    hashes, at = grams(words, first, n)
    out = []
    for i in range(len(off) - 1):
        if at[i + 1] > at[i]:
            out.append(np.unique(hashes[at[i] : at[i + 1]]))
        elif first[i + 1] > first[i]:
            out.append(np.array([whole(words[first[i] : first[i + 1]])], U))
        else:
            out.append(np.zeros(0, U))
    return out
