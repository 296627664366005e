"""Hashes of words and word shingles of Arrow string columns, computed on whole batches.

A word is a maximal run of bytes of its class in the UTF-8 text, so both word
definitions used here work on bytes. Word hashes are polynomials in the bytes'
values modulo 2**64, mixed; shingle hashes combine k word hashes the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time: a worker holds some ten arrays of eight times as many.
PIECE = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_K = mix64(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)

#: All bytes but the space and 09 to 0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Digits, letters A-Z and a-z, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _cut(buf: np.ndarray, docs: np.ndarray, is_word: np.ndarray, lo: int) -> int:
    """The end of a piece from lo: between documents if it can be, else between words."""
    if lo + PIECE >= len(buf):
        return len(buf)
    d = docs[np.searchsorted(docs, lo + PIECE, "right") - 1]
    if d > lo:
        return int(d)
    end = int(docs[np.searchsorted(docs, lo, "right")])
    hi = lo + PIECE
    while hi < end:
        gaps = np.flatnonzero(~is_word[buf[hi - PIECE : hi]])
        if len(gaps):
            return hi - PIECE + int(gaps[-1]) + 1
        hi += PIECE
    return end


def words(texts: pa.Array, is_word: np.ndarray = SPACED, fold: bool = True, heads: tuple[int, ...] | None = None) -> tuple[np.ndarray, ...]:
    """(hashes of all words in order, offsets: document i has words offsets[i] to offsets[i + 1]).

    With heads, numbers of bytes: (hashes of the words and, below them, of so
    many first bytes of each, the words' sizes in bytes, offsets).
    """
    buf, docs = text_bytes(texts)
    value, hashes, begins, lo = _FOLDED if fold else _VALUE, [np.zeros((1 + len(heads or ()), 0), np.uint64)], [np.zeros(0, np.int64)], 0
    sizes = [np.zeros(0, np.int64)]
    while lo < len(buf):
        hi = _cut(buf, docs, is_word, lo)
        part = buf[lo:hi]
        w = is_word[part]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        inside = docs[(docs > lo) & (docs < hi)] - lo
        first[inside] = w[inside]
        last[inside - 1] = w[inside - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(max(PIECE, hi - lo))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * up[: len(part)], out=sums[1:])
        ends = [b, *(np.minimum(b, a + n) for n in heads or ())]
        hashes.append(np.stack([mix64((sums[e] - sums[a]) * down[a] + (e - a).astype(np.uint64) * _K[0]) for e in ends]))
        begins.append(a + lo)
        sizes.append(b - a)
        lo = hi
    found, at = np.concatenate(hashes, axis=1), np.searchsorted(np.concatenate(begins), docs)
    return (found[0], at) if heads is None else (found, np.concatenate(sizes), at)


def shingles(h: np.ndarray, at: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rolling k-word hashes by document, as (hashes, offsets).

    A document of fewer words has one shingle, its whole sequence, if short;
    a document without words has none.
    """
    n = np.diff(at)
    many = np.maximum(n - k + 1, (n > 0).astype(np.int64) if short else 0)
    off = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(len(n)), many)
    begin = at[:-1][doc] + (np.arange(off[-1]) - off[:-1][doc])
    acc, length = np.zeros(len(begin), np.uint64), np.minimum(n, k)[doc]
    for j in range(k):
        if short and len(n) and n.min() < k:
            on = length > j
            acc[on] += h[begin[on] + j] * _K[1 + j]
        else:
            acc += h[begin + j] * _K[1 + j]
    return mix64(acc + length.astype(np.uint64) * _K[0]), off


def cuts(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(begin, number) of slices whose texts have about `most` bytes; a longer text comes alone."""
    _, at = text_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi - lo
        lo = hi


def chunks(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The slices of a batch by its texts in a column."""
    for lo, n in cuts(batch.column(column), most):
        yield batch.slice(lo, n)
