"""Texts of an Arrow batch as bytes, and their words and shingles as numpy arrays.

All loops over characters are numpy's.  A batch is taken in slices of about
``SLICE`` bytes, so memory stays the same whatever a batch holds; one longer
text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: All of ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of slices of about ``size`` bytes."""
    at = total = 0
    for i, x in enumerate(texts):
        total += len(x) + 1
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if len(have) <= 4 * SLICE:
            _powers[int(base)] = have
    return have[:n]


def rolled(data: np.ndarray) -> np.ndarray:
    """Running sums S of a polynomial hash: S[j] - S[i], times ``_INVERSE ** i``, is the hash of data[i:j] (Karp and Rabin)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _power(_BASE, len(data)), out=out[1:])
    return out


def hash_of(sums: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n = len(sums)
    return mix((sums[j] - sums[i]) * _power(_INVERSE, n)[i] + (j - i).astype(np.uint64))


class Words:
    """The words of texts, ``[^\\x20\\x09-\\x0D]+`` if no other bytes are said to be between words: ``start``, ``end`` (bytes of ``data``), ``doc``, 64-bit ``hash``; ``first``: of each text, and the end."""

    def __init__(self, texts: list[bytes], lower: bool = True, space: np.ndarray = _SPACE, hashed: bool = True):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = ~space[self.data]
        turn = np.diff(inside)
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if hashed:
            self.hash = hash_of(rolled(BYTE_VALUES[_LOWER[self.data] if lower else self.data]), self.start, self.end)


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of all runs of ``n`` words; a text with fewer words is one run of all."""
    h, doc = words.hash, words.doc
    if not len(h):
        return doc, h
    sums = rolled(h)
    i = np.arange(max(0, len(h) - n + 1))
    i = i[doc[i] == doc[i + n - 1]]
    few = np.flatnonzero((np.diff(words.first) < n) & (np.diff(words.first) > 0))
    a, b = np.concatenate([i, words.first[few]]), np.concatenate([i + n, words.first[few + 1]])
    return doc[a], hash_of(sums, a, b)


def distinct_by_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (doc, hash) once, by doc and then hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]
