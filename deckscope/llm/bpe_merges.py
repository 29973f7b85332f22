"""Which tokens may stand side by side in a byte-pair encoding.

A text has exactly one cut into tokens whose neighbours are all compatible,
and that is its encoding; so dynamic programming over prefixes finds it
without replaying merges.  Two tokens are compatible if, undoing their merges
from the latest to the earliest, no merge across their border would have come
before the one undone.  All here works on arrays of tokens.
"""

from __future__ import annotations

import numpy as np

from .texts import mix

#: Places for remembered pairs, as a power of two; a new pair takes the place of the one before.
PLACES = 21


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each of ``x`` in the sorted ``keys``, -1 if it is not there."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    k = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[k] == x, k, -1)


class SortedKeys:
    """``find`` in sorted keys, after a look at a table of bits that most others fail."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.maybe = keys, np.zeros(1 << 21, bool)
        self.maybe[keys >> np.uint64(43)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x that are keys, index of the key of each)."""
        at = np.flatnonzero(self.maybe[x >> np.uint64(43)])
        k = find(self.keys, x[at])
        return at[k >= 0], k[k >= 0]


class Merges:
    """``rank``: of each token's last merge, -1 for single symbols; ``left``, ``right``: what it joined."""

    def __init__(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.rank, self.left, self.right = rank.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
        made = np.flatnonzero(self.rank >= 0)
        keys = self.left[made] << 32 | self.right[made]
        order = np.argsort(keys)
        self.pairs, self.pair_rank = keys[order], self.rank[made][order]
        self.known, self.good = np.full(1 << PLACES, -1, np.int64), np.zeros(1 << PLACES, bool)

    def undo(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge before ``limit`` crosses the border of x and y."""
        good, at = np.ones(len(x), bool), np.arange(len(x))
        while len(at):
            k = find(self.pairs, x << 32 | y)
            cross = np.where(k >= 0, self.pair_rank[k] if len(self.pair_rank) else 0, np.iinfo(np.int64).max)
            bad = cross < limit
            good[at[bad]] = False
            go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            x, y, at = x[go], y[go], at[go]
            rx, ry = self.rank[x], self.rank[y]
            late = rx > ry  # of two equal merges the left one came first
            limit = np.where(late, rx, ry + 1)
            x, y = np.where(late, self.right[x], x), np.where(late, y, self.left[y])
        return good

    def reachable(self) -> np.ndarray:
        """Tokens that encode to themselves: no earlier merge crosses the border inside, and both parts do too."""
        made = np.flatnonzero(self.rank >= 0)
        ok = np.ones(len(self.rank), bool)
        ok[made] = self.undo(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made], kind="stable")]:
            ok[t] &= ok[self.left[t]] and ok[self.right[t]]
        return ok

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x.astype(np.int64) << 32 | y
        place = (mix(keys.view(np.uint64)) >> np.uint64(64 - PLACES)).astype(np.int64)
        good = self.good[place]
        new = np.flatnonzero(self.known[place] != keys)
        if len(new):
            one, inverse = np.unique(keys[new], return_inverse=True)
            fit = self.undo(one >> 32, one & 0xFFFFFFFF, np.full(len(one), np.iinfo(np.int64).max))[inverse]
            good[new] = fit
            self.known[place[new]], self.good[place[new]] = keys[new], fit
            clash = self.known[place[new]] != keys[new]  # of two in one place the last stays, with its own answer
            last = np.flatnonzero(~clash)
            self.good[place[new[last]]] = fit[last]
        return good


def symbol_hash(symbols: np.ndarray) -> np.ndarray:
    """A 64-bit number for each byte or code point, to be rolled over."""
    return mix(symbols.astype(np.uint64) + np.uint64(0x51ED270B9F8C5A1D))


def by_length(lengths: np.ndarray, rows: int = 1 << 15):
    """Indices of equal lengths, at most ``rows`` at once."""
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        for a in range(0, len(group), rows):
            yield group[a : a + rows]
