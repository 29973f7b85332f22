"""Token counts of all prefixes of a text by dynamic programming.

For each distinct pre-token of a task and each of its prefixes (in bytes) the
last token of the prefix's encoding is the one that ends there and is
compatible with the last token of what is before it (see ``bpe_merges``); its
count is one more than that prefix's.  Pre-tokens of equal length advance
together.  A text's counts are sums over its pre-tokens, so its total, a
budget, or where to cut it are answered from the stored counts, without
encoding anything again.  Cuts keep the pre-tokens' borders.

Defined cases: null or empty text has no tokens and fits; special strings are
one token, as the library's default takes them; rows of one id are counted
each; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe_merges import Merges, SortedKeys, by_length, find, symbol_hash
from .shared import col
from .texts import _BASE, _INVERSE, _power, hash_of, mix, rolled, slices, texts_of

LIMIT = 512
#: Distinct pre-tokens a task remembers at most; pre-tokens of more bytes go one by one.
REMEMBERED, TOGETHER = 500_000, 40
_S = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens by the sorted hashes of their bytes, and their merges."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters, ids, merges = byte_letters(), spec["model"]["vocab"], spec["model"]["merges"]
        n = max(ids.values()) + 1
        rank, left, right = np.full(n, -1), np.zeros(n), np.zeros(n)
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            t = ids[a + b]
            rank[t], left[t], right[t] = r, ids[a], ids[b]
        self.merges = Merges(rank, left, right)
        ok = self.merges.reachable()
        self.special = [x["content"] for x in spec["added_tokens"]]
        tokens = [(bytes(letters[c] for c in s), i) for s, i in ids.items() if all(c in letters for c in s) and ok[i] and (rank[i] >= 0 or len(s) == 1)]
        self.longest = max(len(b) for b, _ in tokens)
        keys = np.array([hash_of(rolled(symbol_hash(np.frombuffer(b, np.uint8))), np.array([0]), np.array([len(b)]))[0] for b, _ in tokens], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = SortedKeys(keys[order]), np.array([i for _, i in tokens], np.int64)[order]


class Counter:
    """Counts of all prefixes of the pre-tokens seen so far: ``pool``, found by a sorted array of hashes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self):
        self.hash, self.at, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def prefixes_together(self, symbols: np.ndarray) -> np.ndarray:
        """Counts at the prefixes 1 to L of N pre-tokens of equal length: symbols and result are N x L."""
        v, (n, length) = self.v, symbols.shape
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(symbol_hash(symbols) * _power(_BASE, length), axis=1, out=sums[:, 1:])
        inverse = _power(_INVERSE, length + 1)
        last, count = np.full((n, length + 1), -1, np.int64), np.zeros((n, length + 1), np.int32)
        for j in range(1, length + 1):
            open_ = np.arange(n)
            for i in range(max(0, j - v.longest), j):
                hit, k = v.keys.hits(mix((sums[open_, j] - sums[open_, i]) * inverse[i] + np.uint64(j - i)))
                if not len(hit):
                    continue
                rows, token = open_[hit], v.ids[k]
                if i:
                    fits = v.merges.compatible(last[rows, i], token)
                    rows, token, hit = rows[fits], token[fits], hit[fits]
                last[rows, j], count[rows, j] = token, count[rows, i] + 1
                open_ = np.delete(open_, hit)
                if not len(open_):
                    break
        return count[:, 1:]

    def prefixes_alone(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long pre-token: what matches where is found by numpy, a length at a time."""
        v, n = self.v, len(symbols)
        sums, starts, ends, tokens = rolled(symbol_hash(symbols)), [], [], []
        for m in range(1, min(n, v.longest) + 1):
            i = np.arange(n - m + 1)
            hit, k = v.keys.hits(hash_of(sums, i, i + m))
            starts.append(i[hit]), ends.append(i[hit] + m), tokens.append(v.ids[k])
        start, end, token = (np.concatenate(x) for x in (starts, ends, tokens))
        order = np.lexsort((start, end))
        last, count, known = [-1] * (n + 1), [0] * (n + 1), {}
        for i, j, t in zip(start[order].tolist(), end[order].tolist(), token[order].tolist(), strict=True):
            if last[j] < 0 and (not i or last[i] >= 0):
                if i and (key := (last[i], t)) not in known:
                    known[key] = bool(v.merges.compatible(np.array([last[i]]), np.array([t]))[0])
                if not i or known[key]:
                    last[j], count[j] = t, count[i] + 1
        return np.array(count[1:], np.int32)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray):
        size = end - start
        at = np.cumsum(size) - size
        found = np.zeros(int(size.sum()), np.int32)
        for group in by_length(size):
            length = int(size[group[0]])
            if length > TOGETHER:
                for g in group:
                    found[at[g] : at[g] + length] = self.prefixes_alone(data[start[g] : end[g]])
            else:
                where = np.arange(length)
                found[at[group][:, None] + where] = self.prefixes_together(data[start[group][:, None] + where])
        h = np.concatenate([self.hash, hashes])
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], np.concatenate([self.at, at + len(self.pool)])[order]
        self.pool = np.concatenate([self.pool, found])

    def __call__(self, texts: list[bytes]) -> PrefixCounts:
        data, pieces, special, first = [], [], [], [0]
        for x in texts:
            parts, found = [x.decode()], []
            for s in self.v.special:
                parts = [q for p in parts for q in ([p] if p in self.v.special else _between(p.split(s), s))]
            for p in parts:
                if p in self.v.special:
                    special.append(len(pieces) + len(found))
                    found.append(len(p))
                else:
                    found.extend(map(len, PRETOKEN.findall(p)))
            data.append(x)
            pieces.extend(found)
            first.append(len(pieces))
        data, size = np.frombuffer(b"".join(data), np.uint8), np.array(pieces, np.int64)
        character = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # lengths so far are in code points
        edge = character[np.concatenate([[0], np.cumsum(size)])]
        start, end, size = edge[:-1], edge[1:], np.diff(edge)
        h = hash_of(rolled(symbol_hash(data)), start, end)
        is_special = np.zeros(len(size), bool)
        is_special[special] = True
        plain = np.flatnonzero(~is_special)
        u, where, inverse = np.unique(h[plain], return_index=True, return_inverse=True)
        if len(self.hash) + len(u) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(find(self.hash, u) < 0)
        if len(new):
            w = plain[where[new]]
            self.learn(data, start[w], end[w], u[new])
        at = np.zeros(len(size), np.int64)
        at[plain] = self.at[find(self.hash, u)][inverse]
        total = np.ones(len(size), np.int64)
        total[plain] = self.pool[at[plain] + size[plain] - 1]
        return PrefixCounts(data, start, size, at, total, is_special, np.array(first), self.pool)


def _between(parts: list[str], s: str) -> list[str]:
    return [y for i, p in enumerate(parts) for y in ([s] if i else []) + ([p] if p else [])]


class PrefixCounts:
    """Stored counts of some texts: ``total`` of each pre-token, ``before`` it in its text, and inside it."""

    def __init__(self, data, start, size, at, total, special, first, pool):
        self.data, self.start, self.size, self.at, self.total, self.special, self.first, self.pool = data, start, size, at, total, special, first, pool
        sums = np.concatenate([[0], np.cumsum(total)])
        self.n_tokens = sums[first[1:]] - sums[first[:-1]]
        self.before = sums[:-1] - np.repeat(sums[first[:-1]], np.diff(first))

    def inside(self, k: int) -> np.ndarray:
        """Counts at each byte of pre-token k, without what is before it."""
        return np.array([0] * (self.size[k] - 1) + [1]) if self.special[k] else self.pool[self.at[k] : self.at[k] + self.size[k]]

    def at_bytes(self, doc: int) -> np.ndarray:
        """Tokens of each prefix of a text, from the empty one to all bytes."""
        a, b = self.first[doc], self.first[doc + 1]
        return np.concatenate([[0], *(self.before[k] + self.inside(k) for k in range(a, b))])

    def fit(self, doc: int, limit: int) -> int:
        """Bytes of the longest prefix of whole characters with at most ``limit`` tokens."""
        a, b = self.first[doc], self.first[doc + 1]
        if self.n_tokens[doc] <= limit:
            return int(self.size[a:b].sum())
        for k in range(a + int(np.searchsorted(self.before[a:b], limit, "right")) - 1, a - 1, -1):
            inner = self.before[k] + self.inside(k) <= limit
            if self.special[k]:
                inner[:-1] = False
            ends = np.append(self.data[self.start[k] + 1 : self.start[k] + self.size[k]] & 0xC0 != 0x80, True)
            if len(hit := np.flatnonzero(inner & ends)):
                return int(self.start[k] + hit[-1] + 1 - self.start[a])
        return 0


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_bytes`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                got = counter(texts[a:b])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([len(x) for x in texts[a:b]], pa.int64()), pa.array(got.n_tokens, pa.int64()),
                                       pa.array(got.n_tokens > limit), pa.array([got.fit(i, limit) for i in range(b - a)], pa.int64())],
                                      ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return docs.select(col(id_col), col(text_col)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint")
