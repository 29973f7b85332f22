"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits (any byte beyond ASCII is a letter), A-Z
in lower case.  Documents and test items that share a seed, ``min_match``
tokens in a row found by rolling hashes (Karp and Rabin), are tiled: of all
common runs the longest is marked, what it covers on either side is taken out
of the others, and so on until no run of ``min_match`` tokens is left.  Tiles
never overlap but may stand in any order, so a passage that was cut up and put
together anew is caught.  A document is contaminated by an item if its tiles
cover at least ``percent`` of the item's tokens.

Seeds first tell, each counted once a text, which items they could cover far
enough; for those the pairs of places become runs on their diagonals, ``CHUNK``
pairs at a time, so a word repeated all over a text and an item takes the
memory of its runs and not of its pairs.

The items of one block (``BLOCK_CHARS`` of text at most, whatever the size of
the benchmark) go to all tasks; a larger benchmark takes more passes.

Defined cases: null or empty documents and items match nothing; an item with
fewer tokens than a seed's matches where all its tokens stand in a row;
repeated rows, ids and items give a row each (pairs are distinct); an empty
table or benchmark gives no pairs and drops nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_merges import SortedKeys
from .shared import col
from .texts import PUNCTUATION, Words, hash_of, rolled, slices, texts_of

MIN_MATCH, PERCENT = 5, 50
#: Characters of test items that go to the tasks at once.
BLOCK_CHARS = 1 << 24
#: Pairs of places that are looked at at once (32 bytes each, some times over).
CHUNK = 1 << 20


class Items:
    """Test items by the hashes of their seeds."""

    def __init__(self, items: list[tuple], min_match: int = MIN_MATCH, percent: int = PERCENT):
        words = Words([(t or "").encode() for _, t in items], space=PUNCTUATION)
        self.id, self.size, self.min_match, self.percent = [i for i, _ in items], np.diff(words.first), min_match, percent
        self.seeds = {}  # by their number of tokens
        for m in {min_match, *(int(n) for n in self.size if 0 < n < min_match)}:
            at = np.arange(max(0, len(words.hash) - m + 1))
            at = at[words.doc[at] == words.doc[at + m - 1]] if len(at) else at
            at = at[self.size[words.doc[at]] >= min_match] if m == min_match else at[self.size[words.doc[at]] == m]
            if len(at):
                h = hash_of(rolled(words.hash), at, at + m)
                order = np.argsort(h, kind="stable")
                keys, first = np.unique(h[order], return_index=True)
                item = words.doc[at][order]
                self.seeds[m] = SortedKeys(keys), np.append(first, len(order)), item, (at - words.first[words.doc[at]])[order]

    def likely(self, words: Words) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each number of seed tokens: it, the seeds' places in the texts and their keys, and the pairs (text times the number of items, plus item) whose
        seeds cover enough of the item; tiles cover no more.  A text counts a key once, however often it has it."""
        out, sums, many = [], rolled(words.hash), len(self.size)
        for m, (keys, first, item, place) in self.seeds.items():
            at = np.arange(max(0, len(words.hash) - m + 1))
            at = at[words.doc[at] == words.doc[at + m - 1]] if len(at) else at
            hit, k = keys.hits(hash_of(sums, at, at + m))
            at = at[hit]
            once = np.unique(words.doc[at] * np.int64(len(keys.keys) + 1) + k)
            doc, key = once // (len(keys.keys) + 1), once % (len(keys.keys) + 1)
            pairs = []
            for a, b in chunks(first[key + 1] - first[key], edges=doc):
                which, n = expand(first, key[a:b])
                pair, j = np.repeat(doc[a:b], n) * many + item[which], place[which]
                order = np.lexsort((j, pair))
                pair, j = pair[order], j[order]
                new = np.diff(pair, prepend=-1) != 0
                # tokens from the last seed's end on, in order of places
                fresh = np.where(new, m, np.minimum(m, np.diff(j, prepend=0)))
                starts = np.flatnonzero(new)
                covered = np.add.reduceat(fresh, starts) if len(starts) else fresh
                pair = pair[starts]
                pairs.append(pair[100 * covered >= self.percent * self.size[pair % many]])
            out.append((m, at, k, np.concatenate([np.zeros(0, np.int64), *pairs])))
        return out

    def common(self, words: Words) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, seed tokens, places in the text, places in the item, seeds in a row) of the pairs that ``likely`` leaves: their maximal common runs.

        Pairs of places exist for ``CHUNK`` at a time only; what is kept of them are runs."""
        many = len(self.size)
        for m, at, k, pairs in self.likely(words):
            _, first, item, place = self.seeds[m]
            doc = words.doc[at]
            for d, lo, hi in groups(pairs // many):
                here = slice(*np.searchsorted(doc, [d, d + 1]))
                at_d, k_d, runs, wanted = at[here] - words.first[d], k[here], np.zeros((0, 4), np.int64), np.zeros(many, bool)
                wanted[pairs[lo:hi] % many] = True
                for a, b in chunks(first[k_d + 1] - first[k_d]):
                    which, n = expand(first, k_d[a:b])
                    i = np.repeat(at_d[a:b], n)
                    good = wanted[item[which]]
                    which, i = which[good], i[good]
                    seeds = np.stack([item[which], place[which] - i, i, np.ones(len(i), np.int64)], axis=1)
                    runs = np.concatenate([runs, joined(seeds)])
                runs = joined(runs)
                for t, a, b in groups(runs[:, 0]):
                    yield d, t, m, runs[a:b, 2], runs[a:b, 1] + runs[a:b, 2], runs[a:b, 3]

    def tiled(self, words: Words) -> list[tuple[int, int, int]]:
        """(text, item, covered tokens of the item) of contaminated pairs."""
        out = []
        for doc, item, m, i, j, seeds in self.common(words):
            size = int(self.size[item])
            covered = tile(i, j, seeds + m - 1, m, size)
            if 100 * covered >= self.percent * size:
                out.append((doc, item, covered))
        return sorted(out)


def groups(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of stretches of equal values."""
    turn = np.flatnonzero(np.diff(x)) + 1
    if len(x):
        for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(x)], strict=True):
            yield int(x[a]), a, b


def chunks(n: np.ndarray, edges: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches whose ``n`` sum to about ``CHUNK``; where ``edges`` are given, they end only where those change."""
    total, a = np.cumsum(n), 0
    ends = np.arange(1, len(n) + 1) if edges is None else np.append(np.flatnonzero(np.diff(edges)) + 1, len(n)) if len(n) else np.zeros(0, np.int64)
    sums = total[ends - 1]
    while a < len(n):
        k = np.searchsorted(sums, (total[a - 1] if a else 0) + CHUNK, "right")
        b = int(ends[max(k - 1, np.searchsorted(ends, a, "right"))])
        yield a, b
        a = b


def expand(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the entries of all ``keys``, how many each has)."""
    n = first[keys + 1] - first[keys]
    return np.repeat(first[keys], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), n


def joined(runs: np.ndarray) -> np.ndarray:
    """Runs (item, diagonal, place in the text, seeds), given by place, in order; those that follow each other put together."""
    if not len(runs):
        return runs
    low, high = int(runs[:, 1].min()), int(runs[:, 1].max())
    runs = runs[np.argsort(runs[:, 0] * (high - low + 1) + (runs[:, 1] - low), kind="stable")]
    new = np.ones(len(runs), bool)
    new[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0) | (runs[1:, 2] != runs[:-1, 2] + runs[:-1, 3])
    out = runs[new]
    out[:, 3] = np.add.reduceat(runs[:, 3], np.flatnonzero(new))
    return out


def tile(i: np.ndarray, j: np.ndarray, n: np.ndarray, m: int, size: int) -> int:
    """Tokens of an item of ``size`` that greedy tiles cover; maximal common runs of ``n`` tokens at (i, j), ``m`` at least."""
    runs = list(zip((-n).tolist(), j.tolist(), i.tolist(), strict=True))
    heapq.heapify(runs)
    base, reach = int(i.min()), np.zeros(size + 1, np.int64)
    np.add.at(reach, j, 1)
    np.add.at(reach, j + n, -1)
    most = int((np.cumsum(reach) > 0).sum())  # tokens in any run
    in_text, in_item, covered = np.zeros(int((i + n).max()) - base, bool), np.zeros(size, bool), 0
    while runs and covered < most:
        n, y, x = heapq.heappop(runs)
        free = ~(in_item[y : y - n] | in_text[x - base : x - base - n])
        if free.all():
            in_item[y : y - n] = in_text[x - base : x - base - n] = True
            covered -= n
            continue
        if np.count_nonzero(free) < m:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= m:
                heapq.heappush(runs, (a - b, y + a, x + a))
    return covered


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items with text, ``BLOCK_CHARS`` at most at once (a longer item alone)."""
    block, size = [], 0
    for r in benchmark.select(col(item_col), col(text_col)).where(F.length(col(text_col)) > 0).distinct().toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(tuple(r))
        size += len(r[1])
    if block:
        yield block


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", *, min_match: int = MIN_MATCH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, item_tokens, covered_tokens`` of every document and item that contaminates it."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_tokens bigint, covered_tokens bigint"
    arrow = benchmark.select(col(item_col)).limit(0).toArrow().schema.field(0).type
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(Items(block, min_match, percent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                texts = texts_of(batch.column(1))
                for a, b in slices(texts):
                    found = items.tiled(Words(texts[a:b], space=PUNCTUATION))
                    yield pa.record_batch([batch.column(0).take(pa.array([a + d for d, _, _ in found], pa.int64())), pa.array([items.id[i] for _, i, _ in found], arrow),
                                           pa.array([int(items.size[i]) for _, i, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())],
                                          ["doc_id", "item_id", "item_tokens", "covered_tokens"])

        out = out.union(docs.select(col(id_col), col(text_col)).mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *,
                      min_match: int = MIN_MATCH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; a narrow pass for each block of items."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, min_match, percent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep = texts_of(batch.column(at)), np.ones(batch.num_rows, bool)
                for a, b in slices(texts):
                    keep[[a + d for d, _, _ in shared.value.tiled(Words(texts[a:b], space=PUNCTUATION))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
