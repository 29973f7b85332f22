"""Periodic run detection by block convolution.

A run is a longest stretch of words with smallest period q that holds at least
``EXPONENT`` periods and ``SHORTEST`` words.  At each dyadic scale L the words
are cut into blocks of L, and the runs with L <= q < 2 L are looked for: every
whole block inside such a run occurs again q words on.  The number-theoretic
transform gives, for all distances from L to 2 L at once, the sum of squared
differences of a block and the words that follow; word numbers are reduced so
far at each scale that the sums stay below the prime, so they are exact, and
zero means no mismatch.  Blocks one after another with zero at the same
distance are a seed; it is compared word by word and extended at both ends, by
less than a block.  A seed inside a run of a smaller scale is that run again.

Left out beforehand are only blocks that can't be in such a run: one of their
words does not occur again within 2 L words of their text, or the text has
fewer than ``EXPONENT`` L words.  All texts of a slice are one sequence here;
no word equals a word of another text.  Words are told by 64-bit hashes.

Memory is some arrays of a slice of texts, or of one longer text (periods up to 2**26
words).

Defined cases: null or empty text has no words and no runs, and collapses to
an empty text; a row is judged by itself, so ties, repeated rows and null ids
give a row each; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_cascade import let
from .shared import SPACE_CLASS, col
from .texts import Words, slices, texts_of

EXPONENT, SHORTEST = 4, 6
#: The prime 15 * 2**27 + 1 and a generator of its units.
PRIME, GENERATOR = 2013265921, 31
_P = np.uint64(PRIME)
#: Numbers transformed at a time.
POINTS = 1 << 18
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    if (half, inverse) not in _roots:
        root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        out = np.ones(half, np.uint64)
        k = 1
        while k < half:
            out[k : 2 * k] = out[: min(k, half - k)] * np.uint64(pow(root, k, PRIME)) % _P
            k *= 2
        _roots[half, inverse] = out
    return _roots[half, inverse]


def _below(x: np.ndarray) -> np.ndarray:
    """Sums of two residues as residues: x - P wraps to something huge unless x >= P."""
    return np.minimum(x, x - _P)


def transform(rows: np.ndarray) -> np.ndarray:
    """The transform of each row (a power of two long), in bit-reversed order."""
    k, n = rows.shape
    half = n // 2
    while half:
        pairs = rows.reshape(k, -1, 2, half)
        rows = np.empty_like(pairs)
        rows[:, :, 0] = _below(pairs[:, :, 0] + pairs[:, :, 1])
        rows[:, :, 1] = (pairs[:, :, 0] + (_P - pairs[:, :, 1])) * _powers(half, False) % _P
        half //= 2
    return rows.reshape(k, n)


def transform_back(rows: np.ndarray) -> np.ndarray:
    """The rows whose :func:`transform` these are."""
    k, n = rows.shape
    half = 1
    while half < n:
        pairs = rows.reshape(k, -1, 2, half)
        turned = pairs[:, :, 1] * _powers(half, True) % _P
        rows = np.empty_like(pairs)
        rows[:, :, 0] = _below(pairs[:, :, 0] + turned)
        rows[:, :, 1] = _below(pairs[:, :, 0] + (_P - turned))
        half *= 2
    return rows.reshape(k, n) * np.uint64(pow(n, -1, PRIME)) % _P


def occurrences(ids: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) wherever a block of ``size`` ids may occur ``size`` to 2 size - 1 further on.

    The ids are compared modulo the largest number with which the sums of squares are below the prime.
    """
    value = (ids % int(((PRIME - 1) // size) ** 0.5)).astype(np.uint64)
    found, step = [], max(1, POINTS // (2 * size))
    for at in range(0, len(blocks), step):
        some = blocks[at : at + step]
        first = some[:, None] * size
        block = value[first + np.arange(size)]
        place = first + size + np.arange(2 * size)
        window = np.where(place < len(ids), value[np.minimum(place, len(ids) - 1)], np.uint64(0))
        turned = np.zeros_like(window)
        turned[:, :size] = block[:, ::-1]
        products = transform_back(transform(turned) * transform(window) % _P)[:, size - 1 : 2 * size - 1]
        squares = np.zeros((len(some), 2 * size + 1), np.uint64)
        np.cumsum(window * window, axis=1, out=squares[:, 1:])
        apart = (block * block).sum(1)[:, None] + squares[:, size : 2 * size] - squares[:, :size] - np.uint64(2) * products
        b, d = np.nonzero((apart == 0) & (place[:, :size] + size <= len(ids)))
        found.append((some[b], d + size))
    return (np.concatenate([b for b, _ in found]), np.concatenate([d for _, d in found])) if found else (np.zeros(0, np.int64),) * 2


def _chains(block: np.ndarray, distance: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First places in (block, distance), ordered by distance and block, of the series of neighbours, and their lengths."""
    new = np.ones(len(block), bool)
    new[1:] = (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(block)))


def _needed(distance: np.ndarray, size: int, exponent: int, shortest: int) -> np.ndarray:
    """Whole blocks that the shortest run of this period holds, without its last period."""
    return np.maximum(1, (np.maximum(shortest, exponent * distance) - distance - size + 1) // size)


def _agree(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, distance: np.ndarray) -> np.ndarray:
    ok = (at >= 0) & (at + distance < len(ids))
    i = np.where(ok, at, 0)
    j = np.where(ok, at + distance, 0)
    return ok & (ids[i] == ids[j]) & (doc[i] == doc[j])


def _reach(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, step: int, distance: np.ndarray, size: int) -> np.ndarray:
    """How many of the ``size`` words from ``at`` in steps of +1 or -1 agree with those at their distance, up to the first that does not."""
    out = np.zeros(len(at), np.int64)
    part = max(1, POINTS // size)
    for a in range(0, len(at), part):
        ok = _agree(ids, doc, at[a : a + part, None] + step * np.arange(size), distance[a : a + part, None])
        out[a : a + part] = np.where(ok.all(1), size, ok.argmin(1))
    return out


def find_runs(words: Words, exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of all runs, ``start`` counted from the first text's first word, by start and period.

    ``exponent`` is at least 4: seeds rely on whole blocks in a row.
    """
    if exponent < 4:
        raise ValueError("runs hold at least four periods")
    doc, n = words.doc, len(words.doc)
    runs = np.zeros((0, 3), np.int64)
    if not n:
        return runs
    ids = np.unique(words.hash, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n, np.int64)
    same = (ids[order[1:]] == ids[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    text_words = np.diff(words.first)[doc]
    size = 1
    while exponent * size <= text_words.max():
        whole = n // size
        first = np.arange(whole) * size
        may = (again[: whole * size].reshape(whole, size).max(1) < 2 * size) & (doc[first] == doc[first + size - 1]) & (text_words[first] >= exponent * size)
        block, distance = occurrences(ids, np.flatnonzero(may), size)
        by = np.lexsort((block, distance))
        block, distance = block[by], distance[by]
        starts = np.argsort(runs[:, 0], kind="stable")
        begin, end = runs[starts, 0], np.maximum.accumulate(runs[starts, 0] + runs[starts, 1]) if len(runs) else np.zeros(0, np.int64)
        for compared in (False, True):
            at, count = _chains(block, distance, size)
            stay = count >= _needed(distance[at], size, exponent, shortest)
            before = np.searchsorted(begin, block[at] * size, "right") - 1  # a run of a smaller scale around the whole seed is the seed's
            if len(begin):
                stay &= (before < 0) | (end[np.maximum(before, 0)] < (block[at] + count) * size + distance[at])
            kept = np.repeat(stay, count)
            block, distance = block[kept], distance[kept]
            if not compared:
                equal = _reach(ids, doc, block * size, 1, distance, size) == size
                block, distance = block[equal], distance[equal]
        at, count = _chains(block, distance, size)
        low, high, period = block[at] * size, (block[at] + count) * size, distance[at]
        low, high = low - _reach(ids, doc, low - 1, -1, period, size), high + _reach(ids, doc, high, 1, period, size)
        long = high - low + period >= np.maximum(shortest, exponent * period)
        runs = np.concatenate([runs, np.stack([low, high - low + period, period], 1)[long]])
        size *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(words: Words, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts with every run cut to its first period and words joined by one space."""
    turn = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(turn[:-1]) == 0)
    doc, start, end = words.doc[kept], words.start[kept], words.end[kept]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    edge = np.zeros(len(words.data) + 2, np.int8)
    edge[start] += 1
    np.add.at(edge, end + np.where(last, 0, 1), -1)  # each word and the byte after it, which becomes a space
    data = words.data.copy()
    data[end] = 32
    sizes = np.zeros(len(words.first) - 1, np.int64)
    np.add.at(sizes, doc, end - start + ~last)
    return np.concatenate([[0], np.cumsum(sizes)]), data[np.cumsum(edge[: len(data)], dtype=np.int8) > 0]


RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_words, runs, text`` of every row: runs as (start, length, period) by start and period, the text with each run cut to one period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                words = Words(texts[a:b], lower=False)
                runs = find_runs(words, exponent, shortest)
                owner = words.doc[runs[:, 0]]
                offsets = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, 0] - words.first[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(RUNS))
                cut, data = collapsed(words, runs)
                text = pa.StringArray.from_buffers(b - a, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(offsets), rows), text],
                                      ["doc_id", "n_words", "runs", "text"])

    return docs.select(col(id_col), col(text_col)).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")


def planted(id_: Column, text: Column) -> Column:
    """The text, or for a tenth of ids, told by their CRC-32, one whose words repeat from some word on."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        def from_word(x: Column) -> Column:  # (a, p)
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 1),
                                            lambda i: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " ")

        n = F.size(w).cast("long")
        a = g % n
        return F.when(n > 0, let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), from_word)).otherwise("")

    return F.when(h % 10 == 0, let(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda x: x != ""), repeated)).otherwise(text)
