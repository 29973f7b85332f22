"""Texts joined to a user's term table of any size (H6, Q1).

A term hits a text that contains it.  Instead of testing every (text, term)
pair, a gram index over the terms meets the grams of the texts: each term is
keyed by that one of its ``GRAM``-byte pieces which fewest other terms have
(a shorter term by itself), and what has a piece at some place of a text
is compared in full there.  Texts and terms are bytes (UTF-8 of the
lower-cased text), so a place is found at once, however long the text is.

An index of at most ``INDEX_ROWS`` counted rows and ``INDEX_BYTES`` is
broadcast, and each text gives one row with the numbers of the terms in it;
beyond that every text gives a row per place, its pieces are shuffled without
their texts and joined, and only candidates meet their text again.  The texts'
lists, smaller than the texts, are dealt to the tasks by id before they are
taken apart: the hits, far more, are made distinct and counted where they
arise.  Nothing is compiled into the plan, so the table may grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckscope.functions.text import split_sentences
from deckscope.operators.ranking import materialize
from deckscope.session import default_parallelism

GRAM = 4
#: Terms whose index may be broadcast, after counting them (rows of the term table likewise), and their bytes.
INDEX_ROWS, INDEX_BYTES = 500_000, 32 << 20
#: Bytes of text (of one longer text: all) that a task looks through at once.
SLICE = 1 << 20


def bind(x: Column, body) -> Column:
    """``body`` of ``x``, evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def pieces(data: Column, sizes) -> Column:
    """For each of ``sizes`` in turn, the hash of the piece of that many bytes (at the end: of what is left) at every place."""
    def of_size(x, n):
        return F.transform(F.sequence(F.lit(1), F.octet_length(x)), lambda i: F.xxhash64(F.substring(x, i, F.lit(n))))

    return bind(data, lambda x: F.concat(*[of_size(x, n) for n in sizes]))


def grams(data: np.ndarray) -> np.ndarray:
    """The ``GRAM`` bytes at every place as one number (beyond the end: 0)."""
    x = np.concatenate([data, np.zeros(GRAM - 1, np.uint8)]).astype(np.uint32)
    return x[: len(data)] | x[1 : len(data) + 1] << 8 | x[2 : len(data) + 2] << 16 | x[3:] << 24


class TermIndex:
    """Terms by their pieces; ``find`` tells which of them some texts contain."""

    def __init__(self, numbers: list[int], terms: list[bytes], shifts: list[int]):
        self.numbers, self.shift = np.array(numbers, np.int64), np.array(shifts, np.int64)
        self.size = np.array([len(x) for x in terms], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.grams = grams(np.frombuffer(b"".join(terms), np.uint8))
        self.pieces = []  # (mask of the bytes, sorted pieces, their terms, whether any piece has these upper bits when mixed)
        for n in sorted(set(np.minimum(self.size, GRAM).tolist())):
            mask = np.uint32((1 << 8 * n) - 1)
            of = np.flatnonzero(np.minimum(self.size, GRAM) == n)
            keys = self.grams[self.begin[of] + self.shift[of]] & mask
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[self._mixed(keys)] = True
            self.pieces.append((mask, n, keys[order], of[order], seen))

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        return (x * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, term's number) of all pairs, once each, ascending by text."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        end = np.cumsum([len(x) for x in texts])
        here = grams(data)
        found = []
        for mask, n, keys, terms, seen in self.pieces:
            piece = here & mask
            at = np.flatnonzero(seen[self._mixed(piece)])
            low, high = np.searchsorted(keys, piece[at], "left"), np.searchsorted(keys, piece[at], "right")
            many = high - low
            term = terms[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            at = np.repeat(at, many)
            text = np.searchsorted(end, at, "right")
            start = at - self.shift[term]
            inside = (start >= (end - np.fromiter(map(len, texts), np.int64, len(texts)))[text]) & (start + self.size[term] <= end[text])
            text, term, start = text[inside], term[inside], start[inside]
            size, done = self.size[term], 0
            while n == GRAM and len(term) and done < int(size.max()):  # the rest of each term, GRAM bytes a step
                step = np.minimum(done, size - GRAM)
                same = here[start + step] == self.grams[self.begin[term] + step]
                text, term, start, size, done = text[same], term[same], start[same], size[same], done + GRAM
            found.append(np.unique(text * len(self.size) + term))
        pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(len(self.size), 1), self.numbers[pairs % max(len(self.size), 1)]


def terms_of(base: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``_numbers`` (``_no`` of all terms in it) of each row of ``base`` (text ``_lc``) that has a term; the index is broadcast."""
    rows = index.select("_no", "_term", "_shift").toArrow()  # INDEX_ROWS at most
    shared = base.sparkSession.sparkContext.broadcast(TermIndex(*(rows[c].to_pylist() for c in ("_no", "_term", "_shift"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pa.compute.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
                text, numbers = shared.value.find(batch.column(0).slice(a, b - a).to_pylist())
                which, first = np.unique(text, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), pa.array(numbers, pa.int64()))
                if len(which):
                    yield pa.record_batch([*(c.take(pa.array(which + a)) for c in batch.columns[1:]), lists], [*keys, "_numbers"])
                a = b

    schema = T.StructType([*(base.schema[k] for k in keys), T.StructField("_numbers", T.ArrayType(T.LongType()))])
    return base.select("_lc", *keys).mapInArrow(run, schema)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of one ``key`` in one task, in as many tasks as a shuffle has (at least four a core): the work on a row is many times its size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * default_parallelism(spark)), F.col(key))


def term_index(names: DataFrame) -> DataFrame:
    """``_term, _no`` (a number), ``_piece`` (its hash) and ``_shift`` (its place in the term) of distinct lower-case terms ``_term`` as bytes."""
    last = F.greatest(F.octet_length("_term") - GRAM, F.lit(0))
    grams = materialize(names.select("_term", F.posexplode(pieces(F.col("_term"), [GRAM])).alias("at", "piece")).filter(F.col("at") <= last))
    shared = grams.groupBy("piece").agg(F.count_distinct("_term").alias("_n"))
    best = grams.join(shared.hint("merge"), "piece").groupBy("_term").agg(F.min(F.struct("_n", "at", "piece")).alias("_b"))
    return best.select("_term", F.col("_b.piece").alias("_piece"), F.col("_b.at").alias("_shift"), F.monotonically_increasing_id().alias("_no"))


def term_hits(texts: DataFrame, terms: DataFrame, text_col: str, term_col: str, keep_text, keep_terms,
              index_rows: int = INDEX_ROWS) -> DataFrame:
    """``_t0..`` (``keep_text``), ``_term`` and ``_k0..`` (``keep_terms``) of all texts and terms where the
    lower-cased text contains the lower-cased term; pairs may repeat."""
    kept = [f"_k{i}" for i in range(len(keep_terms))]
    table = materialize(terms.select(F.lower(term_col).cast("binary").alias("_term"), *[F.col(c).alias(k) for k, c in zip(kept, keep_terms)])
                        .filter(F.octet_length("_term") > 0).distinct())
    index = materialize(term_index(table.select("_term").distinct()))
    facts = index.agg(F.count(F.lit(1)), F.sum(F.octet_length("_term")), F.collect_set(F.least(F.octet_length("_term"), F.lit(GRAM)))).first()
    keys = [f"_t{i}" for i in range(len(keep_text))]
    base = texts.select(F.lower(text_col).cast("binary").alias("_lc"), *[F.col(c).alias(k) for k, c in zip(keys, keep_text)]).filter(F.octet_length("_lc") > 0)
    if max(facts[0], table.count()) <= index_rows and (facts[1] or 0) <= INDEX_BYTES:
        found = dealt(terms_of(base, index, keys), keys[0]).select(*keys, F.explode("_numbers").alias("_no"))
        return found.join(F.broadcast(index.select("_no", "_term").join(table, "_term")), "_no")
    sizes = sorted(facts[2]) or [GRAM]       # at most GRAM different ones
    at = (F.col("_pos") % F.octet_length("_lc")).alias("_at")
    inside = F.col("_at") >= F.col("_shift")
    here = F.substring("_lc", F.col("_at") - F.col("_shift") + 1, F.octet_length("_term")) == F.col("_term")
    base = base.withColumn("_fp", F.xxhash64("_lc"))
    rows = base.select("_lc", "_fp", *keys, F.posexplode_outer(pieces(F.col("_lc"), sizes)).alias("_pos", "piece")).select("_fp", *keys, at, "piece")
    found = rows.join(index, (F.col("piece") == F.col("_piece")) & inside).select("_fp", *keys, "_at", "_shift", "_term")
    again = base.select(F.col("_lc"), F.col("_fp").alias("_fp2"), *[F.col(k).alias(f"{k}_2") for k in keys]).distinct()
    same = (F.col("_fp") == F.col("_fp2")) & here
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    return found.join(again, same).select(*keys, "_term").join(table, "_term")


def term_join(texts: DataFrame, terms: DataFrame, text_col: str, term_col: str, keep_text, keep_terms,
              index_rows: int = INDEX_ROWS) -> DataFrame:
    """Distinct ``keep_text`` + ``keep_terms`` of all texts and terms where the
    lower-cased text contains the lower-cased term.

    NULL and empty texts and terms hit nothing.  ``index_rows=0`` forces the
    shuffled form (tests)."""
    hits = term_hits(texts, terms, text_col, term_col, keep_text, keep_terms, index_rows)
    return hits.select(*[F.col(f"_t{i}").alias(c) for i, c in enumerate(keep_text)], *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep_terms)]).distinct()


def sentence_terms(df: DataFrame, terms: DataFrame, text_col: str = "full_text", id_col: str = "doc_id",
                   group_col: str = "section", term_col: str = "term") -> DataFrame:
    """H6 with a term table: one row (document, sentence position, section)
    for every kept sentence that contains a term of the section."""
    sents = df.select(id_col, F.posexplode(split_sentences(F.col(text_col))).alias("pos", "sentence"))
    return term_join(sents, terms, "sentence", term_col, [id_col, "pos"], [group_col])


def lexicon_scores(df: DataFrame, table: DataFrame, text_col: str = "text", id_col: str = "doc_id", cap: float = 10.0) -> DataFrame:
    """Q1 for score dimensions: ``id, dimension, hits, score`` from a table
    ``(dimension, component, term, weight, cap, coef)``.

    A component is ``least(distinct terms present * weight, cap)`` with its
    largest weight, cap and coefficient; a dimension is the sum of its
    components times their coefficients, in component order, at most ``cap``.
    Documents without a hit in a dimension have no row (score 0); rows of one
    id count as one document."""
    each = table.groupBy("dimension", "component", F.lower("term").alias("term")).agg(*[F.max(c).alias(c) for c in ("weight", "cap", "coef")])
    hits = term_hits(df, each, text_col, "term", [id_col], ["dimension", "component", "weight", "cap", "coef"]).select(
        F.col("_t0").alias(id_col), F.col("_k0").alias("dimension"), F.col("_k1").alias("component"), "_term", *[f"_k{i}" for i in (2, 3, 4)])
    part = hits.groupBy(id_col, "dimension", "component").agg(
        F.count_distinct("_term").alias("n"), F.max("_k2").alias("w"), F.max("_k3").alias("c"), F.max("_k4").alias("k"))
    value = F.least(F.col("n") * F.col("w"), F.col("c")) * F.col("k")
    per = part.groupBy(id_col, "dimension").agg(F.sum("n").alias("hits"), F.sort_array(F.collect_list(F.struct("component", value.alias("v")))).alias("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x["v"])
    return per.select(id_col, "dimension", "hits", F.least(total, F.lit(cap)).alias("score"))
