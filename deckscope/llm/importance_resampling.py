"""Target-distribution importance resampling with segment de-duplication.

Features are runs of 1 to ``n`` words, hashed into buckets.  A bucket's gain is
the log ratio of its (smoothed) share of the target's features to its share of
the corpus's; a document's weight is the mean gain of its features.  Gumbel
noise from a hash of the id makes the highest scores a weighted draw without
replacement, the same on every run.

A newline is a separator of words, so it cuts a text into lines whose features
stay inside them.  The corpus is grouped by line: a line's features are counted
once and multiplied by its occurrences; the runs of words that cross a newline
are counted from the texts and added.  Scoring does likewise inside each
batch: a distinct line's gains are summed once, and every text adds those of
its lines and of its crossing runs.

Defined cases: null or empty text has no features and weighs 0; a document
whose id is null is weighed but has no score and is not drawn; repeated rows
are weighed and drawn each by itself; an empty corpus or target leaves the
smoothing counts alone; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .shared import col, stored
from .texts import PUNCTUATION, SLICE, Words, slices, texts_of

N, BUCKETS, MIN_WORDS, DRAW_PCT, SEED = 1, 10_000, 20, 10, 2024
#: Words of more bytes are hashed one by one.
LONG = 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


CRC = _crc_table()


def crc_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 registers ``state``, each carried on over its data[start:end], all a byte at a time."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, out = start[order], state[order]
    long = int(np.count_nonzero(size > LONG))
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + size[order[i]]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    ends = np.bincount(size[order[long:]], minlength=LONG + 1)  # words of each length
    left = len(order) - int(ends[0])
    for k in range(LONG):
        if left <= long:
            break
        c = out[long:left]
        out[long:left] = CRC[(c ^ data[at[long:left] + k]) & 255] ^ (c >> np.uint32(8))
        left -= int(ends[k + 1])
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: list[bytes], n: int, buckets: int, crossing: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all runs of 1 to n words inside a line of a text, or of all that cross a newline."""
    words = Words(texts, space=PUNCTUATION, hashed=False)
    data = _FOLD[words.data]
    line = np.cumsum(words.data == 10, dtype=np.int64)[words.start]
    found = []
    for m in range(2 if crossing else 1, n + 1):
        i = np.arange(max(0, len(line) - m + 1))
        i = i[(words.doc[i] == words.doc[i + m - 1]) & ((line[i] != line[i + m - 1]) == crossing)]
        state = np.full(len(i), 0xFFFFFFFF, np.uint32)
        for k in range(m):
            if k:
                state = CRC[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))
            state = crc_on(state, data, words.start[i + k], words.end[i + k])
        found.append((words.doc[i], (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets))
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.zeros(0, np.int64),) * 2


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of all features of all texts: at most ``buckets`` rows."""

    def counted(crossing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets, np.int64)
            for batch in batches:
                texts, times = texts_of(batch.column(0)), batch.column(1).to_numpy()
                for a, b in slices(texts):
                    owner, bucket = features(texts[a:b], n, buckets, crossing)
                    np.add.at(total, bucket, times[a:b][owner])
            hit = np.flatnonzero(total)
            yield pa.record_batch([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

        return run

    text = docs.select(col(text_col).alias("text")).where("text <> ''")
    lines = text.select(F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("times"))
    out = lines.mapInArrow(counted(False), "bucket bigint, n bigint")
    if n > 1:
        out = out.unionByName(text.where(F.contains("text", F.lit("\n"))).select("text", F.lit(1).cast("long").alias("times")).mapInArrow(counted(True), "bucket bigint, n bigint"))
    return out.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths, from two :func:`bucket_counts` (two rows a bucket come to the driver)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in corpus.select("bucket", "n", F.lit(0).alias("of")).union(target.select("bucket", "n", F.lit(1))).collect():
        (t if row[2] else s)[row[0]] = row[1]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row; ``gain`` (one number a bucket) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def sums(texts: list[bytes], crossing: bool) -> tuple[np.ndarray, np.ndarray]:
        owner, bucket = features(texts, n, len(shared.value), crossing)
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, owner, shared.value[bucket])
        return np.bincount(owner, minlength=len(texts)), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, SLICE):
                lines = [x.split(b"\n") for x in texts[a:b]]
                number: dict[bytes, int] = {}
                of = np.array([number.setdefault(x, len(number)) for xs in lines for x in xs], np.int64)
                doc = np.repeat(np.arange(b - a), [len(xs) for xs in lines])
                distinct = list(number)
                count, total, words = (np.zeros(b - a, np.int64) for _ in range(3))
                line_count, line_total = sums(distinct, False)
                line_words = np.diff(Words(distinct, space=PUNCTUATION, hashed=False).first) if n > 1 else line_count
                for out, each in ((count, line_count), (total, line_total), (words, line_words)):
                    np.add.at(out, doc, each[of])
                if n > 1:
                    cross_count, cross_total = sums(texts[a:b], True)
                    count, total = count + cross_count, total + cross_total
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(words), pa.array(count), pa.array(total // np.maximum(count, 1))],
                                      ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(col(id_col), col(text_col)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_words bigint, n_features bigint, weight bigint")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of SHA-256 of ``seed:id``; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", *, n: int = N,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, draw_pct: int = DRAW_PCT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; ``rank`` 1, 2, 3... of the drawn ones, null of the others.

    Drawn are the highest ``draw_pct`` percent of scores among documents of at least
    ``min_words`` words, ties to the smaller id.  Scores are whole thousandths of a
    bounded range (some 170,000 values at most), so counts per score tell the
    driver the least score that can be drawn, and only rows from there up are put in order.
    """
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_text_col, n, buckets), buckets)
    scored = stored(weigh(docs, gain, id_col, text_col, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    may = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    by_score = scored.where(may).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.col("score").desc()).collect()
    draw, seen, least = draw_pct * sum(r.n for r in by_score) // 100, 0, None
    for r in by_score:
        if seen >= draw:
            break
        seen, least = seen + r.n, r.score
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = F.coalesce(may & (F.col("score") >= least), F.lit(False))
    ranked = prefix_sums(scored.where(high), [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")], {"rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < draw, F.col("rank") + 1))
    return ranked.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))
