"""Language identification by interpolated Kneser-Ney character models.

A text's words are its runs of letters, in lower case, each with a border on
both sides; a language's model gives every letter and the last border a
probability after up to ``ORDER - 1`` characters of the word.  N-grams of all
languages are one sorted array of hashes per order, beside it a row of log
probabilities and of backoff weights, a column a language; looking a
character up means finding the longest n-gram that any language has.  A text
gets the language of the least cross-entropy per character.

Counts cover every training row; a task sends each n-gram it has met once.
Continuation counts and discounts are aggregated by Spark over all n-grams, and
none is dropped.  Tables come in blocks of about ``BLOCK_NGRAMS``, dealt by the
last but one character: an n-gram, what precedes it, its context's others and
all it backs off to are in one block (beside the single characters, which each
has), so a character is looked up in one.  Tasks hold a block at a time.
Temperature of
the score and rejection (``rejected``: a cross-entropy above that of 99.9 % of
the predicted language's own texts, to a thousandth of a nat) are calibrated on
all training rows: texts are measured once, and what is summed is a row a
language and thousandth.

Defined cases: null text or none with a letter is ``und`` with score 0; without
any training row all texts are; equal cross-entropies go to the first language
by name; rows with a null id are never trained on and not held out; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_merges import SortedKeys, symbol_hash
from .shared import col, stored
from .texts import SLICE, hash_of, rolled, slices, texts_of

ORDER = 4
#: N-grams of a block (one more only if a single last but one character has them), slices of texts a block is read for.
BLOCK_NGRAMS, HELD_SLICES = 1_000_000, 16
#: Of the score's temperature, those that are tried; parts of a nat in which cross-entropies are counted.
SCALES, PARTS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0), 1000
BORDER = 0x10FFFF
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


class LetterWords:
    """The distinct words of some texts, bordered: ``cp`` one after the other, ``edge`` where each begins and the end; ``word``, ``text`` of each occurrence."""

    def __init__(self, texts: list[bytes]):
        low = [x.decode().lower() for x in texts]
        cp = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
        turn = np.diff(np.concatenate([[0], letters()[cp].view(np.int8)]))
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.text = np.searchsorted(np.cumsum([len(x) + 1 for x in low]), start, "right")
        u, first, self.word, self.n = np.unique(hash_of(rolled(symbol_hash(cp)), start, end), return_index=True, return_inverse=True, return_counts=True)
        start, size = start[first], (end - start)[first]
        self.edge = np.concatenate([[0], np.cumsum(size + 2)])
        self.cp = np.full(int(self.edge[-1]), BORDER, np.uint32)
        inside = np.ones(len(self.cp), bool)
        inside[self.edge[:-1]] = inside[self.edge[1:] - 1] = False
        self.cp[inside] = cp[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(size) else []
        self.of = np.repeat(np.arange(len(u)), size + 2)  # the word of each code point


def ngram_hashes(w: LetterWords, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, hash, hash of its first m - 1, of its last m - 1, last but one character: -1 of single ones) of every n-gram of m that does not end on a word's first border."""
    sums = rolled(symbol_hash(w.cp))
    end = np.arange(m, len(w.cp) + 1)
    end = end[(w.of[end - 1] == w.of[end - m]) & (end - w.edge[w.of[end - 1]] >= 2)] if len(end) else end
    return w.of[end - 1], hash_of(sums, end - m, end), hash_of(sums, end - m, end - 1), hash_of(sums, end - m + 1, end), w.cp[end - 2].astype(np.int64) if m > 1 else np.full(len(end), -1)


# --- counting ---------------------------------------------------------------
COUNTS = "lang string, m int, h bigint, context bigint, suffix bigint, pen bigint, n bigint"


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """``lang, m, h, context, suffix, pen, n`` over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def packed(parts):  # a hash tells its order too
            rows = np.concatenate(parts)
            _, first, inverse = np.unique(rows[:, 1], return_index=True, return_inverse=True)
            return np.column_stack([rows[first, :5], np.bincount(inverse, weights=rows[:, 5]).astype(np.int64)])

        for batch in batches:
            texts, langs = texts_of(batch.column(0)), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for lang in sorted({x for x in langs[a:b] if x is not None}):
                    w = LetterWords([t for t, x in zip(texts[a:b], langs[a:b], strict=True) if x == lang])
                    new = held.setdefault(lang, [])
                    for m in range(1, order + 1):
                        word, h, context, suffix, pen = ngram_hashes(w, m)
                        if len(h):
                            new.append(packed([np.column_stack([np.full(len(h), m), h.view(np.int64), context.view(np.int64), suffix.view(np.int64), pen, w.n[word]])]))
                    if len(new) > 16 * order:
                        held[lang] = [packed(new)]
        for lang, parts in held.items():
            if parts:
                rows = packed(parts)
                yield pa.record_batch([pa.array([lang] * len(rows)), pa.array(rows[:, 0], pa.int32()), *(pa.array(rows[:, i], pa.int64()) for i in range(1, 6))], [x.split()[0] for x in COUNTS.split(", ")])

    rows = docs.where(col(lang_col).isNotNull()).select(col(text_col), col(lang_col).cast("string")).mapInArrow(run, COUNTS)
    return rows.groupBy("lang", "m", "h").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.min("pen").alias("pen"), F.sum("n").alias("n"))


def continuations(counts: DataFrame) -> DataFrame:
    """``counts`` with ``raw``: how many different characters precede an n-gram; at a word's begin none can, and at the highest order none is counted, so counts stand."""
    left = counts.where("m > 1").groupBy("lang", (F.col("m") - 1).alias("m"), F.col("suffix").alias("h")).agg(F.count("*").alias("left"))
    return counts.join(left, ["lang", "m", "h"], "left").withColumn("raw", F.coalesce("left", "n")).drop("left")


class Block:
    """Of each order: sorted hashes and log probability per language; sorted hashes of contexts (which may be n-grams of other blocks) and log backoff weight."""

    def __init__(self, counts: dict[str, np.ndarray], discounts: np.ndarray):
        """``counts``: columns lang (index), m, h, context, suffix, raw; ``discounts``: a row an order, a column a language."""
        self.order, k = discounts.shape
        self.keys, self.p, self.contexts, self.b = [], [], [], []
        for m in range(1, self.order + 1):
            c = {x: v[counts["m"] == m] for x, v in counts.items()}
            c["h"], c["context"], c["suffix"] = (c[x].view(np.uint64) for x in ("h", "context", "suffix"))
            keys = np.unique(c["h"])
            at = np.searchsorted(keys, c["h"])
            raw = np.zeros((len(keys), k))
            raw[at, c["lang"]] = c["raw"]
            d = discounts[m - 1]
            context = np.zeros(len(keys), np.uint64)
            context[at] = c["context"]
            ctx, where = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(ctx), k)), np.zeros((len(ctx), k))
            np.add.at(total, where, raw)
            np.add.at(kinds, where, raw > 0)
            gamma = np.where(total > 0, np.minimum(1.0, np.maximum(d * kinds, 1e-9) / np.maximum(total, 1e-9)), 1.0)
            suffix = np.zeros(len(keys), np.uint64)
            suffix[at] = c["suffix"]
            if m == 1:
                below = np.full((len(keys), k), 1.0 / (len(keys) + 1))  # a character none has seen: this times gamma
                self.floor = np.log(gamma[0] / (len(keys) + 1)) if len(ctx) else np.zeros(k)
            else:
                j = np.searchsorted(self.keys[-1].keys, suffix)
                below = np.exp(self.p[-1])[j]
            p = np.maximum(raw - d, 0) / np.maximum(total, 1e-9)[where] + gamma[where] * below
            self.keys.append(SortedKeys(keys)), self.p.append(np.log(p)), self.contexts.append(SortedKeys(ctx)), self.b.append(np.log(gamma))

    def scores(self, sums: np.ndarray, end: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Log probability, in every language, of the characters before ``end``, of which ``inside`` are in the word."""
        got = np.zeros((len(end), self.p[0].shape[1]))
        open_ = np.arange(len(end))
        for m in range(self.order, 0, -1):
            go = open_[inside[open_] >= m]
            hit, i = self.keys[m - 1].hits(hash_of(sums, end[go] - m, end[go]))
            got[go[hit]] += self.p[m - 1][i]
            open_ = np.setdiff1d(open_, go[hit], assume_unique=True)
            miss = open_[inside[open_] >= m]
            if m == 1:
                got[miss] += self.floor
            else:
                hit, i = self.contexts[m - 1].hits(hash_of(sums, end[miss] - m, end[miss] - 1))
                got[miss[hit]] += self.b[m - 1][i]
        return got


class Model:
    """``blocks``: broadcast; ``starts``: the least last but one character of each."""

    def __init__(self, langs: list[str], blocks: list, starts: list[int]):
        self.langs, self.blocks, self.starts = langs, blocks, np.array(starts, np.int64)
        self.scale, self.worst = 1.0, np.full(len(langs), np.inf)

    @property
    def keys(self) -> list[SortedKeys]:
        """Of the single characters, then of each block and higher order."""
        return [self.blocks[0].value.keys[0], *(k for b in self.blocks for k in b.value.keys[1:])]

    def all_word_scores(self, words: list[LetterWords]) -> list[np.ndarray]:
        todo = []
        for w in words:
            end = np.arange(2, len(w.cp) + 1)
            inside = end - w.edge[w.of[end - 1]] if len(end) else end  # characters of the word up to it
            end, inside = end[inside >= 2], inside[inside >= 2]
            block = np.maximum(np.searchsorted(self.starts, w.cp[end - 2].astype(np.int64), "right") - 1, 0)
            todo.append((w, rolled(symbol_hash(w.cp)), end, inside, block, np.zeros((len(end), len(self.langs)))))
        for i, shared in enumerate(self.blocks):
            for _, sums, end, inside, block, got in todo:
                at = np.flatnonzero(block == i)
                got[at] = shared.value.scores(sums, end[at], inside[at])
            if len(self.blocks) > 1:  # the next one takes its memory
                vars(shared).pop("_value", None)
        found = []
        for w, _, end, _, _, got in todo:
            out = np.zeros((len(w.edge) - 1, len(self.langs)))
            word = w.of[end - 1]
            for k in range(len(self.langs)):
                out[:, k] = np.bincount(word, weights=got[:, k], minlength=len(out))
            found.append(out)
        return found

    def word_scores(self, w: LetterWords) -> np.ndarray:
        """Log probability of each distinct word in every language."""
        return self.all_word_scores([w])[0]

    def slices(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(from, to) of texts to be scored at once: more if there are blocks to be read for them."""
        return slices(texts, SLICE * (HELD_SLICES if len(self.blocks) > 1 else 1))

    def cross_entropy(self, texts: list[bytes]) -> np.ndarray:
        """Nats per character of each text in every language; NaN without a letter."""
        parts = [(a, b, LetterWords(texts[a:b])) for a, b in slices(texts)]
        out = np.zeros((len(texts), len(self.langs)))
        for (a, b, w), scores in zip(parts, self.all_word_scores([w for _, _, w in parts]), strict=True):
            size = np.diff(w.edge) - 1  # the letters and the last border
            n = np.bincount(w.text, weights=size[w.word], minlength=b - a)
            for k in range(len(self.langs)):
                out[a:b, k] = -np.bincount(w.text, weights=scores[w.word, k], minlength=b - a)
            out[a:b] /= np.where(n > 0, n, np.nan)[:, None]
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, -1 for none; score; rejected)."""
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        return self.decide(self.cross_entropy(texts))

    def decide(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``predict`` from the cross-entropies."""
        none = np.isnan(e[:, 0])
        e = np.where(none[:, None], 0.0, e)
        best = e.argmin(1)
        least = e[np.arange(len(e)), best]
        score = 1 / np.exp(-self.scale * (e - least[:, None])).sum(1)
        return np.where(none, -1, best), np.where(none, 0.0, score), none | (least > self.worst[best])


def _collect_counts(counts: DataFrame, most: int) -> DataFrame:
    """``counts`` without the rarest n-grams of two or more, if there are more than ``most``; single characters stay."""
    sizes = counts.where("m > 1").groupBy(F.least(F.col("n"), F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect()  # 1000 rows at most
    total = 0
    for r in sizes:
        total += r["count"]
        if total > most:
            return counts.where((F.col("m") == 1) | (F.col("n") > r["n"]))
    return counts


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, most: int | None = None, sample_rows: int | None = None, block: int = BLOCK_NGRAMS, calibrated: bool = True) -> Model:
    """The model of all n-grams, calibrated on all rows; only if a caller gives ``most``, the rarest beyond are left out of its tables, and ``sample_rows``, that many rows calibrate it.

    ``calibrated=False``: for a caller who measures the texts anyway and goes on with :func:`calibrate`."""
    counts = stored(count_ngrams(docs, text_col, lang_col, order), "ngrams")
    rows = stored(continuations(counts), "continuations")
    tops = rows.groupBy("lang", "m").agg(F.count_if(F.col("raw") == 1).alias("ones"), F.count_if(F.col("raw") == 2).alias("twos")).collect()  # languages times orders
    langs = sorted({r.lang for r in tops})
    if not langs:
        return Model([], [], [])
    place = {x: i for i, x in enumerate(langs)}
    discounts = np.full((order, len(langs)), 0.5)
    for r in tops:
        if r.ones:
            discounts[r.m - 1, place[r.lang]] = r.ones / (r.ones + 2 * r.twos)
    if most is not None:
        rows = _collect_counts(rows, most)
    starts, held = [-1], 0
    for r in rows.where("m > 1").groupBy("pen").count().orderBy("pen").collect():  # a row a character
        if held and held + r["count"] > block:
            starts.append(r.pen)
            held = 0
        held += r["count"]
    blocks = []
    for a, b in zip(starts, [*starts[1:], BORDER + 1], strict=True):
        got = rows.where((F.col("m") == 1) | ((F.col("pen") >= a) & (F.col("pen") < b))).select("lang", "m", "h", "context", "suffix", "raw").toArrow()
        columns = {"lang": np.array([place[x] for x in got["lang"].to_pylist()], np.int64)} | {x: got[x].to_numpy().astype(np.int64) for x in ("m", "h", "context", "suffix", "raw")}
        keep = np.ones(len(columns["m"]), bool)
        for m in range(2, order + 1 if most is not None else 0):  # an n-gram whose suffix was pruned goes too
            here, below = columns["m"] == m, (columns["m"] == m - 1) & keep
            keep[here] &= np.isin(columns["suffix"][here], columns["h"][below])
        blocks.append(docs.sparkSession.sparkContext.broadcast(Block({x: v[keep] for x, v in columns.items()}, discounts)))
    model = Model(langs, blocks, starts)
    if calibrated:
        rows = docs.where(col(lang_col).isNotNull())
        calibrate(model, measure(rows if sample_rows is None else rows.limit(sample_rows), model, text_col, [lang_col]), lang_col)
    return model


def measure(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``_e`` of every row: its text's cross-entropy in each of the model's languages (NaN without a letter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in model.slices(texts):
                e = model.cross_entropy(texts[a:b]) if model.langs else np.zeros((b - a, 0))
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(e.tolist(), pa.list_(pa.float64()))], [*keep, "_e"])

    schema = T.StructType([*(T.StructField(k, docs.schema[k].dataType) for k in keep), T.StructField("_e", T.ArrayType(T.DoubleType()))])
    return docs.select(col(text_col), *[col(k) for k in keep]).mapInArrow(run, schema)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), k)


def calibrate(model: Model, measured: DataFrame, lang_col: str = "lang") -> None:
    """Sets the model's temperature and rejection from all rows of ``measured`` with one of its languages."""
    if not model.langs:
        return
    place = {x: i for i, x in enumerate(model.langs)}
    names = ["truth", "part", "n", *(f"loss{i}" for i in range(len(SCALES)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            e = _matrix(batch.column(1), len(place))
            good = ~np.isnan(e).any(1) & (truth >= 0)
            truth, e = truth[good], e[good]
            own = e[np.arange(len(e)), truth]
            key, of = np.unique(np.column_stack([truth, np.ceil(own * PARTS).astype(np.int64)]), axis=0, return_inverse=True)
            sums = [np.bincount(of, minlength=len(key))]
            for scale in SCALES:
                z = -scale * (e - own[:, None])
                most = z.max(1, keepdims=True)
                loss = np.log(np.exp(z - most).sum(1)) + most[:, 0]
                sums.append(np.zeros(len(key), np.int64))
                np.add.at(sums[-1], of, np.rint(loss * 1e6).astype(np.int64))  # whole numbers: sums are the same in any order
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (key[:, 0], key[:, 1], *sums)], names)

    rows = measured.select(col(lang_col).cast("string"), "_e").mapInArrow(run, ", ".join(f"{x} bigint" for x in names))
    rows = sorted(rows.groupBy("truth", "part").agg(*[F.sum(x).alias(x) for x in names[2:]]).collect())  # a row a language and thousandth of a nat
    if not rows:
        return
    table = np.array([tuple(r) for r in rows], object)
    losses = [sum(table[:, 3 + i]) for i in range(len(SCALES))]
    model.scale = SCALES[losses.index(min(losses))]
    for k in range(len(model.langs)):
        mine = table[table[:, 0] == k]
        if len(mine):
            up_to = np.cumsum(mine[:, 2])
            at = int(np.flatnonzero(1000 * up_to >= 999 * up_to[-1])[0])
            model.worst[k] = mine[at, 1] / PARTS + 0.1


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row, from its text alone."""
    return decide(measure(docs, model, text_col, [id_col]), model, id_col)


def decide(measured: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """:func:`identify` of measured rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.langs, UNKNOWN]
        for batch in batches:
            n = batch.num_rows
            best, score, rejected = model.decide(_matrix(batch.column(1), len(model.langs))) if model.langs else (np.full(n, -1), np.zeros(n), np.zeros(n, bool))
            yield pa.record_batch([batch.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return measured.select(col(id_col), "_e").mapInArrow(run, f"doc_id {dict(measured.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")
