"""Token ids of all texts in files: frequency-ranked, byte-aligned, control bytes apart.

Encoding: texts are cut at ASCII white space, which no token of the word-level
vocabulary crosses; each distinct piece of a task goes through the library
once, and numpy puts a text's ids together.  Plain trailing punctuation is cut
off and A-Z folded first, which the vocabulary's own rules do too.

File format: rows of blocks, ascending by ``doc_id`` over all shards.  A block
holds the ids of whole documents as ranks by frequency over the whole corpus
(the rank table beside the blocks gives the id of each).  Four ranks share a control byte, two
bits each for 1 to 4 data bytes (least significant first); decoding looks the
lengths of a control byte up in a table and gathers the bytes with numpy.
Each block carries the CRC-32 of its bytes; rank table and format version are
files too, so another session reads everything back from the path alone.

Defined cases: a null or empty text has the end id only; rows of one id (or
none, which come first) stand side by side, ordered by their ids; an empty
table gives no block.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckscope.session import ensure_checkpoint_dir

from .shared import col, shuffle_partitions, stored
from .texts import BYTE_VALUES, Words, hash_of, rolled, slices, texts_of

END_ID = 1
#: Distinct pieces a task remembers at most, and ids of a block at most (a longer document is a block of its own).
REMEMBERED, BLOCK_IDS = 500_000, 1 << 19
#: Texts of some 4000 characters whose encodings are held at once.
GROUP = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?*#$%&")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids of many texts; ``pool`` holds those of the pieces seen so far, found by a sorted array of hashes."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        ids = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for x, i in ids.items() if x.endswith("</w>")]] = True
        self.forget()

    def forget(self):
        self.hash, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def _encoded(call, texts: list[str]) -> Iterator:
        """The library's encodings, ``GROUP`` texts at a time: they are large beside the ids that are kept."""
        for a in range(0, len(texts), GROUP):
            yield from call(texts[a : a + GROUP], add_special_tokens=False)

    def _learn(self, pieces: list[str], hashes: np.ndarray):
        """Joined by spaces, many pieces are one call.  A piece of letters alone ends with the first token that ends a
        word; of others a token's offset tells its piece."""
        counts, at, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), len(self.pool)
        pool, plain = [self.pool], np.fromiter((x.isalpha() if x.isascii() else unicodedata.normalize("NFC", x).lower().isalpha() for x in pieces), bool, len(pieces))
        for kind in (True, False):
            of = np.flatnonzero(plain == kind)
            mine = [pieces[i] for i in of.tolist()]
            edges = np.flatnonzero(np.diff(np.cumsum([0, *map(len, mine)]) // 4000)) + 1  # some 4000 characters a call
            edges = np.unique(np.concatenate([[0], edges, [len(mine)]])).tolist()
            texts = [" ".join(mine[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            if kind:
                ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self._encoded(self.tokenizer.encode_batch_fast, texts))])
                end = np.flatnonzero(self.ends[ids])
                if len(end) != len(mine):  # letters to us that are none to the library: all go by offsets
                    plain[:] = False
                    continue
                counts[of] = np.diff(end, prepend=-1)
            else:
                got = []
                for a, b, e in zip(edges, edges[1:], self._encoded(self.tokenizer.encode_batch, texts), strict=False):
                    starts = np.cumsum([0] + [len(x) + 1 for x in mine[a : b - 1]])
                    begin = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
                    counts[of[a:b]] = np.bincount(np.searchsorted(starts, begin, "right") - 1, minlength=b - a)
                    got.append(np.array(e.ids, np.uint32))
                ids = np.concatenate([np.zeros(0, np.uint32), *got])
            at[of] = size + np.cumsum(counts[of]) - counts[of]
            size += len(ids)
            pool.append(ids)
        self.pool = np.concatenate(pool)
        h = np.concatenate([self.hash, hashes])
        order = np.argsort(h, kind="stable")
        self.hash, self.at, self.n = h[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, counts])[order]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, where each text's begin and the end)."""
        w = Words(texts, hashed=False)
        start, end, doc = w.start, w.end, w.doc
        split = np.flatnonzero(_TAIL[w.data[end - 1]] & (end - start > 1))
        cut, begin = end[split], start[split]
        for _ in range(4):
            cut = np.where((cut - 1 > begin) & _TAIL[w.data[cut - 1]], cut - 1, cut)
        good = _LETTER[w.data[cut - 1]]
        split, cut = split[good], cut[good]
        start, last = np.insert(start, split + 1, cut), end[split]
        end[split] = cut
        end = np.insert(end, split + 1, last)
        doc = np.insert(doc, split + 1, doc[split])
        # pieces with a special token's first character keep their letters' case
        odd = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(w.data == ord("<"), out=odd[1:])
        kept = odd[end] > odd[start]
        h = hash_of(rolled(BYTE_VALUES[_FOLD[w.data]]), start, end)
        if kept.any():
            h[kept] = hash_of(rolled(BYTE_VALUES[w.data]), start[kept], end[kept]) ^ np.uint64(0x5555)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(u) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(~np.isin(u, self.hash, assume_unique=True))
        if len(new):
            plain, folded = w.data.tobytes(), _FOLD[w.data].tobytes()
            self._learn([(plain if kept[k] else folded)[start[k] : end[k]].decode() for k in first[new]], u[new])
        k = np.searchsorted(self.hash, u)
        at, n = self.at[k][inverse], self.n[k][inverse]
        per_doc = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(per_doc + 1)])
        total = int(n.sum())
        source = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)
        out = np.full(int(begin[-1]), END_ID, np.uint32)
        text_ids = np.ones(len(out), bool)
        text_ids[begin[1:] - 1] = False
        out[text_ids] = self.pool[source]
        return out, begin


def pack(ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Ids on their way to the files: the planes of their bytes that are not all zero, compressed."""
    x = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    planes = max(1, (int(ids.max()).bit_length() + 7) // 8)
    return squeeze.compress(x[:planes].tobytes())


def unpack(packed: bytes, n: int, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    planes = np.frombuffer(expand.decompress(packed), np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u4").reshape(-1)


# --- the coding -------------------------------------------------------------
#: Data bytes of each of the four ranks that a control byte stands for.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_LIMITS = np.array([1 << 8, 1 << 16, 1 << 24], np.uint64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    ranks = ranks.astype("<u4")
    code = np.searchsorted(_LIMITS, ranks.astype(np.uint64), "right")
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= code[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length) - length
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


# --- the job ----------------------------------------------------------------
def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, packed`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = Encoder(shared.value), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                ids, begin = encoder(texts[a:b])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(begin), pa.int64()),
                                       pa.array([pack(ids[i:j], squeeze) for i, j in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], ["doc_id", "n_tokens", "packed"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(col(id_col), col(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, packed binary")


def _added(total: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    got = np.bincount(np.concatenate(parts), minlength=len(total)) if parts else total
    got[: len(total)] += total if parts else 0
    return got


def id_counts(encoded: DataFrame) -> DataFrame:
    """``id, n`` over all documents; a task sends one row for each id it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, expand = np.zeros(0, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            parts, size = [], 0
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.append(unpack(packed, n, expand))
                size += n
                if size > BLOCK_IDS:
                    total, parts, size = _added(total, parts), [], 0
            total = _added(total, parts)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["id", "n"])

    return encoded.select("n_tokens", "packed").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def by_frequency(encoded: DataFrame) -> np.ndarray:
    """The id of each rank; its length is bounded by the vocabulary."""
    counts = id_counts(encoded).collect()
    counts.sort(key=lambda r: (-r.n, r.id))
    return np.array([r.id for r in counts], np.uint32)


BLOCKS = "shard int, before bigint, n_docs bigint, n_ids bigint, doc_ids binary, lengths binary, control binary, data binary, crc bigint"
#: Version of the files' format; readers refuse others.
FORMAT = 1


def write_blocks(encoded: DataFrame, ids: np.ndarray) -> DataFrame:
    """The files' rows, ranks instead of ids, ascending by ``doc_id`` from shard to shard."""
    spark = encoded.sparkSession
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0  # before: the shard's ids before the block
        docs, parts, size, expand = [], [], 0, zstandard.ZstdDecompressor()

        def flush():
            ranks = shared.value[np.concatenate(parts)]
            control, data = encode_ranks(ranks)
            known = np.array([d is not None for d in docs])
            values = np.array([d if d is not None else 0 for d in docs], "<i8")
            row = [shard, before, len(docs), len(ranks), known.tobytes() + values.tobytes(), np.array([len(x) for x in parts], "<u8").tobytes(), control, data]
            row = [[x] for x in (*row, _crc(row[4:]))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], BLOCKS.replace(" binary", "").replace(" bigint", "").replace(" int", "").split(", "))

        for batch in batches:
            for d, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and size + n > BLOCK_IDS:
                    yield flush()
                    before, docs, parts, size = before + size, [], [], 0
                docs.append(d)
                parts.append(unpack(packed, n, expand))
                size += n
        if docs:
            yield flush()

    order = ["doc_id", "n_tokens", "packed"]
    return encoded.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions(*order).select(*order).mapInArrow(run, BLOCKS)


def _crc(parts: list[bytes]) -> int:
    crc = 0
    for x in parts:
        crc = zlib.crc32(x, crc)
    return crc


def save_files(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The files under ``path``: ``blocks`` (ranks), ``ranks`` (the id of each rank, at most the vocabulary) and, last, ``format`` (version, files' ids).

    They stand alone: :func:`load_files` needs the path only."""
    spark = docs.sparkSession
    if dict(docs.dtypes)[id_col] != "bigint":
        docs = docs.withColumn(id_col, col(id_col).cast("bigint"))
    encoded = stored(encode_texts(docs, vocabulary, id_col, text_col), "token-ids", codec="zstd")
    ids = by_frequency(encoded)
    write_blocks(encoded, ids).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame(list(enumerate(ids.tolist())), "rank long, id long").write.parquet(f"{path}/ranks")
    spark.createDataFrame([(FORMAT, len(ids), _crc([ids.astype("<u4").tobytes()]))], "version int, ids long, crc long").write.parquet(f"{path}/format")


def load_files(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """(the files' blocks, the id of each rank), from the path alone; an error if the version or the rank table is not what was written."""
    told = spark.read.parquet(f"{path}/format").first()
    ids = np.array([r.id for r in sorted(spark.read.schema("rank long, id long").parquet(f"{path}/ranks").collect())], np.uint32)
    if told.version != FORMAT or told.ids != len(ids) or told.crc != _crc([ids.astype("<u4").tobytes()]):
        raise ValueError(f"{path} holds no token files of version {FORMAT}")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), ids


def write_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(the files as a table of blocks, the id of each rank), written under ``path`` (else in the shared folder) and read back."""
    path = path or f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/tables/token-files-{uuid.uuid4().hex}"
    save_files(docs, vocabulary, path, id_col, text_col)
    return load_files(docs.sparkSession, path)


def read_documents_ids(blocks: DataFrame, ids: np.ndarray, make, schema: str) -> DataFrame:
    """``make(doc_id, start, ids)`` gives a row of ``schema`` for each document; ``start``: ids of all documents before it."""
    spark = blocks.sparkSession
    shards = sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row a file
    offset, total = {}, 0
    for r in shards:
        offset[r.shard], total = total, total + r.n
    shared = spark.sparkContext.broadcast((ids, offset))
    names = [x.split()[0] for x in schema.split(", ")]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank, offset = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                if _crc([r[c] for c in ("doc_ids", "lengths", "control", "data")]) != r["crc"]:
                    raise ValueError(f"block at {r['before']} of file {r['shard']} is not what was written")
                got = by_rank[decode_ranks(r["control"], r["data"], r["n_ids"])]
                n = r["n_docs"]
                known, values = np.frombuffer(r["doc_ids"][:n], bool), np.frombuffer(r["doc_ids"][n:], "<i8")
                lengths = np.frombuffer(r["lengths"], "<u8").astype(np.int64)
                begin = np.cumsum(lengths) - lengths
                start = offset[r["shard"]] + r["before"]
                rows = [make(int(v) if k else None, start + int(b), got[b : b + m]) for k, v, b, m in zip(known, values, begin, lengths, strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=out)

    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    out = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    return blocks.mapInArrow(run, schema)


def digest(doc_id, start: int, ids: np.ndarray) -> tuple:
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
