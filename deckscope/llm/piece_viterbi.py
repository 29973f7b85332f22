"""Encoding and decoding with a SentencePiece model by a batched Viterbi search.

A text, with its dummy first space and spaces as U+2581, is cut where a run of
spaces begins, which no piece of the model crosses.  Distinct words of equal
length (in code points) advance together: at each position the hashes of all
substrings that end there are looked up in the sorted keys of the pieces, the
best total score so far is kept by a vectorised maximum, and a backpointer
with it.  The model's merges rule out a piece after another that byte-pair
merging would not leave side by side (``bpe_merges``), which leaves the one
path that the library takes.  Code points outside the model become their
bytes.  Scores are merge ranks; ids that come out are the library's.

Defined cases: null or empty text has no ids and decodes to an empty text;
control pieces written in a text are plain text; rows of one id are encoded
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_merges import Merges, SortedKeys, by_length, symbol_hash
from .shared import col, free_name
from .texts import _BASE, _INVERSE, _power, hash_of, mix, rolled, slices, texts_of

SPACE = 0x2581
#: Distinct words a task remembers at most; words of more code points go one by one.
REMEMBERED, TOGETHER = 500_000, 40
UNKNOWN = -2


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def replay(text: str, rank: dict[str, int]) -> list[tuple]:
    """Byte-pair merging of a piece's own text, for the table of merges: (left, right) of every merge."""
    parts, done = list(text), []
    while True:
        options = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        if not options:
            return done if len(parts) == 1 else []
        _, i = min(options)
        done.append((parts[i], parts[i + 1]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Pieces:
    """The model's pieces by the sorted hashes of their text, scores, merges, bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte = np.full(256, -1, np.int64)
        self.text = [""] * n
        plain = {}
        for i in range(n):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(s[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[s] = i
                self.text[i] = s
        if (self.byte < 0).any():
            raise ValueError("the model has no piece for some byte")
        if any(chr(SPACE) in s.lstrip(chr(SPACE)) for s in plain):
            raise ValueError("a piece has a space after other text")
        scores = {s: sp.get_score(i) for s, i in plain.items()}
        places = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}  # equal scores, equal rank
        joined = {s: places[scores[s]] for s in plain if len(s) > 1}
        rank, left, right, ok = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        for s, i in plain.items():
            last = replay(s, joined) if len(s) > 1 else []
            ok[i] = len(s) == 1 or bool(last)
            if last:
                rank[i], left[i], right[i] = joined[s], plain[last[-1][0]], plain[last[-1][1]]
        self.merges = Merges(rank, left, right)
        self.score = np.where(rank >= 0, -rank.astype(np.float64), -float(len(places)))
        use = [(points(s), i) for s, i in plain.items() if ok[i]]
        self.longest = max(len(s) for s, _ in use)
        keys = np.array([hash_of(rolled(symbol_hash(s)), np.array([0]), np.array([len(s)]))[0] for s, _ in use], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = SortedKeys(keys[order]), np.array([i for _, i in use], np.int64)[order]
        self.single = np.sort(np.array([s[0] for s, _ in use if len(s) == 1], np.uint32))

    @classmethod
    def load(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            return cls(f.read())


class Encoder:
    """Ids of the words seen so far in ``pool``, found by a sorted array of hashes."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.forget()

    def forget(self):
        self.hash, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _known(self, symbols: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.p.single, symbols), len(self.p.single) - 1)
        return self.p.single[k] == symbols

    def together(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, its begin) at each end of the best paths of N words of equal length, both N x (L + 1); -1 off the lattice."""
        p, (n, length) = self.p, symbols.shape
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(symbol_hash(symbols) * _power(_BASE, length), axis=1, out=sums[:, 1:])
        inverse, known = _power(_INVERSE, length + 1), self._known(symbols)
        best = np.full((n, length + 1), -np.inf)
        piece, back = np.full((n, length + 1), -1, np.int64), np.zeros((n, length + 1), np.int32)
        best[:, 0] = 0
        for j in range(1, length + 1):
            for i in range(max(0, j - p.longest), j):
                rows, k = p.keys.hits(mix((sums[:, j] - sums[:, i]) * inverse[i] + np.uint64(j - i)))
                token = p.ids[k]
                if i and len(rows):
                    before = piece[rows, i]
                    fits = before == UNKNOWN
                    seen = np.flatnonzero(before >= 0)
                    fits[seen] = p.merges.compatible(before[seen], token[seen])
                    rows, token = rows[fits], token[fits]
                total = best[rows, i] + p.score[token]
                better = total > best[rows, j]
                rows = rows[better]
                best[rows, j], piece[rows, j], back[rows, j] = total[better], token[better], i
            alone = np.flatnonzero(~known[:, j - 1])  # bytes stand for it, whatever is beside it
            best[alone, j], piece[alone, j], back[alone, j] = best[alone, j - 1], UNKNOWN, j - 1
        return piece, back

    def one(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word: what matches where is found by numpy, a length at a time."""
        p, n = self.p, len(symbols)
        sums, starts, ends, tokens = rolled(symbol_hash(symbols)), [], [], []
        for m in range(1, min(n, p.longest) + 1):
            i = np.arange(n - m + 1)
            hit, k = p.keys.hits(hash_of(sums, i, i + m))
            starts.append(i[hit]), ends.append(i[hit] + m), tokens.append(p.ids[k])
        odd = np.flatnonzero(~self._known(symbols))
        start, end, token = (np.concatenate(x) for x in ([*starts, odd], [*ends, odd + 1], [*tokens, np.full(len(odd), UNKNOWN)]))
        order = np.lexsort((start, end))
        piece, back, best, known = [-1] * (n + 1), [0] * (n + 1), [-np.inf] * (n + 1), {}
        best[0], score = 0.0, p.score
        for i, j, t in zip(start[order].tolist(), end[order].tolist(), token[order].tolist(), strict=True):
            if i and piece[i] == -1:
                continue
            if i and t >= 0 and piece[i] >= 0:
                if (key := (piece[i], t)) not in known:
                    known[key] = bool(p.merges.compatible(np.array([piece[i]]), np.array([t]))[0])
                if not known[key]:
                    continue
            total = best[i] + (score[t] if t >= 0 else 0.0)
            if total > best[j]:
                best[j], piece[j], back[j] = total, t, i
        return np.array(piece)[None], np.array(back)[None]

    def _read(self, symbols: np.ndarray, piece: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has): backpointers followed from the end."""
        n, length = symbols.shape
        at, taken = np.full(n, length), np.zeros((n, length + 1), bool)
        while (go := np.flatnonzero(at > 0)).size:
            taken[go, at[go]] = True
            at[go] = back[go, at[go]]
        row, end = np.nonzero(taken)
        ids = piece[row, end]
        if (ids == -1).any():
            raise AssertionError("a word without a path")
        odd = np.flatnonzero(ids == UNKNOWN)
        if not len(odd):
            return ids.astype(np.uint32), taken.sum(axis=1)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in symbols[row[odd], end[odd] - 1].tolist()]
        repeat = np.ones(len(ids), np.int64)
        repeat[odd] = [len(x) for x in raw]
        out = np.repeat(ids, repeat)
        out[out == UNKNOWN] = self.p.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.uint32), np.bincount(row, weights=repeat, minlength=n).astype(np.int64)

    def learn(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray):
        size, n, at, total = end - start, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), len(self.pool)
        pool = [self.pool]
        for group in by_length(size):
            length = int(size[group[0]])
            for g in [group] if length <= TOGETHER else group[:, None]:
                symbols = cp[start[g][:, None] + np.arange(length)]
                ids, n[g] = self._read(symbols, *(self.together(symbols) if length <= TOGETHER else self.one(symbols[0])))
                at[g] = total + np.cumsum(n[g]) - n[g]
                total += len(ids)
                pool.append(ids)
        h = np.concatenate([self.hash, hashes])
        order = np.argsort(h, kind="stable")
        self.hash, self.at, self.n, self.pool = h[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order], np.concatenate(pool)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the end)."""
        cp = points("".join(chr(SPACE) + x.decode() if x else "" for x in texts)).copy()
        cp[cp == 32] = SPACE
        edge = np.concatenate([[0], np.cumsum([len(x.decode()) + 1 if x else 0 for x in texts])])
        if not len(cp):
            return np.zeros(0, np.uint32), edge
        space = cp == SPACE
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[edge[:-1][np.diff(edge) > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(cp))
        h = hash_of(rolled(symbol_hash(cp)), start, end)
        u, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(u) > REMEMBERED:
            self.forget()
        fresh = np.flatnonzero(~np.isin(u, self.hash, assume_unique=True))
        if len(fresh):
            self.learn(cp, start[where[fresh]], end[where[fresh]], u[fresh])
        k = np.searchsorted(self.hash, u)
        at, n = self.at[k][inverse], self.n[k][inverse]
        sums = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(at - sums[:-1], n) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(start, edge)]


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of some ids: bytes are put together again, the dummy first space goes."""
    byte_of = {int(i): b for b, i in enumerate(pieces.byte)}
    out = b"".join(bytes([byte_of[i]]) if i in byte_of else pieces.text[i].encode() for i in ids.tolist()).decode("utf-8", "replace")
    out = out.replace(chr(SPACE), " ")
    return out[1:] if out.startswith(" ") else out


class Decoder:
    """``decode`` of many texts: pieces' bytes gathered from one array."""

    def __init__(self, pieces: Pieces):
        raw = [x.replace(chr(SPACE), " ").encode() for x in pieces.text]
        for b, i in enumerate(pieces.byte):
            raw[i] = bytes([b])
        self.size = np.array([len(x) for x in raw], np.int64)
        self.at, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        n = self.size[ids]
        sums = np.concatenate([[0], np.cumsum(n)])
        data = self.data[np.repeat(self.at[ids] - sums[:-1], n) + np.arange(sums[-1])].tobytes()
        edge = sums[begin]
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = True) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_crc32``, ``round_trip`` (decoding gives the text back, U+2581 as a space) and, if wanted, ``ids``."""
    import zlib

    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))  # bounded by the vocabulary
    out_id = id_col if id_col.lower() not in ("n_tokens", "ids_crc32", "round_trip", "ids") else free_name(["n_tokens", "ids_crc32", "round_trip", "ids"], id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                got, begin = encoder(texts[a:b])
                same = [x == t or x == t.replace(b"\xe2\x96\x81", b" ") for x, t in zip(decoder(got, begin), texts[a:b], strict=True)]
                parts = [got[i:j] for i, j in zip(begin[:-1], begin[1:], strict=True)]
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(begin), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()), pa.array(same, pa.bool_())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(got.astype(np.int32))))
                yield pa.record_batch(columns, [out_id, "n_tokens", "ids_crc32", "round_trip", *["ids"] * ids])

    schema = f"`{out_id}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * ids
    return docs.select(col(id_col), col(text_col)).mapInArrow(run, schema)
