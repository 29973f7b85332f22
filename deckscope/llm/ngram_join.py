"""Documents whose sets of word shingles are alike, as a T-occurrence search.

A document's set meets another with a Jaccard similarity of t or more only if
they share T = t * size shingles, so of its inverted lists it is enough to
merge the shortest ones and to probe the long ones (DivideSkip):

1. Shingles go, as 40-bit keys within hash buckets, in packed rows to their
   bucket's task, which counts each key's documents (the lists' lengths).
   A key that many documents of a block have goes once, with their number, and
   its documents wait with the block, so a shingle of every document gives an
   entry a block.  The number of buckets follows the table's size.
   Lists of one document link nothing; the others' keys return to their
   documents, and documents with fewer than T such keys are alone for sure.
2. Equal sets are one class from here on.
3. Short lists: the T-th longest list and all longer ones aside, at least one
   of the others holds every partner.  They are merged by a shuffle on the key.
   Each list's most central class is compared with the others first; what that
   links needs no further pair.  Lists that still hold several components give
   the pairs between them whose sizes, places in the lists' order and hash
   places leave room for the overlap; a long list's pairs are dealt to several
   tasks.
4. A candidate's remaining lists are probed by binary search in the sorted keys
   of its partner, unless even all of them could not reach the overlap.

No link between different sets is lost: pairs are left out only if their
classes are known to be in one component.

Defined cases: null or empty texts have an empty set and link with nothing;
fewer words than a shingle's are one shingle; rows of one id are documents of
their own with that id; ``component_id`` is the smallest id in the component
(null ids do not count; a null id alone stays null); an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import col, shuffle_partitions, stored
from .texts import Words, distinct_by_doc, mix, shingle_hashes, slices, texts_of

N, PERCENT = 5, 75
#: Shingles of a block of documents, at most (a longer document is a block of its own); bits of a key within its bucket.
BLOCK, BITS = 1 << 20, 40
BUCKETS_A_PARTITION = 4
#: Bytes of the table for a bucket; buckets at most; keys that a block should have for each bucket, and its shingles at most.
BUCKET_BYTES, MOST_BUCKETS, KEYS_A_ROW, MOST_BLOCK = 16 << 20, 1 << 18, 32, 1 << 23
#: Documents of a block from which on their common key is sent once; rows of a list that one task pairs with the list.
REPEATED, LIST_ROWS = 8, 1000
#: Words of 64 hash places that tell most unlike sets apart.
WIDTH = 4


def _pack(keys: np.ndarray) -> bytes:
    """The low five bytes of each key, in planes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return out.view("<u8").reshape(-1)


def bucket_count(docs: DataFrame) -> int:
    """Buckets so that one's keys fit a task: by the size that the plan knows of its input, else (a plan that can't tell) by the texts' bytes."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >> 50:
        size = docs.agg(F.sum(F.octet_length(docs.columns[1]))).first()[0] or 0
    return int(min(MOST_BUCKETS, max(BUCKETS_A_PARTITION * shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES)))


def _blocks(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows: for each block and bucket the documents (place in the block, how many keys) and keys, and the repeated keys with their counts;
    and a row of the block's ids, set sizes and repeated keys with their documents."""
    task, serial = TaskContext.get().partitionId(), 0
    names = ["bucket", "block", "docs", "counts", "keys", "hot", "many"]
    ids, docs, hashes, size = [], [], [], 0
    most = min(max(BLOCK, KEYS_A_ROW * buckets), MOST_BLOCK)

    def flush():
        doc, h = (np.concatenate(x) for x in (docs, hashes))
        block = task << 24 | serial
        key = (h // np.uint64(buckets)) & np.uint64((1 << BITS) - 1) | (h % np.uint64(buckets)) << np.uint64(BITS)
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        often = times[inverse] >= REPEATED
        order = np.argsort(inverse[often], kind="stable")
        hot, hot_doc = key[often][order], doc[often][order]
        first = np.flatnonzero(np.concatenate([[True], hot[1:] != hot[:-1]])) if len(hot) else np.zeros(0, int)
        hot, many = hot[first], np.diff(np.append(first, len(hot))).astype("<u4")
        key, doc_of = key[~often], doc[~often]
        order = np.argsort(key >> np.uint64(BITS), kind="stable")
        key, doc_of = key[order], doc_of[order]
        bucket, hot_bucket = (key >> np.uint64(BITS)).astype(np.int64), (hot >> np.uint64(BITS)).astype(np.int64)  # both in order
        rows = []
        for x in np.union1d(bucket, hot_bucket):
            (a, b), (c, d) = (np.searchsorted(of, [x, x + 1]) for of in (bucket, hot_bucket))
            mine = doc_of[a:b]
            turn = np.append(np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])), b - a) if b > a else np.zeros(1, int)
            rows.append((int(x), block, mine[turn[:-1]].astype("<u4").tobytes(), np.diff(turn).astype("<u4").tobytes(), _pack(key[a:b]), _pack(hot[c:d]), many[c:d].tobytes()))
        known = np.array([i is not None for i in ids])
        values = np.array([0 if i is None else i for i in ids], "<i8")
        rows.append((buckets + block % buckets, block, known.tobytes() + values.tobytes(), np.bincount(doc, minlength=len(ids)).astype("<u4").tobytes(), hot_doc.astype("<u4").tobytes(), hot.tobytes(), many.tobytes()))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], names)

    for batch in batches:
        texts, new = texts_of(batch.column(1)), batch.column(0).to_pylist()
        for a, b in slices(texts):
            doc, h = distinct_by_doc(*shingle_hashes(Words(texts[a:b]), n))
            if ids and (size + len(h) > most or len(ids) + b - a > 1 << 20):
                yield flush()
                serial, ids, docs, hashes, size = serial + 1, [], [], [], 0
            docs.append(doc + len(ids)), hashes.append(h), ids.extend(new[a:b])
            size += len(h)
    if ids:
        yield flush()


def _shared(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket's rows: the keys that two documents or more have, and how many; rows of ids pass."""
    rows = table.to_pylist()
    out = [r | {"df": b""} for r in rows if r["bucket"] >= buckets]
    rows = [r for r in rows if r["bucket"] < buckets]
    if rows:
        keys, hot = [_unpack(r["keys"]) for r in rows], [_unpack(r["hot"]) for r in rows]
        many = np.concatenate([np.ones(sum(map(len, keys)), np.int64), *(np.frombuffer(r["many"], "<u4").astype(np.int64) for r in rows)])
        _, inverse = np.unique(np.concatenate(keys + hot), return_inverse=True)
        df = np.minimum(np.bincount(inverse, weights=many).astype(np.int64)[inverse], 2**32 - 1)
        at, hot_at = 0, sum(map(len, keys))
        for r, k, h in zip(rows, keys, hot, strict=True):
            mine, hot_df = df[at : at + len(k)], df[hot_at : hot_at + len(h)]
            at, hot_at = at + len(k), hot_at + len(h)
            keep = mine > 1
            if keep.any() or len(h):
                doc = np.repeat(np.frombuffer(r["docs"], "<u4"), np.frombuffer(r["counts"], "<u4"))[keep]
                turn = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc)) if len(doc) else np.zeros(1, int)
                out.append({"bucket": r["bucket"], "block": r["block"], "docs": doc[turn[:-1]].astype("<u4").tobytes(), "counts": np.diff(turn).astype("<u4").tobytes(),
                            "keys": _pack(k[keep]), "df": mine[keep].astype("<u4").tobytes(), "hot": r["hot"], "many": hot_df.astype("<u4").tobytes()})
    return pa.Table.from_pylist(out, schema=_SHARED)


_PACKED = "bucket int, block bigint, docs binary, counts binary, keys binary, hot binary, many binary"
_SHARED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in ("docs", "counts", "keys", "hot", "many", "df"))])
_SETS = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("center", pa.int64()), ("gap", pa.int64()), ("keys", pa.binary()), ("short", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def _sets(table: pa.Table, buckets: int, percent: int) -> pa.Table:
    """A block's documents; ``keys`` (sorted) and ``short`` lists of those that may have a partner."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["bucket"] >= buckets)
    n = np.frombuffer(head["counts"], "<u4").astype(np.int64)
    known, ids = np.frombuffer(head["docs"][: len(n)], bool), np.frombuffer(head["docs"][len(n) :], "<i8")
    rows = [r for r in rows if r["bucket"] < buckets]
    doc = np.concatenate([np.zeros(0, np.int64), *(np.repeat(np.frombuffer(r["docs"], "<u4"), np.frombuffer(r["counts"], "<u4")) for r in rows)]).astype(np.int64)
    key = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r["keys"]) | np.uint64(r["bucket"] << BITS) for r in rows)])
    df = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["df"], "<u4") for r in rows)]).astype(np.int64)
    hot, many = np.frombuffer(head["hot"], "<u8"), np.frombuffer(head["many"], "<u4")
    if len(hot):  # the block's own documents of its repeated keys, with the lengths that the buckets told
        told = np.concatenate([_unpack(r["hot"]) | np.uint64(r["bucket"] << BITS) for r in rows])
        order = np.argsort(told)
        length = np.concatenate([np.frombuffer(r["many"], "<u4") for r in rows])[order][np.searchsorted(told[order], hot)]
        doc = np.concatenate([doc, np.frombuffer(head["keys"], "<u4").astype(np.int64)])
        key, df = np.concatenate([key, np.repeat(hot, many)]), np.concatenate([df, np.repeat(length.astype(np.int64), many)])
    found = np.bincount(doc, minlength=len(n))
    need = -(-percent * n // 100)  # the least overlap with any partner
    may = (found >= need) & (n > 0)
    use = may[doc]
    doc, key, df = doc[use], key[use], df[use]
    order = np.lexsort((key, doc))
    doc, key, df = doc[order], key[order], df[order]
    first = np.searchsorted(doc, np.arange(len(n) + 1))
    center = np.bincount(doc, weights=np.log2(df), minlength=len(n)) * 1000 / np.maximum(n, 1)
    keys, short, bits = [None] * len(n), [None] * len(n), [None] * len(n)
    flag = np.zeros((len(n), 64 * WIDTH), bool)  # which of that many hash places a set has
    flag[doc, (mix(key) % np.uint64(64 * WIDTH)).astype(np.int64)] = True
    flag = np.packbits(flag, axis=1, bitorder="little").view("<i8")
    for i in np.flatnonzero(may):
        k, d = key[first[i] : first[i + 1]], df[first[i] : first[i + 1]]
        keys[i] = k.tobytes()
        short[i], bits[i] = k[np.lexsort((k, d))[: len(k) - need[i] + 1]].view(np.int64), flag[i]
    columns = [(head["block"] << 20) + np.arange(len(n)), pa.array(ids, pa.int64(), mask=~known), n, found == n, center.astype(np.int64), n - found, pa.array(keys, pa.binary()), pa.array(short, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_SETS)


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the similarity."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}"), F.col("short").alias(f"short_{x}"))
    both = pairs.join(side("a"), "a").join(side("b").drop("short_b"), "b").select("a", "b", "n_a", "n_b", "keys_a", "keys_b", "short_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, keys_a, keys_b, short_a = (c.to_pylist() if i < 6 else c for i, c in enumerate(batch.columns))
            good = []
            for i in range(len(a)):
                x, y, short = np.frombuffer(keys_a[i], np.uint64), np.frombuffer(keys_b[i], np.uint64), short_a[i].values.to_numpy().view(np.uint64)
                inside = lambda k, y=y: int((y[np.minimum(np.searchsorted(y, k), len(y) - 1)] == k).sum())
                merged = inside(short)
                need = -(-percent * (n_a[i] + n_b[i]) // (100 + percent))
                if merged + len(x) - len(short) >= need:  # the long lists could still make up for it
                    good.append(merged + inside(np.setdiff1d(x, short, assume_unique=True)) >= need)
                else:
                    good.append(False)
            keep = np.array(good, bool)
            yield pa.record_batch([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; linked are sets with 100 * intersection >= percent * union."""
    docs = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    buckets = bucket_count(docs)
    rows = docs.mapInArrow(lambda x: _blocks(x, n, buckets), _PACKED)
    shared = rows.groupBy("bucket").applyInArrow(lambda t: _shared(t, buckets), _PACKED + ", df binary")
    sets = stored(shared.groupBy("block").applyInArrow(lambda t: _sets(t, buckets, percent),
                                                       "node bigint, doc_id bigint, n bigint, whole boolean, center bigint, gap bigint, keys binary, short array<bigint>, bits array<bigint>"), "sets")
    some = sets.where(F.col("keys").isNotNull())
    # equal sets are one class; a set with a key of its own has no equal
    sign = [F.xxhash64("keys").alias("s1"), F.xxhash64(F.lit(1), "keys").alias("s2")]
    equal = some.where("whole").select("node", *sign)
    classes = equal.groupBy("s1", "s2").agg(F.min("node").alias("rep"), F.count("*").alias("many"))
    copies = classes.where("many > 1").select("s1", "s2", "rep")
    to_rep = stored(equal.join(copies, ["s1", "s2"]).where("node <> rep").select("node", "rep"), "copies")
    lists = stored(some.join(to_rep.select("node"), "node", "left_anti").select("node", "n", "center", "gap", F.posexplode("short").alias("at", "key")).select("node", "n", "center", "key", (F.col("n") - F.col("gap") - F.col("at")).alias("rest")), "lists")
    # an overlap can begin at a shared list only if both sets go on long enough from there, in the lists' common order
    room = lambda rest_a, rest_b, n_a, n_b: (100 + percent) * F.least(rest_a, rest_b) >= percent * (F.col(n_a) + F.col(n_b))
    heads = lists.groupBy("key").agg(F.max(F.struct("center", (-F.col("node")).alias("m"), "n", "rest")).alias("h"), F.count("*").alias("many")).where("many > 1")
    heads = heads.select("key", (-F.col("h.m")).alias("b"), F.col("h.n").alias("n_b"), F.col("h.rest").alias("rest_b"))
    stars = lists.join(heads, "key").where((F.col("node") != F.col("b")) & room("rest", "rest_b", "n", "n_b")).select(F.col("node").alias("a"), "b").distinct()
    links = stored(_alike(stars, sets, percent), "star-links")
    comp = stored(components(links), "star-components")
    # what the stars leave: pairs between components that share a short list
    placed = stored(lists.join(comp, "node", "left").select("key", "node", "n", "rest", F.coalesce("comp", "node").alias("comp")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.col("rest") / F.col("n")).alias("most"), F.ceil(F.count("*") / LIST_ROWS).alias("parts")).where("lo < hi").select("key", "most", "parts")
    # room for both needs sqrt(share_a * share_b) >= 2 percent / (100 + percent) of what is left of the sets (means of sizes and of rests);
    # rows that fail even with the list's largest share meet nobody there, so a passage that many unlike sets share gives no pairs to look at
    shares = F.col("rest") / F.col("n") * F.col("most") >= (2 * percent / (100 + percent)) ** 2 - 1e-9
    left = placed.join(mixed, "key").where(shares).drop("most").join(sets.select("node", "bits"), "node")
    # partners' sizes are in the same band or the next, so bands are part of the key
    left = left.withColumn("band", F.floor(F.log("n") / float(np.log(100 / percent) * 1.000001)).cast("int"))
    x, y = (left.select("key", "band", "parts", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "rest", "comp", "bits"))) for s in "ab")
    # of a long list each part of the one side meets the whole other side in a task of its own
    x = x.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    y = y.withColumn("part", F.pmod(F.xxhash64("node_b"), F.col("parts"))).drop("parts")
    differ = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(WIDTH)), F.lit(0))
    both, smaller = F.col("n_a") + F.col("n_b"), (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    # keys that only one set has are at least as many as hash places that only one has
    may = smaller & (F.col("comp_a") != F.col("comp_b")) & room("rest_a", "rest_b", "n_a", "n_b") & ((100 + percent) * (both - differ) >= 2 * percent * both)
    cross = x.join(y, ["key", "band", "part"]).where(may).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    more = stored(_alike(cross, sets, percent), "cross-links")
    whole = stored(components(links.union(more)), "components")
    # back to documents: a class's copies, the smallest id of each component
    member = to_rep.select("node", "rep").union(whole.select("node", F.col("node").alias("rep"))).union(to_rep.select(F.col("rep").alias("node"), "rep")).distinct()
    member = member.join(whole.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("node", F.coalesce("comp", "rep").alias("comp"))
    member = stored(sets.select("node", "doc_id").join(member, "node"), "members")
    least = member.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = member.join(least, "comp").select("node", "component_id")
    return sets.select("node", "doc_id", F.col("n").alias("n_shingles")).join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
