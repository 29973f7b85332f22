"""N-gram Jaccard join against all pairs in plain Python."""

import random

import brute
import pytest

from deckscope.llm import ngram_join
from deckscope.llm.components import components
from deckscope.llm.queries import QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_jaccard_join"](spark, f"/root/testdata/{sf}").collect()}
    assert got == brute.components(docs)


def near_copies(seed, groups=12, most=25):
    """Copies with so many words changed that many pairs are just under or over the threshold, and chains of them."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        text = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, most)):
            copy = text[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 3)}"
            out.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper() + "\n")
            if rng.random() < 0.3:
                text = copy
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_similar(df).collect()}
    assert got == brute.components(docs)
    assert len({c for _, c in got.values()}) < len(docs)


def test_hard(spark):
    long_text = " ".join(f"v{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "TWO words"), (6, "two  words "), (7, "é É"), (8, "É é"), (9, long_text), (10, long_text + " end"), (11, "a b c d e"), (11, "a b c d e"), (11, "other words here to be read"), (None, "a b c d e"), (None, "alone it is here"), (12, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n", "'x' as `a.b`")
    got = ngram_join.join_similar(df).collect()
    assert len(got) == len(rows)
    comp = {}
    for r in got:
        comp.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert comp[1] == {(0, 1)} and comp[2] == {(0, 2)} and comp[3] == {(0, 3)} and comp[12] == {(0, 12)}
    assert comp[4] == comp[5] == comp[6] == {(1, 4)} and comp[7] == {(1, 7)} and comp[8] == {(1, 8)}
    assert comp[9] == {(29996, 9)} and comp[10] == {(29997, 9)}
    assert comp[11] == {(1, 11), (2, 11)} and comp[None] == {(1, 11), (1, None)}
    assert ngram_join.join_similar(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(100, 160)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)]
    up = {x: x for e in edges for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize(("buckets", "rows"), [(1, 1000), (700, 3)])
def test_common_shingles(spark, monkeypatch, buckets, rows):
    """A shingle of every document, lists of many unlinked documents dealt to several tasks, one bucket or hundreds: links as of all pairs."""
    monkeypatch.setattr(ngram_join, "bucket_count", lambda docs: buckets)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", rows)
    rng = random.Random(7)
    half = " ".join(f"c{i}" for i in range(18))
    docs = [(i, "every document begins like this " + t) for i, t in near_copies(3, groups=6)]
    docs += [(1000 + i, f"every document begins like this {half} " + " ".join(f"u{rng.randint(0, 9)}" for _ in range(9))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_similar(df).collect()}
    assert got == brute.components(docs)


def test_hot_shingle_is_an_entry_a_block(spark):
    """What a bucket's task gets of a shingle of every document does not grow with the documents of a block."""
    docs = spark.range(5000).selectExpr("id", "concat('a b c d e ', 'x', id, ' y', id, ' z', id) as text").coalesce(1)
    rows = docs.mapInArrow(lambda x: ngram_join._blocks(x, 5, 4), ngram_join._PACKED).where("bucket < 4").collect()
    assert sum(len(r.hot) // 5 for r in rows) == 1 and sum(len(r.keys) // 5 for r in rows) == 5000 * 3
    assert [int.from_bytes(r.many, "little") for r in rows if r.many] == [5000]


def test_buckets_follow_the_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    few = ngram_join.bucket_count(docs)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 1024)
    assert few == ngram_join.BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")) < ngram_join.bucket_count(docs)
