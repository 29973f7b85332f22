"""Periodic runs, importance resampling and source mixing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deckscope.llm import importance_resampling as R
from deckscope.llm import periodic_runs as P
from deckscope.llm import source_mixing as M
from deckscope.llm.prefix import prefix_sums
from deckscope.llm.queries import ORACLE, QUERIES
from deckscope.llm.texts import Words

SF = "/root/testdata/sf0.001"
HARD = [(1, None, "b"), (2, "", None), (3, " \n\t ", "a"), (4, "x " * 40, "a"), (4, "x " * 40, "a"), (None, "é É One one\nTWO two " * 9, None), (5, "a b\nc " * 7 + "d", "ſ"),
        (6, "w" * 5000 + " tail " * 25, "b"), (7, " ".join(f"v{i % 700}" for i in range(2900)), "a"), (8, "\n".join("same line of words here" for _ in range(8)), "a")]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as weight", "3 as `a.b`", "4 as id_", "5 as _part", "6 as copies")


def plain_runs(w, exponent=P.EXPONENT, shortest=P.SHORTEST):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        s = None
        for i in range(len(w) - q + 1):
            if i < len(w) - q and w[i] == w[i + q]:
                s = i if s is None else s
            elif s is not None:
                if i - s + q >= max(shortest, exponent * q):
                    found.setdefault((s, i - s + q), q)
                s = None
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_of(texts):
    words = Words([x.encode() for x in texts], lower=False)
    runs = P.find_runs(words)
    cut, data = P.collapsed(words, runs)
    data = data.tobytes()
    out = [[] for _ in texts]
    for s, n, q in runs.tolist():
        d = words.doc[s]
        out[d].append((s - int(words.first[d]), n, q))
    return out, [data[a:b].decode() for a, b in zip(cut, cut[1:])]


def plain_cut(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("size", [2, 4, 64, 1024])
def test_transform_and_back(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(0, P.PRIME, (2, 3, size), dtype=np.uint64)
    assert (P.transform_back(P.transform(a)) == a).all()
    got = P.transform_back(P.transform(a) * P.transform(b) % np.uint64(P.PRIME))
    x, y = a[0].tolist(), b[0].tolist()
    assert got[0].tolist() == [sum(x[i] * y[(k - i) % size] for i in range(size)) % P.PRIME for k in range(size)]


def test_runs_random_texts():
    """Small alphabets, nested periods, and a slice of many texts at once."""
    rng, texts = random.Random(5), []
    for k in range(250):
        out = []
        while len(out) < rng.randint(0, 160):
            piece = [rng.choice("ab" if k % 2 else "abcdefgh") for _ in range(rng.randint(1, 22))]
            if rng.random() < 0.3:
                piece = piece * 4 + piece[:2]
            out += piece * rng.choice([1, 1, 2, 4, 5, 9]) + piece[: rng.randint(0, len(piece))]
        texts.append("  ".join(out))
    got, cut = runs_of(texts)
    want = [plain_runs(x.split()) for x in texts]
    assert got == want and sum(map(len, want)) > 300
    assert cut == [plain_cut(x.split(), r) for x, r in zip(texts, want)]


def test_runs_long_constant_and_near_periodic():
    """One word a hundred thousand times, a long period, and periods broken just before they count."""
    n = 100_000
    period = [f"w{i}" for i in range(9001)]
    almost = (["a", "b", "c", "d", "e"] * 4)[:-1]
    got, cut = runs_of([" ".join("x" for _ in range(n)), " ".join(period * 4), " ".join(almost), " ".join([*almost, "e"]), "a a a a a", "a a a a a a", "thue " * 0])
    assert got == [[(0, n, 1)], [(0, 4 * 9001, 9001)], [], [(0, 20, 5)], [], [(0, 6, 1)], []]
    assert cut[0] == "x" and cut[1] == " ".join(period) and cut[3] == "a b c d e"


def test_runs_hard(hard):
    got = P.detect(hard)
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    want = []
    for i, t, _ in HARD:
        w = (t or "").split()
        r = plain_runs(w)
        want.append((i or 0, len(w), r, plain_cut(w, r)))
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got.collect()) == sorted(want)
    assert P.detect(hard.limit(0)).count() == 0


def test_planted(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(300)] + [(None, "a b")]
    for i, t, new in spark.createDataFrame(rows, "id long, t string").select("id", "t", P.planted(F.col("id"), F.col("t"))).collect():
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        w = t.split()
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        assert new == " ".join(w)


def plain_features(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return len(w), [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def plain_resample(docs, target, n, buckets, min_words=R.MIN_WORDS):
    crc = lambda x: zlib.crc32(x.encode()) % buckets
    feats = [(i, *plain_features(t, n)) for i, t in docs]
    s = Counter(crc(x) for _, _, f in feats for x in f)
    t = Counter(crc(x) for text in target for x in plain_features(text, n)[1])
    S, T = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in s}
    rows = []
    for i, words, f in feats:
        weight = sum(gain[crc(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{R.SEED}:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in rows if r[4] is not None and r[1] >= min_words), key=lambda r: (-r[4], r[0]))
    drawn = len(may) * R.DRAW_PCT // 100
    return Counter([(*r, None) for r in rows if r not in may[:drawn]] + [(*r, k + 1) for k, r in enumerate(may[:drawn])])


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (1, 7), (2, 100), (3, 10_000)])
def test_resampling(spark, n, buckets):
    rng = random.Random(n)
    vocabulary = ["alpha", "Beta", "ÉÉ", "𝒳y", "9", "x" * 300] + [f"t{i}" for i in range(30)]
    docs = [(i, "".join(rng.choice(vocabulary) + rng.choice(" \n-\t.") for _ in range(rng.choice([0, 5, 25, 60])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "a\n\nb\nc\n" * 20), (203, "\n".join(["one shared line of text"] * 9))]
    target = ["alpha beta t1 t2", None, "", "t3\nt4 t5\n9"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as n", "2 as weight")
    got = R.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain_resample(docs, target, n, buckets)


def test_resampling_hard(spark, hard):
    """Null ids have no score; repeated rows are both drawn; empty tables."""
    target = spark.createDataFrame([("one two x",)], "text string")
    got = R.resample(hard, target, draw_pct=100).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, plain_features(t, 1)[0]) for i, t, _ in HARD)
    assert [r.score for r in got if r.doc_id is None] == [None] and sum(r.rank is not None for r in got if r.doc_id == 4) == 2
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(r.rank is not None for r in got) + 1))
    assert R.resample(hard.limit(0), target).count() == 0
    assert all(r.rank is None and r.weight <= 0 for r in R.resample(hard, target.limit(0), draw_pct=5).collect())


def test_prefix_sums(spark):
    """One value in most rows, and rows that are equal in all."""
    rows = [(1 if i % 10 else i, i % 3) for i in range(3000)]
    got = [tuple(r) for r in prefix_sums(spark.createDataFrame(rows, "k long, v long").repartition(7), [F.col("k"), F.col("v")], {"before": F.col("v"), "place": F.lit(1)}).collect()]
    got.sort(key=lambda r: r[3])
    assert [r[:2] for r in got] == sorted(rows) and [r[3] for r in got] == list(range(3000))
    assert [r[2] for r in got] == [sum(r[1] for r in got[:i]) for i in range(0, 3000)]


def plain_targets(sizes, most=M.MOST, pct=M.SHARE_PCT):
    """{source: words} -> {source: target}, sharing again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, left, open_ = {}, sum(sizes.values()) * pct / 100, set(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: rate * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, "w " * rng.randint(0, 40), rng.choice(["web", "web", "web", "web", "news", None, "", "é", "zz" if i < 9 else "web"])) for i in range(900)] + [(900, "long " * 9000, "news")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = M.plan(df).collect()
    size = {i: len(t.split()) for i, t, _ in docs}
    of = {i: s for i, _, s in docs}
    sizes = Counter()
    for i, s in of.items():
        sizes[s] += size[i]
    want, taken = plain_targets(sizes), Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"] and sum(c.words for c in r.copies) == r.taken and (r.position is None) == (r.taken == 0)
        taken[of[r.doc_id]] += r.taken
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s]) for s in sizes} and len({round(want[s] / sizes[s], 3) for s in sizes}) > 1
    assert [r.position for r in rows if r.position is not None] == sorted(r.position for r in rows if r.position is not None)
    assert rows == M.plan(df.repartition(2)).collect()


def test_mixing_positions_follow_the_schedule(spark):
    """Words in each tenth of the mix are the schedule's integral over that tenth."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "'w w w' as text", "concat('s', id % 3) as source")
    rows = M.training_order(M.plan(docs, carry=["source", "text"])).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and {"epoch", "words", "text"} <= set(rows[0].asDict())
    got = defaultdict(Counter)
    for r in rows:
        got[r.source][min(int(r.position * 10), 9)] += r.words
    for k, schedule in enumerate(M.SCHEDULES):
        at = lambda t: next(v + (w - v) * (t - a) / (b - a) for (a, v), (b, w) in zip(schedule, schedule[1:]) if t <= b)
        for tenth in range(10):
            want = sum(at((tenth + (j + 0.5) / 50) / 10) for j in range(50)) / 500 / M.integral(schedule) * sum(got[f"s{k}"].values())
            assert got[f"s{k}"][tenth] == pytest.approx(want, rel=0.01, abs=4)


def test_mixing_hard(spark, hard):
    got = M.plan(hard, carry=["a.b", "size", "source"])
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "position", "copies", "a.b", "source"]
    rows = got.collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len((t or "").split())) for i, t, _ in HARD)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert M.plan(hard.limit(0)).count() == 0
    assert {r.taken for r in M.plan(hard.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}
    full = M.plan(hard, share_pct=400).collect()  # more than all sources have thrice
    assert all(r.taken == 3 * r["size"] for r in full)


@pytest.mark.parametrize("knots", [((0.1, 1), (1, 1)), ((0, 1), (0.5, -1), (1, 2)), ((0, 0), (1, 0)), ((0, 1), (0, 2), (1, 1))])
def test_mixing_bad_schedules(knots):
    with pytest.raises(ValueError):
        M.integral(knots)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_importance_resampling", "op13_source_mixing"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


def test_mixing_is_native(spark):
    plan = QUERIES["op13_source_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
