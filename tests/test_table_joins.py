"""Term tables, valence tables and medians by counting, against plain versions."""
import random
import statistics

import pytest
from pyspark.sql import functions as F

from deckscope.functions import sentiment as S
from deckscope.functions import text as T
from deckscope.operators import portfolio as P
from deckscope.operators import term_join as TJ
from deckscope.operators import valence_join as VJ
from deckscope.operators.selection import medians
from deckscope.sources import fixtures as FX
from tests.conftest import SF_SMALL, one


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = [(1, "The Same chairs; AI and ML"), (2, None), (3, ""), (4, "a"), (5, "aaaa aaaa b"), (6, "é𝒳 é𝒳y É"), (None, "the same"), (7, "x" * 5000 + "needle"), (1, "other text of one")]
TERMS = [("s", "SAM"), ("s", "ai"), ("t", "a"), ("t", None), ("t", ""), ("u", "aaaa"), ("u", "aaa a"), ("u", "é𝒳y"), ("u", "xxxxneedle"), ("v", "absent"), ("s", "sam"), ("w", "aaaa aaaa b")]


@pytest.mark.parametrize("rows", [TJ.INDEX_ROWS, 0])
def test_term_join_hard(spark, rows):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as at", "2 as piece")
    terms = spark.createDataFrame(TERMS, "section string, term string")
    got = TJ.term_join(df, terms, "text", "term", ["doc_id"], ["section", "term"], rows).collect()
    want = {(i, s, t) for i, x in TEXTS for s, t in TERMS if x and t and t.lower() in x.lower()}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 10
    assert TJ.term_join(df.limit(0), terms, "text", "term", ["doc_id"], ["section"], rows).count() == 0
    assert TJ.term_join(df, terms.limit(0), "text", "term", ["doc_id"], ["section"], rows).count() == 0


@pytest.mark.parametrize("rows", [TJ.INDEX_ROWS, 0])
def test_term_join_two_hundred_thousand_terms(spark, rows):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]
    terms = {" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 3, 3, 4]))) for _ in range(330_000)}
    texts = [(i, " ".join(rng.choices(words, k=60))) for i in range(300)]
    assert len(terms) >= 200_000
    sizes = {len(t) for t in terms}
    want = {(i, x[a : a + n]) for i, x in texts for n in sizes for a in range(len(x) - n + 1) if x[a : a + n] in terms}
    table = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    out = TJ.term_join(spark.createDataFrame(texts, "doc_id long, text string"), table, "text", "term", ["doc_id"], ["term"], rows)
    assert {tuple(r) for r in out.collect()} == want and len(want) > 10_000
    assert "CartesianProduct" not in _plan(out) and "NestedLoop" not in _plan(out)


def test_lexicon_scores(spark):
    df = spark.createDataFrame([(1, "growth and margin growth"), (2, "nothing here"), (3, "MARGIN"), (4, None)], "doc_id long, text string")
    table = spark.createDataFrame([("d", "a", "growth", 2.0, 10.0, 0.5), ("d", "a", "margin", 2.0, 3.0, 0.5), ("d", "b", "and", 30.0, 10.0, 1.0), ("e", "a", "margin", 1.0, 9.0, 1.0)],
                                  "dimension string, component string, term string, weight double, cap double, coef double")
    got = {(r.doc_id, r.dimension): (r.hits, r.score) for r in TJ.lexicon_scores(df, table).collect()}
    # component a: two terms * 2 within its largest cap 10, half of it; b: 30 within 10; at most 10 in all
    assert got == {(1, "d"): (3, 10.0), (1, "e"): (1, 1.0), (3, "d"): (1, 1.0), (3, "e"): (1, 1.0)}


def test_table_sentiment_equals_literals(spark):
    rows = [(1, "not very good at all, extremely bad!"), (2, None), (3, ""), (4, "good"), (4, "good"), (None, "never so not really great"), (5, "plain words only"), (6, "bad " * 3000)]
    df = FX.decks(spark, SF_SMALL).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    df = df.withColumn("full_text", T.clean_text(F.col("text")))
    lit = df.withColumn("toks", S.tokens(F.col("full_text"), True)).withColumn("s", S.scores(S.valences("toks"), F.size("toks")))
    want = lit.select("doc_id", "s.pos", "s.neg", "s.neu", "s.compound").collect()
    got = VJ.table_sentiment(df, VJ.lexicon_table(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r.compound < 0 for r in got)
    assert VJ.table_sentiment(df.limit(0), VJ.lexicon_table(spark)).count() == 0


def test_table_sentiment_large_table_is_not_broadcast_by_hint(spark, monkeypatch):
    from deckscope.operators import ranking

    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 3)
    df = spark.createDataFrame([(1, "good bad"), (2, "fine")], "doc_id long, full_text string")
    out = VJ.table_sentiment(df, VJ.lexicon_table(spark))
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()
    assert out.count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_medians(spark, seed):
    rng = random.Random(seed)
    make = [lambda: rng.choice([3.0, 3.0, rng.random()]), lambda: rng.gauss(0, 1) * 10.0 ** rng.randint(-30, 30), lambda: float(rng.randint(0, 5)),
            lambda: rng.choice([1.7e308, -1.7e308, 0.0])]
    rows = [(rng.choice(["a", "b", None, "c"]), make[(seed + i) % 4 if seed else 0]()) for i in range(400 + seed)] + [("a", None), ("z", None), ("n", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    by = {}
    for g, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert {r.g: r.m for r in medians(df, "v", ["g"], "m", buckets=16).collect()} == {g: statistics.median(v) for g, v in by.items()}
    assert one(medians(df, "v"))["median"] == statistics.median([v for vs in by.values() for v in vs])


def test_medians_empty_and_plan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert medians(df.limit(0), "v").count() == 0 and medians(df.limit(0), "v", ["g"]).count() == 0
    out = medians(df, "v", ["g"])
    assert "rangepartitioning" not in _plan(out) and one(out)["median"] == 1.5
    empty = one(P.portfolio_stats(df.limit(0).withColumnRenamed("v", "composite_score")))
    assert (empty.n, empty.median, empty.mean) == (0, None, None)


def test_no_category(spark):
    """Frames without a category, with NULL ones, and with only one."""
    df = spark.createDataFrame([("x", 5.0, None), ("y", 8.0, "SaaS"), ("z", 0.0, "SaaS")], "deck_name string, composite_score double, category string")
    assert P.category_performance(df).count() == 0                       # one category only
    more = df.unionByName(spark.createDataFrame([("w", 3.0, "Other")], "deck_name string, composite_score double, category string"))
    assert sorted(tuple(r) for r in P.category_performance(more).collect()) == [("Other", 3.0, 1), ("SaaS", 4.0, 2)]
    assert P.category_performance(df.drop("category")).count() == 0
    assert sorted(tuple(r) for r in P.tier_hierarchy(df).collect()) == [("SaaS", "SaaS", "Total", 2), ("SaaS-Investment Ready", "Investment Ready", "SaaS", 1), ("Total", "Portfolio", "", 3)]
    assert [tuple(r) for r in P.tier_hierarchy(df.drop("category")).collect()] == [("Total", "Portfolio", "", 3)]


def test_term_index_looks_at_bytes_in_place():
    """Random texts of few letters: pieces cross the texts' edges, repeat and overlap; terms shorter and longer than a piece."""
    rng = random.Random(5)
    make = lambda n: "".join(rng.choices("abé𝒳", k=n)).encode()
    terms = sorted({make(rng.randint(1, 7)) for _ in range(120)})
    shifts = [rng.randint(0, max(len(t) - TJ.GRAM, 0)) for t in terms]
    texts = [make(rng.randint(0, 60)) for _ in range(200)]
    text, number = TJ.TermIndex(list(range(7, 7 + len(terms))), terms, shifts).find(texts)
    assert list(zip(text.tolist(), number.tolist())) == [(i, 7 + k) for i, x in enumerate(texts) for k in sorted(range(len(terms)), key=lambda k: k) if terms[k] in x]


def test_lexicon_scores_hits_meet_no_shuffle(spark):
    """The hits, far more than the texts, are counted where they arise: behind the texts' lists no exchange but broadcasts."""
    df = spark.createDataFrame([(i % 7, f"growth and margin {i}") for i in range(40)] + [(None, "margin"), (None, "growth")], "doc_id long, text string")
    table = spark.createDataFrame([("d", "a", t, 1.0, 10.0, 0.5) for t in ("Growth", "growth", "margin", "n")], "dimension string, component string, term string, weight double, cap double, coef double")
    out = TJ.lexicon_scores(df, table)
    plan = _plan(out)
    assert plan[: plan.index("MapInArrow")].count("Exchange hashpartitioning") == 1
    assert {(r.doc_id, r.hits, r.score) for r in out.collect()} == {(i, 3, 1.5) for i in (*range(7), None)}
