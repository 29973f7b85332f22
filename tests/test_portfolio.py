import math

import pytest
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.functions.mathx import normal_cdf
from deckscope.operators import ml as ML
from deckscope.operators import portfolio as P
from deckscope.operators import ranking as R
from deckscope.operators.selection import medians
from deckscope.sources import fixtures as FX
from tests.conftest import SF_SMALL, one

DIMS = L.DIMENSIONS


def _frame(spark, rows):
    """rows: (name, category, composite, dict of dims)"""
    data = [(n, c, comp, *[float(d.get(k, 5.0)) for k in DIMS]) for n, c, comp, d in rows]
    return spark.createDataFrame(data, "deck_name string, category string, composite_score double, "
                                 + ", ".join(f"{k} double" for k in DIMS))


def test_performance_tier_boundaries(spark):
    vals = [0.0, 0.1, 4.0, 4.01, 7.0, 7.5, 10.0, 10.5]
    df = spark.createDataFrame([(v,) for v in vals], "c double")
    got = [r["t"] for r in df.select(P.performance_tier(F.col("c")).alias("t")).collect()]
    assert got == [None, "Needs Work", "Needs Work", "Promising", "Promising", "Investment Ready",
                   "Investment Ready", None]


def test_recommendation_tiers_and_exclusion(spark):
    rows = [
        ("a", "SaaS", 9.0, {}), ("b", "SaaS", 8.0, {}), ("c", "Fintech", 7.5, {}),
        ("d", "Fintech", 6.5, {"market_potential": 8.5}),             # CONSIDER (market)
        ("e", None, 6.0, {"traction_strength": 9.0}),                  # CONSIDER (traction), category Unknown
        ("f", "EdTech", 5.0, {"team_experience": 7.0}),                # WATCH
        ("g", "EdTech", 3.0, {"team_experience": 9.0}),                # nothing
    ]
    recs = P.recommendations(_frame(spark, rows)).collect()
    assert [(r["type"], r["deck"]) for r in recs] == [
        ("STRONG_BUY", "a"), ("STRONG_BUY", "b"), ("STRONG_BUY", "c"),
        ("CONSIDER", "d"), ("CONSIDER", "e"), ("WATCH", "f")]
    assert recs[3]["reasoning"] == "Strong market potential with solid overall fundamentals in Fintech space"
    assert recs[4]["reasoning"] == "Strong traction with solid overall fundamentals in startup space"
    assert recs[4]["category"] == "Unknown"


def test_top_three_always_strong_buy_even_with_low_scores(spark):
    recs = P.recommendations(_frame(spark, [("a", "SaaS", 1.0, {}), ("b", "SaaS", 0.5, {})])).collect()
    assert [r["type"] for r in recs] == ["STRONG_BUY", "STRONG_BUY"]


def test_due_diligence_flags(spark):
    rows = [("x", "SaaS", 9.9, {"team_experience": 3.9, "market_potential": 8.1}),   # flag 1 and 4
            ("y", "SaaS", 5.0, {"team_experience": 4.0, "market_potential": 9.0}),   # none (team not < 4)
            ("z", "SaaS", 5.0, {"traction_strength": 7.1, "business_model": 4.9})]   # flag 2
    out = {r["deck_name"]: r["flags"] for r in P.due_diligence_flags(_frame(spark, rows)).collect()}
    assert out == {"x": [L.FLAG_TEAM_MARKET, L.FLAG_INCONSISTENT], "z": [L.FLAG_TRACTION_MODEL]}


def test_exact_median_and_positions_with_hot_key(spark):
    vals = [(i % 7) * 1.0 if i % 3 else 3.0 for i in range(300)]   # value 3.0 holds over a third of rows
    df = spark.createDataFrame([(i, v, "g" if i % 2 else "h") for i, v in enumerate(vals)], "id long, v double, g string")
    med = one(medians(df, "v"))["median"]
    s = sorted(vals)
    assert med == (s[149] + s[150]) / 2
    grouped = {r["g"]: r["m"] for r in medians(df, "v", ["g"], "m").collect()}
    for g in ("g", "h"):
        sv = sorted(v for i, v in enumerate(vals) if ("g" if i % 2 else "h") == g)
        n = len(sv)
        assert grouped[g] == (sv[(n - 1) // 2] + sv[n // 2]) / 2
    pos = R.global_positions(df, [F.col("v"), F.col("id")], ["g"], "p").collect()
    expect = {}
    for g in ("g", "h"):
        ordered = sorted((v, i) for i, v in enumerate(vals) if ("g" if i % 2 else "h") == g)
        expect.update({i: k + 1 for k, (v, i) in enumerate(ordered)})
    assert {r["id"]: r["p"] for r in pos} == expect


def test_rank_method_min(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", 5.0), ("d", 1.0)], "deck_name string, s double")
    got = {r["deck_name"]: r["rank"] for r in R.rank_desc(df, "s").collect()}
    assert got == {"b": 1, "a": 2, "c": 2, "d": 4}


def test_ranks_and_positions_never_shuffle_the_large_side_on_the_score(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("double").alias("s"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [R.rank_desc(df, "s"), R.global_positions(df, [F.col("s")])]
        for plan in plans:
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        assert sorted(r["position"] for r in plans[1].collect()) == list(range(1, 1001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_clusters_of_rows_with_null_dimensions(spark):
    dims = ML.L.DIMENSIONS
    rows = [(f"d{i}", float(i % 5), *[float((i * k) % 7) for k in range(1, len(dims) + 1)]) for i in range(12)]
    rows.append(("hole", 1.0, None, *[1.0] * (len(dims) - 1)))
    df = spark.createDataFrame(rows, "deck_name string, composite_score double, " + ", ".join(f"{d} double" for d in dims))
    out = ML.cluster_performance(df)
    got = {r["deck_name"]: r["cluster_name"] for r in out.collect()}
    assert len(got) == 13 and got["hole"] is None and all(v for k, v in got.items() if k != "hole")
    assert ML.project_2d(out).count() == 12


def test_normal_cdf_against_math_erf(spark):
    xs = [-4.0, -1.5, -0.3, 0.0, 0.2, 1.0, 2.5, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r["p"] for r in df.select(normal_cdf(F.col("x"), F.lit(0.0), F.lit(1.5)).alias("p")).collect()]
    for x, p in zip(xs, got):
        assert p == pytest.approx(0.5 * (1 + math.erf(x / (1.5 * math.sqrt(2)))), abs=2e-7)


def test_benchmark_comparison_inner_and_percentile_clip(spark):
    rows = [("a", "SaaS", 9.9, {}), ("b", "Gaming", 5.0, {}), ("c", "EdTech", 0.0, {})]
    out = {r["deck_name"]: r for r in P.benchmark_comparison(_frame(spark, rows)).collect()}
    assert set(out) == {"a", "c"}                      # no benchmark for Gaming -> dropped
    assert out["a"]["percentile_rank"] == pytest.approx(94.52, abs=0.01)
    assert out["c"]["percentile_rank"] == 1.0          # clipped at 1
    assert out["a"]["overall_vs_industry"] == "Above" and out["c"]["overall_vs_industry"] == "Below"


def test_histogram_counts_cover_all_rows(spark):
    df = spark.createDataFrame([(float(i % 11),) for i in range(50)], "composite_score double")
    h = P.histogram(df, ["composite_score"]).collect()
    assert sum(r["count"] for r in h) == 50
    assert max(r["bin"] for r in h) == 9


def test_tier_hierarchy_null_tier_only_above_leaf(spark):
    rows = [("a", "SaaS", 0.0, {}), ("b", "SaaS", 5.0, {}), ("c", "Fintech", 8.0, {})]
    out = {r["id"]: (r["parent"], r["value"]) for r in P.tier_hierarchy(_frame(spark, rows)).collect()}
    assert out == {"Total": ("", 3), "SaaS": ("Total", 2), "Fintech": ("Total", 1),
                   "SaaS-Promising": ("SaaS", 1), "Fintech-Investment Ready": ("Fintech", 1)}


def test_composition_strongest_first_wins_ties(spark):
    rows = [("a", "SaaS", 5.0, {d: 5.0 for d in DIMS}), ("b", "Fintech", 5.0, {d: 5.0 for d in DIMS})]
    r = one(P.portfolio_composition(_frame(spark, rows)))
    assert r["strongest_dimension"] == "problem_clarity" and r["weakest_dimension"] == "problem_clarity"
    assert r["needs_development"] == 2 and r["category_diversity"] == 2


def test_missing_dimension_counts_as_zero(spark):
    df = spark.createDataFrame([("a", "SaaS", 5.0)], "deck_name string, category string, composite_score double")
    r = one(P.benchmark_comparison(df))
    assert r["market_vs_benchmark"] == pytest.approx(0.0 - 7.9)


def test_category_performance_counts_composites(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", None), ("b", None), (None, 9.0)], "category string, composite_score double")
    assert sorted(tuple(x) for x in P.category_performance(df).collect()) == [("a", 4.0, 1), ("b", None, 0)]


def test_benchmarks_of_the_caller_are_checked(spark, monkeypatch):
    """Same rows by broadcast and by shuffle; a category named twice is an error."""
    pf, own = FX.portfolio(spark, SF_SMALL), P.benchmark_table(spark)
    want = sorted(map(tuple, P.benchmark_comparison(pf).collect()), key=str)
    assert want == sorted(map(tuple, P.benchmark_comparison(pf, own).collect()), key=str)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 2)
    assert want == sorted(map(tuple, P.benchmark_comparison(pf, own).collect()), key=str)
    with pytest.raises(ValueError, match="several benchmarks"):
        P.benchmark_comparison(pf, own.unionByName(own.limit(1)))


def test_bottom_rows_without_a_count(spark):
    for n in range(9):
        df = spark.range(n).selectExpr("concat('d', id) as deck_name", "cast(floor(id / 2) as double) as composite_score")
        ranked = [r.deck_name for r in df.orderBy(F.col("composite_score").desc(), "deck_name").collect()]
        assert [r.deck_name for r in R.bottom_k(df, 3).collect()] == (ranked[max(3, n - 3):] if n > 3 else [])


def test_one_scan_for_trends_and_two_for_recommendations(spark):
    pf = FX.portfolio(spark, SF_SMALL)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(P.market_trends(pf)).count("FileScan") == plan(pf).count("FileScan")
    assert plan(P.recommendations(pf)).count("FileScan") <= 3 * plan(pf).count("FileScan")
