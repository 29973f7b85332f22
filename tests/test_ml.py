"""Forest and clusters: the same for any layout, and equal to plain versions."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckscope import lexicons as L
from deckscope.operators import forest as FO
from deckscope.operators import ml as ML
from deckscope.operators.clusters import MILLION, k_means, z_scores
from deckscope.sources import fixtures as FX
from tests.conftest import SF_SMALL, one


@pytest.fixture(scope="module")
def portfolio(spark):
    return FX.portfolio(spark, SF_SMALL)


def layouts(df):
    return df.repartition(1), df.repartition(7, F.rand(3))


def test_forest_is_the_same_for_two_layouts(portfolio):
    got = []
    for df in layouts(portfolio):
        m = ML.fit_success_model(df, num_trees=12, max_fit_rows=60)
        got.append((sorted(map(tuple, m.predict(df).select("deck_name", "success_probability").collect())), [tuple(r) for r in m.importances(df.sparkSession).collect()], m.r2()))
    assert got[0][:2] == got[1][:2]                    # predictions and importances to the last bit
    assert got[0][2] == pytest.approx(got[1][2], abs=1e-9) and got[0][2][0] > 0.8
    assert math.isclose(sum(g for _, g in got[0][1]), 1.0, abs_tol=1e-9)
    assert all(0 <= p <= 1 for _, p in got[0][0]) and len(got[0][0]) == portfolio.count()


def test_too_few_rows_and_null_scores(spark, portfolio):
    few = ML.fit_success_model(portfolio.limit(2))
    assert {r.success_probability for r in few.predict(portfolio).collect()} == {None}
    assert few.importances(spark).count() == 0 and all(math.isnan(x) for x in few.r2())
    holes = portfolio.withColumn("market_potential", F.when(F.col("deck_key") % 3 > 0, F.col("market_potential"))) \
        .withColumn("composite_score", F.when(F.col("deck_key") % 5 > 0, F.col("composite_score")))
    m = ML.fit_success_model(holes, num_trees=4)
    assert m.predict(holes).filter("success_probability is null").count() == 0


def plain_split(x, y, w):
    best = None
    for f in range(x.shape[1]):
        values = sorted(set(x[:, f]))
        for a, b in zip(values, values[1:]):
            low = x[:, f] <= a
            err = sum(np.sum(w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2) for s in (low, ~low))
            gain = np.sum(w * (y - np.average(y, weights=w)) ** 2) - err
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (a + b) / 2)
    return best


def test_splits_equal_all_splits_tried():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 14))
        x, y, w = rng.integers(0, 5, (n, 3)).astype(float), rng.random(n), rng.integers(1, 4, n).astype(float)
        got = FO.best_split(np.ascontiguousarray(x.T), y, w, np.argsort(x.T, axis=1, kind="stable"))
        want = plain_split(x, y, w)
        assert (got is None) == (want is None)
        if want:
            assert got[0] == pytest.approx(want[0], abs=1e-9) and got[1:] == want[1:]


def test_tree_learns_its_rows_and_weights():
    rng = np.random.default_rng(1)
    x, y = rng.random((300, 4)), rng.random(300)
    t = FO.fit_tree(x, y, np.ones(300), 30)
    arrays = tuple(np.array(t[k]) for k in ("feature", "threshold", "left", "right", "value"))
    assert np.allclose(FO.predict_rows([arrays], x), y) and max(t["importance"]) <= 1
    assert len(FO.fit_tree(x, y, np.ones(300), 1)["value"]) == 3 and FO.fit_tree(x, y, np.zeros(300), 5)["value"] == []
    keys = rng.integers(-2**62, 2**62, 200_000)
    w = FO.poisson_weights(keys, 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w != FO.poisson_weights(keys, 4, 42)).any()


def test_clusters_are_the_same_for_two_layouts(portfolio):
    a, b = (sorted((r.deck_name, r.cluster, r.cluster_name, tuple(r.features)) for r in ML.cluster_performance(df).collect()) for df in layouts(portfolio))
    assert a == b and {r[1] for r in a} == {0, 1, 2, 3}


def test_clusters_equal_plain_rounds(portfolio):
    """Assignments and centres are a fixed point of Lloyd's rule, by numpy."""
    df, centres = k_means(portfolio, L.DIMENSIONS, "deck_name", 4, rounds=200)
    rows = df.collect()
    x = np.array([[r[d] for d in L.DIMENSIONS] for r in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose(z, np.array([r.features.toArray() for r in rows]))
    c = np.array(centres) / MILLION
    d = ((z[:, None] - c[None]) ** 2).sum(2)
    assert [r.cluster for r in rows] == d.argmin(1).tolist()
    for k in range(4):
        assert np.allclose(c[k], z[d.argmin(1) == k].mean(0), atol=1e-3)


def test_clusters_hard(spark, portfolio):
    few = ML.cluster_performance(portfolio.limit(2))
    assert {(r.cluster, r.cluster_name) for r in few.collect()} == {(None, None)} and ML.project_2d(few).count() == 0
    assert ML.cluster_performance(portfolio.limit(0)).count() == 0
    same = portfolio.withColumns({d: F.lit(5.0) for d in L.DIMENSIONS})        # one point: one cluster
    assert {r.cluster for r in ML.cluster_performance(same).collect()} == {0}
    assert [z._jc.toString() for z in z_scores(same, L.DIMENSIONS)] == ["0.0"] * 7
    null = ML.cluster_performance(portfolio.withColumn("team_experience", F.when(F.col("deck_key") % 4 > 0, F.col("team_experience"))))
    assert one(null.agg(F.count_if(F.col("cluster").isNull() != (F.col("deck_key") % 4 == 0)).alias("n"))).n == 0
