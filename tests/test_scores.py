"""Score grids against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchframe.operators import scores as G

RATES = [(1, 1.6, 1.2), (2, 1.1, 1.9), (3, 1.4, 1.1), (4, 5.5, 0.7), (5, 0.3, 0.2), (6, 22.0, 1.0)]
Q = (0.2, 0.3, 0.5)


def pmf(rate, n):
    return np.array([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(n + 1)])


def grid(lh, la, n):
    m = np.outer(pmf(lh, n), pmf(la, n))
    return m / m.sum()


def hda(m):
    return np.array([np.triu(m, 1).sum(), np.trace(m), np.tril(m, -1).sum()])


@pytest.fixture(scope="module")
def rates(spark):
    rows = [(i, h, a, i % 4, (i * 2) % 3, *Q) for i, h, a in RATES]
    return spark.createDataFrame(rows, "match_id long, lambda_home double, lambda_away double, home_goals int, away_goals int, p_away double, p_draw double, p_home double")


def as_matrix(cells, n):
    return np.array(cells).reshape(n + 1, n + 1)


def test_fixed_grid_outcomes_and_over(rates):
    out = {r.match_id: r for r in G.over_under_prob(G.grid_to_outcome(G.score_grid_fixed(rates))).collect()}
    for i, h, a in RATES:
        m = grid(h, a, 10)
        np.testing.assert_allclose(as_matrix(out[i].grid, 10), m, atol=1e-14)
        np.testing.assert_allclose([out[i].s_away, out[i].s_draw, out[i].s_home], hda(m), atol=1e-13)
        low = sum(m[x, y] for x in range(3) for y in range(3) if x + y <= 2)
        assert out[i].p_over == pytest.approx(1 - low, abs=1e-12)


def test_adaptive_support_bounds_the_tail(rates):
    for r in G.score_grid_adaptive(rates).collect():
        h, a = np.cumsum(pmf(r.lambda_home, 300)), np.cumsum(pmf(r.lambda_away, 300))
        n = r.grid_max
        assert n >= 10 and 1 - h[n] * a[n] <= 2e-12
        if n > 10:  # one goal less would not do
            m = n - 1
            assert min(h[m], a[m]) < 1 - 2e-13 or 1 - h[m] * a[m] > 5e-13
        assert sum(r.grid) == pytest.approx(1, abs=3e-12)
        assert len(r.grid) == (n + 1) ** 2


def test_adaptive_refuses_bad_rates(spark):
    df = spark.createDataFrame([(1, -1.0, 1.0)], "match_id long, lambda_home double, lambda_away double")
    with pytest.raises(Exception, match="positive"):
        G.score_grid_adaptive(df).collect()
    big = spark.createDataFrame([(1, 240.0, 1.0)], "match_id long, lambda_home double, lambda_away double")
    with pytest.raises(Exception, match="support"):
        G.score_grid_adaptive(big).collect()


def test_dixon_coles(rates):
    rho = -0.2
    for r in G.dixon_coles(G.score_grid_fixed(rates, 8), rho).collect():
        m = grid(r.lambda_home, r.lambda_away, 8)
        h, a = r.lambda_home, r.lambda_away
        for (i, j), t in {(0, 0): 1 - h * a * rho, (1, 1): 1 - rho, (0, 1): 1 + h * rho, (1, 0): 1 + a * rho}.items():
            m[i, j] *= max(t, 0)
        np.testing.assert_allclose(as_matrix(r.grid, 8), m / m.sum(), atol=1e-14)


def test_reweight_sets_marginals_and_keeps_ratios(rates):
    for r in G.reweight_grid(G.score_grid_fixed(rates), out="fused").collect():
        base, fused = as_matrix(r.grid, 10), as_matrix(r.fused, 10)
        np.testing.assert_allclose(hda(fused), Q, atol=3e-12)
        np.testing.assert_allclose(fused[2, 1] * base[3, 0], fused[3, 0] * base[2, 1], rtol=1e-9)


def test_reweight_zero_classes(spark):
    schema = "match_id long, grid array<double>, p_away double, p_draw double, p_home double"
    only_home = [0.0, 0.0, 1.0, 0.0]
    fine = G.reweight_grid(spark.createDataFrame([(1, only_home, 0.0, 0.0, 1.0)], schema)).first()
    assert fine.grid == [0.0, 0.0, 1.0, 0.0]
    with pytest.raises(Exception, match="no score mass for draw"):
        G.reweight_grid(spark.createDataFrame([(1, only_home, 0.0, 0.1, 0.9)], schema)).collect()


def test_subnormal_mass_does_not_overflow(spark):
    df = spark.createDataFrame([(1, [0.5, 5e-324, 0.5, 0.0], 0.2, 0.3, 0.5)], "match_id long, grid array<double>, p_away double, p_draw double, p_home double")
    assert G.reweight_grid(df).first().grid == [0.3, 0.2, 0.5, 0.0]


def test_stats_mode_mean_and_outside(rates):
    for r in G.score_stats(G.score_grid_fixed(rates, 2)).collect():
        m = grid(r.lambda_home, r.lambda_away, 2)
        i, j = np.unravel_index(m.argmax(), m.shape)
        assert (r.mode_home_goals, r.mode_away_goals) == (i, j)
        assert r.expected_home_goals == pytest.approx((m.sum(axis=1) * np.arange(3)).sum())
        kept = pmf(r.lambda_home, 2).sum() * pmf(r.lambda_away, 2).sum()
        true = pmf(r.lambda_home, 9)[r.home_goals] * pmf(r.lambda_away, 9)[r.away_goals] / kept
        assert r.actual_outside_grid == int(r.home_goals > 2 or r.away_goals > 2)
        assert r.true_score_nll == pytest.approx(-math.log(true), abs=1e-10)


def test_stats_outside_with_target(rates):
    g = G.reweight_grid(G.score_grid_fixed(rates, 2), out="fused")
    for r in G.score_stats(g, target=("p_away", "p_draw", "p_home"), grid="fused").collect():
        raw = np.outer(pmf(r.lambda_home, 2), pmf(r.lambda_away, 2))
        cls = 0 if r.home_goals < r.away_goals else 1 if r.home_goals == r.away_goals else 2
        true = pmf(r.lambda_home, 9)[r.home_goals] * pmf(r.lambda_away, 9)[r.away_goals] / hda(raw)[cls] * Q[cls]
        assert r.true_score_nll == pytest.approx(-math.log(true), abs=1e-10)


def test_nll_identity_finds_an_altered_row(rates):
    y = F.when(F.col("home_goals") > F.col("away_goals"), 2).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(0)
    g = G.grid_to_outcome(G.reweight_grid(G.score_grid_fixed(rates.withColumn("y", y)), out="fused"))
    base = G.score_stats(g).select(*g.columns, F.col("true_score_nll").alias("base_nll"))
    both = G.score_stats(base, target=("p_away", "p_draw", "p_home"), grid="fused")
    assert G.nll_identity_check(both, "true_score_nll", "base_nll").count() == 0
    off = both.withColumn("base_nll", F.col("base_nll") + F.when(F.col("match_id") == 3, 1e-6).otherwise(0.0))
    assert [r.match_id for r in G.nll_identity_check(off, "true_score_nll", "base_nll").collect()] == [3]


def test_tail_goes_to_away(rates):
    for r in G.poisson_outcome_tail(rates).collect():
        assert r.p_away + r.p_draw + r.p_home == pytest.approx(1)
        assert r.p_home == pytest.approx(np.tril(np.outer(pmf(r.lambda_home, 8), pmf(r.lambda_away, 8)), -1).sum())


def test_missing_rate_gives_nulls(spark):
    df = spark.createDataFrame([(1, None, 1.0, 1, 0), (2, 1.2, 1.0, 1, 0)],
                               "match_id long, lambda_home double, lambda_away double, home_goals int, away_goals int")
    out = G.score_stats(G.grid_to_outcome(G.score_grid_fixed(df))).orderBy("match_id").collect()
    for c in ("grid", "s_away", "s_draw", "s_home", "expected_home_goals", "true_score_nll", "true_score_probability",
              "mode_home_goals", "exact_score_hit", "actual_outside_grid"):
        assert out[0][c] is None and out[1][c] is not None


def test_grids_are_made_after_the_join_of_their_probabilities(spark):
    from matchframe.catalog.score_queries import reweighted
    plan = reweighted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan
    assert plan.rindex("ArrowEvalPython") < plan.index("Join")
