"""Metrics, tests and back-tests against hand values and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchframe.functions import scalars as S
from matchframe.operators import errors as K
from matchframe.operators import metrics as H
from matchframe.operators import uncertainty as I
from matchframe.operators import value as L

P = "match_id long, y int, p_away double, p_draw double, p_home double"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = [rng.randrange(1, 9) for _ in range(3)]
        rows.append((i, rng.randrange(3), *[x / sum(w) for x in w]))
    return rows, spark.createDataFrame(rows, P)


def test_hand_values(spark):
    rows = [(0, 0, .8, .1, .1), (1, 1, .2, .6, .2), (2, 2, .1, .2, .7)]
    df = S.predicted_class(spark.createDataFrame(rows, P))
    m = H.classification_metrics(df).first()
    assert m.accuracy == 1 and m.f1_1 == 1 and m.macro_f1 == 1
    b = sum((1 - p) ** 2 + q ** 2 + r ** 2 for p, q, r in ((.8, .1, .1), (.6, .2, .2), (.7, .1, .2))) / 9
    assert H.brier(df).first().brier == pytest.approx(b)
    assert H.log_loss(df).first().log_loss == pytest.approx(-(math.log(.8) + math.log(.6) + math.log(.7)) / 3)


def test_division_by_zero_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0, 2), (1, 0, 2)], "match_id long, y int, predicted int")
    m = H.classification_metrics(df).first()
    assert m.macro_f1 == 0 and m.precision_1 == 0 and m.recall_2 == 0


def test_auc_with_ties(table):
    rows, df = table
    got = H.roc_auc(df, cells=16).first()
    for k in range(3):
        pos = [r[2 + k] for r in rows if r[1] == k]
        neg = [r[2 + k] for r in rows if r[1] != k]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[f"auc_{k}"] == pytest.approx(want)


def test_ties_in_picks(spark):
    df = spark.createDataFrame([(1, 0.4, 0.2, 0.4), (2, 0.25, 0.5, 0.25), (3, None, 0.5, 0.5)], "id int, q_away double, q_draw double, q_home double")
    assert [r.market_pick for r in S.market_pick(df).collect()] == [0, 1, None]
    assert [r.market_pick for r in S.market_pick(df, tie="home").collect()] == [2, 1, None]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 2, 0.0, 0.8, 0.2), (2, 2, 0.0, 0.0, 1.0)], P)
    low = {(r.cls, r.bin): r.n for r in H.calibration_bins(df, 5, "edge_low").collect()}
    assert low == {(0, 0): 2, (1, 0): 1, (1, 3): 1, (2, 0): 1, (2, 4): 1}
    half = {(r.cls, r.bin): r.n for r in H.calibration_bins(df, 10, "half_open", 1).collect()}
    assert half == {(0, 0): 2, (1, 0): 1, (1, 8): 1, (2, 2): 1}  # p = 1 is left out


def test_diebold_mariano(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random(300), rng.random(300) + 0.05
    df = spark.createDataFrame([(i, f"2020-01-{1 + i // 12:02d}", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "match_id long, d string, loss_a double, loss_b double")
    df = df.withColumn("match_date", F.to_date("d"))
    d = a - b
    stat = d.mean() / math.sqrt((d.var(ddof=1) + 2 * np.cov(d[:-1], d[1:])[0, 1]) / len(d))
    for per_block in (17, 10_000):
        r = I.diebold_mariano(df, rows_per_block=per_block).first()
        assert r.dm_stat == pytest.approx(stat)
        assert r.p_value == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)), abs=1e-6)
    same = I.diebold_mariano(df.withColumn("loss_b", F.col("loss_a"))).first()
    assert (same.dm_stat, same.p_value) == (0, 1)


def test_exact_binomials(spark):
    df = spark.createDataFrame([(0, 0), (3, 9), (12, 5), (700, 640), (5, 5), (40000, 39000)], "b long, c long")
    for r in df.withColumn("t", I.binomial_tail(F.greatest("b", "c"), F.col("b") + F.col("c"))).collect():
        n, k = r.b + r.c, max(r.b, r.c)
        if n > 2000:
            z = (k - 0.5 - n / 2) / math.sqrt(n / 4)
            assert r.t == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-2)
        else:
            assert r.t == pytest.approx(sum(math.comb(n, i) for i in range(k, n + 1)) / 2 ** n, rel=1e-8)
    t = spark.createDataFrame([(40, 90)], "wins long, n long")
    want = sum(math.comb(90, i) * (1 / 3) ** i * (2 / 3) ** (90 - i) for i in range(40, 91))
    assert I.binomial_test(t).first().p_value == pytest.approx(want, rel=1e-8)


def test_bootstrap_draws_whole_clusters_within_strata(spark):
    """All rows of a stratum share one value, so every stratified draw has the same mean."""
    rows = [(i, f"2020-01-{1 + i % 20:02d}", i % 2, float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "match_id long, day string, season int, d_accuracy double")
    df = df.withColumn("match_date", F.concat("day", F.lit("-"), "season"))
    r = I.stratified_bootstrap(df, reps=50, metrics=["d_accuracy"]).first()
    assert r.delta == r.ci95_low == r.ci95_high == 0.5
    free = I.cluster_bootstrap(df, reps=200, metrics=["d_accuracy"]).first()
    assert free.ci95_low < 0.5 < free.ci95_high
    again = I.cluster_bootstrap(df.repartition(7), reps=200, metrics=["d_accuracy"]).first()
    assert (free.ci95_low, free.ci95_high) == (again.ci95_low, again.ci95_high)


def test_bootstrap_draws_are_never_broadcast(spark):
    """Their size is estimated from the few cluster rows they are made of."""
    df = spark.range(3000).select(F.expr("date_add(date '2020-01-01', cast(id % 300 as int))").alias("match_date"), (F.col("id") % 3).alias("season"),
                                  (F.col("id") % 7).cast("double").alias("d_accuracy"))
    draws = I.bootstrap_draws(df, "match_date", ["d_accuracy"], 400, 1, "season")
    assert len(draws.collect()) == 400
    joins = [line for line in draws._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Join" in line and "_pick" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_iid_bootstrap_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.1, 1, 2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "match_id long, diff double")
    r = I.iid_bootstrap_brier(df, reps=200).first()
    se = x.std() / math.sqrt(len(x))
    assert abs(r.mean_diff - x.mean()) < 0.3 * se
    assert r.ci_lower == pytest.approx(x.mean() - 1.96 * se, abs=0.6 * se) and r.ci_upper == pytest.approx(x.mean() + 1.96 * se, abs=0.6 * se)


def test_auc_of_a_narrow_band_of_scores(spark):
    """All scores within a millionth: the one cell they fall into is cut again, and the value is exact."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        p = 0.5 + 1e-6 * rng.randrange(400) / 400
        rows.append((i, rng.randrange(3), 0.25 + (0.5 - p), p, 0.25))
    df = spark.createDataFrame(rows, P)
    got = H.roc_auc(df, scores_per_cell=20).first()
    for k, c in enumerate(("p_away", "p_draw", "p_home")):
        pos = [r[2 + k] for r in rows if r[1] == k]
        neg = [r[2 + k] for r in rows if r[1] != k]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[f"auc_{k}"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    assert H.roc_auc(df).first() == pytest.approx(got, abs=1e-12)


def test_bags_of_rows_give_the_interval_of_the_rows(spark):
    """On a table of ten rows per bag, with heavy tails and nulls, the interval from bags has the
    place and width of the exact one; below the number of bags both are row bootstraps."""
    rng = np.random.default_rng(2)
    x = rng.standard_t(3, 5000) + 0.05
    df = spark.createDataFrame([(i, float(v) if i % 50 else None) for i, v in enumerate(x)], "match_id long, diff double")
    exact = I.iid_bootstrap_brier(df, reps=400, buckets=None).first()
    bags = I.iid_bootstrap_brier(df, reps=4000, buckets=500).first()
    width = exact.ci_upper - exact.ci_lower
    assert bags.ci_upper - bags.ci_lower == pytest.approx(width, rel=0.15)
    assert bags.mean_diff == pytest.approx(exact.mean_diff, abs=0.05 * width)
    assert bags.ci_lower == pytest.approx(exact.ci_lower, abs=0.12 * width)
    assert bags.pct_below_zero == pytest.approx(exact.pct_below_zero, abs=5)
    again = I.iid_bootstrap_brier(df.repartition(9), reps=4000, buckets=500).first()
    assert tuple(again) == pytest.approx(tuple(bags), abs=1e-12)


def test_scopes_and_audit(spark, table):
    _, df = table
    preds = df.select("*", F.lit("m").alias("model"), F.lit(2020).alias("season"), F.when(F.col("match_id") % 2 == 0, "E0").otherwise("E1").alias("division"),
                      F.lit("2020-01-01").cast("date").alias("match_date"))
    per = H.per_match_metrics(preds)
    s = H.summarize_scopes(per)
    assert {r.scope for r in s.collect()} == {"overall", "season", "league", "actual_outcome", "season_league"}
    a = H.recompute_audit(per, s).first()
    assert a.n_unmatched == 0 and a.max_diff_log_loss == 0 and a.n_rows == 9
    assert all(r.score_nll is None for r in s.collect())  # a metric with nulls has no mean


def test_bets(spark):
    df = spark.createDataFrame([(1, 2020, "E0", 2, 0.1, 0.3, 0.6, 4.0, 4.0, 2.0), (2, 2020, "E0", 0, 0.6, 0.2, 0.2, 4.0, 4.0, None), (3, 2020, "E1", 0, 0.2, 0.2, 0.6, 4.0, 4.0, 2.0)],
                               "match_id long, season int, division string, y int, p_away double, p_draw double, p_home double, odds_away double, odds_draw double, odds_home double")
    bets = L.explode_outcomes(df)
    assert bets.count() == 6  # the match without odds is left out
    best = L.select_best(bets, 0.0).orderBy("match_id").collect()
    assert [(r.match_id, r.outcome, r.hit) for r in best] == [(1, 1, 0), (3, 2, 0)] or [(r.outcome, r.hit) for r in best] == [(2, 1), (2, 0)]
    r = L.settle(bets.where("outcome = 2"), stake=100).first()
    assert (r.bets, r.wins, r.profit, r.roi) == (2, 1, 0.0, 0.0)
    sweep = {x.threshold: x.bets for x in L.threshold_sweep(bets).collect()}
    assert sweep[0.0] == 2 and 1.0 not in sweep


def test_error_log_is_limited_per_type(spark, table):
    _, df = table
    j = df.select("*", F.col("p_away").alias("q_away"), F.col("p_draw").alias("q_draw"), F.col("p_home").alias("q_home"), F.lit("2020-01-01").cast("date").alias("match_date"))
    j = S.market_pick(S.predicted_class(j), tie="home")
    log = K.error_log(j, limit=5)
    assert max(r["count"] for r in log.groupBy("error_type").count().collect()) <= 5
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
