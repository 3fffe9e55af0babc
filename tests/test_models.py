"""Fits, selection and ratings on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MATCH_SCHEMA, random_matches
from matchframe.functions import scalars as S
from matchframe.functions.kernels import PiKernel, PoissonKernel, deal_waves
from matchframe.operators import models as FM
from matchframe.operators import ratings as R
from matchframe.operators import selection as J

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        x = rng.normal(0, 1, 2)
        y = int(np.argmax([x[0], 0.3 * x[1], -x[0] + 0.2] + rng.gumbel(0, 1, 3)))
        rows.append((i, 2019 + i // 200, "E0" if i % 3 else "E1", y, float(x[0]), None if i % 10 == 0 else float(x[1] * 50), None))
    df = spark.createDataFrame(rows, "match_id long, season int, division string, y int, a double, b double, c double")
    return df.withColumn("match_date", F.date_add(F.lit("2019-08-01").cast("date"), F.col("match_id").cast("int"))).cache()


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_logistic_regression_is_at_the_optimum(data):
    """Gradient of total loss + |w|^2 / (2C) is near zero at the fitted coefficients; an all-null column fills with 0."""
    model = FM.fit_lr(data, COLS)
    pdf = data.orderBy("match_id").toPandas()
    x = np.column_stack([pdf.a, pdf.b.fillna(pdf.b.mean()), np.zeros(len(pdf))])
    w, b = np.array(model.coef), np.array(model.intercept)
    p = softmax(x @ w.T + b)
    err = p - np.eye(3)[pdf.y]
    grad = err.T @ x + w
    assert np.abs(grad).max() < 1e-6
    assert np.abs(err.sum(axis=0)).max() < 1e-6
    got = FM.predict(model, data).orderBy("match_id").toPandas()
    np.testing.assert_allclose(got[["p_away", "p_draw", "p_home"]], p, atol=1e-9)


def test_reloaded_model_predicts_the_same(spark, data, tmp_path):
    for k, model in enumerate((FM.fit_lr_scaled(data, COLS), FM.fit_boosted(data, ["a", "b"], rounds=2), FM.fit_forest(data, ["a", "b"], trees=3))):
        FM.save_model(model, str(tmp_path / str(k)))
        a, b = (FM.predict(x, data).orderBy("match_id").toPandas() for x in (model, FM.load_model(str(tmp_path / str(k)))))
        np.testing.assert_array_equal(a.p_home, b.p_home)
        assert model.log["n_parameters"] > 0 and FM.model_bytes(model) > 0


def test_one_vs_rest_models_give_probabilities(data):
    for model in (FM.fit_boosted(data, ["a", "b"], rounds=2), FM.fit_lr_l1(data, ["a", "b"])):
        p = FM.predict(model, data).toPandas()[["p_away", "p_draw", "p_home"]].to_numpy()
        np.testing.assert_allclose(p.sum(axis=1), 1)
        assert (p > 0).all()


def test_all_linear_fits_are_at_their_optimum(data):
    """Optimality conditions by the library and, for L1, zero coefficients among them."""
    goals = data.withColumn("g", F.when(F.col("match_id") % 7 == 0, None).otherwise(F.col("match_id") % 4))
    l1 = FM.fit_lr_l1(data, COLS, c=0.02)
    assert any(w == 0 for row in l1.coef for w in row[:2]) and any(w != 0 for row in l1.coef for w in row)
    poisson = FM.fit_poisson_glm(goals.withColumn("h", F.col("y") + 1), ["a", "b"], "g", "h")
    weights = FM.class_weights(data).drop("n_class")
    cases = [(FM.fit_lr(data, COLS), data, {}), (FM.fit_lr_scaled(data, COLS, c=3.0), data, {}), (l1, data, {}),
             (FM.fit_balanced(data, COLS), data.join(weights, "y"), {"weight": "class_weight"}), (poisson[0], goals, {"label": "g"})]
    for model, rows, kw in cases:
        got = FM.stationarity(model, rows, **kw).collect()
        assert len(got) == len(model.coef) * (len(model.cols) + 1) and max(r.residual for r in got) < 1e-7
        assert model.log["converged"]
    worse = FM.Linear(**{**vars(cases[0][0]), "coef": [[w + 0.1 for w in row] for row in cases[0][0].coef], "intercept": [0.5, 0.0, 0.0]})
    assert max(r.residual for r in FM.stationarity(worse, data).collect()) > 1e-3


def test_poisson_fit_against_iteratively_reweighted_least_squares(data):
    pdf = data.orderBy("match_id").toPandas()
    x = np.column_stack([pdf.a, pdf.b.fillna(pdf.b.mean()) / 50, np.ones(len(pdf))])
    beta = np.zeros(3)
    for _ in range(50):
        mu = np.exp(x @ beta)
        beta += np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (pdf.y - mu))
    got = FM.predict_rates(FM.fit_poisson_glm(data, ["a", "b"], "y", "y"), data).orderBy("match_id").toPandas()
    np.testing.assert_allclose(got.lambda_home, np.exp(x @ beta), rtol=1e-8)


def test_many_fits_equal_single_fits_and_share_scans(data, monkeypatch):
    """Different columns, C and training seasons in shared passes give what each fit alone gives."""
    from pyspark.sql import DataFrame

    from matchframe.operators import newton as N
    fits = [FM.lr_spec(f"{c}-{cols}-{until}", cols, c, until=until) for c in (0.1, 10.0) for cols in (["a"], ["a", "b"], COLS) for until in (2020, 2021)]
    scans = []
    monkeypatch.setattr(N, "SLOTS", 1)  # the two-level sum
    original = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: scans.append(1) or original(self))
    both = N.fit_many(data.repartition(7), fits)
    assert len(scans) <= 12
    for f, s in zip(fits, both):
        alone = N.fit_many(data, [f])[0]
        np.testing.assert_allclose(s.coef, alone.coef, atol=1e-6)
        np.testing.assert_allclose(s.intercept, alone.intercept, atol=1e-6)
        assert s.n == (200 if f.until == 2020 else 300)


def test_lasso_step_is_exact_where_columns_are_sums_of_others():
    """Optimality of the quadratic model after one step; coordinate descent left such columns far from it."""
    from matchframe.operators import newton as N
    rng = np.random.default_rng(8)
    for seed in range(5):
        a = rng.normal(size=(400, 8))
        x = np.column_stack([a, a[:, :4] + a[:, 4:], a[:, 0] - a[:, 1], a[:, :3] @ rng.normal(size=(3, 6)) + 1e-3 * rng.normal(size=(400, 6)), np.ones(400)])
        hess, grad = x.T @ x, -x.T @ rng.normal(size=400) * 10
        lam = np.append(np.full(x.shape[1] - 1, 20.0), 0.0)
        theta = np.where(rng.random(len(lam)) < 0.5, rng.normal(size=len(lam)), 0.0)
        step = N._lasso_step(grad, hess, theta, lam)
        w, slope = theta + step, grad + hess @ step
        gap = np.where((w != 0) | (lam == 0), np.abs(slope + lam * np.sign(w)), np.maximum(np.abs(slope) - lam, 0.0))
        assert gap.max() < 1e-4 and (w == 0).sum() >= 3


def test_fits_of_a_group_share_one_hessian(data, monkeypatch):
    """Every fit had a Hessian of its own in every pass. A fit that the shared one serves badly still gets its own."""
    from matchframe.operators import newton as N
    strong = data.withColumn("d", F.when(F.col("y") == 0, 3.0).when(F.col("y") == 1, 0.0).otherwise(-3.0) + F.col("a") / 4)
    sets = [["a", "b", "d"], ["a"], ["b"], ["a", "b"], ["d"]]
    fits = [FM.lr_spec("-".join(c), c, 5.0, until=until) for c in sets for until in (2020, 2021)]
    asked, scan = [], N._scan
    monkeypatch.setattr(N, "_scan", lambda asks, *a: asked.append([len(x.hessians) for x in asks]) or scan(asks, *a))
    found = N.fit_many(strong, fits)
    assert asked[0] == [1, 1] and sum(map(sum, asked)) < len(asked) * len(fits) and max(map(max, asked)) > 1
    for f, s in zip(fits, found):
        alone = FM.Linear("", list(f.cols), s.n, "softmax", s.means.tolist(), s.coef.tolist(), s.intercept.tolist(), s.sds.tolist(), "l2", 5.0)
        assert s.converged and max(r.residual for r in FM.stationarity(alone, strong.where(F.col("season") < f.until)).collect()) < 1e-7


def test_softmax_of_far_margins():
    from matchframe.operators import newton as N
    for size in (1.0, 400.0, 1e5):
        eta = np.random.default_rng(2).normal(size=(3, 2, 50)) * size
        p, norm = N._softmax(eta.copy())
        z = np.concatenate([eta, -eta.sum(1, keepdims=True)], 1)
        top = z.max(1, keepdims=True)
        e = np.exp(z - top)
        np.testing.assert_allclose(np.stack(p, 1), e / e.sum(1, keepdims=True), atol=1e-12)
        np.testing.assert_allclose(norm, np.log(e.sum(1)) + top[:, 0], rtol=1e-12)


def plain_boosting(x, y, edges, prior, rounds, depth, rate):
    """A plain booster: recursive trees on the same bins."""
    from matchframe.operators import boosting as B
    bins = B.binned(x, edges).astype(int)
    f = np.tile(prior, (len(y), 1))

    def grow(rows, level, g, h):
        best = None
        if level < depth:
            for c in range(x.shape[1]):
                for cut in range(B.BINS - 1):
                    left = rows[bins[rows, c] <= cut]
                    right = rows[bins[rows, c] > cut]
                    if h[left].sum() < B.LEAST_CURVATURE or h[right].sum() < B.LEAST_CURVATURE:
                        continue
                    gain = sum(g[r].sum() ** 2 / (h[r].sum() + B.RIDGE) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + B.RIDGE)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, left, right)
        if best is None:
            return [(rows, -g[rows].sum() / (h[rows].sum() + B.RIDGE))]
        return grow(best[1], level + 1, g, h) + grow(best[2], level + 1, g, h)
    for _ in range(rounds):
        g, h = B.gradients(f, y)
        step = np.zeros_like(f)
        for k in range(3):
            for rows, value in grow(np.arange(len(y)), 0, g[:, k], h[:, k]):
                step[rows, k] = value
        f = f + rate * step
    return f


def test_boosting_against_a_plain_booster(data, monkeypatch):
    from matchframe.operators import boosting as B
    monkeypatch.setattr(B, "REFRESH", 2)
    monkeypatch.setattr(B, "SLOTS", 1)
    model = FM.fit_boosted(data.repartition(5), ["a", "b"], rounds=5, depth=3)
    pdf = data.orderBy("match_id").toPandas()
    x = np.column_stack([pdf.a, pdf.b.fillna(pdf.b.mean())])
    want = plain_boosting(x, pdf.y.to_numpy(), model.edges, model.prior, 5, 3, 0.1)
    np.testing.assert_allclose(model.margins(x), want, atol=1e-8)
    got = FM.predict(model, data).orderBy("match_id").toPandas()
    np.testing.assert_allclose(got[["p_away", "p_draw", "p_home"]], softmax(want), atol=1e-8)
    assert (got.predicted == pdf.y).mean() > 0.5


def test_boosting_scans_chunks_of_rows(data, monkeypatch):
    """A row of the scanned table was one match."""
    from matchframe.operators import boosting as B
    monkeypatch.setattr(B, "REFRESH", 2)
    sizes, write = [], B.write_chunks
    monkeypatch.setattr(B, "write_chunks", lambda df: sizes.append((t := write(df)).count()) or t)
    FM.fit_boosted(data.repartition(3), ["a", "b"], rounds=3, depth=2)
    assert sizes == [3, 3]


def test_leaves_of_a_tree_with_pruned_nodes():
    from matchframe.operators import boosting as B
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 64, (200, 5)).astype(np.uint8)
    for depth in (1, 2, 3, 4):
        inner = (1 << depth) - 1
        tree = B.Tree(rng.integers(-1, 5, inner), rng.integers(5, 60, inner), np.zeros(inner + 1))
        for row, got in zip(bins, tree.leaf(np.asfortranarray(bins))):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(tree.column[node] >= 0 and row[tree.column[node]] > tree.cut[node])
            assert got == node - inner


def test_naive_bayes(data):
    pdf = data.orderBy("match_id").toPandas()
    x = np.column_stack([pdf.a, pdf.b.fillna(pdf.b.mean())])
    eps = 1e-9 * x.var(axis=0).max()
    logp = []
    for k in range(3):
        xk = x[pdf.y == k]
        v = xk.var(axis=0) + eps
        logp.append(math.log(len(xk) / len(x)) - 0.5 * np.log(2 * np.pi * v).sum() - ((x - xk.mean(axis=0)) ** 2 / (2 * v)).sum(axis=1))
    got = FM.fit_naive_bayes(data, data, ["a", "b"]).orderBy("match_id").toPandas()
    np.testing.assert_allclose(got[["p_away", "p_draw", "p_home"]], softmax(np.column_stack(logp)), atol=1e-9)


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in S.standardize(df, df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_suite_logs_failures(data):
    def broken(train, cols):
        raise RuntimeError("does not fit")
    preds, log = FM.run_model_suite(data, ["a"], [2020], {"lr": FM.fit_lr, "broken": broken})
    assert preds.count() == 100 and [e["model"] for e in log if "error" in e] == ["broken"]
    row = FM.suite_log(preds.sparkSession, log).first()
    assert (row.model, row.fold, row.n_parameters, row.n_train) == ("lr", 2020, 6, 200) and row.predict_seconds > 0


def test_permutation_keeps_blocks_and_joint_rows(spark):
    df = spark.createDataFrame([(i, "E0" if i < 40 else "E1", i * 10, i * 100) for i in range(60)], "match_id long, division string, u long, v long")
    out = J.shuffle_within(df, ["u", "v"]).collect()
    assert sorted(r.u_shuffled for r in out) == [i * 10 for i in range(60)]
    assert all(r.v_shuffled == 10 * r.u_shuffled for r in out)
    assert all((r.u_shuffled < 400) == (r.division == "E0") for r in out)
    assert any(r.u != r.u_shuffled for r in out)
    wide = J.shuffle_within(df, ["u"], block=()).collect()
    assert any((r.u_shuffled < 400) != (r.division == "E0") for r in wide)


def test_importance_finds_the_informative_column(data):
    model = FM.fit_lr(data, ["a", "b"])
    got = {r.feature: r for r in J.permutation_importance(model, data, repeats=3).collect()}
    assert got["a"]["rank"] == 1 and got["a"].permutation_logloss_mean > 0.05
    fam = {r.family: r for r in J.group_importance(model, data, {"both": ["a", "b"]}, repeats=2).collect()}
    assert fam["both"].n_features == 2 and fam["both"].permutation_logloss_mean > 0.05
    forest = FM.fit_forest(data, ["a", "b"], trees=5, depth=3)
    assert J.permutation_importance(forest, data, repeats=2).first().permutation_logloss_mean is not None


def test_moments_of_columns_come_from_one_scan_without_aggregates(spark, monkeypatch):
    from pyspark.sql import DataFrame
    from matchframe.operators import newton
    rng = np.random.default_rng(4)
    rows = [(int(s) if s else None, float(a) if a > -1 else None, 1e6 + float(b), 7.25, None) for s, a, b in zip(rng.integers(0, 4, 500), rng.normal(size=500), rng.normal(size=500))]
    df = spark.createDataFrame(rows, "season int, a double, b double, c double, d double").repartition(5)
    want = {r.season: r for r in df.groupBy("season").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate("abcd") for k, f in (("c", F.count), ("m", F.avg), ("v", F.var_pop))]).collect()}
    monkeypatch.setattr(DataFrame, "groupBy", None)
    got = {r["season"]: r for r in newton._moments(df, list("abcd"), "season")}
    assert set(got) == set(want) and None in got
    for s, w in want.items():
        assert got[s]["n"] == w.n
        for i in range(4):
            assert got[s][f"c{i}"] == w[f"c{i}"]
            assert not w[f"c{i}"] or (got[s][f"m{i}"], got[s][f"v{i}"]) == pytest.approx((w[f"m{i}"], w[f"v{i}"]), rel=1e-9)


def test_class_weights_need_no_join(data):
    got = FM.with_class_weights(data)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = data.join(FM.class_weights(data).drop("n_class"), "y")
    assert sorted(map(tuple, got.select("match_id", "class_weight").collect())) == sorted(map(tuple, want.select("match_id", "class_weight").collect()))


def test_importance_writes_rows_once_and_permutes_ids_alone(data, monkeypatch):
    written, numbered = [], []
    keep, permute = J.materialize, J.shuffle_within
    monkeypatch.setattr(J, "materialize", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(J, "shuffle_within", lambda df, *a, **kw: numbered.append(df.columns) or permute(df, *a, **kw))
    J.permutation_importance(FM.fit_lr(data, ["a", "b"]), data, repeats=4).collect()
    assert [df.count() for df in written] == [data.count()]
    assert numbered == [["match_id", "rep", "division"]]


def test_permuted_ids_travel_as_runs(spark, monkeypatch):
    """Ids alone were numbered and joined row by row; runs of them give the same permutation, without rows of a null block."""
    rows = [(i * 7919 + 3, ("E0", "E1", None)[i % 3], rep) for i in range(700) for rep in range(2)]
    df = spark.createDataFrame(rows, "match_id long, division string, rep int").repartition(3)
    seed = F.lit(42) + F.col("rep")
    for block in (["rep", "division"], ["rep"], []):
        ids = (df if block else df.where("rep = 1")).select("match_id", *block)
        want = J.shuffle_within(ids.withColumn("u", F.col("match_id")), ["u"], block, seed if block else 42).select(*block, "match_id", "u_shuffled").collect()
        with monkeypatch.context() as m:
            m.setattr(J, "cell_rank", None)
            m.setattr(J, "IDS_PER_CELL", 100)
            m.setattr(J, "RANKS_PER_PART", 64)
            got = J.shuffle_within(ids, ["match_id"], block, seed if block else 42).select(*block, "match_id", "match_id_shuffled").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_blocks_keep_every_bit():
    from matchframe.plans import packed as P
    rng = np.random.default_rng(3)
    block = np.stack([rng.normal(size=3000), rng.integers(0, 9, 3000) / 7, np.full(3000, np.nan), np.where(rng.random(3000) < 0.5, -0.0, 0.0), rng.integers(0, 700, 3000) / 3])
    for part in (block, block[:, :1], block[:, :0]):
        again = P.expand_block(P.squeeze_block(part), 5, part.shape[1])
        assert (again.view(np.int64) == np.ascontiguousarray(part).view(np.int64)).all()
    assert len(P.squeeze_block(block[1:])) < 3000 * 5
    ids = rng.integers(-5, 1 << 50, (2, 999))
    assert (P.expand_ids(P.squeeze_ids(*ids), 2, 999) == ids).all()


def test_importance_of_a_linear_model_is_that_of_scoring_permuted_rows(data):
    """Replaced margins give what scoring every permuted copy of the rows gives."""
    model, repeats = FM.fit_lr(data, ["a", "b"]), 2
    got = {r.feature: r for r in J.permutation_importance(model, data, repeats=repeats).collect()}
    pdf = data.orderBy("match_id").toPandas()
    x = np.column_stack([pdf.a, pdf.b.fillna(pdf.b.mean())])
    coef, b = np.array(model.coef), np.array(model.intercept)

    def loss(z):
        return -np.log(softmax(z @ coef.T + b)[np.arange(len(z)), pdf.y])
    rises = {"a": [], "b": []}
    for r in range(repeats):
        moved = J.shuffle_within(data.select("match_id", "division", "a", F.coalesce("b", F.lit(float(pdf.b.mean()))).alias("b")), ["a", "b"], seed=42 + r)
        m = moved.orderBy("match_id").toPandas()
        for i, c in enumerate("ab"):
            z = x.copy()
            z[:, i] = m[f"{c}_shuffled"]
            rises[c].append((loss(z) - loss(x)).mean())
    for c in "ab":
        assert got[c].permutation_logloss_mean == pytest.approx(np.mean(rises[c]), abs=1e-9)
        assert got[c].permutation_logloss_std == pytest.approx(np.std(rises[c], ddof=1), abs=1e-9)


def test_correlation_pairs_skip_nulls(data):
    pdf = data.toPandas()
    got = J.correlation_pairs(data, ["a", "b", "c", "y"], threshold=0.0).collect()
    assert {(r.feature_a, r.feature_b) for r in got} == {("a", "b"), ("a", "y"), ("b", "y")}
    for r in got:
        assert r.absolute_correlation == pytest.approx(abs(pdf[r.feature_a].astype(float).corr(pdf[r.feature_b].astype(float))), abs=1e-10)


def test_validate_grid_and_winner(data):
    grid = J.validate_grid(data, {"good": ["a", "b"], "poor": ["b"]}, [2020])
    rows = grid.collect()
    assert {r.config for r in rows} == {"good", "poor"} and all(r.n_matches == 100 for r in rows)
    assert J.pick_winner(grid).first().config == "good"
    for r in rows:  # the shared scan scores as predictions row by row do
        model = FM.fit_lr(data.where("season < 2020"), {"good": ["a", "b"], "poor": ["b"]}[r.config])
        want = J._pooled(FM.predict(model, data.where("season = 2020"), ("match_id", "season", "y")), ["season"]).first()
        for c in ("accuracy", "macro_f1", "draw_f1", "log_loss", "brier"):
            assert r[c] == pytest.approx(want[c], abs=1e-9)
        assert r.min_season_accuracy == r.accuracy and r.max_season_log_loss == r.log_loss
    with pytest.raises(ValueError):
        J.validate_grid(data.withColumn("match_date", F.lit("2020-01-01").cast("date")), {"x": ["a"]}, [2020])


def test_candidate_sets():
    cols = ["home_goals_for_5", "home_goals_for_10", "home_win_rate_5", "h2h_draws", "league_level"]
    ranked = ["home_goals_for_5", "h2h_draws", "home_goals_for_10", "league_level", "home_win_rate_5"]
    sets = J.candidate_sets(cols, ranked, ranked[:2], [("home_goals_for_5", "h2h_draws")], tops=(2,), drops=(1,))
    assert sets["all_5"] == cols and sets["groups__form__h2h"] == ["home_win_rate_5", "h2h_draws"]
    assert [c for c in cols if c != "home_win_rate_5"] in sets.values() and sets["top_2"] == ["home_goals_for_5", "h2h_draws"]
    assert "positive_permutation" not in sets  # the same columns as top_2
    assert [c for c in cols if c != "h2h_draws"] in sets.values()  # of a correlated pair the better one
    assert sets["window_5_only"] == [c for c in cols if c != "home_goals_for_10"]
    assert len({tuple(v) for v in sets.values()}) == len(sets)


# ---------------------------------------------------------------- ratings

def plain_fold(rows, kernel):
    teams, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        h, a = (teams.setdefault((r[3], t), kernel.new_team()) for t in (r[5], r[6]))
        out[r[0]] = kernel.step(h, a, r[7], r[8], True)
    return out, teams


@pytest.mark.parametrize("kind,kernel", [("pi", PiKernel), ("poisson", PoissonKernel)])
def test_fold_in_blocks_equals_one_pass(spark, kind, kernel):
    rows = random_matches(150, seed=9, hot=True)
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    want, teams = plain_fold(rows, kernel({}))
    for per_block in (30, 10_000):
        h = (R.pi_rating if kind == "pi" else R.poisson_rating)(df, rows_per_block=per_block)
        for r in h.collect():
            assert [r.p_away, r.p_draw, r.p_home] == pytest.approx(want[r.match_id][:3], abs=1e-12)
    got = {(r.league, r.team): r for r in R.team_strengths(df, kind=kind, rows_per_block=30).collect()}
    assert set(got) == set(teams)
    first = "mu" if kind == "pi" else "home_attack"
    assert all(got[k][first] == pytest.approx(v[0]) for k, v in teams.items())


def test_poisson_outcome_equals_the_full_grid():
    k = PoissonKernel({})
    g = np.arange(9)
    for lh, la in ((1.4, 1.1), (3.5, 0.2), (0.1, 6.0)):
        ph, pa = (np.exp(g * math.log(x) - x - np.array([math.lgamma(i + 1) for i in g])) for x in (lh, la))
        m = np.outer(ph, pa)
        for (i, j), t in {(0, 0): 1 + 0.2 * lh * la, (1, 1): 1.2, (0, 1): 1 - 0.2 * lh, (1, 0): 1 - 0.2 * la}.items():
            m[i, j] *= max(t, 0)
        m /= m.sum()
        assert k.outcome(lh, la) == pytest.approx((np.triu(m, 1).sum(), np.trace(m), np.tril(m, -1).sum()), abs=1e-12)


def test_frozen_ratings_do_not_move(small):
    frozen = R.rating_eval(small, "2020-08-01", update=False)
    for team in ("T1", "T2"):
        seen = {r.home_mu for r in frozen.where((F.col("home_team") == team) & (F.col("league") == "E0")).collect()}
        assert len(seen) == 1


def test_rating_search_scores_every_set(small):
    out = R.rating_search(small, [{"pi": 0.001}, {"pi": 0.05}]).collect()
    assert len(out) == 2 and sum(r.best for r in out) == 1
    assert min(out, key=lambda r: r.nll).best == 1
    assert len(R.full_grid({"a": (1, 2), "b": (3, 4, 5)})) == 6
    picks = R.sample_params(R.PI_GRID, 20)
    assert len({tuple(p.items()) for p in picks}) == 20 and picks == R.sample_params(R.PI_GRID, 20)


@pytest.mark.parametrize("kind,kernel,sets", [("pi", PiKernel, [{"pi": v} for v in (0.001, 0.01, 0.05, 0.1, 0.3)] + [{"delta": 0.8}]),
                                              ("poisson", PoissonKernel, [{"learning_rate": v} for v in (0.01, 0.05, 0.1)] + [{"rho": 0.0}, {"max_goals": 5}])])
def test_rating_search_adds_losses_inside_tasks(spark, kind, kernel, sets):
    """One row per league, block and set leaves a task, not one per match; sums equal a plain pass per set."""
    rows = random_matches(150, seed=9, hot=True)
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    folded = R.fold_matches(df, sets, kind, rows_per_block=30, losses=True)
    assert {r.tag for r in folded.select("tag").distinct().collect()} == {"loss", "team"}
    got = {r.param_id: (r.n, r.nll) for r in R.rating_search(df, sets, kind, rows_per_block=30).collect()}
    for i, s in enumerate(sets):
        seen, _ = plain_fold(rows, kernel(s))
        assert got[i] == (150, pytest.approx(sum(-math.log(seen[r[0]][2 if r[7] > r[8] else 1 if r[7] == r[8] else 0]) for r in rows)))


def test_sampled_search_scores_all_published_sets(spark):
    """Four of a hundred sets were searched."""
    from conftest import DATA
    from matchframe.catalog import QUERIES
    out = QUERIES["F19_rating_search_sampled"](spark, DATA).collect()
    assert sorted(r.param_id for r in out) == list(range(100)) and sum(r.best for r in out) == 1
    assert len({r.n for r in out}) == 1


def test_waves_hold_a_team_once_and_keep_its_order():
    rng = np.random.default_rng(3)
    home, away = rng.integers(0, 12, 400), rng.integers(0, 12, 400)
    wave = deal_waves(home, away, 12)
    last = {}
    for h, a, w in zip(home, away, wave):
        assert w == max(last.get(h, -1), last.get(a, -1)) + 1
        last[h] = last[a] = w
    assert wave.max() < 200


def test_games_are_counted_before_each_match(spark):
    rows = random_matches(90, seed=2, hot=True)
    want, _ = plain_fold(rows, PoissonKernel({}))
    got = R.poisson_rating(spark.createDataFrame(rows, MATCH_SCHEMA), rows_per_block=20).collect()
    assert len(got) == 90
    for r in got:
        assert [r.lambda_home, r.lambda_away, r.home_games, r.away_games] == pytest.approx(want[r.match_id][3:7])


def test_diverging_ratings_keep_probabilities(spark):
    """With such a step, goal rates pass 1,000 within a few matches; the grid's mass was zero and the fold failed."""
    rows = [(i, *r[1:7], 9 * (1 + i % 7), *r[8:]) for i, r in enumerate(random_matches(80, seed=5))]
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    sets = [{"learning_rate": 0.5}, {"learning_rate": 0.5, "rho": 0.0}]
    out = R.poisson_rating(df, sets).collect()
    assert max(r.lambda_home for r in out) > 1000
    assert all(0 < p < 1 for r in out for p in (r.p_away, r.p_draw, r.p_home))
    scaled = [r for r in out if r.param_id == 0]
    assert all(r.p_away + r.p_draw + r.p_home == pytest.approx(1) for r in scaled)
    want, _ = plain_fold(rows, PoissonKernel(sets[0]))
    assert all([r.p_away, r.p_draw, r.p_home] == pytest.approx(want[r.match_id][:3], abs=1e-9) for r in scaled)
    k = PoissonKernel({})
    assert k.outcome(900.0, 1.0)[2] == pytest.approx(1, abs=1e-3) and k.outcome(0.0, 1.0)[2] < 0.01
