"""Iterative fits, sequential ratings, feature selection and streams (rows-only checks),
and file sources written from the derived tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import market_probs
from ..operators import history as C
from ..operators import models as FM
from ..operators import ratings as R
from ..operators import selection as J
from ..operators.metrics import fit_complexity
from ..operators.text import keyword_in_context
from ..plans import views
from ..plans.session import materialize, scratch_dir
from ..sources import files
from ..streaming import streams
from .base import FEED, MATCHES, PLAYERS, PREDS, SCORED, TEAM_ROWS, matches, query, r, with_
from .history_queries import MATRIX_NEEDS, STATE, matrix_parts

TEST = 2000
COLS10 = [f"{s}_{c}_10" for s in ("home", "away") for c in ("team_state_points", "goals_for", "goals_against", "avg_shots", "avg_sot")]
ALL_COLS = [*C.matrix_columns(), *C.H2H_COLUMNS, "league_level"]
KEYS = ("match_id", "season", "division", "match_date", "y")


def matrix(spark, d):
    """The feature matrix, written once and read back for the fits."""
    m = materialize(matches(spark, d))  # read by several branches of the plan
    return materialize(C.feature_matrix_66(m, keep=("home_goals", "away_goals", "odds_home", "odds_draw", "odds_away")))


def split(df):
    return df.where(F.col("season") < TEST), df.where(F.col("season") == TEST)


def fitted(name, fit, cols=COLS10):
    @query(name)
    def run(spark, d):
        train, test = split(matrix(spark, d))
        return FM.predict(fit(train, cols), test, ("match_id", "y"))
    return run


fitted("F1_fit_lr", FM.fit_lr, ALL_COLS)
fitted("F2_fit_lr_scaled", FM.fit_lr_scaled, ALL_COLS)
fitted("F3_fit_lr_l1", FM.fit_lr_l1, ALL_COLS)
fitted("F4_fit_balanced", FM.fit_balanced, ALL_COLS)
fitted("F5_fit_forest", lambda t, c: FM.fit_forest(t, c, trees=40, depth=8, leaf=8), ALL_COLS)
fitted("F6_fit_boosted", lambda t, c: FM.fit_boosted(t, c, rounds=50, depth=3), ALL_COLS)
fitted("F8_fit_mlp", lambda t, c: FM.fit_mlp(t, c, layers=(32, 16), max_iter=30))


@query("F13_fit_poisson_glm")
def fit_poisson_glm(spark, d):
    train, test = split(matrix(spark, d))
    return FM.predict_rates(FM.fit_poisson_glm(train, ALL_COLS), test)


def optimal(name, fit, outputs):
    """Every optimality condition of a fit on all columns holds (outputs x columns and intercepts)."""
    @query(f"{name}_optimality", with_(MATCHES) + f"""SELECT COUNT(*) AS n_train, {outputs * (len(ALL_COLS) + 1)} AS n_conditions, {outputs * (len(ALL_COLS) + 1)} AS n_met FROM matches WHERE season < {TEST} AND y IS NOT NULL""")
    def run(spark, d):
        train, _ = split(matrix(spark, d))
        models = fit(train)
        checks = [FM.stationarity(m, rows, weight=weight) for m, rows, weight in models]
        every = checks[0].unionByName(checks[1]) if len(checks) > 1 else checks[0]
        return every.agg(F.lit(models[0][0].n_train).cast("long").alias("n_train"), F.count(F.lit(1)).alias("n_conditions"), F.count_if(F.col("residual") < 1e-6).alias("n_met"))
    return run


def _balanced(train):
    return [(FM.fit_balanced(train, ALL_COLS), FM.with_class_weights(train), "class_weight")]


optimal("F1_fit_lr", lambda t: [(FM.fit_lr(t, ALL_COLS), t, None)], 3)
optimal("F2_fit_lr_scaled", lambda t: [(FM.fit_lr_scaled(t, ALL_COLS), t, None)], 3)
optimal("F3_fit_lr_l1", lambda t: [(FM.fit_lr_l1(t, ALL_COLS), t, None)], 3)
optimal("F4_fit_balanced", _balanced, 3)
optimal("F13_fit_poisson_glm", lambda t: [(m, t, None) for m in FM.fit_poisson_glm(t, ALL_COLS)], 2)


@query("F23_save_load_model", with_(MATCHES) + "SELECT COUNT(*) AS n, CAST(0 AS DOUBLE) AS max_diff FROM matches WHERE season = 2000")
def save_load_model(spark, d):
    """Largest probability difference between a model and its reloaded copy."""
    train, test = split(matrix(spark, d))
    model = FM.fit_lr(train, ALL_COLS)
    path = scratch_dir(spark)
    FM.save_model(model, path)
    again = FM.predict(FM.load_model(path), test).select("match_id", F.col("p_home").alias("again"))
    return FM.predict(model, test).join(again, "match_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p_home") - F.col("again"))).alias("max_diff"))


@query("F24_run_model_suite")
def run_model_suite(spark, d):
    registry = {"lr": lambda t, c: FM.fit_lr(t, c), "lr_scaled": lambda t, c: FM.fit_lr_scaled(t, c)}
    preds, log = FM.run_model_suite(matrix(spark, d), ALL_COLS, [1998, 1999, TEST], registry)
    return FM.suite_metrics(preds).unionByName(FM.suite_failures(spark, log), allowMissingColumns=True)


LINEAR_SUITE = {"lr": FM.fit_lr, "lr_scaled": FM.fit_lr_scaled, "lr_l1": FM.fit_lr_l1, "lr_balanced": FM.fit_balanced}


@query("H15_fit_complexity_suite", f"""SELECT model, CAST(1 AS BIGINT) AS n_fits, {len(ALL_COLS)} AS n_features, CAST({3 * (len(ALL_COLS) + 1)} AS BIGINT) AS n_parameters,
{r(f"{8 * (4 * len(ALL_COLS) + 3)} AS model_bytes")}, TRUE AS timed FROM (VALUES ('lr'), ('lr_scaled'), ('lr_l1'), ('lr_balanced')) v(model)""")
def fit_complexity_suite(spark, d):
    """The fit log of a real suite, summed up per model."""
    _, log = FM.run_model_suite(matrix(spark, d), ALL_COLS, [TEST], LINEAR_SUITE)
    out = fit_complexity(FM.suite_log(spark, log))
    return out.select("model", "n_fits", "n_features", "n_parameters", "model_bytes", ((F.col("fit_seconds") > 0) & (F.col("predict_seconds") > 0)).alias("timed"))


@query("F25_train_on_all")
def train_on_all(spark, d):
    return FM.train_on_all(matrix(spark, d), ALL_COLS, "lr")


@query("L8_feature_set_comparison")
def feature_set_comparison(spark, d):
    df = market_probs(matrix(spark, d))
    sets = {name: [c for c in ALL_COLS if J.family(c) in some] for name, some in (
        ("form", ("form", "margins", "goals_strength")), ("shooting", ("shooting",)), ("pair", ("h2h",)), ("form_and_shooting", ("form", "margins", "goals_strength", "shooting")))}
    return J.feature_set_comparison(df, sets | {"all": ALL_COLS}, TEST, market=("q_away", "q_draw", "q_home"))


# ---------------------------------------------------------------- ratings
@query("F17_pi_rating")
def pi_rating(spark, d):
    return R.pi_rating(matches(spark, d)).drop("learned")


@query("F18_poisson_rating")
def poisson_rating(spark, d):
    return R.poisson_rating(matches(spark, d)).drop("learned")


@query("F19_rating_search")
def rating_search(spark, d):
    return R.rating_search(matches(spark, d), [{"pi": v} for v in R.PI_VALUES])


SEARCHED_SETS = 100  # as published


@query("F19_rating_search_sampled")
def rating_search_sampled(spark, d):
    return R.rating_search(matches(spark, d), R.sample_params(R.POISSON_GRID, SEARCHED_SETS), kind="poisson")


@query("F20_rating_eval_frozen")
def rating_eval_frozen(spark, d):
    return R.rating_eval(matches(spark, d), "1999-08-01", update=False)


@query("F20_rating_eval_online")
def rating_eval_online(spark, d):
    return R.rating_eval(matches(spark, d), "1999-08-01", kind="poisson", update=True)


@query("F21_rating_features")
def rating_features(spark, d):
    m = matches(spark, d)
    return R.rating_features(m.select("match_id", "season", "y"), R.pi_rating(m))


@query("F22_team_strengths")
def team_strengths(spark, d):
    return R.team_strengths(matches(spark, d))


# ---------------------------------------------------------------- selection
def _hash_sql(*parts):
    return f"('0x' || SUBSTR(MD5(CONCAT_WS('|', {', '.join(parts)})), 1, 8))::BIGINT"


_TO, _FROM = _hash_sql("'42'", "'to'", "CAST(match_id AS VARCHAR)"), _hash_sql("'42'", "'from'", "CAST(match_id AS VARCHAR)")


@query("J1_shuffle_within", with_(MATCHES, f"""a AS (SELECT match_id, division, home_goals, ROW_NUMBER() OVER (PARTITION BY division ORDER BY {_TO}, match_id) AS k FROM matches),
b AS (SELECT division, home_goals, away_goals, ROW_NUMBER() OVER (PARTITION BY division ORDER BY {_FROM}, match_id) AS k FROM matches)""")
       + "SELECT a.match_id, a.division, b.home_goals AS home_goals_shuffled, b.away_goals AS away_goals_shuffled FROM a JOIN b ON a.division = b.division AND a.k = b.k")
def shuffle_within(spark, d):
    m = matches(spark, d).select("match_id", "division", "home_goals", "away_goals")
    return J.shuffle_within(m, ["home_goals", "away_goals"]).select("match_id", "division", "home_goals_shuffled", "away_goals_shuffled")


def _families():
    families: dict[str, list[str]] = {}
    for c in ALL_COLS:
        families.setdefault(J.family(c), []).append(c)
    return families


@query("J2_permutation_importance")
def permutation_importance(spark, d):
    train, test = split(matrix(spark, d))
    return J.permutation_importance(FM.fit_lr(train, ALL_COLS), test)


@query("J3_group_importance")
def group_importance(spark, d):
    train, test = split(matrix(spark, d))
    return J.group_importance(FM.fit_lr(train, ALL_COLS), test, _families())


@query("J4_coef_table")
def coef_table(spark, d):
    train, _ = split(matrix(spark, d))
    return J.coef_table(FM.fit_lr(train, ALL_COLS), train)


# A model whose coefficients are stated by a rule: what J2 to J5 do with a model has a SQL form.
STATED = [[((7 * j + 5 * k + 3) % 11 - 5) / 4000 for j in range(len(ALL_COLS))] for k in range(3)]
STATED_INTERCEPT = [0.1, 0.0, -0.1]


def stated_model():
    return FM.Linear("stated", ALL_COLS, 0, "softmax", [0.0] * len(ALL_COLS), STATED, STATED_INTERCEPT)


def _stated_sql(seasons):
    """Tables: cf (coefficients), pf (rows with their permuted partner, per season and repeat)."""
    cols, source = matrix_parts()
    found = dict(c.rpartition(" AS ")[::2][::-1] if " AS " in c else (c, c) for c in cols)
    values = ", ".join(f"({j + 1}, '{c}', '{J.family(c)}', {', '.join(repr(STATED[k][j]) for k in range(3))})" for j, c in enumerate(ALL_COLS))
    def ordered(salt, by):
        return f"ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY ('0x' || SUBSTR(MD5(CONCAT_WS('|', CAST(42 + rep AS VARCHAR), '{salt}', CAST(match_id AS VARCHAR))), 1, 8))::BIGINT, match_id)"
    margins = ", ".join(f"{b!r} + LIST_DOT_PRODUCT(x, [{', '.join(map(repr, row))}]::DOUBLE[]) AS m{k}" for k, (row, b) in enumerate(zip(STATED, STATED_INTERCEPT)))
    last = len(ALL_COLS)
    return [*MATRIX_NEEDS, f"cf AS (SELECT * FROM (VALUES {values}) v(j, feature, family, c0, c1, c2))",
            f"fm AS (SELECT m.match_id, m.season, m.division, m.y, [{', '.join(f'COALESCE(CAST({found[c]} AS DOUBLE), 0.0)' for c in ALL_COLS)}] AS x FROM {source})",
            f"""rw AS (SELECT rep, match_id, season, division, y, x, {margins}, {ordered('to', 'season, rep, division')} AS ka, {ordered('from', 'season, rep, division')} AS kb,
{ordered('to', 'season, rep')} AS wa, {ordered('from', 'season, rep')} AS wb FROM fm, UNNEST(GENERATE_SERIES(0, 4)) g(rep) WHERE season IN ({seasons}))""",
            f"""pf AS (SELECT a.season, a.rep, a.match_id, a.y, a.m0, a.m1, a.m2, a.x, LIST_CONCAT(b.x[1:{last - 1}], [w.x[{last}]]) AS xs
FROM rw a JOIN rw b ON b.season = a.season AND b.rep = a.rep AND b.division = a.division AND b.kb = a.ka JOIN rw w ON w.season = a.season AND w.rep = a.rep AND w.wb = a.wa)"""]


def _scores_sql(source, zs):
    """Loss and hit from margins."""
    p = "EXP({0}) / (EXP({1}) + EXP({2}) + EXP({3}))"
    z = dict(zip("abc", zs))
    e = " + ".join(f"EXP({v} - GREATEST({', '.join(zs)}))" for v in zs)
    chosen = f"CASE y WHEN 0 THEN {z['a']} WHEN 1 THEN {z['b']} ELSE {z['c']} END"
    loss = f"-LN(GREATEST(EXP({chosen} - GREATEST({', '.join(zs)})) / ({e}), 1e-15))"
    hit = f"CASE WHEN (CASE WHEN {zs[0]} >= {zs[1]} AND {zs[0]} >= {zs[2]} THEN 0 WHEN {zs[1]} >= {zs[2]} THEN 1 ELSE 2 END) = y THEN 1.0 ELSE 0.0 END"
    return loss, hit


def _importance_ctes(by):
    """im: season, feature, mean and deviation of both measures over the repeats; by: feature or family."""
    moved = f"""mv AS (SELECT season, rep, match_id, y, m0, m1, m2, {by} AS feature, m0 + SUM((xs[j] - x[j]) * c0) AS z0, m1 + SUM((xs[j] - x[j]) * c1) AS z1, m2 + SUM((xs[j] - x[j]) * c2) AS z2
FROM pf, cf GROUP BY season, rep, match_id, y, m0, m1, m2, {by})"""
    l1, h1 = _scores_sql("mv", ("z0", "z1", "z2"))
    l0, h0 = _scores_sql("mv", ("m0", "m1", "m2"))
    return [moved, f"im0 AS (SELECT season, feature, rep, AVG({l1} - ({l0})) AS dl, AVG({h0} - ({h1})) AS da FROM mv GROUP BY season, feature, rep)",
            """im AS (SELECT season, feature, AVG(dl) AS dl, STDDEV_SAMP(dl) AS sl, AVG(da) AS da, STDDEV_SAMP(da) AS sa, ROW_NUMBER() OVER (PARTITION BY season ORDER BY AVG(dl) DESC, feature) AS rk
FROM im0 GROUP BY season, feature)"""]


_MEASURES = r("dl AS permutation_logloss_mean", "sl AS permutation_logloss_std", "im.da AS permutation_accuracy_mean", "sa AS permutation_accuracy_std")


@query("J2_permutation_importance_stated", with_(*_stated_sql("2000"), *_importance_ctes("feature"))
       + f"SELECT im.feature, family, {_MEASURES}, CAST(rk AS INT) AS rank FROM im JOIN cf ON cf.feature = im.feature")
def permutation_importance_stated(spark, d):
    return J.permutation_importance(stated_model(), split(matrix(spark, d))[1])


@query("J3_group_importance_stated", with_(*_stated_sql("2000"), *_importance_ctes("family"))
       + f"SELECT im.feature AS family, {_MEASURES}, CAST(rk AS INT) AS rank, (SELECT CAST(COUNT(*) AS INT) FROM cf WHERE cf.family = im.feature) AS n_features FROM im")
def group_importance_stated(spark, d):
    return J.group_importance(stated_model(), split(matrix(spark, d))[1], _families())


@query("J4_coef_table_stated", with_(*_stated_sql("2000"), f"sd AS (SELECT j, STDDEV_POP(x[j]) AS sd FROM fm, UNNEST(GENERATE_SERIES(1, {len(ALL_COLS)})) g(j) WHERE season < {TEST} GROUP BY j)",
       *[f"ct AS (SELECT feature, family, {', '.join(f'(c{k} - (c0 + c1 + c2) / 3) * sd AS k{k}' for k in range(3))} FROM cf JOIN sd USING (j))"])
       + f"SELECT feature, family, {r('k0 AS coef_away', 'k1 AS coef_draw', 'k2 AS coef_home', '(ABS(k0) + ABS(k1) + ABS(k2)) / 3 AS coefficient_mean_abs')} FROM ct")
def coef_table_stated(spark, d):
    return J.coef_table(stated_model(), split(matrix(spark, d))[0])


RANKED_SEASONS = (1997, 1998, 1999)


def importance_by_season(df, model_of):
    """Permutation importance of every ranked season, one model per season."""
    parts = [J.permutation_importance(model_of(df.where(F.col("season") < s)), df.where(F.col("season") == s)).withColumn("season", F.lit(s)) for s in RANKED_SEASONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("J5_importance_stability_stated", with_(*_stated_sql(", ".join(map(str, RANKED_SEASONS))), *_importance_ctes("feature"))
       + f"""SELECT feature, {r("AVG(dl) AS mean_logloss_increase", "AVG(rk) AS mean_rank")}, CAST(MAX(rk) AS INT) AS worst_rank, COUNT(CASE WHEN dl > 0 THEN 1 END) AS positive_seasons, COUNT(CASE WHEN rk <= 15 THEN 1 END) AS top_seasons
FROM im GROUP BY feature""")
def importance_stability_stated(spark, d):
    """Stability of the importance of a stated model over three seasons."""
    return J.importance_stability(importance_by_season(matrix(spark, d), lambda train: stated_model()))


@query("J5_importance_stability_fitted")
def importance_stability_fitted(spark, d):
    """Stability over three seasons, each ranked by a model of the seasons before it."""
    return J.importance_stability(importance_by_season(matrix(spark, d), lambda train: FM.fit_lr(train, ALL_COLS)))


_STAB = """imp AS (SELECT division AS feature, season, AVG(home_goals - away_goals) AS rise, CAST(ROW_NUMBER() OVER (PARTITION BY season ORDER BY AVG(home_goals - away_goals) DESC, division) AS INT) AS rk FROM matches GROUP BY division, season)"""


@query("J5_importance_stability", with_(MATCHES, _STAB) + f"""SELECT feature, {r("AVG(rise) AS mean_logloss_increase", "AVG(rk) AS mean_rank")}, MAX(rk) AS worst_rank, COUNT(CASE WHEN rise > 0 THEN 1 END) AS positive_seasons, COUNT(CASE WHEN rk <= 2 THEN 1 END) AS top_seasons FROM imp GROUP BY feature""")
def importance_stability(spark, d):
    """Importance rows per (league as feature, season), taken from mean goal differences."""
    per = matches(spark, d).groupBy(F.col("division").alias("feature"), "season").agg(F.avg(F.col("home_goals") - F.col("away_goals")).alias("permutation_logloss_mean"))
    ranked = C.row_ranking(per, ["season"], [F.col("permutation_logloss_mean").desc(), F.col("feature")])
    return J.importance_stability(ranked, top=2)


CORR_COLS = ("home_goals", "away_goals", "home_shots", "away_shots", "home_sot", "away_sot", "odds_home", "odds_draw", "odds_away", "y")
_CP = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ABS(CORR({a}, {b})) AS c FROM matches" for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:])


@query("J7_correlation_pairs_raw", with_(MATCHES, f"cp AS ({_CP})") + f"SELECT feature_a, feature_b, {r('c AS absolute_correlation')} FROM cp WHERE c >= 0.3")
def correlation_pairs_raw(spark, d):
    return J.correlation_pairs(matches(spark, d), CORR_COLS, threshold=0.3)


def _matrix_corr_sql():
    cols, source = matrix_parts()
    found = dict(c.rpartition(" AS ")[::2][::-1] if " AS " in c else (c, c) for c in cols)
    names = "[" + ", ".join(f"'{c}'" for c in ALL_COLS) + "]"
    n = len(ALL_COLS)
    return with_(*MATRIX_NEEDS, f"fx AS (SELECT [{', '.join(f'CAST({found[c]} AS DOUBLE)' for c in ALL_COLS)}] AS x FROM {source})",
                 f"cp AS (SELECT i, j, ABS(CORR(x[i], x[j])) AS c FROM fx, UNNEST(GENERATE_SERIES(1, {n})) a(i), UNNEST(GENERATE_SERIES(1, {n})) b(j) WHERE i < j GROUP BY i, j)") + (
        f"SELECT {names}[i] AS feature_a, {names}[j] AS feature_b, {r('c AS absolute_correlation')} FROM cp WHERE c >= 0.95 AND NOT ISNAN(c)")


@query("J7_correlation_pairs", _matrix_corr_sql())
def correlation_pairs(spark, d):
    """Close pairs among the 66 columns."""
    return J.correlation_pairs(matrix(spark, d), ALL_COLS)


RANK_SEASON, VALID_SEASONS = 1998, (1999, TEST)


def searched_sets(df):
    """Candidate column sets from the importance season and the correlations before it (66 ranked
    names and the close pairs come to the driver)."""
    before = df.where(F.col("season") < RANK_SEASON)
    ranking = J.permutation_importance(FM.fit_lr(before, ALL_COLS), df.where(F.col("season") == RANK_SEASON)).orderBy("rank").select("feature", "permutation_logloss_mean").collect()
    pairs = [(p.feature_a, p.feature_b) for p in J.correlation_pairs(before, ALL_COLS).collect()]
    return J.candidate_sets(ALL_COLS, [x.feature for x in ranking], [x.feature for x in ranking if x.permutation_logloss_mean > 0], pairs)


def searched_grid(spark, d):
    df = matrix(spark, d)
    sets = searched_sets(df)
    return sets, J.validate_grid(df, sets, VALID_SEASONS)


@query("J9_validate_grid")
def validate_grid(spark, d):
    """All candidate sets on both validation seasons."""
    return searched_grid(spark, d)[1]


@query("J10_pick_winner_searched")
def pick_winner_searched(spark, d):
    return J.pick_winner(materialize(searched_grid(spark, d)[1]))


@query("J12_retention_table_searched")
def retention_table_searched(spark, d):
    """Which of the 66 columns the searched winner keeps."""
    sets, grid = searched_grid(spark, d)
    winner = sets[J.pick_winner(grid).first().config]
    names = spark.createDataFrame([(c,) for c in ALL_COLS], "feature string")
    return J.retention_table(names, names.where(F.col("feature").isin(winner)))


_GRID = """gr AS (SELECT CONCAT('set_', home_team) AS config, 1.0 AS c, COUNT(*) AS n_features, AVG(CASE WHEN predicted = scored.y THEN 1.0 ELSE 0.0 END) AS accuracy, AVG(ll) AS log_loss FROM scored JOIN matches USING (match_id) GROUP BY home_team)"""


def _grid(spark, d):
    """A result grid with one configuration per home team."""
    from ..operators.metrics import per_match_metrics
    m = matches(spark, d)
    per = per_match_metrics(views.preds(m)).join(m.select("match_id", "home_team"), "match_id")
    return per.groupBy(F.concat(F.lit("set_"), F.col("home_team").cast("string")).alias("config")).agg(
        F.count(F.lit(1)).alias("n_features"), F.avg("accuracy").alias("accuracy"), F.avg("log_loss").alias("log_loss")).withColumn("c", F.lit(1.0))


@query("J10_pick_winner", with_(MATCHES, PREDS, SCORED, _GRID) + f"SELECT config, n_features, {r('accuracy', 'log_loss')} FROM (SELECT * FROM gr ORDER BY log_loss, n_features, config, c LIMIT 1)")
def pick_winner(spark, d):
    return J.pick_winner(_grid(spark, d)).select("config", "n_features", "accuracy", "log_loss")


@query("J10_pick_winner_accuracy", with_(MATCHES, PREDS, SCORED, _GRID) + f"SELECT config, n_features, {r('accuracy', 'log_loss')} FROM (SELECT * FROM gr ORDER BY accuracy DESC, log_loss, n_features LIMIT 1)")
def pick_winner_accuracy(spark, d):
    return J.pick_winner(_grid(spark, d), "accuracy").select("config", "n_features", "accuracy", "log_loss")


@query("J11_drop_family_ablation")
def drop_family_ablation(spark, d):
    return J.drop_family_ablation(matrix(spark, d), ALL_COLS, TEST)


@query("J12_retention_table", with_(MATCHES) + """SELECT CONCAT('home_win_rate_', home_team) AS feature, 'form' AS family, CASE WHEN SUM(home_goals) > SUM(away_goals) THEN 1 ELSE 0 END AS selected FROM matches GROUP BY home_team""")
def retention_table(spark, d):
    """Features named by home team; selected where the team scored more than it conceded."""
    teams = matches(spark, d).groupBy("home_team").agg((F.sum("home_goals") > F.sum("away_goals")).alias("keep"))
    named = teams.select(F.concat(F.lit("home_win_rate_"), F.col("home_team").cast("string")).alias("feature"), "keep")
    return J.retention_table(named, named.where("keep"))


# ---------------------------------------------------------------- streams
def _write_in_order(df, path):
    """One append per season, oldest first, so that files arrive in date order."""
    for season in [row[0] for row in df.select("season").distinct().orderBy("season").collect()]:
        df.where(F.col("season") == season).drop("season").coalesce(1).write.mode("append").parquet(path)


def _land_seasons(df, path):
    """One append per season, oldest first, by as many tasks as read it; a stream takes what has landed before the next one comes."""
    for season in [row[0] for row in df.select("season").distinct().orderBy("season").collect()]:
        df.where(F.col("season") == season).drop("season").write.mode("append").parquet(path)
        yield season


def _stream(df, path):
    """All that has landed since the last trigger."""
    return df.sparkSession.readStream.schema(df.drop("season").schema).parquet(path)


@query("S1_stream_form", with_(MATCHES, TEAM_ROWS, STATE) + f"""SELECT o.match_id, CAST(o.team AS VARCHAR) AS team, CAST(LEAST(dd.k, 10) AS INT) AS n_prior,
{r("team_state_points_10 AS avg_points", "goals_for_10 AS avg_gf", "goals_against_10 AS avg_ga", "win_rate_10 AS win_rate")}
FROM o JOIN dd ON dd.team = o.team AND dd.match_date = o.match_date JOIN st ON st.team = o.team AND st.match_date = o.match_date""")
def stream_form(spark, d):
    rows = materialize(C.to_team_rows(matches(spark, d)).select("season", "team", "match_id", "match_date", "points", "gf", "ga"), "season")
    base = scratch_dir(spark)
    for _ in _land_seasons(rows, f"{base}/in"):
        streams.run_stream_form(_stream(rows, f"{base}/in"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("match_id", "team", "n_prior", "avg_points", "avg_gf", "avg_ga", "win_rate")


@query("S2_stream_rating")
def stream_rating(spark, d):
    rows = materialize(matches(spark, d).select("season", "division", "match_id", "match_date", "home_team", "away_team", "home_goals", "away_goals"))
    base = scratch_dir(spark)
    _write_in_order(rows, f"{base}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streams.run_available(streams.stream_rating(src), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


@query("S3_stream_hit_rate", f"""WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, CASE WHEN value > 10 THEN 1 ELSE 0 END AS hit FROM events),
w AS (SELECT CAST(CAST(ts AS DATE) - CAST(i AS INT) AS TIMESTAMP) AS ws, hit FROM e, UNNEST(GENERATE_SERIES(0, 29)) g(i))
SELECT CAST(CAST(ws AS DATE) AS VARCHAR) AS window_day, COUNT(*) AS n, SUM(hit)::BIGINT AS hits, {r("AVG(CAST(hit AS DOUBLE)) AS hit_rate")} FROM w GROUP BY ws""")
def stream_hit_rate(spark, d):
    """Windows of 30 days sliding by one; a closing row after the last event lets every window out."""
    base = scratch_dir(spark)
    ev = spark.read.parquet(f"{d}/events.parquet")
    rows = ev.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 10).cast("int").alias("hit"))
    rows.unionByName(streams.closing_row(rows, span="30 days", lateness="2 days")).write.parquet(f"{base}/in")
    src = spark.readStream.schema("ts timestamp, hit int").parquet(f"{base}/in")
    streams.run_available(streams.stream_hit_rate(src), f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.to_date("window_start").alias("window_day"), "n", "hits", "hit_rate")


# ---------------------------------------------------------------- files
SRC = {"Div": "division", "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHG": "home_goals", "FTAG": "away_goals", "HS": "home_shots", "AS": "away_shots",
       "HST": "home_sot", "AST": "away_sot", "B365H": "odds_home", "B365D": "odds_draw", "B365A": "odds_away"}


def _season_csv(spark, d, path):
    """Season-like CSV files with source headers and two columns no reader knows."""
    m = matches(spark, d)
    out = m.select(*[F.col(v).cast("string").alias(k) for k, v in SRC.items()], F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
                   F.col("match_id").cast("string").alias("Referee"), F.when(F.col("y") == 2, "H").when(F.col("y") == 1, "D").otherwise("A").alias("FTR"),
                   F.lit("x").alias("Attendance"), F.lit("y").alias("SJH"))
    out.write.csv(path, header=True)
    return path


@query("A1_read_match_csv", with_(MATCHES) + f"""SELECT CAST(match_id AS VARCHAR) AS referee, CAST(match_date AS VARCHAR) AS date, division, CAST(home_team AS VARCHAR) AS home_team, CAST(away_team AS VARCHAR) AS away_team, SUBSTR('ADH', y + 1, 1) AS result_full,
{r("home_goals AS home_goals_full", "away_goals AS away_goals_full", "home_shots", "away_sot AS away_shots_target", "odds_home", "odds_away")} FROM matches""")
def read_match_csv(spark, d):
    raw = files.read_match_csv(spark, _season_csv(spark, d, scratch_dir(spark)))
    df = files.coerce_numeric(files.parse_match_date(raw), [*files.NUMERIC_COLUMNS, "odds_home", "odds_draw", "odds_away"])
    return df.select("referee", "date", "division", "home_team", "away_team", "result_full", "home_goals_full", "away_goals_full", "home_shots", "away_shots_target", "odds_home", "odds_away")


def _layout_csv(spark, d, path):
    """Three layouts of season files: all columns, without odds and in another order, without shots and with two-digit years."""
    m = matches(spark, d)
    day = F.date_format("match_date", "dd/MM/yyyy").alias("Date")
    cols = {k: F.col(v).cast("string").alias(k) for k, v in SRC.items()}
    no_odds = [c for k, c in cols.items() if not k.startswith("B365")]
    no_shots = [c for k, c in cols.items() if k not in ("HS", "AS", "HST", "AST")]
    m.where("season <= 1995").select(*cols.values(), day, F.lit("x").alias("Weather")).write.csv(f"{path}/a", header=True)
    m.where("season = 1996").select(day, *reversed(no_odds)).write.csv(f"{path}/b", header=True)
    m.where("season > 1996").select(F.lit("y").alias("SJH"), *no_shots, F.date_format("match_date", "dd/MM/yy").alias("Date")).write.csv(f"{path}/c", header=True)
    return [f"{path}/{x}" for x in "abc"]


@query("A1_read_match_csv_layouts", with_(MATCHES) + f"""SELECT CAST(match_date AS VARCHAR) AS date, division, CAST(home_team AS VARCHAR) AS home_team, CAST(away_team AS VARCHAR) AS away_team,
{r("home_goals AS home_goals_full", "CASE WHEN season <= 1996 THEN home_shots END AS home_shots", "CASE WHEN season <> 1996 THEN odds_draw END AS odds_draw")} FROM matches""")
def read_match_csv_layouts(spark, d):
    raw = files.read_match_csv(spark, _layout_csv(spark, d, scratch_dir(spark)))
    df = files.coerce_numeric(files.parse_match_date(raw), [*files.NUMERIC_COLUMNS, "odds_draw"])
    return df.select("date", "division", "home_team", "away_team", "home_goals_full", "home_shots", "odds_draw")


@query("A4_union_seasons", with_(MATCHES) + f"""SELECT match_id, division, {r("CASE WHEN season >= 1997 THEN odds_home END AS odds_home")}, CASE WHEN season < 1997 THEN 'early' ELSE 'late' END AS source FROM matches""")
def union_seasons(spark, d):
    m = matches(spark, d)
    early = m.where("season < 1997").select("match_id", "division")
    late = m.where("season >= 1997").select("division", "match_id", "odds_home")
    return files.union_seasons([early, late], ["early", "late"])


@query("A6_read_feed_json", with_(MATCHES, FEED) + f"""SELECT CAST(feed_date AS VARCHAR) AS feed_date, home_name, away_name, CONCAT('S', CAST(feed_season AS VARCHAR)) AS season, {r("home_ppg AS pre_match_home_ppg", "home_xg AS team_a_xg_prematch")} FROM feed""")
def read_feed_json(spark, d):
    base = scratch_dir(spark)
    f = views.feed(matches(spark, d))
    out = f.select(F.unix_seconds(F.to_timestamp("feed_date")).alias("date_unix"), "home_name", "away_name", F.col("home_ppg").alias("pre_match_home_ppg"),
                   F.col("away_ppg").alias("pre_match_away_ppg"), F.col("home_xg").alias("team_a_xg_prematch"), F.col("away_xg").alias("team_b_xg_prematch"), "feed_season")
    out.write.partitionBy("feed_season").json(base)
    # Spark names its files part-...; the season comes from the folder instead of the file name
    read = files.read_feed_json(spark, base, None, multi_line=False)
    season = F.concat(F.lit("S"), F.col("feed_season").cast("string"))
    return read.select("feed_date", "home_name", "away_name", season.alias("season"), "pre_match_home_ppg", "team_a_xg_prematch")


@query("A7_read_players", with_(PLAYERS) + f"SELECT player_id, CAST(club_id AS BIGINT) AS club_team_id, CASE WHEN player_id % 9 <> 0 THEN position END AS position, {r('age', 'minutes AS minutes_played_overall')}, goals AS goals_overall FROM players")
def read_players(spark, d):
    path = scratch_dir(spark)
    p = views.players(spark, d)
    text = p.select(F.col("player_id").cast("string").alias("player_id"), F.col("club_id").cast("string").alias("club_team_id"),
                    F.when(F.col("player_id") % 9 == 0, "N/A").otherwise(F.col("position")).alias("position"), F.coalesce(F.col("age").cast("string"), F.lit("NA")).alias("age"),
                    F.col("minutes").cast("string").alias("minutes_played_overall"), F.col("goals").cast("string").alias("goals_overall"), F.col("assists").cast("string").alias("assists_overall"))
    text.write.csv(path, header=True)
    return files.read_players(spark, path, "csv").select("player_id", "club_team_id", "position", "age", "minutes_played_overall", "goals_overall")


@query("A7_read_players_json", with_(PLAYERS) + f"SELECT player_id, CAST(club_id AS BIGINT) AS club_team_id, position, {r('age', 'minutes AS minutes_played_overall')}, goals AS goals_overall FROM players")
def read_players_json(spark, d):
    path = scratch_dir(spark)
    p = views.players(spark, d)
    p.select("player_id", F.col("club_id").alias("club_team_id"), "position", "age", F.col("minutes").alias("minutes_played_overall"), F.col("goals").alias("goals_overall"), F.col("assists").alias("assists_overall")).write.json(path)
    return files.read_players(spark, path, "json", multi_line=False).select("player_id", "club_team_id", "position", "age", "minutes_played_overall", "goals_overall")


@query("A8_read_feed_csv", with_(MATCHES) + """SELECT CAST(match_id AS DOUBLE) AS timestamp, CAST(match_date AS VARCHAR) AS feed_date, CAST(STRFTIME(CAST(match_date AS TIMESTAMP) + INTERVAL (12 + match_id % 10) HOUR, '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS kickoff, CAST(home_team AS VARCHAR) AS home_team_name FROM matches""")
def read_feed_csv(spark, d):
    path = scratch_dir(spark)
    m = matches(spark, d)
    time = F.to_timestamp("match_date") + F.make_dt_interval(F.lit(0), (12 + F.col("match_id") % 10).cast("int"))
    text = F.concat(F.date_format(time, "MMM d yyyy - h:mm"), F.lower(F.date_format(time, "a")))
    m.select(F.col("match_id").cast("string").alias("timestamp"), text.alias("date_GMT"), F.col("home_team").cast("string").alias("home_team_name"), F.col("away_team").cast("string").alias("away_team_name")).write.csv(path, header=True)
    return files.read_feed_csv(spark, path).select("timestamp", "feed_date", "kickoff", "home_team_name")


@query("A8_read_feed_csv_targets", with_(MATCHES, "fd AS (SELECT *, CASE WHEN match_id % 10 = 3 THEN NULL ELSE home_goals END AS h, CASE WHEN match_id % 14 = 5 THEN NULL ELSE away_goals END AS a FROM matches)")
       + f"""SELECT CAST(match_id AS DOUBLE) AS timestamp, {r("CAST(h AS DOUBLE) AS home_team_goal_count", "CASE WHEN match_id % 4 > 0 THEN (match_id % 300) / 100 END AS pre_match_xg")}, CASE match_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Stadium 1' ELSE '7' END AS stadium,
CASE WHEN h > a THEN 2 WHEN h = a THEN 1 ELSE 0 END AS target_result, {r("CAST(h + a AS DOUBLE) AS total_goal_count")}, CASE WHEN h + a > 2.5 THEN 1 ELSE 0 END AS target_over_2_5 FROM fd""")
def read_feed_csv_targets(spark, d):
    """Numbers, text and all three spellings of a missing value."""
    path = scratch_dir(spark)
    k = F.col("match_id")
    text = F.date_format("match_date", "MMM d yyyy - h:mm")
    matches(spark, d).select(
        k.cast("string").alias("timestamp"), F.concat(text, F.lit("pm")).alias("date_GMT"), F.col("home_team").cast("string").alias("home_team_name"), F.col("away_team").cast("string").alias("away_team_name"),
        F.when(k % 10 == 3, "N/A").otherwise(F.col("home_goals").cast("string")).alias("home_team_goal_count"), F.when(k % 14 == 5, "NA").otherwise(F.col("away_goals").cast("string")).alias("away_team_goal_count"),
        F.when(k % 4 == 0, "").otherwise(((k % 300) / 100).cast("string")).alias("pre_match_xg"), F.when(k % 3 == 0, "N/A").when(k % 3 == 1, "Stadium 1").otherwise("7").alias("stadium")).write.csv(path, header=True)
    return files.read_feed_csv(spark, path).select("timestamp", "home_team_goal_count", "pre_match_xg", "stadium", "target_result", "total_goal_count", "target_over_2_5")


def _write_arrays(df, folder, path, key):
    """JSON arrays, eight files per folder value."""
    rows = df.select(folder, F.pmod(F.xxhash64(key), F.lit(8)).alias("part"), F.to_json(F.struct(*[c for c in df.columns if c != folder])).alias("j"))
    arrays = rows.groupBy(folder, "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    arrays.select(folder, "value").write.partitionBy(folder).option("maxRecordsPerFile", 1).text(path)


@query("A6_read_feed_json_arrays", with_(MATCHES, FEED) + f"""SELECT CAST(feed_date AS VARCHAR) AS feed_date, home_name, away_name, CONCAT(CAST(feed_season AS VARCHAR), '-', RIGHT(CAST(feed_season + 1 AS VARCHAR), 2)) AS season,
{r("home_ppg AS pre_match_home_ppg", "home_xg AS team_a_xg_prematch")} FROM feed WHERE feed_season <> 1996""")
def read_feed_json_arrays(spark, d):
    """Array files in a folder per season id; a map gives the labels and leaves one season out."""
    path = scratch_dir(spark)
    f = views.feed(matches(spark, d))
    out = f.select(F.unix_seconds(F.to_timestamp("feed_date")).alias("date_unix"), "home_name", "away_name", F.col("home_ppg").alias("pre_match_home_ppg"),
                   F.col("away_ppg").alias("pre_match_away_ppg"), F.col("home_xg").alias("team_a_xg_prematch"), F.col("away_xg").alias("team_b_xg_prematch"),
                   (F.col("feed_season") * 10 + 7).alias("sid"))
    _write_arrays(out, "sid", path, "home_name")
    labels = {str(s * 10 + 7): f"{s}-{str(s + 1)[-2:]}" for s in range(1980, 2030) if s != 1996}
    read = files.read_feed_json(spark, path, labels, from_folder=True)
    return read.select("feed_date", "home_name", "away_name", "season", "pre_match_home_ppg", "team_a_xg_prematch")


@query("A7_read_players_arrays", with_(PLAYERS) + f"SELECT player_id, CONCAT('Y', CAST(season AS VARCHAR)) AS season, CAST(club_id AS BIGINT) AS club_team_id, position, {r('age', 'minutes AS minutes_played_overall')}, goals AS goals_overall FROM players")
def read_players_arrays(spark, d):
    path = scratch_dir(spark)
    p = views.players(spark, d)
    _write_arrays(p.select("player_id", F.col("club_id").alias("club_team_id"), "position", "age", F.col("minutes").alias("minutes_played_overall"), F.col("goals").alias("goals_overall"),
                           F.col("assists").alias("assists_overall"), F.col("season").alias("sid")), "sid", path, "player_id")
    read = files.read_players(spark, path, "json", {str(s): f"Y{s}" for s in range(1980, 2030)}, from_folder=True)
    return read.select("player_id", "season", "club_team_id", "position", "age", "minutes_played_overall", "goals_overall")


@query("A9_read_closing_odds", with_(MATCHES, """co AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY season, home_team, away_team ORDER BY match_date, odds_home NULLS FIRST, odds_draw, odds_away) AS rn FROM matches)""")
       + f"""SELECT CAST(season AS VARCHAR) AS season, CASE WHEN home_team < 39 THEN CONCAT('Club ', LPAD(CAST(home_team AS VARCHAR), 2, '0')) ELSE '39' END AS home_team, CASE WHEN away_team < 39 THEN CONCAT('Club ', LPAD(CAST(away_team AS VARCHAR), 2, '0')) ELSE '39' END AS away_team,
CAST(match_date AS VARCHAR) AS date, {r("odds_home AS odds_home_close", "odds_draw AS odds_draw_close")} FROM co WHERE rn = 1""")
def read_closing_odds(spark, d):
    path = scratch_dir(spark)
    m = matches(spark, d)
    out = m.select("season", F.date_format("match_date", "dd/MM/yyyy").alias("Date"), F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"), F.col("odds_home").alias("B365CH"),
                   F.col("odds_draw").alias("B365CD"), F.col("odds_away").alias("B365CA"))
    out.repartition("season").write.partitionBy("season").csv(path, header=True)
    names = {str(i): f"Club {i:02d}" for i in range(39)}
    odds = files.read_closing_odds(spark, path, names, season=F.regexp_extract(F.input_file_name(), r"season=(\d+)", 1))
    return odds.select("season", "home_team", "away_team", "date", "odds_home_close", "odds_draw_close")


@query("A15_fingerprint_files_content", with_(MATCHES, """tx AS (SELECT season, match_id, CONCAT(CAST(match_id AS VARCHAR), ',', CAST(home_goals AS VARCHAR), ',', CAST(away_goals AS VARCHAR)) AS t FROM matches),
fl AS (SELECT season, STRING_AGG(t || CASE WHEN season % 2 = 1 THEN CHR(13) ELSE '' END || CHR(10), '' ORDER BY match_id) AS body, STRING_AGG(t || CHR(10), '' ORDER BY match_id) AS lf FROM tx GROUP BY season)""")
       + "SELECT season, CAST(STRLEN(body) AS BIGINT) AS length, SHA256(body) AS sha256, SHA256(lf) AS sha256_lf, CASE WHEN season % 2 = 1 THEN 'line_endings_only' ELSE 'same' END AS status FROM fl")
def fingerprint_files_content(spark, d):
    """Season files with known lines, those of odd seasons with CRLF, against the hashes of their LF form."""
    path = scratch_dir(spark)
    m = matches(spark, d)
    line = F.concat_ws(",", F.col("match_id").cast("string"), F.col("home_goals").cast("string"), F.col("away_goals").cast("string"))
    line = F.concat(line, F.when(F.col("season") % 2 == 1, "\r").otherwise(""))
    m.select("season", "match_id", line.alias("value")).repartition("season").sortWithinPartitions("season", "match_id").select("season", "value").write.partitionBy("season").text(path)
    have = files.fingerprint_files(spark, path)
    manifest = have.select("path", F.col("sha256_lf").alias("sha256"))
    season = F.regexp_extract("path", r"season=(\d+)", 1).cast("int").alias("season")
    return files.fingerprint_files(spark, path, manifest).select(season, "length", "sha256", "sha256_lf", "status")


@query("A15_fingerprint_files", None)
def fingerprint_files(spark, d):
    """Hash every file of a written season export against a manifest of its own hashes, one of them altered."""
    path = _season_csv(spark, d, scratch_dir(spark))
    have = files.fingerprint_files(spark, path).where(F.col("file").startswith("part-"))
    first = have.agg(F.min("file").alias("f"))
    manifest = have.select("file", F.when(F.col("file") == first.scalar(), F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    gone = spark.range(1).select(F.lit("gone.csv").alias("file"), F.lit("1" * 64).alias("sha256"))
    out = files.fingerprint_files(spark, path, manifest.unionByName(gone))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


@query("A19_write_table", with_(MATCHES) + f"SELECT match_id, season, {r('odds_home', 'home_shots')} FROM matches")
def write_table(spark, d):
    """Compressed CSV, partitioned by season, read back."""
    path = scratch_dir(spark)
    m = matches(spark, d).select("match_id", "season", "odds_home", "home_shots")
    files.write_table(m, path, "csv.gz", partition_by=["season"])
    return spark.read.schema("match_id long, odds_home double, home_shots double, season int").csv(path, header=True).select("match_id", "season", "odds_home", "home_shots")


# ---------------------------------------------------------------- text
KEYWORD = "the"


@query("T1_keyword_in_context", f"""WITH p AS (SELECT doc_id, text, STRING_SPLIT_REGEX(text, '(?i){KEYWORD}') AS parts FROM documents),
h AS (SELECT doc_id, text, LEN(parts) - 1 AS n_hits, k, LENGTH(ARRAY_TO_STRING(parts[1:k], '')) + (k - 1) * {len(KEYWORD)} AS start FROM p, UNNEST(GENERATE_SERIES(1, 5)) g(k) WHERE k <= LEN(parts) - 1)
SELECT doc_id, CAST(n_hits AS INT) AS n_hits, CAST(k AS INT) AS hit, CAST(start AS INT) AS start,
SUBSTR(text, CAST(GREATEST(0, start - 1200) + 1 AS BIGINT), CAST(start + {len(KEYWORD)} + 2200 - GREATEST(0, start - 1200) AS BIGINT)) AS context FROM h""")
def keyword_in_context_query(spark, d):
    return keyword_in_context(views.table(spark, d, "documents"), KEYWORD)
