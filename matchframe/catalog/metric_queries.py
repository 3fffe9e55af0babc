"""Metrics, error analysis, value selection and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import predicted_class
from ..operators import errors as K
from ..operators import metrics as H
from ..operators import uncertainty as I
from ..operators import value as L
from ..operators.joins import paired_models
from ..plans import views
from .base import JOINED, MATCHES, PLAYERS, PREDS, SCORED, joined, matches, query, r, with_

S = with_(MATCHES, PREDS, SCORED)
J = with_(MATCHES, PREDS, JOINED)


def preds(spark, d):
    return predicted_class(views.preds(matches(spark, d)))


@query("H1_confusion", S + "SELECT model, y, " + ", ".join(f"COUNT(CASE WHEN predicted = {k} THEN 1 END) AS pred_{k}" for k in range(3)) + " FROM scored GROUP BY model, y")
def confusion(spark, d):
    return H.confusion(preds(spark, d), ["model"])


@query("H1_confusion_shares", S + "SELECT model, y, " + r(*[f"AVG(CASE WHEN predicted = {k} THEN 1.0 ELSE 0.0 END) AS pred_{k}" for k in range(3)]) + " FROM scored GROUP BY model, y")
def confusion_shares(spark, d):
    return H.confusion(preds(spark, d), ["model"], normalise=True)


def class_counts(by: str, src: str = "scored", y: str = "y") -> str:
    cols = ", ".join(f"COUNT(CASE WHEN {y} = {k} AND predicted = {k} THEN 1 END) AS tp{k}, COUNT(CASE WHEN {y} = {k} THEN 1 END) AS t{k}, COUNT(CASE WHEN predicted = {k} THEN 1 END) AS p{k}" for k in range(3))
    return f"cc AS (SELECT {by}, COUNT(*) AS n_matches, COUNT(CASE WHEN {y} = predicted THEN 1 END) AS correct, {cols} FROM {src} GROUP BY {by})"


def prec(k):
    return f"COALESCE(1.0 * tp{k} / NULLIF(p{k}, 0), 0)"


def rec(k):
    return f"COALESCE(1.0 * tp{k} / NULLIF(t{k}, 0), 0)"


def f1(k):
    return f"COALESCE(2.0 * tp{k} / NULLIF(t{k} + p{k}, 0), 0)"


_METRICS = ["1.0 * correct / n_matches AS accuracy"]
for _name, _f in (("precision", prec), ("recall", rec), ("f1", f1)):
    _METRICS.append(f"({_f(0)} + {_f(1)} + {_f(2)}) / 3 AS macro_{_name}")
    _METRICS.append(f"({_f(0)} * t0 + {_f(1)} * t1 + {_f(2)} * t2) / n_matches AS weighted_{_name}")
    _METRICS += [f"{_f(k)} AS {_name}_{k}" for k in range(3)]


@query("H2_classification_metrics", with_(MATCHES, PREDS, SCORED, class_counts("model, season")) + f"SELECT model, season, n_matches, correct, t0 AS support_0, t1 AS support_1, t2 AS support_2, {r(*_METRICS)} FROM cc")
def classification_metrics(spark, d):
    return H.classification_metrics(preds(spark, d), ["model", "season"])


@query("H3_log_loss", S + f"SELECT model, division, {r('AVG(ll) AS log_loss')} FROM scored GROUP BY model, division")
def log_loss(spark, d):
    return H.log_loss(preds(spark, d), ["model", "division"])


@query("H4_brier", S + f"""SELECT model, {r("AVG(br) AS brier", *[f"AVG(POWER(CASE WHEN y = {k} THEN 1.0 ELSE 0.0 END - {p}, 2)) AS brier_{k}" for k, p in enumerate(("p_away", "p_draw", "p_home"))])} FROM scored GROUP BY model""")
def brier(spark, d):
    return H.brier(preds(spark, d), ["model"])


LONG = "lg AS (" + " UNION ALL ".join(f"SELECT match_id, model, season, y, {k} AS cls, {p} AS p, CASE WHEN y = {k} THEN 1 ELSE 0 END AS hit FROM preds" for k, p in enumerate(("p_away", "p_draw", "p_home"))) + ")"


@query("H5_roc_auc", with_(MATCHES, PREDS, LONG, """rk AS (SELECT model, cls, hit, RANK() OVER (PARTITION BY model, cls ORDER BY p) + (COUNT(*) OVER (PARTITION BY model, cls, p) - 1) / 2.0 AS rnk FROM lg),
au AS (SELECT model, cls, (SUM(CASE WHEN hit = 1 THEN rnk ELSE 0 END) - SUM(hit) * (SUM(hit) + 1) / 2.0) / (1.0 * SUM(hit) * SUM(1 - hit)) AS auc FROM rk GROUP BY model, cls)""")
       + f"SELECT model, {r(*[f'MAX(CASE WHEN cls = {k} THEN auc END) AS auc_{k}' for k in range(3)], 'AVG(auc) AS auc_macro')} FROM au GROUP BY model")
def roc_auc(spark, d):
    return H.roc_auc(preds(spark, d), ["model"])


_BIN = r("AVG(p) AS mean_predicted", "AVG(CAST(hit AS DOUBLE)) AS observed", "AVG(p) - AVG(CAST(hit AS DOUBLE)) AS gap")


@query("H6_calibration_bins", with_(MATCHES, PREDS, LONG) + f"SELECT model, cls, CAST(FLOOR(p * 10) AS BIGINT) AS bin, COUNT(*) AS n, {_BIN} FROM lg WHERE p < 1 GROUP BY 1, 2, 3 HAVING COUNT(*) >= 10")
def calibration_bins(spark, d):
    return H.calibration_bins(preds(spark, d), by=["model"])


@query("H6_calibration_edge_low", with_(MATCHES, PREDS, LONG) + f"SELECT model, cls, CAST(GREATEST(CEIL(p * 5) - 1, 0) AS BIGINT) AS bin, COUNT(*) AS n, {_BIN} FROM lg GROUP BY 1, 2, 3")
def calibration_edge_low(spark, d):
    return H.calibration_bins(preds(spark, d), 5, "edge_low", by=["model"])


@query("H8_per_match_metrics", S + f"SELECT match_id, model, season, division, y AS actual, predicted, {r('CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END AS accuracy', 'll AS log_loss', 'br AS brier')} FROM scored")
def per_match_metrics(spark, d):
    return H.per_match_metrics(views.preds(matches(spark, d))).select("match_id", "model", "season", "division", "actual", "predicted", "accuracy", "log_loss", "brier")


SCOPES = (("overall", "'ALL'", "model"), ("season", "CAST(season AS VARCHAR)", "model, season"), ("league", "division", "model, division"),
          ("actual_outcome", "CAST(y AS VARCHAR)", "model, y"), ("season_league", "CONCAT(season, '/', division)", "model, season, division"))
_COUNTS = ", ".join(f"COUNT(CASE WHEN y = {k} AND predicted = {k} THEN 1 END) AS tp{k}, COUNT(CASE WHEN y = {k} THEN 1 END) AS t{k}, COUNT(CASE WHEN predicted = {k} THEN 1 END) AS p{k}" for k in range(3))
SUMMARY = "sm AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS scope, {g} AS grp, model, COUNT(*) AS n_matches, COUNT(CASE WHEN y = predicted THEN 1 END) AS correct, AVG(CASE WHEN y = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, AVG(ll) AS log_loss, AVG(br) AS brier, {_COUNTS} FROM scored GROUP BY {by}"
    for s, g, by in SCOPES) + ")"


@query("H9_summarize_scopes", with_(MATCHES, PREDS, SCORED, SUMMARY) + f"SELECT scope, grp AS \"group\", model, n_matches, correct, {r('accuracy', 'log_loss', 'brier', f'({f1(0)} + {f1(1)} + {f1(2)}) / 3 AS macro_f1', f'{f1(1)} AS draw_f1')} FROM sm")
def summarize_scopes(spark, d):
    out = H.summarize_scopes(H.per_match_metrics(views.preds(matches(spark, d))))
    return out.select("scope", "group", "model", "n_matches", "correct", "accuracy", "log_loss", "brier", "macro_f1", "draw_f1")


def _of(model, column):
    return f"MAX(CASE WHEN model = '{model}' THEN {column} END)"


@query("H10_contrast", with_(MATCHES, PREDS, SCORED, SUMMARY) + f"""SELECT scope, grp AS "group", {_of('m1', 'n_matches')} AS n_matches, {_of('m2', 'correct')} - {_of('m1', 'correct')} AS extra_correct, {r(f"{_of('m1', 'accuracy')} AS base_accuracy", f"{_of('m2', 'accuracy')} AS selected_accuracy", f"{_of('m2', 'log_loss')} - {_of('m1', 'log_loss')} AS log_loss_delta", f"{_of('m2', 'accuracy')} - {_of('m1', 'accuracy')} AS accuracy_delta")}
FROM sm GROUP BY scope, grp""")
def contrast(spark, d):
    return H.contrast(H.summarize_scopes(H.per_match_metrics(views.preds(matches(spark, d)))), "m1", "m2")


@query("H10_contrast_counts", with_(MATCHES, PREDS, SCORED, SUMMARY) + """SELECT a.scope, COUNT(*) AS n_groups, COUNT(CASE WHEN b.correct > a.correct THEN 1 END) AS accuracy_up, COUNT(CASE WHEN b.log_loss < a.log_loss THEN 1 END) AS log_loss_down
FROM sm a JOIN sm b ON a.scope = b.scope AND a.grp = b.grp AND a.model = 'm1' AND b.model = 'm2' GROUP BY a.scope""")
def contrast_counts(spark, d):
    return H.contrast_counts(H.contrast(H.summarize_scopes(H.per_match_metrics(views.preds(matches(spark, d)))), "m1", "m2"))


@query("H11_model_table", with_(MATCHES, PREDS, SCORED, class_counts("model, season")) + f"""SELECT model, season, {r("acc AS accuracy", "mf AS macro_f1")}, CAST(ROW_NUMBER() OVER (PARTITION BY season ORDER BY acc DESC, mf DESC, model) AS INT) AS position
FROM (SELECT model, season, 1.0 * correct / n_matches AS acc, ({f1(0)} + {f1(1)} + {f1(2)}) / 3 AS mf FROM cc)""")
def model_table(spark, d):
    t = H.classification_metrics(preds(spark, d), ["model", "season"], per_class=False)
    return H.model_table(t, ["season"]).select("model", "season", "accuracy", "macro_f1", "position")


@query("H12_probability_histogram", with_(MATCHES, PREDS, LONG) + "SELECT model, y, cls, CAST(LEAST(FLOOR(p * 10), 9) AS BIGINT) AS bin, COUNT(*) AS n FROM lg GROUP BY 1, 2, 3, 4")
def probability_histogram(spark, d):
    return H.probability_histogram(preds(spark, d), by=["model"])


@query("H13_class_balance", with_(MATCHES) + f"""SELECT season, y, n, {r("1.0 * n / SUM(n) OVER (PARTITION BY season) AS share", "1.0 * MAX(n) OVER (PARTITION BY season) / SUM(n) OVER (PARTITION BY season) AS naive_accuracy")}
FROM (SELECT season, y, COUNT(*) AS n FROM matches GROUP BY season, y)""")
def class_balance(spark, d):
    return H.class_balance(matches(spark, d), by=["season"])


_PCA = [f"AVG(CASE WHEN y = {k} THEN CASE WHEN {c} = {k} THEN 1.0 ELSE 0.0 END END) AS {s}_{n}" for s, c in (("model", "predicted"), ("market", "market_pick")) for k, n in ((2, "home"), (1, "draw"), (0, "away"))]


@query("H14_per_class_accuracy", J + f"SELECT season, {r(*_PCA)} FROM joined GROUP BY season")
def per_class_accuracy(spark, d):
    return H.per_class_accuracy(joined(spark, d), ["season"], columns={"model": "predicted", "market": "market_pick"})


@query("H15_fit_complexity", with_(MATCHES) + f"""SELECT model, COUNT(*) AS n_fits, {r("AVG(fit) AS fit_seconds", "AVG(pr) AS predict_seconds", "AVG(sz) AS model_bytes")}, MAX(nf) AS n_features, MAX(np) AS n_parameters
FROM (SELECT division AS model, AVG(home_goals) AS fit, AVG(away_goals) AS pr, MAX(home_team) AS nf, MAX(away_team) AS np, SUM(home_goals) AS sz FROM matches GROUP BY division, season) GROUP BY model""")
def fit_complexity(spark, d):
    """A fit log with one line per (league, season), its figures taken from the matches."""
    log = matches(spark, d).groupBy(F.col("division").alias("model"), "season").agg(
        F.avg("home_goals").alias("fit_seconds"), F.avg("away_goals").alias("predict_seconds"), F.max("home_team").alias("n_features"),
        F.max("away_team").alias("n_parameters"), F.sum("home_goals").alias("model_bytes"))
    return H.fit_complexity(log)


@query("H16_recompute_audit", with_(MATCHES, PREDS, SCORED, SUMMARY) + """SELECT COUNT(*) AS n_rows, COUNT(CASE WHEN scope = 'league' THEN 1 END) AS n_unmatched, ROUND(0.25, 6) AS max_diff_accuracy,
0.0 AS max_diff_log_loss, 0.0 AS max_diff_brier, 0.0 AS max_diff_macro_f1, 0.0 AS max_diff_draw_f1 FROM sm""")
def recompute_audit(spark, d):
    """Stored summaries lacking the league scope, with one accuracy off by a quarter."""
    per = H.per_match_metrics(views.preds(matches(spark, d)))
    stored = H.summarize_scopes(per).where("scope <> 'league'")
    off = (F.col("scope") == "overall") & (F.col("model") == "m1")
    return H.recompute_audit(per, stored.withColumn("accuracy", F.col("accuracy") + F.when(off, 0.25).otherwise(0.0)))


def _pos(p):
    return f"COUNT(CASE WHEN position = '{p}' THEN 1 END)"


_N = "COUNT(*)"


@query("H17_squad_profile", with_(PLAYERS) + f"""SELECT season, club_id, COUNT(*) AS n_players, {_pos('Goalkeeper')} AS n_gk, {_pos('Defender')} AS n_def, {_pos('Midfielder')} AS n_mid, {_pos('Forward')} AS n_fwd,
COUNT(CASE WHEN minutes >= 900 THEN 1 END) AS n_regulars, {r(*[x for s, p in (("def", "Defender"), ("mid", "Midfielder"), ("fwd", "Forward")) for x in (f"1.0 * {_pos(p)} / {_N} AS {s}_ratio", f"10.0 * {_pos(p)} / {_N} AS {s}_per_10players")], "COALESCE(AVG(age), 0) AS avg_age", f"1.0 * COUNT(CASE WHEN minutes >= 900 THEN 1 END) / {_N} AS regular_ratio", "COALESCE(SUM(minutes * minutes) / NULLIF(SUM(minutes) * SUM(minutes), 0), 0) AS min_concentration", "AVG(minutes) AS avg_minutes")}
FROM players GROUP BY season, club_id""")
def squad_profile(spark, d):
    return H.squad_profile(views.players(spark, d))


def _goals(p):
    return f"COALESCE(SUM(CASE WHEN position = '{p}' THEN goals END), 0)"


@query("H18_squad_production", with_(PLAYERS) + f"""SELECT season, club_id, COUNT(*) AS n_players, COUNT(CASE WHEN minutes >= 900 THEN 1 END) AS n_regulars, SUM(goals)::BIGINT AS total_goals, SUM(assists)::BIGINT AS total_assists,
SUM(goals + assists)::BIGINT AS total_goal_involvement, {_goals('Forward')}::BIGINT AS forward_goals, {_goals('Midfielder')}::BIGINT AS midfielder_goals, {_goals('Defender')}::BIGINT AS defender_goals, MAX(goals) AS top_scorer_goals,
{r("1.0 * COUNT(CASE WHEN minutes >= 900 THEN 1 END) / COUNT(*) AS regular_ratio", "COALESCE(AVG(age), 0) AS avg_age", "SUM(minutes) AS total_minutes", "COALESCE(1.0 * SUM(goals * goals) / NULLIF(SUM(goals) * SUM(goals), 0), 1.0 / COUNT(*)) AS goal_concentration", "COALESCE(SUM(minutes * minutes) / NULLIF(SUM(minutes) * SUM(minutes), 0), 1.0 / COUNT(*)) AS min_concentration", f"COALESCE(1.0 * {_goals('Forward')} / NULLIF(SUM(goals), 0), 0) AS forward_goal_share", f"COALESCE(1.0 * {_goals('Midfielder')} / NULLIF(SUM(goals), 0), 0) AS midfielder_goal_share", "COALESCE(1.0 * MAX(goals) / NULLIF(SUM(goals), 0), 0) AS top_scorer_share", "COALESCE(SUM(goals * minutes) / NULLIF(SUM(minutes), 0), 0) AS team_goals", "COALESCE(AVG(age), 0) AS rank_age")}
FROM players GROUP BY season, club_id""")
def squad_production(spark, d):
    p = views.players(spark, d).withColumn("rank_age", F.col("age"))
    return H.squad_production(p, weighted=["goals"], ranks=["rank_age"]).withColumnRenamed("avg_rank_age", "rank_age")


# ---------------------------------------------------------------- errors
_SIDES = ("COUNT(*) AS n_matches", "AVG(CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END) AS model_acc", "AVG(CASE WHEN market_pick = y THEN 1.0 ELSE 0.0 END) AS market_acc",
          "AVG(b_model) AS model_brier", "AVG(b_market) AS market_brier")
_BR = "(POWER(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END - {0}_away, 2) + POWER(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END - {0}_draw, 2) + POWER(CASE WHEN y = 2 THEN 1.0 ELSE 0.0 END - {0}_home, 2)) / 3"
SIDED = f"sided AS (SELECT *, {_BR.format('p')} AS b_model, {_BR.format('q')} AS b_market FROM joined)"
JS = with_(MATCHES, PREDS, JOINED, SIDED)


def _bracket_sql(value, edges, extra=()):
    b = " + ".join(f"CASE WHEN {value} >= {e} THEN 1 ELSE 0 END" for e in edges)
    return JS + f"""SELECT {b} AS bracket, {_SIDES[0]}, {r(*_SIDES[1:], f"AVG({value}) AS mean_value", "AVG(CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END) - AVG(CASE WHEN market_pick = y THEN 1.0 ELSE 0.0 END) AS delta_acc", *extra)}
FROM sided GROUP BY 1 HAVING COUNT(*) >= 5"""


@query("K1_by_market_bracket", _bracket_sql("q_home", K.MARKET_EDGES))
def by_market_bracket(spark, d):
    return K.by_market_bracket(joined(spark, d))


_TOP = "GREATEST(p_away, p_draw, p_home)"


@query("K2_by_confidence", _bracket_sql(_TOP, K.CONFIDENCE_EDGES, (f"AVG({_TOP}) - AVG(CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END) AS overconfidence",)))
def by_confidence(spark, d):
    return K.by_confidence(joined(spark, d))


@query("K3_by_strength_gap", _bracket_sql("COALESCE(odds_away - odds_home, 0)", K.GAP_EDGES))
def by_strength_gap(spark, d):
    return K.by_strength_gap(joined(spark, d).withColumn("gap", F.col("odds_away") - F.col("odds_home")), "gap")


_LL = "-LN(CASE y WHEN 0 THEN {0}_away WHEN 1 THEN {0}_draw ELSE {0}_home END)"


@query("K4_by_season", JS + f"SELECT season, {_SIDES[0]}, {r(*_SIDES[1:], f'AVG({_LL.format(chr(112))}) AS model_log_loss', f'AVG({_LL.format(chr(113))}) AS market_log_loss')} FROM sided GROUP BY season")
def by_season(spark, d):
    return K.by_season(joined(spark, d))


_CAL = " UNION ALL ".join(f"SELECT '{s}' AS source, {k} AS cls, {c}_{n} AS p, CASE WHEN y = {k} THEN 1 ELSE 0 END AS hit FROM joined" for s, c in (("model", "p"), ("market", "q")) for k, n in ((0, "away"), (1, "draw"), (2, "home")))


@query("K5_calibration_table", with_(MATCHES, PREDS, JOINED, f"lg AS ({_CAL})") + f"SELECT source, cls, CAST(FLOOR(p * 10) AS BIGINT) AS bin, COUNT(*) AS n, {_BIN} FROM lg WHERE p < 1 GROUP BY 1, 2, 3 HAVING COUNT(*) >= 10")
def calibration_table(spark, d):
    return K.calibration_table(joined(spark, d))


_RIGHT = "CASE WHEN predicted = y AND market_pick = y THEN 'both' WHEN predicted = y THEN 'model' WHEN market_pick = y THEN 'market' ELSE 'none' END"


@query("K6_disagreement", J + f"""SELECT y AS outcome, CASE WHEN predicted = market_pick THEN 1 ELSE 0 END AS agree, {_RIGHT} AS "right", COUNT(*) AS n FROM joined GROUP BY 1, 2, 3
UNION ALL SELECT NULL, CASE WHEN predicted = market_pick THEN 1 ELSE 0 END, {_RIGHT}, COUNT(*) FROM joined GROUP BY 2, 3""")
def disagreement(spark, d):
    return K.disagreement(joined(spark, d))


@query("K7_confusion_patterns", J + "SELECT y, COUNT(*) AS n, COUNT(CASE WHEN predicted = y THEN 1 END) AS model_correct, COUNT(CASE WHEN market_pick = y THEN 1 END) AS market_correct, "
       + ", ".join(f"COUNT(CASE WHEN {c} = {k} THEN 1 END) AS {s}_pred_{n}" for s, c in (("model", "predicted"), ("market", "market_pick")) for k, n in ((0, "away"), (1, "draw"), (2, "home"))) + " FROM joined GROUP BY y")
def confusion_patterns(spark, d):
    return K.confusion_patterns(joined(spark, d))


@query("K8_error_log", J + f"""SELECT error_type, CAST(rn AS INT) AS position, match_id, y, predicted, market_pick, {r(f"{_TOP} AS model_confidence", "GREATEST(q_away, q_draw, q_home) AS market_confidence")}
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY error_type ORDER BY match_date, match_id) AS rn FROM (SELECT *, CASE WHEN predicted <> y AND market_pick <> y THEN 'both_wrong' WHEN predicted <> y THEN 'only_model_wrong' WHEN market_pick <> y THEN 'only_market_wrong' END AS error_type FROM joined))
WHERE error_type IS NOT NULL AND rn <= 30""")
def error_log(spark, d):
    return K.error_log(joined(spark, d))


@query("K9_best_worst", with_(MATCHES, PREDS, JOINED, SIDED, "br AS (" + "SELECT " + " + ".join(f"CASE WHEN q_home >= {e} THEN 1 ELSE 0 END" for e in K.MARKET_EDGES)
       + " AS bracket, AVG(CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END) - AVG(CASE WHEN market_pick = y THEN 1.0 ELSE 0.0 END) AS dl FROM sided GROUP BY 1 HAVING COUNT(*) >= 5)")
       + f"""SELECT (SELECT bracket FROM br ORDER BY dl DESC, bracket LIMIT 1) AS best_bracket, {r("(SELECT MAX(dl) FROM br) AS best_delta")}, (SELECT bracket FROM br ORDER BY dl, bracket LIMIT 1) AS worst_bracket, {r("(SELECT MIN(dl) FROM br) AS worst_delta")}""")
def best_worst(spark, d):
    return K.best_worst(K.by_market_bracket(joined(spark, d)))


# ---------------------------------------------------------------- value
_INV = "(1 / odds_away + 1 / odds_draw + 1 / odds_home)"
BETS = "bets AS (" + " UNION ALL ".join(
    f"SELECT match_id, season, division, {k} AS outcome, p_{n} AS model_p, (1 / odds_{n}) / {_INV} AS market_p, odds_{n} AS odds, p_{n} / ((1 / odds_{n}) / {_INV}) - 1 AS edge, CASE WHEN y = {k} THEN 1 ELSE 0 END AS hit FROM joined WHERE odds_home > 0 AND odds_draw > 0 AND odds_away > 0"
    for k, n in ((0, "away"), (1, "draw"), (2, "home"))) + ")"
B = (MATCHES, PREDS, JOINED, BETS)
_BETCOLS = "match_id, season, division, outcome, hit, " + r("model_p", "market_p", "odds", "edge")
BEST = "best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY edge DESC, outcome) AS rn FROM bets WHERE edge > {t}) WHERE rn = 1)"


def ledger_sql(stake="1.0"):
    return ("COUNT(*) AS bets, COALESCE(SUM(hit), 0)::BIGINT AS wins, " + r("100.0 * SUM(hit) / COUNT(*) AS win_rate", f"SUM(CASE WHEN hit = 1 THEN odds - 1 ELSE -1.0 END) * {stake} AS profit",
            "100.0 * SUM(CASE WHEN hit = 1 THEN odds - 1 ELSE -1.0 END) / COUNT(*) AS roi"))


def bets(spark, d):
    return L.explode_outcomes(joined(spark, d))


@query("L1_explode_outcomes", with_(*B) + f"SELECT {_BETCOLS} FROM bets")
def explode_outcomes(spark, d):
    return bets(spark, d)


for _n, _f, _w in (("all", L.select_all, "TRUE"), ("home", L.select_home, "outcome = 2"), ("draw", L.select_draw, "outcome = 1"), ("away", L.select_away, "outcome = 0")):
    query(f"L2_select_{_n}", with_(*B) + f"SELECT {_BETCOLS} FROM bets WHERE edge > 0.10 AND {_w}")(lambda spark, d, _f=_f: _f(bets(spark, d)))


@query("L3_select_best", with_(*B, BEST.format(t="0.10")) + f"SELECT {_BETCOLS} FROM best")
def select_best(spark, d):
    return L.select_best(bets(spark, d))


@query("L4_settle", with_(*B, BEST.format(t="0.10")) + f"SELECT season, {ledger_sql('100.0')} FROM best GROUP BY season")
def settle(spark, d):
    return L.settle(L.select_best(bets(spark, d)), 100.0, ["season"])


@query("L5_by_season_league", with_(*B, BEST.format(t="0.10")) + f"SELECT season, division, {ledger_sql()} FROM best GROUP BY GROUPING SETS ((season), (division), ())")
def by_season_league(spark, d):
    return L.by_season_league(L.select_best(bets(spark, d)))


@query("L6_threshold_sweep", with_(*B, BEST.format(t="0.0")) + f"SELECT t.threshold::DOUBLE AS threshold, {ledger_sql()} FROM best JOIN (VALUES (0.0), (0.05), (0.10), (0.20), (0.30), (0.50), (0.75), (1.0)) t(threshold) ON best.edge >= t.threshold GROUP BY 1")
def threshold_sweep(spark, d):
    return L.threshold_sweep(bets(spark, d))


DISC = """disc AS (SELECT {by}COUNT(*) AS n, AVG(CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END) AS model_acc, AVG(CASE WHEN market_pick = y THEN 1.0 ELSE 0.0 END) AS market_acc,
COUNT(CASE WHEN predicted = y AND market_pick <> y THEN 1 END) AS b, COUNT(CASE WHEN predicted <> y AND market_pick = y THEN 1 END) AS c FROM joined {group})"""
PV = "CASE WHEN b + c = 0 THEN 1.0 ELSE LEAST(1.0, 2 * (SELECT SUM(EXP(LGAMMA(b + c + 1) - LGAMMA(i + 1) - LGAMMA(b + c - i + 1) + (b + c) * LN(0.5))) FROM UNNEST(GENERATE_SERIES(GREATEST(b, c), b + c)) g(i))) END"


@query("L7_model_vs_market", with_(MATCHES, PREDS, JOINED, DISC.format(by="season, ", group="GROUP BY season"), f"pv AS (SELECT *, {PV} AS p FROM disc)")
       + f"SELECT season, n, b, c, {r('model_acc', 'market_acc', 'p AS p_value', 'model_acc - market_acc AS delta')}, CASE WHEN p >= 0.05 THEN 'tie' WHEN model_acc > market_acc THEN 'model' ELSE 'market' END AS verdict FROM pv")
def model_vs_market(spark, d):
    return L.model_vs_market(joined(spark, d), ["season"])


@query("L7_model_vs_market_pooled", with_(MATCHES, PREDS, JOINED, DISC.format(by="", group=""), f"pv AS (SELECT *, {PV} AS p FROM disc)")
       + f"SELECT n, b, c, {r('model_acc', 'market_acc', 'p AS p_value', 'model_acc - market_acc AS delta')}, CASE WHEN p >= 0.05 THEN 'tie' WHEN model_acc > market_acc THEN 'model' ELSE 'market' END AS verdict FROM pv")
def model_vs_market_pooled(spark, d):
    return L.model_vs_market(joined(spark, d))


# ---------------------------------------------------------------- uncertainty
DELTAS = """deltas AS (SELECT a.match_id, a.season, a.match_date, CASE WHEN b.predicted = b.y THEN 1.0 ELSE 0.0 END - CASE WHEN a.predicted = a.y THEN 1.0 ELSE 0.0 END AS d_accuracy, b.ll - a.ll AS d_log_loss, a.br AS br_a, b.br AS br_b
FROM scored a JOIN scored b ON a.match_id = b.match_id AND a.model = 'm1' AND b.model = 'm2')"""


def _h(*parts):
    return f"('0x' || SUBSTR(MD5(CONCAT_WS('|', {', '.join(parts)})), 1, 8))::BIGINT"


def boot_sql(cluster, stratum, reps, seed):
    part = f"PARTITION BY {stratum} " if stratum else ""
    st = f"{stratum}, " if stratum else ""
    hs = [f"'{seed}'", "CAST(rep AS VARCHAR)", *([f"CAST({stratum} AS VARCHAR)"] if stratum else []), "CAST(slot AS VARCHAR)"]
    on = f"AND d.{stratum} = p.{stratum}" if stratum else ""
    return with_(MATCHES, PREDS, SCORED, DELTAS,
                 f"per AS (SELECT {st}{cluster} AS cl, COUNT(*) AS n, SUM(d_accuracy) AS s1, SUM(d_log_loss) AS s2 FROM deltas GROUP BY {st}{cluster})",
                 f"sl AS (SELECT *, ROW_NUMBER() OVER ({part}ORDER BY {_h('CAST(cl AS VARCHAR)')}, cl) AS slot, COUNT(*) OVER ({part}) AS size FROM per)",
                 f"dr AS (SELECT {st}rep, {_h(*hs)} % size + 1 AS pick FROM sl, UNNEST(GENERATE_SERIES(0, {reps - 1})) g(rep))",
                 f"rp AS (SELECT rep, SUM(p.s1) / SUM(p.n) AS m1, SUM(p.s2) / SUM(p.n) AS m2 FROM dr d JOIN sl p ON p.slot = d.pick {on} GROUP BY rep)") + f"""
SELECT 'd_accuracy' AS metric, {r("(SELECT AVG(d_accuracy) FROM deltas) AS delta", "QUANTILE_CONT(m1, 0.025) AS ci95_low", "QUANTILE_CONT(m1, 0.975) AS ci95_high")}, {reps} AS repeats FROM rp
UNION ALL SELECT 'd_log_loss', {r("(SELECT AVG(d_log_loss) FROM deltas) AS delta", "QUANTILE_CONT(m2, 0.025) AS ci95_low", "QUANTILE_CONT(m2, 0.975) AS ci95_high")}, {reps} FROM rp"""


def deltas(spark, d):
    per = H.per_match_metrics(views.preds(matches(spark, d)))
    return paired_models(per, "m1", "m2", ["match_id", "match_date", "season"], ["accuracy", "log_loss"])


@query("I1_cluster_bootstrap", boot_sql("match_date", None, 2000, 123))
def cluster_bootstrap(spark, d):
    return I.cluster_bootstrap(deltas(spark, d))


@query("I2_stratified_bootstrap", boot_sql("match_date", "season", 4000, 123))
def stratified_bootstrap(spark, d):
    return I.stratified_bootstrap(deltas(spark, d))


@query("I3_season_bootstrap", boot_sql("season", None, 4000, 123))
def season_bootstrap(spark, d):
    return I.season_bootstrap(deltas(spark, d))


_U = " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in I._POISSON1)


def _iid_sql(reps, buckets):
    rows = "bg AS (SELECT match_id AS id, br_b - br_a AS dd, 1 AS n FROM deltas)"
    if buckets:
        rows = f"bg AS (SELECT ('0x' || SUBSTR(MD5(CONCAT_WS('|', 'bag', CAST(match_id AS VARCHAR))), 1, 8))::BIGINT % {buckets} AS id, SUM(br_b - br_a) AS dd, COUNT(*) AS n FROM deltas GROUP BY 1)"
    return (with_(MATCHES, PREDS, SCORED, DELTAS, rows,
                  f"hx AS (SELECT dd, n, g, MD5(CONCAT_WS('|', '42', CAST(g AS VARCHAR), CAST(id AS VARCHAR))) AS h FROM bg, UNNEST(GENERATE_SERIES(0, {reps // 4 - 1})) q(g))",
                  "ln AS (SELECT dd, n, g * 4 + i AS rep, ('0x' || SUBSTR(h, CAST(8 * i + 1 AS INT), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM hx, UNNEST(GENERATE_SERIES(0, 3)) w(i))",
                  f"dr AS (SELECT rep, SUM(({_U}) * dd) / SUM(({_U}) * n) AS m FROM ln GROUP BY rep)", "od AS (SELECT m, ROW_NUMBER() OVER (ORDER BY m) AS k FROM dr)")
            + f"SELECT {r('AVG(m) AS mean_diff', f'MAX(CASE WHEN k = {int(.025 * reps) + 1} THEN m END) AS ci_lower', f'MAX(CASE WHEN k = {int(.975 * reps) + 1} THEN m END) AS ci_upper', '100.0 * AVG(CASE WHEN m < 0 THEN 1.0 ELSE 0.0 END) AS pct_below_zero')} FROM od")


@query("I4_iid_bootstrap_brier", _iid_sql(5000, I.BUCKETS))
def iid_bootstrap_brier(spark, d):
    per = H.per_match_metrics(views.preds(matches(spark, d)))
    diff = paired_models(per, "m1", "m2", ["match_id"], ["brier"]).select("match_id", F.col("d_brier").alias("diff"))
    return I.iid_bootstrap_brier(diff)


def _dm_sql():
    from .scalar_queries import normal_cdf_sql
    return with_(MATCHES, PREDS, SCORED, DELTAS, "lg AS (SELECT br_b - br_a AS dd, LAG(br_b - br_a) OVER (ORDER BY match_date, match_id) AS pv FROM deltas)",
                 "s AS (SELECT COUNT(*) AS n, AVG(dd) AS mean_diff, VAR_SAMP(dd) AS g0, COVAR_SAMP(pv, dd) AS g1 FROM lg)",
                 "t AS (SELECT n, mean_diff, CASE WHEN g0 + 2 * g1 > 0 THEN mean_diff / SQRT((g0 + 2 * g1) / n) ELSE 0 END AS dm FROM s)") + f"SELECT n, {r('mean_diff', 'dm AS dm_stat', 'CASE WHEN dm = 0 THEN 1.0 ELSE 2 * (1 - ' + normal_cdf_sql('ABS(dm)') + ') END AS p_value')} FROM t"


@query("I5_diebold_mariano", _dm_sql())
def diebold_mariano(spark, d):
    p = predicted_class(views.preds(matches(spark, d)))
    per = p.groupBy("match_id", "match_date").agg(*[F.max(F.when(F.col("model") == m, H.row_brier())).alias(c) for m, c in (("m2", "loss_a"), ("m1", "loss_b"))])
    return I.diebold_mariano(per, rows_per_block=2500)


@query("I6_mcnemar_exact", with_(MATCHES, PREDS, JOINED, DISC.format(by="division, ", group="GROUP BY division")) + f"SELECT division, b, c, {r(PV + ' AS p_value')} FROM disc")
def mcnemar_exact(spark, d):
    j = joined(spark, d).select("division", (F.col("predicted") == F.col("y")).cast("int").alias("hit_a"), (F.col("market_pick") == F.col("y")).cast("int").alias("hit_b"))
    return I.mcnemar_exact(j, by=["division"])


_BT = "(SELECT SUM(EXP(LGAMMA(n + 1) - LGAMMA(i + 1) - LGAMMA(n - i + 1) + i * LN(1.0 / 3) + (n - i) * LN(2.0 / 3))) FROM UNNEST(GENERATE_SERIES(wins, n)) g(i))"


@query("I7_binomial_test", with_(MATCHES, PREDS, JOINED, "wl AS (SELECT season, COUNT(CASE WHEN predicted = y THEN 1 END) AS wins, COUNT(*) AS n FROM joined GROUP BY season)") + f"SELECT season, wins, n, {r(f'CASE WHEN wins = 0 THEN 1.0 ELSE LEAST(1.0, {_BT}) END AS p_value')} FROM wl")
def binomial_test(spark, d):
    t = joined(spark, d).groupBy("season").agg(F.count_if(F.col("predicted") == F.col("y")).alias("wins"), F.count(F.lit(1)).alias("n"))
    return I.binomial_test(t)


@query("I8_positive_share", with_(*B, BEST.format(t="0.10"), "rs AS (SELECT season, SUM(CASE WHEN hit = 1 THEN odds - 1 ELSE -1.0 END) AS p FROM best GROUP BY season)") + f"SELECT COUNT(*) AS n_seasons, {r('AVG(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS positive_share')} FROM rs")
def positive_share(spark, d):
    return I.positive_share(L.settle(L.select_best(bets(spark, d)), by=["season"]))
