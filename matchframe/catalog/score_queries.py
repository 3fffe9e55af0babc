"""Closed-form goal models, score grids, simple classifiers and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as C
from ..operators import models as FM
from ..operators import scores as G
from ..operators.metrics import goal_metrics
from ..plans import views
from ..plans.session import materialize
from .base import MATCHES, PREDS, TEAM_ROWS, matches, query, r, with_
from .history_queries import SEASON_RATINGS

S = 0.05
PARAMS = f"""base AS (SELECT LN(GREATEST(AVG(away_goals), {S})) AS mu, LN(GREATEST(AVG(home_goals), {S})) - LN(GREATEST(AVG(away_goals), {S})) AS mu_home FROM matches WHERE season < 2000),
prm AS (SELECT team, COUNT(*) AS n, LN(GREATEST((SUM(gf) + {S}) / (COUNT(*) + {S}), {S})) - (SELECT mu FROM base) AS attack, LN(GREATEST((SUM(ga) + {S}) / (COUNT(*) + {S}), {S})) - (SELECT mu FROM base) AS defence
FROM team_rows WHERE season < 2000 GROUP BY team)"""
RATES = PARAMS + """,
rates AS (SELECT m.match_id, m.season, m.y, m.home_goals, m.away_goals, EXP(b.mu + b.mu_home + COALESCE(h.attack, 0) + COALESCE(a.defence, 0)) AS lambda_home, EXP(b.mu + COALESCE(a.attack, 0) + COALESCE(h.defence, 0)) AS lambda_away
FROM matches m CROSS JOIN base b LEFT JOIN prm h ON h.team = m.home_team LEFT JOIN prm a ON a.team = m.away_team)"""
BASE = (MATCHES, TEAM_ROWS, RATES)


def rates(spark, d):
    m = matches(spark, d)
    # fitted parameters are a small table: write them once instead of fitting them in every branch of the plan
    params = materialize(FM.fit_attack_defence(m.where("season < 2000")))
    return FM.expected_goals(m, params).select("match_id", "season", "y", "home_goals", "away_goals", "lambda_home", "lambda_away")


@query("F14_fit_attack_defence", with_(MATCHES, TEAM_ROWS, PARAMS) + f"SELECT team, n, {r('attack', 'defence', '(SELECT mu FROM base) AS mu', '(SELECT mu_home FROM base) AS mu_home')} FROM prm")
def fit_attack_defence(spark, d):
    return FM.fit_attack_defence(matches(spark, d).where("season < 2000"))


@query("F15_expected_goals", with_(*BASE) + f"SELECT match_id, {r('lambda_home', 'lambda_away')} FROM rates")
def expected_goals(spark, d):
    return rates(spark, d).select("match_id", "lambda_home", "lambda_away")


@query("F16_ratio_poisson", with_(MATCHES, TEAM_ROWS, SEASON_RATINGS, """lastr AS (SELECT team, attack, defence FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY season DESC) AS rn FROM sr WHERE season < 2000) WHERE rn = 1),
lg AS (SELECT AVG(home_goals) AS h, AVG(away_goals) AS a FROM matches WHERE season < 2000)""") + f"""
SELECT m.match_id, {r("lg.h * COALESCE(x.attack, 1) * COALESCE(z.defence, 1) AS lambda_home", "lg.a * COALESCE(z.attack, 1) * COALESCE(x.defence, 1) AS lambda_away")}
FROM matches m CROSS JOIN lg LEFT JOIN lastr x ON x.team = m.home_team LEFT JOIN lastr z ON z.team = m.away_team""")
def ratio_poisson(spark, d):
    m = matches(spark, d)
    train = m.where("season < 2000")
    return FM.ratio_poisson(m, C.last_season_ratings(C.season_ratings(train)), train).select("match_id", "lambda_home", "lambda_away")


def grid_sql(top: str = "10", renorm: bool = True) -> str:
    raw = f"""raw AS (SELECT q.*, h.k AS hg, a.k AS ag, EXP(h.k * LN(lambda_home) - lambda_home - LGAMMA(h.k + 1)) * EXP(a.k * LN(lambda_away) - lambda_away - LGAMMA(a.k + 1)) AS p0
FROM rates q, UNNEST(GENERATE_SERIES(0, {top})) h(k), UNNEST(GENERATE_SERIES(0, {top})) a(k))"""
    return raw + ",\ngrid AS (SELECT *, " + ("p0 / SUM(p0) OVER (PARTITION BY match_id)" if renorm else "p0") + " AS p FROM raw)"


def outcome_cols(p="p", prefix="s_"):
    return [f"SUM(CASE WHEN hg < ag THEN {p} ELSE 0 END) AS {prefix}away", f"SUM(CASE WHEN hg = ag THEN {p} ELSE 0 END) AS {prefix}draw", f"SUM(CASE WHEN hg > ag THEN {p} ELSE 0 END) AS {prefix}home"]


@query("G1_score_grid_fixed", with_(*BASE, grid_sql()) + f"SELECT CAST(hg AS INT) AS hg, CAST(ag AS INT) AS ag, COUNT(*) AS n, {r('SUM(p) AS sum_p', 'MIN(p) AS min_p', 'MAX(p) AS max_p', 'SUM(p * match_id) / 1e6 AS keyed')} FROM grid GROUP BY hg, ag")
def score_grid_fixed(spark, d):
    """All cells of all grids, summed per score; `keyed` ties the cells to their matches."""
    cells = G.explode_grid(G.score_grid_fixed(rates(spark, d)))
    return cells.groupBy("hg", "ag").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"),
                                         (F.sum(F.col("p") * F.col("match_id")) / 1e6).alias("keyed"))


ADAPTIVE = """pk AS (SELECT match_id, k, EXP(k * LN(lambda_home) - lambda_home - LGAMMA(k + 1)) AS ph, EXP(k * LN(lambda_away) - lambda_away - LGAMMA(k + 1)) AS pa
FROM rates, UNNEST(GENERATE_SERIES(0, 90)) g(k)),
tl AS (SELECT match_id, k, SUM(ph) OVER w AS th, SUM(pa) OVER w AS ta FROM pk WINDOW w AS (PARTITION BY match_id ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sup AS (SELECT match_id, MIN(k) AS n FROM tl WHERE k BETWEEN 10 AND 80 AND th <= 1e-12 / 4 AND ta <= 1e-12 / 4 GROUP BY match_id)"""


@query("G2_score_grid_adaptive", with_(*BASE, ADAPTIVE) + f"""SELECT match_id, CAST(n AS INT) AS grid_max, (n + 1) * (n + 1) AS n_cells, {r("1.0 AS total", "(1 - t.th) * (1 - t.ta) AS kept")}
FROM sup JOIN tl t USING (match_id) WHERE t.k = n""")
def score_grid_adaptive(spark, d):
    g = G.score_grid_adaptive(rates(spark, d))
    total = F.aggregate("grid", F.lit(0.0), lambda acc, p: acc + p)
    return g.select("match_id", "grid_max", F.size("grid").cast("bigint").alias("n_cells"), total.alias("total"), (1.0 - F.col("omitted_mass")).alias("kept"))


@query("G3_grid_to_outcome", with_(*BASE, grid_sql()) + f"SELECT match_id, {r(*outcome_cols())} FROM grid GROUP BY match_id")
def grid_to_outcome(spark, d):
    return G.grid_to_outcome(G.score_grid_fixed(rates(spark, d))).select("match_id", "s_away", "s_draw", "s_home")


DC = """dc0 AS (SELECT *, GREATEST(p * CASE WHEN hg = 0 AND ag = 0 THEN 1 + 0.2 * lambda_home * lambda_away WHEN hg = 1 AND ag = 1 THEN 1.2 WHEN hg = 0 AND ag = 1 THEN 1 - 0.2 * lambda_home WHEN hg = 1 AND ag = 0 THEN 1 - 0.2 * lambda_away ELSE 1 END, 0) AS pd FROM grid),
dc AS (SELECT *, pd / SUM(pd) OVER (PARTITION BY match_id) AS p2 FROM dc0)"""


@query("G4_dixon_coles", with_(*BASE, grid_sql("8"), DC) + f"SELECT match_id, {r(*outcome_cols('p2'), 'SUM(CASE WHEN hg = 0 AND ag = 0 THEN p2 ELSE 0 END) AS p00')} FROM dc GROUP BY match_id")
def dixon_coles(spark, d):
    g = G.grid_to_outcome(G.dixon_coles(G.score_grid_fixed(rates(spark, d), 8)))
    return g.select("match_id", "s_away", "s_draw", "s_home", F.element_at("grid", 1).alias("p00"))


M1 = "q AS (SELECT match_id, p_away, p_draw, p_home FROM preds WHERE model = 'm1')"
REWEIGHT = f"""mass AS (SELECT match_id, {', '.join(outcome_cols())} FROM grid GROUP BY match_id),
rw AS (SELECT g.*, m.s_away, m.s_draw, m.s_home, q.p_away, q.p_draw, q.p_home,
  g.p / CASE WHEN hg < ag THEN s_away WHEN hg = ag THEN s_draw ELSE s_home END * CASE WHEN hg < ag THEN p_away WHEN hg = ag THEN p_draw ELSE p_home END AS pw
FROM grid g JOIN mass m USING (match_id) JOIN q USING (match_id))"""
RW = with_(MATCHES, PREDS, TEAM_ROWS, RATES, grid_sql(), M1, REWEIGHT)


def reweighted(spark, d):
    q = views.preds(matches(spark, d)).where("model = 'm1'").select("match_id", "p_away", "p_draw", "p_home")
    # joined before the grids are made: rates are narrow, grids are not shuffled
    g = G.grid_to_outcome(G.score_grid_fixed(rates(spark, d).join(q, "match_id")))
    return G.reweight_grid(g, out="fused")


@query("G5_reweight_grid", RW + f"SELECT match_id, {r(*outcome_cols('pw', 'w_'), 'SUM(pw * hg) AS exp_home', 'SUM(pw * ag) AS exp_away', 'MAX(pw) AS top_p')} FROM rw GROUP BY match_id")
def reweight_grid(spark, d):
    g = reweighted(spark, d)
    out = G.score_stats(G.grid_to_outcome(g, "w_", grid="fused"), target=("p_away", "p_draw", "p_home"), grid="fused")
    return out.select("match_id", "w_away", "w_draw", "w_home", F.col("expected_home_goals").alias("exp_home"), F.col("expected_away_goals").alias("exp_away"),
                      F.array_max("fused").alias("top_p"))


def stats_cte(src: str, p: str) -> str:
    return f"""md AS (SELECT match_id, hg AS mh, ag AS ma FROM {src} QUALIFY ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY {p} DESC, hg, ag) = 1),
sa AS (SELECT match_id, MIN(y) AS y, MIN(home_goals) AS h, MIN(away_goals) AS a, SUM({p} * hg) AS eh, SUM({p} * ag) AS ea, SUM(CASE WHEN hg = home_goals AND ag = away_goals THEN {p} ELSE 0 END) AS tp FROM {src} GROUP BY match_id),
ss AS (SELECT * FROM sa JOIN md USING (match_id))"""


STAT_COLS = ("CAST(mh AS INT) AS mode_home_goals, CAST(ma AS INT) AS mode_away_goals, CASE WHEN mh = h AND ma = a THEN 1 ELSE 0 END AS exact_score_hit, "
             "CASE WHEN ABS(eh - h) <= 1 THEN 1 ELSE 0 END AS home_within_1, CASE WHEN ABS(eh + ea - h - a) <= 1 THEN 1 ELSE 0 END AS total_within_1, "
             + r("eh AS expected_home_goals", "ea AS expected_away_goals", "tp AS true_score_probability", "-LN(tp) AS true_score_nll", "ABS(eh - h) AS home_abs_error", "ABS(eh + ea - h - a) AS total_abs_error"))
_STATS = ("match_id", "mode_home_goals", "mode_away_goals", "exact_score_hit", "home_within_1", "total_within_1", "expected_home_goals", "expected_away_goals",
          "true_score_probability", "true_score_nll", "home_abs_error", "total_abs_error")


@query("G6_score_stats", with_(*BASE, grid_sql(), stats_cte("grid", "p")) + f"SELECT match_id, {STAT_COLS} FROM ss")
def score_stats(spark, d):
    return G.score_stats(G.score_grid_fixed(rates(spark, d))).select(*_STATS)


OUTSIDE = """CASE WHEN home_goals > 2 OR away_goals > 2 THEN home_goals * LN(lambda_home) - lambda_home - LGAMMA(home_goals + 1) + away_goals * LN(lambda_away) - lambda_away - LGAMMA(away_goals + 1)
- LN((SELECT SUM(EXP(k * LN(lambda_home) - lambda_home - LGAMMA(k + 1))) FROM UNNEST(GENERATE_SERIES(0, 2)) g(k))) - LN((SELECT SUM(EXP(k * LN(lambda_away) - lambda_away - LGAMMA(k + 1))) FROM UNNEST(GENERATE_SERIES(0, 2)) g(k)))
ELSE (SELECT LN(SUM(p)) FROM grid g WHERE g.match_id = rates.match_id AND g.hg = rates.home_goals AND g.ag = rates.away_goals) END"""


@query("G6_score_stats_outside", with_(*BASE, grid_sql("2")) + f"SELECT match_id, CASE WHEN home_goals > 2 OR away_goals > 2 THEN 1 ELSE 0 END AS actual_outside_grid, {r('-(' + OUTSIDE + ') AS true_score_nll')} FROM rates")
def score_stats_outside(spark, d):
    """A 0..2 grid, so that many true scores lie outside it."""
    return G.score_stats(G.score_grid_fixed(rates(spark, d), 2)).select("match_id", "actual_outside_grid", "true_score_nll")


@query("G6_score_stats_fused", with_(MATCHES, PREDS, TEAM_ROWS, RATES, grid_sql(), M1, REWEIGHT, stats_cte("rw", "pw")) + f"SELECT match_id, {STAT_COLS} FROM ss")
def score_stats_fused(spark, d):
    return G.score_stats(reweighted(spark, d), target=("p_away", "p_draw", "p_home"), grid="fused").select(*_STATS)


def _both_nll(spark, d):
    base = G.score_stats(reweighted(spark, d)).withColumnRenamed("true_score_nll", "base_nll").select("match_id", "y", "home_goals", "away_goals", "lambda_home", "lambda_away", "grid_max", "fused",
                                                                                                    "s_away", "s_draw", "s_home", "p_away", "p_draw", "p_home", "base_nll")
    return G.score_stats(base, target=("p_away", "p_draw", "p_home"), grid="fused")


@query("G7_nll_identity_check", with_(MATCHES) + "SELECT match_id FROM matches WHERE FALSE")
def nll_identity_check(spark, d):
    return G.nll_identity_check(_both_nll(spark, d), "true_score_nll", "base_nll").select("match_id")


@query("G7_nll_identity_check_planted", with_(MATCHES) + f"""SELECT match_id, {r("CASE WHEN match_id % 17 <> 0 THEN CASE WHEN match_id % 26 = 0 THEN -1e-4 ELSE 1e-4 END END AS identity_gap")}
FROM matches WHERE match_id % 13 = 0 OR match_id % 17 = 0""")
def nll_identity_check_planted(spark, d):
    """Gaps on both sides, missing values, and gaps below the tolerance."""
    k = F.col("match_id")
    moved = F.when(k % 17 == 0, None).when(k % 26 == 0, F.col("true_score_nll") - 1e-4).when(k % 13 == 0, F.col("true_score_nll") + 1e-4).when(
        k % 19 == 0, F.col("true_score_nll") + 1e-10).otherwise(F.col("true_score_nll"))
    both = _both_nll(spark, d).withColumn("true_score_nll", moved)
    return G.nll_identity_check(both, "true_score_nll", "base_nll").select("match_id", "identity_gap")


@query("G8_over_under_prob", with_(*BASE, grid_sql()) + f"SELECT match_id, {r('LEAST(1.0, SUM(CASE WHEN hg + ag > 2.5 THEN p ELSE 0 END)) AS p_over')} FROM grid GROUP BY match_id")
def over_under_prob(spark, d):
    return G.over_under_prob(G.score_grid_fixed(rates(spark, d))).select("match_id", "p_over")


@query("G9_grid_validate", with_(MATCHES) + "SELECT match_id, CASE WHEN match_id % 7 = 0 THEN 'negative_or_not_finite' WHEN match_id % 11 = 0 THEN 'not_normalised' ELSE 'not_square' END AS problem FROM matches WHERE match_id % 7 = 0 OR match_id % 11 = 0 OR match_id % 13 = 0")
def grid_validate(spark, d):
    """Grids damaged in three ways by match number."""
    g = G.score_grid_fixed(rates(spark, d))
    k = F.col("match_id")
    factor = F.when(k % 7 == 0, -1.0).when(k % 11 == 0, 1.5).otherwise(1.0)
    damaged = F.transform("grid", lambda p: p * factor)
    short = (k % 13 == 0) & (k % 7 != 0) & (k % 11 != 0)
    return G.grid_validate(g.withColumn("grid", F.when(short, F.slice(damaged, 1, 120)).otherwise(damaged)))


@query("G10_poisson_outcome_tail", with_(*BASE, grid_sql("8", renorm=False)) + f"SELECT match_id, {r('1 - SUM(CASE WHEN hg >= ag THEN p ELSE 0 END) AS p_away', 'SUM(CASE WHEN hg = ag THEN p ELSE 0 END) AS p_draw', 'SUM(CASE WHEN hg > ag THEN p ELSE 0 END) AS p_home')} FROM grid GROUP BY match_id")
def poisson_outcome_tail(spark, d):
    return G.poisson_outcome_tail(rates(spark, d)).select("match_id", "p_away", "p_draw", "p_home")


@query("H7_goal_metrics", with_(*BASE, grid_sql(), stats_cte("grid", "p")) + f"""SELECT y, COUNT(*) AS n, {r("AVG(ABS(eh - h)) AS home_goal_mae", "AVG(ABS(ea - a)) AS away_goal_mae", *[f"AVG(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS {n}" for c, n in (("mh = h", "home_exact"), ("ma = a", "away_exact"), ("mh = h AND ma = a", "score_exact"), ("ABS(mh - h) <= 1", "home_within_1"), ("ABS(ma - a) <= 1", "away_within_1"), ("ABS(mh + ma - h - a) <= 1", "total_within_1"))])} FROM ss GROUP BY y""")
def goal_metrics_query(spark, d):
    return goal_metrics(G.score_stats(G.score_grid_fixed(rates(spark, d))), ["y"])


# ---------------------------------------------------------------- classifiers without iteration
NB_COLS = ("home_shots", "away_shots", "odds_home", "odds_draw", "odds_away")
_FILL = ", ".join(f"COALESCE({c}, (SELECT AVG({c}) FROM matches WHERE season < 2000)) AS {c}" for c in NB_COLS)
_VAR = ", ".join(f"(SELECT VAR_POP({c}) FROM tr)" for c in NB_COLS)
NB = (f"""tr AS (SELECT y, {_FILL} FROM matches WHERE season < 2000), vs AS (SELECT 1e-9 * GREATEST({_VAR}) AS v),
pc AS (SELECT y, COUNT(*) * 1.0 / (SELECT COUNT(*) FROM tr) AS prior, {', '.join(f'AVG({c}) AS m_{c}, VAR_POP({c}) + (SELECT v FROM vs) AS v_{c}' for c in NB_COLS)} FROM tr GROUP BY y),
te AS (SELECT match_id, {_FILL} FROM matches WHERE season >= 2000),
sc AS (SELECT te.match_id, pc.y, LN(prior) {''.join(f" - 0.5 * LN(2 * PI() * v_{c}) - POWER({c} - m_{c}, 2) / (2 * v_{c})" for c in NB_COLS)} AS l FROM te, pc),
ex AS (SELECT match_id, y, EXP(l - MAX(l) OVER (PARTITION BY match_id)) AS e FROM sc)""")


@query("F7_fit_naive_bayes", with_(MATCHES, NB) + f"SELECT match_id, {r(*[f'SUM(CASE WHEN y = {k} THEN e ELSE 0 END) / SUM(e) AS p_{n}' for k, n in ((0, 'away'), (1, 'draw'), (2, 'home'))])} FROM ex GROUP BY match_id")
def fit_naive_bayes(spark, d):
    m = matches(spark, d)
    return FM.fit_naive_bayes(m.where("season < 2000"), m.where("season >= 2000"), NB_COLS)


@query("F4_class_weights", with_(MATCHES) + f"SELECT y, COUNT(*) AS n_class, {r('(SELECT COUNT(*) FROM matches) / (3.0 * COUNT(*)) AS class_weight')} FROM matches GROUP BY y")
def class_weights(spark, d):
    return FM.class_weights(matches(spark, d))


_TOPY = "(SELECT y FROM matches WHERE season < 2000 GROUP BY y ORDER BY COUNT(*) DESC, y LIMIT 1)"


@query("F9_fit_majority", with_(MATCHES) + f"SELECT match_id, {r(*[f'CASE WHEN {_TOPY} = {k} THEN 1.0 ELSE 0.0 END AS p_{n}' for k, n in ((0, 'away'), (1, 'draw'), (2, 'home'))])}, {_TOPY} AS predicted FROM matches WHERE season >= 2000")
def fit_majority(spark, d):
    m = matches(spark, d)
    return FM.fit_majority(m.where("season < 2000"), m.where("season >= 2000"))


TWO = "a AS (SELECT * FROM preds WHERE model = 'm1'), b AS (SELECT * FROM preds WHERE model = 'm2')"


def _two(spark, d):
    p = views.preds(matches(spark, d))
    return p.where("model = 'm1'"), p.where("model = 'm2'")


@query("F10_soft_vote", with_(MATCHES, PREDS, TWO) + f"SELECT a.match_id, {r(*[f'(a.p_{n} + b.p_{n}) / 2 AS p_{n}' for n in ('away', 'draw', 'home')])} FROM a JOIN b USING (match_id)")
def soft_vote(spark, d):
    return FM.soft_vote(*_two(spark, d)).select("match_id", "p_away", "p_draw", "p_home")


_BL = "CASE a.y WHEN 0 THEN w * a.p_away + (1 - w) * b.p_away WHEN 1 THEN w * a.p_draw + (1 - w) * b.p_draw ELSE w * a.p_home + (1 - w) * b.p_home END"


@query("F11_blend_weight", with_(MATCHES, PREDS, TWO, f"bl AS (SELECT w, AVG(-LN(GREATEST({_BL}, 1e-15))) AS ll FROM a JOIN b USING (match_id), (VALUES {', '.join(f'({0.30 + 0.05 * i:.2f}::DOUBLE)' for i in range(10))}) g(w) GROUP BY w)")
       + f"SELECT {r('w AS weight', 'll AS log_loss')}, CASE WHEN ROW_NUMBER() OVER (ORDER BY ll, w) = 1 THEN 1 ELSE 0 END AS best FROM bl")
def blend_weight(spark, d):
    return FM.blend_weight(*_two(spark, d))


COVERED = "a.p_home > a.p_away"


@query("F12_two_tier", with_(MATCHES, PREDS, TWO) + f"SELECT match_id, {r(*[f'CASE WHEN {COVERED} THEN a.p_{n} ELSE b.p_{n} END AS p_{n}' for n in ('away', 'draw', 'home')])}, CASE WHEN {COVERED} THEN 1 ELSE 2 END AS tier FROM a JOIN b USING (match_id)")
def two_tier(spark, d):
    """The first model covers the matches it gives to the home side."""
    rich, fallback = _two(spark, d)
    return FM.two_tier(rich.where("p_home > p_away"), fallback).select("match_id", "p_away", "p_draw", "p_home", "tier")
