"""History windows, joins and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as E
from ..operators import history as C
from ..operators import joins as D
from ..plans import views
from ..plans.blocks import dated_rank
from .base import FEED, MATCHES, PLAYERS, PREDS, SCORED, TEAM_ROWS, matches, query, r, with_

M = with_(MATCHES)
W5 = ("5", "10")


@query("C1_to_team_rows", with_(MATCHES, TEAM_ROWS) + """SELECT match_id, CAST(match_date AS VARCHAR) AS match_date, season, division, venue, team, opponent, gf, ga, shots, sot,
goal_diff, points::DOUBLE AS points, result::DOUBLE AS result, win_margin::DOUBLE AS win_margin, loss_margin::DOUBLE AS loss_margin FROM team_rows""")
def to_team_rows(spark, d):
    return C.to_team_rows(matches(spark, d))


# ---- row order at the same venue
def _venue_sql(windows, rates):
    cols = []
    for n in windows:
        w = f"OVER (PARTITION BY team, venue ORDER BY match_date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols += [f"AVG(gf) {w} AS avg_goals_for_{n}", f"AVG(ga) {w} AS avg_goals_against_{n}", f"AVG(gf) {w} - AVG(ga) {w} AS avg_goal_diff_{n}", f"AVG(points) {w} AS avg_points_{n}"]
        for name, v in (("win", 1), ("draw", 0), ("loss", -1)):
            hits = f"SUM(CASE WHEN result = {v} THEN 1.0 ELSE 0.0 END) {w}"
            rate = f"COALESCE({hits}, 0) / LEAST(COUNT(*) {w} + 1, {n})" if rates == "literal" else f"{hits} / NULLIF(COUNT(*) {w}, 0)"
            cols.append(f"{rate} AS {name}_rate_{n}")
    names = [c.rpartition(" AS ")[2] for c in cols]
    wide = [f"MAX(CASE WHEN venue = '{s}' THEN {c} END) AS {s}_{c}" for s in ("home", "away") for c in names]
    return (with_(MATCHES, TEAM_ROWS, f"f AS (SELECT match_id, venue, {', '.join(cols)} FROM team_rows)")
            + f"SELECT match_id, {r(*wide)} FROM f GROUP BY match_id")


@query("C2_venue_form", _venue_sql((5, 10), "clean"))
def venue_form(spark, d):
    return C.venue_form(matches(spark, d), (5, 10))


@query("C2_venue_form_literal", _venue_sql((5,), "literal"))
def venue_form_literal(spark, d):
    return C.venue_form(matches(spark, d), (5,), rates="literal")


@query("C2_venue_form_blocks", _venue_sql((5,), "clean"))
def venue_form_blocks(spark, d):
    """The same with histories cut into short blocks."""
    return C.venue_form(matches(spark, d), (5,), rows_per_block=40)


def _shots_cte(windows):
    cols = []
    for n in windows:
        w = f"OVER (PARTITION BY team, venue ORDER BY match_date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols += [f"AVG(shots) {w} AS avg_shots_{n}", f"AVG(sot) {w} AS avg_sot_{n}", f"AVG(sot) {w} / NULLIF(AVG(shots) {w}, 0) AS shot_accuracy_{n}",
                 f"SUM(gf) {w} / NULLIF(SUM(shots) {w}, 0) AS conversion_rate_{n}"]
    names = [c.rpartition(" AS ")[2] for c in cols]
    return f"vs AS (SELECT match_id, venue, {', '.join(cols)} FROM team_rows)", [f"MAX(CASE WHEN venue = '{s}' THEN {c} END) AS {s}_{c}" for s in ("home", "away") for c in names]


_VS, _VSW = _shots_cte((5, 10))


@query("C3_venue_shots", with_(MATCHES, TEAM_ROWS, _VS) + f"SELECT match_id, {r(*_VSW)} FROM vs GROUP BY match_id")
def venue_shots(spark, d):
    return C.venue_shots(matches(spark, d), (5, 10))


# ---- prior days: rows numbered per team, k = rows on earlier days
FORM_AGG = {"team_state_points": "AVG(o.points)", "goals_for": "AVG(o.gf)", "goals_against": "AVG(o.ga)", "goal_differential": "AVG(o.goal_diff)",
            "win_rate": "AVG(CASE WHEN o.result = 1 THEN 1.0 WHEN o.result IS NOT NULL THEN 0.0 END)", "draw_rate": "AVG(CASE WHEN o.result = 0 THEN 1.0 WHEN o.result IS NOT NULL THEN 0.0 END)",
            "loss_rate": "AVG(CASE WHEN o.result = -1 THEN 1.0 WHEN o.result IS NOT NULL THEN 0.0 END)", "win_margin_goals": "AVG(o.win_margin)", "loss_margin_goals": "AVG(o.loss_margin)",
            "avg_shots": "AVG(o.shots)", "avg_sot": "AVG(o.sot)", "_gf": "SUM(o.gf)", "_sh": "SUM(o.shots)"}
_state = ", ".join(f"{agg} FILTER (WHERE o.rn > d.k - {n}) AS {name}_{n}" for n in (5, 10) for name, agg in FORM_AGG.items())
STATE = f"""o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date, match_id) AS rn FROM team_rows),
dd AS (SELECT team, match_date, MIN(rn) - 1 AS k FROM o GROUP BY team, match_date),
st AS (SELECT d.team, d.match_date, {_state} FROM dd d LEFT JOIN o ON o.team = d.team AND o.rn <= d.k AND o.rn > d.k - 10 GROUP BY d.team, d.match_date)"""
STATE_COLS = [c for n in W5 for c in (*[f"{k}_{n}" for k in FORM_AGG if not k.startswith("_")], f"avg_sot_{n} / NULLIF(avg_shots_{n}, 0) AS shot_accuracy_{n}",
                                      f"CASE WHEN _sh_{n} > 0 THEN _gf_{n} / _sh_{n} END AS conversion_rate_{n}")]


@query("C4_prior_day_form", with_(MATCHES, TEAM_ROWS, STATE) + f"SELECT team, CAST(match_date AS VARCHAR) AS match_date, {r(*STATE_COLS)} FROM st")
def prior_day_form(spark, d):
    return C.prior_day_form(C.to_team_rows(matches(spark, d)))


# ---- row order over both venues
LEAGUE_ROWS = """lr AS (SELECT match_id, SUM(home_goals + away_goals) OVER w / NULLIF(2.0 * COUNT(*) OVER w, 0) AS league_avg FROM matches
WINDOW w AS (ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
ROW_FORM = {"team_state_points": "AVG(points)", "goals_for": "AVG(gf)", "goals_against": "AVG(ga)", "goal_differential": "AVG(goal_diff)", "win_rate": "AVG(CASE WHEN result = 1 THEN 1.0 ELSE 0.0 END)",
            "draw_rate": "AVG(CASE WHEN result = 0 THEN 1.0 ELSE 0.0 END)", "loss_rate": "AVG(CASE WHEN result = -1 THEN 1.0 ELSE 0.0 END)", "win_margin_goals": "AVG(win_margin)",
            "loss_margin_goals": "AVG(loss_margin)"}
_rf = ", ".join(f"{a} OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {k}_{n}" for n in (5, 10) for k, a in ROW_FORM.items())
RF = LEAGUE_ROWS + f""",
rf0 AS (SELECT match_id, venue, team, {_rf} FROM team_rows),
rf AS (SELECT rf0.*, {', '.join(f'goals_for_{n} / NULLIF(league_avg, 0) AS attack_strength_{n}, goals_against_{n} / NULLIF(league_avg, 0) AS defense_strength_{n}' for n in (5, 10))} FROM rf0 JOIN lr USING (match_id))"""
RF_COLS = [f"{k}_{n}" for n in (5, 10) for k in (*ROW_FORM, "attack_strength", "defense_strength")]


@query("C4b_prior_row_form", with_(MATCHES, TEAM_ROWS, RF) + f"SELECT match_id, venue, team, {r(*RF_COLS)} FROM rf")
def prior_row_form(spark, d):
    m = matches(spark, d)
    return C.prior_row_form(C.to_team_rows(m), C.expanding_league_mean_rows(m))


@query("C5_expanding_league_mean", M + f"""SELECT CAST(match_date AS VARCHAR) AS match_date, {r("SUM(g) OVER w / SUM(n) OVER w AS league_avg")}
FROM (SELECT match_date, SUM(home_goals + away_goals) AS g, 2.0 * COUNT(*) AS n FROM matches GROUP BY match_date)
WINDOW w AS (ORDER BY match_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_league_mean(spark, d):
    return C.expanding_league_mean(matches(spark, d))


@query("C5_expanding_league_mean_rows", with_(MATCHES, LEAGUE_ROWS) + f"SELECT match_id, {r('league_avg')} FROM lr")
def expanding_league_mean_rows(spark, d):
    return C.expanding_league_mean_rows(matches(spark, d), rows_per_block=4000)


LEAGUE_DAYS = """ld AS (SELECT match_date, SUM(g) OVER w / SUM(n) OVER w AS league_avg
FROM (SELECT match_date, SUM(home_goals + away_goals) AS g, 2.0 * COUNT(*) AS n FROM matches GROUP BY match_date)
WINDOW w AS (ORDER BY match_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("C6_strengths", with_(MATCHES, TEAM_ROWS, STATE, LEAGUE_DAYS) + f"""SELECT team, CAST(st.match_date AS VARCHAR) AS match_date,
{r('goals_for_10 / NULLIF(league_avg, 0) AS attack_strength_10', 'goals_against_10 / NULLIF(league_avg, 0) AS defense_strength_10')} FROM st JOIN ld ON ld.match_date = st.match_date""")
def strengths(spark, d):
    m = matches(spark, d)
    state = C.prior_day_form(C.to_team_rows(m), (10,))
    out = C.strengths(state.join(F.broadcast(C.expanding_league_mean(m)), "match_date"), (10,))
    return out.select("team", "match_date", "attack_strength_10", "defense_strength_10")


# ---- pairs
PAIRS = """pr AS (SELECT match_id, match_date, LEAST(home_team, away_team) AS lo, GREATEST(home_team, away_team) AS hi, home_team < away_team AS low_home,
  CASE WHEN home_team < away_team THEN home_goals ELSE away_goals END AS gl, CASE WHEN home_team < away_team THEN away_goals ELSE home_goals END AS gh FROM matches)"""
H2H_CLEAN = PAIRS + """,
po AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lo, hi ORDER BY match_date, match_id) AS rn FROM pr),
pd AS (SELECT *, MIN(rn) OVER (PARTITION BY lo, hi, match_date) - 1 AS k FROM po),
h2h AS (SELECT d.match_id,
  CAST(COUNT(CASE WHEN (d.low_home AND o.gl > o.gh) OR (NOT d.low_home AND o.gh > o.gl) THEN 1 END) AS INT) AS h2h_home_wins,
  CAST(COUNT(CASE WHEN (d.low_home AND o.gh > o.gl) OR (NOT d.low_home AND o.gl > o.gh) THEN 1 END) AS INT) AS h2h_away_wins,
  CAST(COUNT(CASE WHEN o.gl = o.gh THEN 1 END) AS INT) AS h2h_draws,
  COALESCE(AVG(CASE WHEN d.low_home THEN o.gl ELSE o.gh END), 0) AS h2h_home_avg_goals, COALESCE(AVG(CASE WHEN d.low_home THEN o.gh ELSE o.gl END), 0) AS h2h_away_avg_goals
  FROM pd d LEFT JOIN po o ON o.lo = d.lo AND o.hi = d.hi AND o.rn <= d.k AND o.rn > d.k - 5 GROUP BY d.match_id)"""
H2H_COLS = "h2h_home_wins, h2h_away_wins, h2h_draws, " + r("h2h_home_avg_goals", "h2h_away_avg_goals")


@query("C7_h2h_clean", with_(MATCHES, H2H_CLEAN) + f"SELECT match_id, {H2H_COLS} FROM h2h")
def h2h_clean(spark, d):
    return C.h2h_clean(matches(spark, d))


H2H_LEGACY = PAIRS + """,
hl AS (SELECT match_id, CAST(COUNT(CASE WHEN gl > gh THEN 1 END) OVER w AS INT) AS h2h_home_wins, CAST(COUNT(CASE WHEN gh > gl THEN 1 END) OVER w AS INT) AS h2h_away_wins,
  CAST(COUNT(CASE WHEN gl = gh THEN 1 END) OVER w AS INT) AS h2h_draws, COALESCE(AVG(gl) OVER w, 0) AS h2h_home_avg_goals, COALESCE(AVG(gh) OVER w, 0) AS h2h_away_avg_goals
  FROM pr WINDOW w AS (PARTITION BY lo, hi ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


@query("C8_h2h_legacy", with_(MATCHES, H2H_LEGACY) + f"SELECT match_id, {H2H_COLS} FROM hl")
def h2h_legacy(spark, d):
    return C.h2h_legacy(matches(spark, d))


# ---- matrices
def matrix_parts() -> tuple[list[str], str]:
    """The 66 columns as SQL expressions with names, and the joins they come from."""
    cols = []
    for n in W5:
        for s, a in (("home", "h"), ("away", "a")):
            cols += [f"{a}.{k}_{n} AS {s}_{k}_{n}" for k in FORM_AGG if not k.startswith("_")]
            cols += [f"{a}.goals_for_{n} / NULLIF(league_avg, 0) AS {s}_attack_strength_{n}", f"{a}.goals_against_{n} / NULLIF(league_avg, 0) AS {s}_defense_strength_{n}",
                     f"{a}.avg_sot_{n} / NULLIF({a}.avg_shots_{n}, 0) AS {s}_shot_accuracy_{n}", f"CASE WHEN {a}._sh_{n} > 0 THEN {a}._gf_{n} / {a}._sh_{n} END AS {s}_conversion_rate_{n}"]
    return cols + list(C.H2H_COLUMNS) + ["m.league_level AS league_level"], """matches m JOIN st h ON h.team = m.home_team AND h.match_date = m.match_date JOIN st a ON a.team = m.away_team AND a.match_date = m.match_date
JOIN ld ON ld.match_date = m.match_date JOIN h2h ON h2h.match_id = m.match_id"""


MATRIX_NEEDS = (MATCHES, TEAM_ROWS, STATE, LEAGUE_DAYS, H2H_CLEAN)


def _matrix_sql():
    cols, source = matrix_parts()
    return with_(*MATRIX_NEEDS) + f"""SELECT m.match_id, CAST(m.match_date AS VARCHAR) AS match_date, m.season, m.division, m.home_team, m.away_team, m.y, {r(*cols)}
FROM {source}"""


@query("C9_feature_matrix_66", _matrix_sql())
def feature_matrix_66(spark, d):
    return C.feature_matrix_66(matches(spark, d))


_W44 = [f"MAX(CASE WHEN venue = '{s}' THEN {k}_{n} END) AS {s}_{k}_{n}" for n in (5, 10) for s in ("home", "away") for k in C.FORM_METRICS]


@query("C10_feature_matrix_44", with_(MATCHES, TEAM_ROWS, RF) + f"SELECT match_id, {r(*_W44)} FROM rf GROUP BY match_id")
def feature_matrix_44(spark, d):
    return C.feature_matrix_44(matches(spark, d))


@query("C10_feature_matrix_65", with_(MATCHES, TEAM_ROWS, RF, _VS, H2H_LEGACY) + f"""SELECT x.*, {', '.join(n.rpartition(' AS ')[2] for n in _VSW)}, {H2H_COLS}
FROM (SELECT match_id, {r(*_W44)} FROM rf GROUP BY match_id) x JOIN (SELECT match_id, {r(*_VSW)} FROM vs GROUP BY match_id) v USING (match_id) JOIN hl USING (match_id)""")
def feature_matrix_65(spark, d):
    return C.feature_matrix_65(matches(spark, d))


_REL = [f"{s}_{c}_5" for s in ("home", "away") for c in ("goals_for", "win_rate")]
_RELM = """mat AS (SELECT m.match_id, m.match_date, m.division, h.goals_for_5 AS home_goals_for_5, h.win_rate_5 AS home_win_rate_5, a.goals_for_5 AS away_goals_for_5, a.win_rate_5 AS away_win_rate_5
FROM matches m JOIN st h ON h.team = m.home_team AND h.match_date = m.match_date JOIN st a ON a.team = m.away_team AND a.match_date = m.match_date)"""


@query("B10_league_relative", with_(MATCHES, TEAM_ROWS, STATE, _RELM) + f"""SELECT match_id, {r(*[f"{c} - SUM(s_{c}) OVER w / NULLIF(SUM(n_{c}) OVER w, 0) AS rel_{c}" for c in _REL])}
FROM (SELECT mat.*, {', '.join(f"CASE WHEN fst THEN SUM({c}) OVER dy END AS s_{c}, CASE WHEN fst THEN COUNT({c}) OVER dy END AS n_{c}" for c in _REL)}
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY division, match_date ORDER BY match_id) = 1 AS fst FROM mat) mat WINDOW dy AS (PARTITION BY division, match_date))
WINDOW w AS (PARTITION BY division ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def league_relative(spark, d):
    m = matches(spark, d)
    mat = C.history_lookup(C.to_team_rows(m), m, 5).select("match_id", "match_date", "division", *_REL)
    return C.league_relative(mat, _REL).select("match_id", *[f"rel_{c}" for c in _REL])


@query("B10_league_relative_full", with_(MATCHES, TEAM_ROWS, STATE, _RELM) + f"SELECT match_id, {r(*[f'{c} - AVG({c}) OVER (PARTITION BY division) AS rel_{c}' for c in _REL])} FROM mat")
def league_relative_full(spark, d):
    m = matches(spark, d)
    mat = C.history_lookup(C.to_team_rows(m), m, 5).select("match_id", "match_date", "division", *_REL)
    return C.league_relative(mat, _REL, mode="full").select("match_id", *[f"rel_{c}" for c in _REL])


@query("D9_history_lookup", with_(MATCHES, TEAM_ROWS, STATE) + f"""SELECT m.match_id, {r('h.team_state_points_10 AS home_team_state_points_10', 'a.team_state_points_10 AS away_team_state_points_10', 'h.goals_for_10 AS home_goals_for_10', 'a.goals_against_10 AS away_goals_against_10')}
FROM matches m JOIN st h ON h.team = m.home_team AND h.match_date = m.match_date JOIN st a ON a.team = m.away_team AND a.match_date = m.match_date""")
def history_lookup(spark, d):
    m = matches(spark, d)
    return C.history_lookup(C.to_team_rows(m), m, 10).select("match_id", "home_team_state_points_10", "away_team_state_points_10", "home_goals_for_10", "away_goals_against_10")


_VF5 = _venue_sql((5, 10), "clean")
_T3 = "(1 / odds_home + 1 / odds_draw + 1 / odds_away)"


@query("C11_build_features", with_(MATCHES, TEAM_ROWS, _VS, H2H_LEGACY) + f"""SELECT m.match_id, {r(*[f"v.{n.rpartition(' AS ')[2]} AS {n.rpartition(' AS ')[2]}" for n in _VSW])}, {H2H_COLS},
{r(f"(1 / odds_home) / {_T3} AS impl_home_prob", f"{_T3} - 1 AS overround")}, {', '.join(f"CASE WHEN m.division = 'E{i}' THEN 1.0 ELSE 0.0 END::DOUBLE AS league_E{i}" for i in range(4))},
{r("home_avg_shots_5 - AVG(home_avg_shots_5) OVER (PARTITION BY m.division) AS rel_home_avg_shots_5")}
FROM matches m JOIN (SELECT match_id, {', '.join(_VSW)} FROM vs GROUP BY match_id) v ON v.match_id = m.match_id JOIN hl ON hl.match_id = m.match_id""")
def build_features(spark, d):
    out = C.build_features(matches(spark, d), (5, 10), divisions=[f"E{i}" for i in range(4)], relative="full")
    shots = [n.rpartition(" AS ")[2] for n in _VSW]
    return out.select("match_id", *shots, *C.H2H_COLUMNS, "impl_home_prob", "overround", *[f"league_E{i}" for i in range(4)], "rel_home_avg_shots_5")


@query("C12_cumulative_ppg", with_(MATCHES, TEAM_ROWS, """q AS (SELECT match_id, venue, COALESCE(AVG(points) OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ppg FROM team_rows)""") + f"""
SELECT match_id, {r("MAX(CASE WHEN venue = 'home' THEN ppg END) AS home_ppg", "MAX(CASE WHEN venue = 'away' THEN ppg END) AS away_ppg", "MAX(CASE WHEN venue = 'home' THEN ppg END) - MAX(CASE WHEN venue = 'away' THEN ppg END) AS ppg_diff")} FROM q GROUP BY match_id""")
def cumulative_ppg(spark, d):
    return C.cumulative_ppg(matches(spark, d))


@query("C13_static_ppg", with_(MATCHES, TEAM_ROWS, "tp AS (SELECT team, AVG(points) AS ppg FROM team_rows WHERE season < 2000 AND team < 38 GROUP BY team)") + f"""
SELECT m.match_id, {r("COALESCE(h.ppg, (SELECT AVG(ppg) FROM tp)) AS home_static_ppg", "COALESCE(a.ppg, (SELECT AVG(ppg) FROM tp)) AS away_static_ppg")}
FROM matches m LEFT JOIN tp h ON h.team = m.home_team LEFT JOIN tp a ON a.team = m.away_team WHERE m.season >= 2000""")
def static_ppg(spark, d):
    m = matches(spark, d)
    train = m.where("season < 2000")
    # a training span without two of the teams: rows of teams 38 and 39 are blanked
    known = train.select(*[F.when(F.col(c) < 38, F.col(c)).alias(c) if c in ("home_team", "away_team") else F.col(c) for c in train.columns])
    target = m.where("season >= 2000")
    return C.static_ppg(known, target).select("match_id", "home_static_ppg", "away_static_ppg")


@query("C14_last_k_sequences", with_(MATCHES, TEAM_ROWS, """o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date, match_id) AS rn FROM team_rows)""") + f"""
SELECT m.match_id, s.venue, s.pos AS pos, {r("COALESCE(p.gf, 0) AS gf", "COALESCE(p.ga, 0) AS ga", "CASE WHEN p.venue = 'home' THEN 1.0 ELSE 0.0 END AS is_home")}
FROM matches m JOIN (SELECT o.match_id, o.venue, o.team, o.rn, g.pos FROM o CROSS JOIN (SELECT CAST(UNNEST(RANGE(0, 10)) AS INT) AS pos) g) s ON s.match_id = m.match_id
LEFT JOIN o p ON p.team = s.team AND p.rn = s.rn - 10 + s.pos""")
def last_k_sequences(spark, d):
    seq = C.last_k_sequences(matches(spark, d), 10)
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("venue"), F.col(f"{s}_seq").alias("seq")) for s in ("home", "away")]))
    return (seq.select("match_id", both.alias("v")).select("match_id", "v.venue", F.posexplode("v.seq").alias("pos", "x"))
            .select("match_id", "venue", "pos", "x.gf", "x.ga", "x.is_home"))


@query("C14_sequence_mask", with_(MATCHES, TEAM_ROWS, "o AS (SELECT match_id, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date, match_id) - 1 AS k FROM team_rows)")
       + f"SELECT match_id, {r('LEAST(10, MAX(k)) AS n_valid')} FROM o GROUP BY match_id")
def sequence_mask(spark, d):
    seq = C.last_k_sequences(matches(spark, d), 10)
    return seq.select("match_id", F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("n_valid"))


@query("C15_recent_form_snapshot", with_(MATCHES, TEAM_ROWS, """top AS (SELECT * FROM team_rows WHERE division = 'E0'),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team, venue ORDER BY match_date DESC, match_id DESC) AS rn FROM top WHERE season = (SELECT MAX(season) FROM top)),
car AS (SELECT team, venue, AVG(gf) AS gf, AVG(points) AS pts FROM top GROUP BY team, venue), rec AS (SELECT team, venue, AVG(gf) AS gf, AVG(points) AS pts FROM ranked WHERE rn <= 5 GROUP BY team, venue),
tab AS (SELECT c.team, c.venue, CASE WHEN c.team IN (3, 7) THEN c.gf ELSE COALESCE(x.gf, c.gf) END AS gf, CASE WHEN c.team IN (3, 7) THEN c.pts ELSE COALESCE(x.pts, c.pts) END AS pts
  FROM car c LEFT JOIN rec x ON x.team = c.team AND x.venue = c.venue)""") + f"""
SELECT f.home_team, f.away_team, {r("COALESCE(h.gf, 0) AS home_avg_goals_for", "COALESCE(a.gf, 0) AS away_avg_goals_for", "COALESCE(h.pts, 0) AS home_avg_points", "COALESCE(a.pts, 0) AS away_avg_points")}
FROM (SELECT DISTINCT home_team, away_team FROM matches) f LEFT JOIN tab h ON h.team = f.home_team AND h.venue = 'home' LEFT JOIN tab a ON a.team = f.away_team AND a.venue = 'away'""")
def recent_form_snapshot(spark, d):
    m = matches(spark, d)
    fixtures = m.select("home_team", "away_team").distinct()
    return C.recent_form_snapshot(m, fixtures, 5, promoted=[3, 7]).select("home_team", "away_team", "home_avg_goals_for", "away_avg_goals_for", "home_avg_points", "away_avg_points")


SEASON_RATINGS = """sr AS (SELECT t.season, t.team, CASE WHEN MIN(l.h) > 0 THEN AVG(t.gf) / MIN(l.h) ELSE 1.0 END AS attack,
CASE WHEN MIN(l.h) > 0 AND MIN(l.a) > 0 THEN AVG(t.ga) / MIN(l.a) ELSE 1.0 END AS defence
FROM team_rows t JOIN (SELECT season, AVG(home_goals) AS h, AVG(away_goals) AS a FROM matches GROUP BY season) l ON l.season = t.season GROUP BY t.season, t.team)"""


@query("C16_season_ratings", with_(MATCHES, TEAM_ROWS, SEASON_RATINGS) + f"""SELECT s.team, s.season, {r("attack", "defence")} FROM sr s JOIN (SELECT team, MAX(season) AS season FROM sr GROUP BY team) x USING (team, season)""")
def season_ratings(spark, d):
    ratings = C.season_ratings(matches(spark, d))
    last = C.last_season_ratings(ratings)
    return last.join(ratings.groupBy("team").agg(F.max("season").alias("season")), "team")


@query("C16_season_ratings_all", with_(MATCHES, TEAM_ROWS, SEASON_RATINGS) + f"""SELECT team, season, {r("attack", "defence")} FROM sr""")
def season_ratings_all(spark, d):
    return C.season_ratings(matches(spark, d))


def _rolling_sql(frame):
    return with_(MATCHES, PREDS, SCORED) + f"""SELECT match_id, model, {r("CASE WHEN n >= 5 THEN h / n END AS rolling_accuracy")}, n AS rolling_n FROM (
SELECT match_id, model, COUNT(*) OVER w AS n, SUM(CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END) OVER w AS h FROM scored WINDOW w AS ({frame}))"""


def _hits(spark, d):
    p = views.preds(matches(spark, d))
    from ..functions.scalars import predicted_class
    return predicted_class(p).withColumn("correct", (F.col("predicted") == F.col("y")).cast("int"))


@query("C17_rolling_time_accuracy", with_(MATCHES, PREDS, SCORED, """hd AS (SELECT match_id, model, match_date, CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END AS hit FROM scored),
rt AS (SELECT match_id, model, COUNT(*) OVER w AS n0, COALESCE(SUM(hit) OVER w, 0) AS h0, ROW_NUMBER() OVER v AS n1, SUM(hit) OVER v AS h1 FROM hd
WINDOW w AS (PARTITION BY model ORDER BY match_date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
v AS (PARTITION BY model, match_date ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
       + f"SELECT match_id, model, n0 + n1 AS rolling_n, {r('CASE WHEN n0 + n1 >= 5 THEN (h0 + h1) / (n0 + n1) END AS rolling_accuracy')} FROM rt")
def rolling_time_accuracy(spark, d):
    return C.rolling_time_accuracy(_hits(spark, d), rows_per_block=3000).select("match_id", "model", "rolling_n", "rolling_accuracy")


@query("C17_rolling_time_accuracy_day", _rolling_sql("PARTITION BY model ORDER BY match_date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW"))
def rolling_time_accuracy_day(spark, d):
    return C.rolling_time_accuracy(_hits(spark, d), ties="day").select("match_id", "model", "rolling_n", "rolling_accuracy")


@query("C18_row_ranking", with_(MATCHES, TEAM_ROWS) + f"""SELECT season, team, {r("pts AS points")}, CAST(ROW_NUMBER() OVER (PARTITION BY season ORDER BY pts DESC, team) AS INT) AS rank
FROM (SELECT season, team, SUM(points) AS pts FROM team_rows GROUP BY season, team)""")
def row_ranking(spark, d):
    totals = C.to_team_rows(matches(spark, d)).groupBy("season", "team").agg(F.sum("points").alias("points"))
    return C.row_ranking(totals, ["season"], [F.col("points").desc(), F.col("team")])


@query("dated_rank", M + "SELECT match_id, division, ROW_NUMBER() OVER (PARTITION BY division ORDER BY match_date, match_id) AS row_rank FROM matches")
def dated_rank_query(spark, d):
    return dated_rank(matches(spark, d), ["division"], "match_date", "match_id", rows_per_block=500).select("match_id", "division", "row_rank")


# ---- the flagship
@query("flagship_form_features", with_(MATCHES, TEAM_ROWS, STATE, LEAGUE_DAYS) + f"""SELECT m.match_id, CAST(m.match_date AS VARCHAR) AS match_date, m.home_team, m.away_team, m.y,
{r(*[f"{a}.{k}_10 AS {s}_{k}_10" for s, a in (("home", "h"), ("away", "a")) for k in ("team_state_points", "goals_for", "goals_against", "win_rate")],
   *[f"{a}.{c}_10 / NULLIF(league_avg, 0) AS {s}_{o}_10" for s, a in (("home", "h"), ("away", "a")) for o, c in (("attack_strength", "goals_for"), ("defense_strength", "goals_against"))])}
FROM matches m JOIN st h ON h.team = m.home_team AND h.match_date = m.match_date JOIN st a ON a.team = m.away_team AND a.match_date = m.match_date
JOIN ld ON ld.match_date = m.match_date WHERE m.season = 2000""")
def flagship_form_features(spark, d):
    m = matches(spark, d)
    state = C.history_lookup(C.to_team_rows(m), m, 10).where("season = 2000").join(F.broadcast(C.expanding_league_mean(m)), "match_date")
    for side in ("home", "away"):
        state = C.strengths(state, (10,), f"{side}_")
    cols = [f"{s}_{k}_10" for s in ("home", "away") for k in ("team_state_points", "goals_for", "goals_against", "win_rate", "attack_strength", "defense_strength")]
    return state.select("match_id", "match_date", "home_team", "away_team", "y", *cols)


# ---- joins
@query("D1_enrich_by_date", with_(MATCHES, FEED, "f1 AS (SELECT feed_date, home_name, away_name, MIN(home_ppg) AS home_ppg, MIN(away_ppg) AS away_ppg, MIN(home_xg) AS home_xg, MIN(away_xg) AS away_xg FROM feed GROUP BY 1, 2, 3)") + f"""
SELECT m.match_id, {r("f1.home_ppg AS home_ppg", "f1.away_ppg AS away_ppg", "f1.home_xg AS home_xg", "f1.away_xg AS away_xg")} FROM matches m LEFT JOIN f1 ON f1.feed_date = m.match_date
AND f1.home_name = CASE WHEN m.home_team < 39 THEN CONCAT('Club ', LPAD(CAST(m.home_team AS VARCHAR), 2, '0')) END AND f1.away_name = CASE WHEN m.away_team < 39 THEN CONCAT('Club ', LPAD(CAST(m.away_team AS VARCHAR), 2, '0')) END""")
def enrich_by_date(spark, d):
    m = matches(spark, d)
    return D.enrich_by_date(m, views.feed(m), views.name_map(spark)).select("match_id", "home_ppg", "away_ppg", "home_xg", "away_xg")


@query("D2_enrich_by_fixture", M + f"""SELECT m.match_id, {r("x.close_home AS close_home")} FROM matches m LEFT JOIN (SELECT season, home_team, away_team, MIN(odds_home) AS close_home FROM matches WHERE home_shots > away_shots GROUP BY 1, 2, 3) x
ON x.season = m.season AND x.home_team = m.home_team AND x.away_team = m.away_team""")
def enrich_by_fixture(spark, d):
    m = matches(spark, d)
    side = m.where("home_shots > away_shots").select("season", "home_team", "away_team", F.col("odds_home").alias("close_home"))
    return D.enrich_by_fixture(m, side).select("match_id", "close_home")


@query("D3_squad_join", with_(MATCHES, PLAYERS, "sq AS (SELECT season, club_id, COUNT(*) AS n_players, AVG(age) AS avg_age FROM players GROUP BY 1, 2)") + f"""
SELECT m.match_id, h.n_players AS home_n_players, a.n_players AS away_n_players, {r("h.avg_age AS home_avg_age", "a.avg_age AS away_avg_age")} FROM matches m
LEFT JOIN sq h ON h.season = m.season AND h.club_id = m.home_team LEFT JOIN sq a ON a.season = m.season AND a.club_id = m.away_team""")
def squad_join(spark, d):
    squads = views.players(spark, d).groupBy("season", "club_id").agg(F.count(F.lit(1)).alias("n_players"), F.avg("age").alias("avg_age"))
    out = D.squad_join(matches(spark, d), squads, {"home": "home_team", "away": "away_team"})
    return out.select("match_id", "home_n_players", "away_n_players", "home_avg_age", "away_avg_age")


def _second_minus_first(expr):
    return f"MAX(CASE WHEN model = 'm2' THEN {expr} END) - MAX(CASE WHEN model = 'm1' THEN {expr} END)"


@query("D4_paired_models", with_(MATCHES, PREDS, SCORED) + f"""SELECT match_id, 1 AS sound, {r(f"{_second_minus_first('CASE WHEN predicted = y THEN 1 ELSE 0 END')} AS d_accuracy", f"{_second_minus_first('ll')} AS d_log_loss", f"{_second_minus_first('br')} AS d_brier")}
FROM scored WHERE model IN ('m1', 'm2') GROUP BY match_id""")
def paired_models(spark, d):
    from ..operators.metrics import per_match_metrics
    per = per_match_metrics(views.preds(matches(spark, d)))
    return D.paired_models(per, "m1", "m2", ["match_id"], ["accuracy", "log_loss", "brier"])


@query("D5_reconcile", M + """SELECT match_id, 1 AS n_left, 1 AS n_right, CASE WHEN match_id % 19 = 0 THEN 1 ELSE 0 END AS n_differ, CASE WHEN match_id % 19 = 0 THEN 'mismatch' ELSE 'same' END AS status FROM matches""")
def reconcile(spark, d):
    m = matches(spark, d)
    right = m.select("match_id", F.when(F.col("match_id") % 19 == 0, F.col("home_goals") + 1).otherwise(F.col("home_goals")).alias("home_goals"), "y")
    return D.reconcile(m, right, ["match_id"], ["home_goals", "y"])


@query("D6_orphans", M + """SELECT home_team, away_team FROM (SELECT DISTINCT home_team, away_team FROM matches WHERE season >= 2000) x WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.season < 2000 AND m.division = 'E0' AND m.home_team = x.home_team AND m.away_team = x.away_team)""")
def orphans(spark, d):
    m = matches(spark, d)
    return D.orphans(m.where("season >= 2000"), m.where("season < 2000 AND division = 'E0'"), ["home_team", "away_team"])


@query("D7_team_param_join", with_(MATCHES, TEAM_ROWS, "p AS (SELECT team, AVG(gf) AS attack, AVG(ga) AS defence FROM team_rows WHERE team < 35 GROUP BY team)") + f"""
SELECT m.match_id, {r("COALESCE(h.attack, 0) AS home_attack", "COALESCE(h.defence, 0) AS home_defence", "COALESCE(a.attack, 0) AS away_attack", "COALESCE(a.defence, 0) AS away_defence")}
FROM matches m LEFT JOIN p h ON h.team = m.home_team LEFT JOIN p a ON a.team = m.away_team""")
def team_param_join(spark, d):
    m = matches(spark, d)
    p = C.to_team_rows(m).where("team < 35").groupBy("team").agg(F.avg("gf").alias("attack"), F.avg("ga").alias("defence"))
    return D.team_param_join(m, p).select("match_id", "home_attack", "home_defence", "away_attack", "away_defence")


FOLDS = (1998, 1999, 2000)


@query("D8_season_expanding", M + """SELECT m.match_id, f.fold, CASE WHEN m.season = f.fold THEN 'test' ELSE 'train' END AS role FROM matches m JOIN (VALUES (1998), (1999), (2000)) f(fold) ON m.season <= f.fold""")
def season_expanding(spark, d):
    return D.season_expanding(matches(spark, d), FOLDS).select("match_id", "fold", "role")


# ---- folds
RANKED = "rk AS (SELECT match_id, ROW_NUMBER() OVER (ORDER BY match_date, match_id) AS k, COUNT(*) OVER () AS n FROM matches)"


@query("E1_temporal_split", with_(MATCHES, RANKED) + "SELECT match_id, CASE WHEN k <= GREATEST(FLOOR(n * 0.8), 100) THEN 'train' ELSE 'test' END AS role FROM rk")
def temporal_split(spark, d):
    return E.temporal_split(matches(spark, d), 0.2).select("match_id", "role")


@query("E2_season_split", M + "SELECT match_id, CASE WHEN season IN (1999, 2000) THEN 'test' ELSE 'train' END AS role FROM matches")
def season_split(spark, d):
    return E.season_split(matches(spark, d), [1999, 2000]).select("match_id", "role")


WALK = """per AS (SELECT season, COUNT(*) AS n, MIN(match_date) AS f, MAX(match_date) AS l FROM matches GROUP BY season),
wf AS (SELECT season AS fold, CAST(SUM(n) OVER w AS BIGINT) AS n_train, n AS n_test, CAST(MAX(l) OVER w AS VARCHAR) AS train_last_date, CAST(f AS VARCHAR) AS test_first_date, CAST(l AS VARCHAR) AS test_last_date
FROM per WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("E3_walk_forward", with_(MATCHES, WALK) + "SELECT * FROM wf WHERE n_train >= 500 AND n_test >= 50")
def walk_forward(spark, d):
    return E.walk_forward(matches(spark, d), min_train=500, min_test=50)


@query("E4_three_way_split", with_(MATCHES, RANKED) + "SELECT match_id, CASE WHEN k <= FLOOR(n * 0.8) THEN 'train' WHEN k <= FLOOR(n * 0.9) THEN 'validation' ELSE 'test' END AS role FROM rk")
def three_way_split(spark, d):
    return E.three_way_split(matches(spark, d)).select("match_id", "role")


@query("E5_fold_guard", M + """SELECT 1999 AS fold, 'season_overlap' AS problem UNION ALL SELECT 2000, 'empty_train' WHERE (SELECT COUNT(*) FROM matches WHERE season = 2000) > 0""")
def fold_guard(spark, d):
    """Three folds: 1998 sound, 1999 trained on its own season too, 2000 without training rows."""
    m = matches(spark, d)
    folded = D.season_expanding(m, FOLDS)
    leak = m.where("season = 1999").withColumn("fold", F.lit(1999)).withColumn("role", F.lit("train"))
    return E.fold_guard(folded.where("NOT (fold = 2000 AND role = 'train')").unionByName(leak))


@query("E6_fold_table", with_(MATCHES, WALK, """debut AS (SELECT team, MIN(season) AS season FROM (SELECT home_team AS team, season FROM matches UNION ALL SELECT away_team, season FROM matches) GROUP BY team)""") + """
SELECT wf.*, (SELECT STRING_AGG(CAST(p.season AS VARCHAR), ',' ORDER BY p.season) FROM per p WHERE p.season < wf.fold) AS train_seasons, (SELECT COUNT(*) FROM debut WHERE debut.season = wf.fold) AS unknown_teams
FROM wf WHERE fold IN (1998, 1999, 2000)""")
def fold_table(spark, d):
    return E.fold_table(matches(spark, d), FOLDS)
