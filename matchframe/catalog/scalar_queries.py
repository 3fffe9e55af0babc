"""Sources' quality checks and row-wise features on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.stats import normal_cdf
from ..plans import views
from ..sources import files, quality
from .base import JOINED, MATCHES, PREDS, joined, matches, query, r, with_

M = with_(MATCHES)
LABEL = "CONCAT(CAST({s} AS VARCHAR), '-', LPAD(CAST(({s} + 1) % 100 AS VARCHAR), 2, '0'))"
# a file name per match; every 97th carries the following season's file
SRC_SEASON = "(season + CASE WHEN match_id % 97 = 0 THEN 1 ELSE 0 END)"
SOURCE_SQL = (f"CONCAT(division, LPAD(CAST({SRC_SEASON} % 100 AS VARCHAR), 2, '0'), "
              f"LPAD(CAST(({SRC_SEASON} + 1) % 100 AS VARCHAR), 2, '0'), '.csv')")


def sourced(spark, d):
    m = matches(spark, d)
    s = F.col("season") + F.when(F.col("match_id") % 97 == 0, 1).otherwise(0)
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    return m.withColumn("source_file", F.concat("division", two(s), two(s + 1), F.lit(".csv")))


SOURCED = "sourced AS (SELECT *, " + SOURCE_SQL + " AS source_file FROM matches)"


@query("A2_parse_match_date", M + """SELECT match_id, CAST(CASE WHEN match_id % 11 = 0 THEN NULL ELSE match_date END AS VARCHAR) AS date FROM matches""")
def parse_match_date(spark, d):
    m = matches(spark, d)
    text = (F.when(F.col("match_id") % 11 == 0, F.lit("31/31/2001"))
            .when(F.col("match_id") % 2 == 0, F.date_format("match_date", "dd/MM/yyyy")).otherwise(F.date_format("match_date", "dd/MM/yy")))
    return files.parse_match_date(m.select("match_id", text.alias("date")))


@query("A3_coerce_numeric", M + f"""SELECT match_id, {r("CASE WHEN match_id % 7 = 0 THEN NULL ELSE home_goals END AS home_goals_full", "home_shots")} FROM matches""")
def coerce_numeric(spark, d):
    m = matches(spark, d)
    text = m.select("match_id", F.when(F.col("match_id") % 7 == 0, "n/a").otherwise(F.col("home_goals").cast("string")).alias("home_goals_full"),
                    F.col("home_shots").cast("string").alias("home_shots"))
    return files.coerce_numeric(text)


@query("A5_add_targets", M + """SELECT match_id, CASE WHEN match_id % 13 = 0 THEN NULL ELSE y END AS target_result,
CAST(CASE WHEN match_id % 17 = 0 THEN NULL ELSE home_goals + away_goals END AS INT) AS total_goals,
CASE WHEN match_id % 17 <> 0 AND home_goals + away_goals > 2.5 THEN 1 ELSE 0 END AS target_over_2_5,
CASE WHEN match_id % 17 <> 0 AND home_goals > away_goals THEN 1 ELSE 0 END AS home_win FROM matches""")
def add_targets(spark, d):
    m = matches(spark, d)
    raw = m.select("match_id", F.when(F.col("match_id") % 17 != 0, F.col("home_goals")).alias("home_goals_full"),
                   F.col("away_goals").alias("away_goals_full"),
                   F.when(F.col("match_id") % 13 == 0, "?").otherwise(S.class_letter("y")).alias("result_full"))
    return quality.add_targets(raw).select("match_id", "target_result", "total_goals", "target_over_2_5", "home_win")


@query("A10_season_from_date", M + f"SELECT match_id, {LABEL.format(s='season')} AS season_label FROM matches")
def season_from_date(spark, d):
    return matches(spark, d).select("match_id", quality.season_from_date("match_date").alias("season_label"))


@query("A11_season_from_source", with_(MATCHES, SOURCED) + f"""SELECT match_id, source_file,
CASE WHEN {SRC_SEASON} % 100 = 99 THEN NULL ELSE CONCAT('20', SUBSTR(source_file, 3, 2), '-', SUBSTR(source_file, 5, 2)) END AS source_season FROM sourced""")
def season_from_source(spark, d):
    return sourced(spark, d).select("match_id", "source_file", quality.season_from_source("source_file", strict=False).alias("source_season"))


SHIFTED = """shifted AS (SELECT match_id, match_date + INTERVAL 10 YEAR AS d10, season + 10 AS season10, season + 10 + CASE WHEN match_id % 97 = 0 THEN 1 ELSE 0 END AS src, division FROM matches)"""


def shifted(spark, d):
    """The same matches ten years later, so that all file names belong to one century."""
    m = matches(spark, d)
    s = F.col("season") + 10 + F.when(F.col("match_id") % 97 == 0, 1).otherwise(0)
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    return m.withColumn("date", F.add_months("match_date", 120)).withColumn("source_file", F.concat("division", two(s), two(s + 1), F.lit(".csv")))


@query("A12_season_mismatch_report", with_(MATCHES, SHIFTED) + f"""SELECT match_id, {LABEL.format(s='src')} AS source_season, {LABEL.format(s='season10')} AS calendar_season
FROM shifted WHERE src <> season10""")
def season_mismatch_report(spark, d):
    return quality.season_mismatch_report(shifted(spark, d)).select("match_id", "source_season", "calendar_season")


@query("A13_source_file_audit", with_(MATCHES, SHIFTED) + f"""SELECT CONCAT(division, LPAD(CAST(src % 100 AS VARCHAR), 2, '0'), LPAD(CAST((src + 1) % 100 AS VARCHAR), 2, '0'), '.csv') AS source_file,
COUNT(*) AS matches, CAST(CAST(MIN(d10) AS DATE) AS VARCHAR) AS date_min, CAST(CAST(MAX(d10) AS DATE) AS VARCHAR) AS date_max,
SUM(CASE WHEN MONTH(d10) = 7 THEN 1 ELSE 0 END)::BIGINT AS july_matches, MIN({LABEL.format(s='src')}) AS assigned_season FROM shifted GROUP BY 1""")
def source_file_audit(spark, d):
    return quality.source_file_audit(shifted(spark, d))


SIDES = """lefts AS (SELECT match_id, home_goals, y FROM matches WHERE odds_home IS NOT NULL),
rights AS (SELECT match_id, GREATEST(home_goals, away_goals) AS home_goals, y FROM matches WHERE home_shots IS NOT NULL)"""


@query("A14_reconcile", with_(MATCHES, SIDES) + """SELECT COUNT(CASE WHEN l.match_id IS NOT NULL AND g.match_id IS NOT NULL AND l.home_goals = g.home_goals THEN 1 END) AS same,
COUNT(CASE WHEN l.home_goals <> g.home_goals THEN 1 END) AS mismatch, COUNT(CASE WHEN g.match_id IS NULL THEN 1 END) AS left_only,
COUNT(CASE WHEN l.match_id IS NULL THEN 1 END) AS right_only, CAST(0 AS BIGINT) AS repeated_key,
COUNT(CASE WHEN l.home_goals <> g.home_goals THEN 1 END) AS fields_differ
FROM lefts l FULL OUTER JOIN rights g ON l.match_id = g.match_id""")
def reconcile_summary(spark, d):
    """Matches with odds against matches with shots, the latter carrying the larger score."""
    m = matches(spark, d)
    left = m.where("odds_home IS NOT NULL").select("match_id", "home_goals", "y")
    right = m.where("home_shots IS NOT NULL").select("match_id", F.greatest("home_goals", "away_goals").alias("home_goals"), "y")
    return quality.reconcile_summary(quality.reconcile(left, right, ["match_id"], ["home_goals", "y"]))


@query("A16_contract_checks", M + """SELECT 'unique_fixture' AS rule, CONCAT(match_date, '|', home_team, '|', away_team) AS detail, COUNT(*) AS n_rows
FROM matches GROUP BY match_date, home_team, away_team HAVING COUNT(*) > 1
UNION ALL SELECT 'once_a_day', CONCAT(match_date, '|', team), COUNT(*) FROM (SELECT match_date, home_team AS team FROM matches UNION ALL SELECT match_date, away_team FROM matches)
GROUP BY match_date, team HAVING COUNT(*) > 1""")
def contract_checks(spark, d):
    return quality.contract_checks(matches(spark, d))


@query("A17_data_audit", M + """SELECT season, COUNT(*) AS matches, CAST(MIN(match_date) AS VARCHAR) AS date_min, CAST(MAX(match_date) AS VARCHAR) AS date_max,
66 AS n_features FROM matches GROUP BY ROLLUP (season)""")
def data_audit(spark, d):
    return quality.data_audit(matches(spark, d), 66)


@query("A18_coverage_report", M + f"""SELECT season, division, COUNT(*) AS n, COUNT(odds_home) AS n_present,
{r("AVG(CASE WHEN odds_home IS NULL THEN 0.0 ELSE 1.0 END) AS share_present")} FROM matches GROUP BY season, division""")
def coverage_report(spark, d):
    return quality.coverage_report(matches(spark, d), "odds_home")


T3 = "(1 / odds_home + 1 / odds_draw + 1 / odds_away)"


@query("B1_devig_odds", M + f"""SELECT match_id, {r(f"(1 / odds_home) / {T3} AS impl_home", f"(1 / odds_draw) / {T3} AS impl_draw", f"(1 / odds_away) / {T3} AS impl_away", f"{T3} - 1 AS overround", "(1 / odds_home) / (1 / odds_home + 1 / odds_away) AS two_home", "(1 / odds_away) / (1 / odds_home + 1 / odds_away) AS two_away")} FROM matches""")
def devig_odds(spark, d):
    df = S.devig_odds(matches(spark, d), {"home": "odds_home", "draw": "odds_draw", "away": "odds_away"})
    df = S.devig_odds(df, {"home": "odds_home", "away": "odds_away"}, prefix="two_", overround=None)
    return df.select("match_id", "impl_home", "impl_draw", "impl_away", "overround", "two_home", "two_away")


@query("B2_market_probs", with_(MATCHES, PREDS, JOINED) + f"SELECT match_id, {r('q_away', 'q_draw', 'q_home')} FROM joined")
def market_probs(spark, d):
    return S.market_probs(matches(spark, d)).select("match_id", "q_away", "q_draw", "q_home")


# odds with unusable values: below 1.01, zero, missing
BAD = """bad AS (SELECT match_id, CASE WHEN match_id % 31 = 0 THEN 0.0 WHEN match_id % 37 = 0 THEN 0.9 ELSE odds_home END AS odds_home, odds_draw, odds_away FROM matches)"""


def _bad(m):
    k = F.col("match_id")
    return m.select("match_id", F.when(k % 31 == 0, 0.0).when(k % 37 == 0, 0.9).otherwise(F.col("odds_home")).alias("odds_home"), "odds_draw", "odds_away")


def _variant_sql(oh: str, where: str = "", extra: str = "", default: str | None = None) -> str:
    t = f"(1 / odds_away + 1 / odds_draw + 1 / {oh})"
    wrap = (lambda e: f"COALESCE({e}, {default})") if default else (lambda e: e)
    cols = r(wrap(f"(1 / odds_away) / {t}") + " AS q_away", wrap(f"(1 / odds_draw) / {t}") + " AS q_draw", wrap(f"(1 / {oh}) / {t}") + " AS q_home")
    return with_(MATCHES, BAD) + f"SELECT match_id, {cols}{extra} FROM bad {where}"


@query("B2v_floor", _variant_sql("CASE WHEN odds_home IS NOT NULL THEN GREATEST(odds_home, 1.01) END"))
def market_floor(spark, d):
    return S.market_probs(_bad(matches(spark, d)), on_invalid="floor").select("match_id", "q_away", "q_draw", "q_home")


@query("B2v_null", _variant_sql("NULLIF(odds_home, 0)"))
def market_null(spark, d):
    return S.market_probs(_bad(matches(spark, d)), on_invalid="null").select("match_id", "q_away", "q_draw", "q_home")


@query("B2v_payout", _variant_sql("(CASE WHEN odds_home > 1 THEN odds_home END)", default="1.0 / 3",
                                  extra=", CASE WHEN odds_home > 1 THEN odds_home ELSE 999.0 END AS pay_home"))
def market_payout(spark, d):
    return S.market_probs(_bad(matches(spark, d)), on_invalid="payout").select("match_id", "q_away", "q_draw", "q_home", "pay_home")


@query("B2v_drop", _variant_sql("odds_home", where="WHERE odds_home > 1"))
def market_drop(spark, d):
    return S.market_probs(_bad(matches(spark, d)), on_invalid="drop").select("match_id", "q_away", "q_draw", "q_home")


@query("B3_market_pick", with_(MATCHES, PREDS, JOINED) + """SELECT match_id, market_pick AS away_first,
CASE WHEN q_home >= q_draw AND q_home >= q_away THEN 2 WHEN q_draw >= q_away THEN 1 ELSE 0 END AS home_first FROM joined""")
def market_pick(spark, d):
    df = S.market_probs(matches(spark, d))
    df = S.market_pick(S.market_pick(df, out="away_first"), tie="home", out="home_first")
    return df.select("match_id", "away_first", "home_first")


@query("B4_predicted_class", with_(MATCHES, PREDS) + """SELECT match_id, model,
CASE WHEN p_away >= p_draw AND p_away >= p_home THEN 0 WHEN p_draw >= p_home THEN 1 ELSE 2 END AS predicted FROM preds""")
def predicted_class(spark, d):
    return S.predicted_class(views.preds(matches(spark, d))).select("match_id", "model", "predicted")


CLUB = "CONCAT('Club ', LPAD(CAST({0} AS VARCHAR), 2, '0'))"


@query("B5_map_names", M + f"""SELECT match_id, CASE WHEN home_team < 39 THEN {CLUB.format('home_team')} END AS strict_home,
CASE WHEN home_team < 39 THEN {CLUB.format('home_team')} ELSE CAST(home_team AS VARCHAR) END AS lenient_home FROM matches""")
def map_names(spark, d):
    names = views.name_map(spark)
    df = S.map_names(matches(spark, d), ["home_team"], names, suffix="_s")
    df = S.map_names(df, ["home_team"], names, lenient=True, suffix="_l")
    return df.select("match_id", F.col("home_team_s").alias("strict_home"), F.col("home_team_l").alias("lenient_home"))


@query("B6_diff_columns", M + f"SELECT match_id, {r('home_shots - away_shots AS shots_diff', 'odds_home - odds_away AS odds_diff')} FROM matches")
def diff_columns(spark, d):
    df = S.diff_columns(matches(spark, d), {"shots_diff": ("home_shots", "away_shots"), "odds_diff": ("odds_home", "odds_away")})
    return df.select("match_id", "shots_diff", "odds_diff")


@query("B7_availability_flags", M + """SELECT match_id, CASE WHEN home_shots > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_home_shots,
CASE WHEN odds_home > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_odds_home FROM matches""")
def availability_flags(spark, d):
    return S.availability_flags(matches(spark, d), ["home_shots", "odds_home"]).select("match_id", "has_home_shots", "has_odds_home")


@query("B8_one_hot_league", M + "SELECT match_id, " + ", ".join(f"CASE WHEN division = 'E{i}' THEN 1.0 ELSE 0.0 END::DOUBLE AS league_E{i}" for i in range(4)) + " FROM matches")
def one_hot_league(spark, d):
    return S.one_hot_league(matches(spark, d), [f"E{i}" for i in range(4)]).select("match_id", *[f"league_E{i}" for i in range(4)])


@query("B9_league_level", M + "SELECT match_id, CAST(SUBSTR(division, 2, 1) AS INT) AS level FROM matches")
def league_level(spark, d):
    return S.league_level(matches(spark, d), out="level").select("match_id", "level")


@query("B11_pair_key", M + "SELECT match_id, LEAST(home_team, away_team) AS team_low, GREATEST(home_team, away_team) AS team_high FROM matches")
def pair_key(spark, d):
    return S.pair_key(matches(spark, d)).select("match_id", "team_low", "team_high")


@query("B12_labels_text", with_(MATCHES, PREDS, JOINED) + """SELECT match_id, SUBSTR('ADH', y + 1, 1) AS actual_letter, SUBSTR('ADH', predicted + 1, 1) AS predicted_letter,
CONCAT(home_goals, '-', away_goals) AS score_text, CASE WHEN y = predicted THEN 1 ELSE 0 END AS correct FROM joined""")
def labels_text(spark, d):
    return S.labels_text(joined(spark, d)).select("match_id", "actual_letter", "predicted_letter", "score_text", "correct")


@query("B13_select_features", with_(MATCHES, PREDS, JOINED) + f"SELECT match_id, league_level, {r('p_away', 'p_draw', 'p_home', 'q_away', 'q_draw', 'q_home')}, predicted, market_pick FROM joined")
def select_features(spark, d):
    return S.select_features(joined(spark, d), keep=["match_id"])


@query("B15_impute_mean", M + f"""SELECT match_id, season, {r("COALESCE(home_shots, (SELECT AVG(home_shots) FROM matches WHERE season < 1999)) AS home_shots", "COALESCE(odds_home, (SELECT AVG(odds_home) FROM matches WHERE season < 1999)) AS odds_home")} FROM matches WHERE season >= 1999""")
def impute_mean(spark, d):
    m = matches(spark, d)
    return S.impute_mean(m.where("season < 1999"), m.where("season >= 1999"), ["home_shots", "odds_home"]).select("match_id", "season", "home_shots", "odds_home")


@query("B15_impute_own", M + f"""SELECT match_id, {r("COALESCE(home_shots, (SELECT AVG(home_shots) FROM matches WHERE season >= 1999)) AS home_shots")} FROM matches WHERE season >= 1999""")
def impute_own(spark, d):
    m = matches(spark, d)
    return S.impute_mean(m.where("season < 1999"), m.where("season >= 1999"), ["home_shots"], own_means=True).select("match_id", "home_shots")


@query("B16_standardize", M + f"""SELECT match_id, {r("(home_shots - (SELECT AVG(home_shots) FROM matches WHERE season < 1999)) / (SELECT STDDEV_POP(home_shots) FROM matches WHERE season < 1999) AS home_shots", "(odds_away - (SELECT AVG(odds_away) FROM matches WHERE season < 1999)) / (SELECT STDDEV_POP(odds_away) FROM matches WHERE season < 1999) AS odds_away")} FROM matches WHERE season >= 1999""")
def standardize(spark, d):
    m = matches(spark, d)
    return S.standardize(m.where("season < 1999"), m.where("season >= 1999"), ["home_shots", "odds_away"]).select("match_id", "home_shots", "odds_away")


@query("B17_filters", M + "SELECT match_id, season, division FROM matches WHERE season IN (1997, 1999) AND odds_home > 1 AND odds_draw > 1 AND home_shots IS NOT NULL")
def filters(spark, d):
    return S.filter_rows(matches(spark, d), seasons=[1997, 1999], valid_odds=["odds_home", "odds_draw"], not_null=["home_shots"]).select("match_id", "season", "division")


# normal distribution and binomial tail, see functions/stats.py
def normal_cdf_sql(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.2316419 * ABS({z})))"
    poly = "0.0"
    for b in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = f"(({poly}) + ({b})) * {t}"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - EXP(-{z} * {z} / 2.0) / 2.5066282746310002 * ({poly}) ELSE EXP(-{z} * {z} / 2.0) / 2.5066282746310002 * ({poly}) END)"


@query("F_normal_cdf", M + f"SELECT match_id, {r(normal_cdf_sql('(home_goals - away_goals + odds_draw - 3.5)') + ' AS cdf')} FROM matches")
def normal_cdf_query(spark, d):
    return matches(spark, d).select("match_id", normal_cdf(F.col("home_goals") - F.col("away_goals") + F.col("odds_draw") - 3.5).alias("cdf"))
