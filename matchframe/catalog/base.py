"""Registration of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import views
from ..plans.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# values that end in a 5 on the seventh digit would be rounded by the last bit of
# each engine's sum; both sides move them off that border first
NUDGE = 1e-9


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to six digits, dates as text."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c + F.lit(NUDGE), DIGITS).alias(f.name)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with its SQL where one exists."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return tidy(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r(*cols: str, prefix: str = "") -> str:
    """SQL: each column rounded under its own name ("expr AS name" allowed)."""
    out = []
    for c in cols:
        expr, _, name = c.rpartition(" AS ")
        expr, name = (expr, name) if expr else (prefix + c, c)
        out.append(f"ROUND(CAST({expr} AS DOUBLE) + 1e-9, {DIGITS}) + 0.0 AS {name}")
    return ", ".join(out)


# ---- shared common table expressions

MATCHES = """matches AS (
SELECT o.o_orderkey AS match_id, CAST(o.o_orderdate AS DATE) AS match_date,
  CASE WHEN MONTH(o.o_orderdate) >= 8 THEN CAST(YEAR(o.o_orderdate) AS INT) ELSE CAST(YEAR(o.o_orderdate) AS INT) - 1 END AS season,
  CONCAT('E', CAST(o.o_orderkey % 4 AS VARCHAR)) AS division, CAST(o.o_orderkey % 4 AS INT) AS league_level,
  CAST(o.o_custkey % 40 AS INT) AS home_team, CAST((o.o_custkey % 40 + 1 + o.o_orderkey % 39) % 40 AS INT) AS away_team,
  CAST(COALESCE(l.hg, 0) AS INT) AS home_goals, CAST(COALESCE(l.ag, 0) AS INT) AS away_goals,
  CASE WHEN COALESCE(l.hg, 0) > COALESCE(l.ag, 0) THEN 2 WHEN COALESCE(l.hg, 0) = COALESCE(l.ag, 0) THEN 1 ELSE 0 END AS y,
  l.hs AS home_shots, l.aws AS away_shots, l.hst AS home_sot, l.awst AS away_sot,
  CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE CAST(120 + (o.o_orderkey * 37) % 400 AS DOUBLE) / 100 END AS odds_home,
  CAST(280 + (o.o_orderkey * 53) % 200 AS DOUBLE) / 100 AS odds_draw,
  CAST(130 + (o.o_orderkey * 71) % 500 AS DOUBLE) / 100 AS odds_away
FROM orders o LEFT JOIN (
  SELECT l_orderkey,
    SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hg, SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS ag,
    SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS hs, SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS aws,
    SUM(CASE WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN l_quantity ELSE 0 END) AS hst,
    SUM(CASE WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN l_quantity ELSE 0 END) AS awst
  FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

PREDS = """preds AS (
SELECT m.match_id, m.season, m.division, m.match_date, m.y, t.model,
  CAST(1 + (m.match_id * t.a) % 89 AS DOUBLE) / (3 + (m.match_id * t.a) % 89 + (m.match_id * t.b) % 53 + (m.match_id * t.c) % 97) AS p_away,
  CAST(1 + (m.match_id * t.b) % 53 AS DOUBLE) / (3 + (m.match_id * t.a) % 89 + (m.match_id * t.b) % 53 + (m.match_id * t.c) % 97) AS p_draw,
  CAST(1 + (m.match_id * t.c) % 97 AS DOUBLE) / (3 + (m.match_id * t.a) % 89 + (m.match_id * t.b) % 53 + (m.match_id * t.c) % 97) AS p_home
FROM matches m CROSS JOIN (SELECT 'm1' AS model, 31 AS a, 17 AS b, 13 AS c UNION ALL SELECT 'm2' AS model, 29 AS a, 23 AS b, 11 AS c) t)"""

# predicted class, hit, log loss and Brier score of every prediction
SCORED = """scored AS (
SELECT *, CASE WHEN p_away >= p_draw AND p_away >= p_home THEN 0 WHEN p_draw >= p_home THEN 1 ELSE 2 END AS predicted,
  -LN(CASE y WHEN 0 THEN p_away WHEN 1 THEN p_draw ELSE p_home END) AS ll,
  (POWER((CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) - p_away, 2) + POWER((CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) - p_draw, 2)
   + POWER((CASE WHEN y = 2 THEN 1.0 ELSE 0.0 END) - p_home, 2)) / 3 AS br
FROM preds)"""

FEED = """feed AS (
SELECT match_date AS feed_date, season AS feed_season, CONCAT('Club ', LPAD(CAST(home_team AS VARCHAR), 2, '0')) AS home_name,
  CONCAT('Club ', LPAD(CAST(away_team AS VARCHAR), 2, '0')) AS away_name, CAST((match_id * 7) % 300 AS DOUBLE) / 100 AS home_ppg,
  CAST((match_id * 11) % 300 AS DOUBLE) / 100 AS away_ppg, CAST((match_id * 3) % 250 AS DOUBLE) / 100 AS home_xg,
  CAST((match_id * 19) % 250 AS DOUBLE) / 100 AS away_xg
FROM matches WHERE match_id % 5 <> 0)"""

PLAYERS = """players AS (
SELECT c_custkey AS player_id, CAST(1995 + c_custkey % 6 AS INT) AS season, CAST(c_nationkey AS INT) AS club_id,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Goalkeeper' WHEN 'BUILDING' THEN 'Defender' WHEN 'MACHINERY' THEN 'Midfielder'
    WHEN 'FURNITURE' THEN 'Midfielder' ELSE 'Forward' END AS position,
  CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(17 + c_custkey % 20 AS DOUBLE) END AS age,
  CASE WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal / 3 END AS minutes,
  CAST((c_custkey * 7) % 12 AS INT) AS goals, CAST((c_custkey * 5) % 9 AS INT) AS assists
FROM customer)"""

TEAM_ROWS = """team_rows AS (
SELECT *, gf - ga AS goal_diff, CASE WHEN gf > ga THEN 3.0 WHEN gf = ga THEN 1.0 ELSE 0.0 END AS points,
  CASE WHEN gf > ga THEN 1.0 WHEN gf = ga THEN 0.0 ELSE -1.0 END AS result,
  GREATEST(gf - ga, 0.0) AS win_margin, GREATEST(ga - gf, 0.0) AS loss_margin
FROM (SELECT match_id, match_date, season, division, 'home' AS venue, home_team AS team, away_team AS opponent,
        CAST(home_goals AS DOUBLE) AS gf, CAST(away_goals AS DOUBLE) AS ga, home_shots AS shots, home_sot AS sot FROM matches
      UNION ALL SELECT match_id, match_date, season, division, 'away', away_team, home_team, CAST(away_goals AS DOUBLE),
        CAST(home_goals AS DOUBLE), away_shots, away_sot FROM matches))"""

# one row per match: model m1, the market (1/3 each when odds are unusable), both picks
JOINED = """joined AS (
SELECT *, CASE WHEN p_away >= p_draw AND p_away >= p_home THEN 0 WHEN p_draw >= p_home THEN 1 ELSE 2 END AS predicted,
  CASE WHEN q_away >= q_draw AND q_away >= q_home THEN 0 WHEN q_draw >= q_home THEN 1 ELSE 2 END AS market_pick
FROM (SELECT m.*, p.p_away, p.p_draw, p.p_home,
    COALESCE((1 / m.odds_away) / (1 / m.odds_away + 1 / m.odds_draw + 1 / m.odds_home), 1.0 / 3) AS q_away,
    COALESCE((1 / m.odds_draw) / (1 / m.odds_away + 1 / m.odds_draw + 1 / m.odds_home), 1.0 / 3) AS q_draw,
    COALESCE((1 / m.odds_home) / (1 / m.odds_away + 1 / m.odds_draw + 1 / m.odds_home), 1.0 / 3) AS q_home
  FROM matches m JOIN preds p ON p.match_id = m.match_id AND p.model = 'm1'))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.matches(spark, sf_dir)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import market_pick, market_probs, predicted_class
    m = views.matches(spark, sf_dir)
    p = views.preds(m).where("model = 'm1'").select("match_id", "p_away", "p_draw", "p_home")
    return market_pick(predicted_class(market_probs(m.join(p, "match_id"))))
