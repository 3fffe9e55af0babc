"""Value selection against market odds and its settlement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import P_COLS
from .uncertainty import mcnemar_exact

ODDS = ("odds_away", "odds_draw", "odds_home")
THRESHOLDS = (0.0, 0.05, 0.10, 0.20, 0.30, 0.50, 0.75, 1.0)


def explode_outcomes(df: DataFrame, odds: Sequence[str] = ODDS, keep: Sequence[str] = ("match_id", "season", "division"), y: str = "y") -> DataFrame:
    """Three rows per match: model p, market p, odds, edge = p/q - 1, hit. Rows with odds missing or <= 0 are left out."""
    valid = F.lit(True)
    for o in odds:
        valid = valid & F.coalesce(F.col(o) > 0, F.lit(False))
    # inside the projection the odds are known to be positive
    inv = [1.0 / F.nullif(F.col(o), F.lit(0.0)) for o in odds]
    total = inv[0] + inv[1] + inv[2]
    rows = F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(p).alias("model_p"), (i / total).alias("market_p"), F.col(o).alias("odds"),
                              (F.col(p) / (i / total) - 1).alias("edge"), (F.col(y) == k).cast("int").alias("hit"))
                     for k, (p, o, i) in enumerate(zip(P_COLS, odds, inv))])
    return df.where(valid).select(*keep, F.explode(rows).alias("b")).select(*keep, "b.*")


def select_all(bets: DataFrame, t: float = 0.10) -> DataFrame:
    return bets.where(F.col("edge") > t)


def select_home(bets: DataFrame, t: float = 0.10) -> DataFrame:
    return bets.where((F.col("outcome") == 2) & (F.col("edge") > t))


def select_draw(bets: DataFrame, t: float = 0.10) -> DataFrame:
    return bets.where((F.col("outcome") == 1) & (F.col("edge") > t))


def select_away(bets: DataFrame, t: float = 0.10) -> DataFrame:
    return bets.where((F.col("outcome") == 0) & (F.col("edge") > t))


def select_best(bets: DataFrame, t: float = 0.10, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """The outcome with the highest edge per match, the earliest on ties."""
    others = [c for c in bets.columns if c not in keys]
    best = bets.where(F.col("edge") > t).groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct("edge", -F.col("outcome"))).alias("b"))
    return best.select(*keys, "b.*").select(*bets.columns)


def _ledger(stake: float):
    profit = F.sum(F.when(F.col("hit") == 1, F.col("odds") - 1).otherwise(-1.0)) * stake
    n = F.count(F.lit(1))
    share = F.nullif(n, F.lit(0))
    return [n.alias("bets"), F.coalesce(F.sum("hit"), F.lit(0)).alias("wins"), (100.0 * F.sum("hit") / share).alias("win_rate"),
            F.coalesce(profit, F.lit(0.0)).alias("profit"), (100.0 * profit / (share * stake)).alias("roi")]


def settle(bets: DataFrame, stake: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Bets, wins, win rate, profit and return in percent."""
    return bets.groupBy(*by).agg(*_ledger(stake))


def by_season_league(bets: DataFrame, stake: float = 1.0) -> DataFrame:
    """Settlement per season, per league and overall in one pass (null = all)."""
    s, d = F.col("season"), F.col("division")
    return bets.groupingSets([[s], [d], []], s, d).agg(*_ledger(stake))


def threshold_sweep(bets: DataFrame, thresholds: Sequence[float] = THRESHOLDS, stake: float = 1.0) -> DataFrame:
    """Best positive-edge pick per match, settled at every threshold it reaches.

    Each pick is matched with the thresholds by filtering a literal array.
    """
    picks = select_best(bets, 0.0)
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("edge"))
    return picks.withColumn("threshold", F.explode(reached)).groupBy("threshold").agg(*_ledger(stake))


def model_vs_market(joined: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Accuracy of model and market, their difference, McNemar's p and a verdict."""
    rows = joined.select(*by, (F.col("predicted") == F.col("y")).cast("int").alias("hit_a"), (F.col("market_pick") == F.col("y")).cast("int").alias("hit_b"))
    # counts of the 2 x 2 table carry everything
    acc = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("hit_a").alias("model_acc"), F.avg("hit_b").alias("market_acc"))
    test = mcnemar_exact(rows, by=by)
    both = acc.join(test, list(by)) if by else acc.select("*", *[test.select(c).scalar().alias(c) for c in ("b", "c", "p_value")])
    verdict = (F.when(F.col("p_value") >= alpha, "tie").when(F.col("model_acc") > F.col("market_acc"), "model").otherwise("market"))
    return both.withColumn("delta", F.col("model_acc") - F.col("market_acc")).withColumn("verdict", verdict)
