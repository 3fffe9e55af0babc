"""Where a model and the market go wrong.

`joined` has one row per match: class y, model p_*, market q_*, and the two picks
`predicted` and `market_pick`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import P_COLS
from .metrics import calibration_bins, row_brier, row_log_loss

Q_COLS = ("q_away", "q_draw", "q_home")
# bracket edges (fixed values)
MARKET_EDGES = (0.30, 0.40, 0.45, 0.50, 0.55, 0.65, 0.80)
CONFIDENCE_EDGES = (0.40, 0.45, 0.50, 0.55, 0.65, 0.80)
GAP_EDGES = (-0.8, -0.4, -0.1, 0.1, 0.4, 0.8)


def bracket(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value: 0 .. len(edges)."""
    out = F.lit(0)
    for e in edges:
        out = out + (value >= e).cast("int")
    return out


def _hit(col: str) -> Column:
    return F.avg((F.col(col) == F.col("y")).cast("double"))


def _both_sides() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_matches"), _hit("predicted").alias("model_acc"), _hit("market_pick").alias("market_acc"),
            F.avg(row_brier("y", P_COLS)).alias("model_brier"), F.avg(row_brier("y", Q_COLS)).alias("market_brier")]


def _by_bracket(joined: DataFrame, value: Column, edges: Sequence[float], min_n: int, extra: Sequence[Column] = ()) -> DataFrame:
    out = joined.withColumn("_v", value).groupBy(bracket(F.col("_v"), edges).alias("bracket")).agg(
        *_both_sides(), F.avg("_v").alias("mean_value"), *extra)
    return out.where(F.col("n_matches") >= min_n).withColumn("delta_acc", F.col("model_acc") - F.col("market_acc"))


def by_market_bracket(joined: DataFrame, edges: Sequence[float] = MARKET_EDGES, min_n: int = 5) -> DataFrame:
    return _by_bracket(joined, F.col("q_home"), edges, min_n)


def by_confidence(joined: DataFrame, edges: Sequence[float] = CONFIDENCE_EDGES, min_n: int = 5) -> DataFrame:
    out = _by_bracket(joined, F.greatest(*P_COLS), edges, min_n)
    return out.withColumn("overconfidence", F.col("mean_value") - F.col("model_acc"))


def by_strength_gap(joined: DataFrame, gap_col: str, edges: Sequence[float] = GAP_EDGES, min_n: int = 5) -> DataFrame:
    return _by_bracket(joined, F.coalesce(F.col(gap_col), F.lit(0.0)), edges, min_n)


def by_season(joined: DataFrame, season: str = "season") -> DataFrame:
    return joined.groupBy(season).agg(*_both_sides(), F.avg(row_log_loss("y", P_COLS)).alias("model_log_loss"),
                                      F.avg(row_log_loss("y", Q_COLS)).alias("market_log_loss"))


def calibration_table(joined: DataFrame, bins: int = 10, min_n: int = 10) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(name).alias("source"), *[F.col(c).alias(p) for c, p in zip(cols, P_COLS)])
                      for name, cols in (("model", P_COLS), ("market", Q_COLS))])
    long = joined.select("y", F.explode(sides).alias("s")).select("y", "s.*")
    return calibration_bins(long, bins, "half_open", min_n, by=("source",))


def disagreement(joined: DataFrame) -> DataFrame:
    """Agreement x who is right, per true outcome and over all outcomes (outcome null)."""
    agree = F.col("predicted") == F.col("market_pick")
    model, market = F.col("predicted") == F.col("y"), F.col("market_pick") == F.col("y")
    right = F.when(model & market, "both").when(model, "model").when(market, "market").otherwise("none")
    return (joined.select(F.col("y").alias("outcome"), agree.cast("int").alias("agree"), right.alias("right"))
            .groupingSets([[F.col("outcome"), F.col("agree"), F.col("right")], [F.col("agree"), F.col("right")]],
                          F.col("outcome"), F.col("agree"), F.col("right"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_patterns(joined: DataFrame) -> DataFrame:
    names = ((0, "away"), (1, "draw"), (2, "home"))
    cols = [F.count_if(F.col(c) == k).alias(f"{src}_pred_{n}") for src, c in (("model", "predicted"), ("market", "market_pick")) for k, n in names]
    return joined.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("y")).alias("model_correct"),
                                   F.count_if(F.col("market_pick") == F.col("y")).alias("market_correct"), *cols)


def error_log(joined: DataFrame, limit: int = 30, order: Sequence[str] = ("match_date", "match_id"), keep: Sequence[str] = ("match_id",)) -> DataFrame:
    """The first rows of each error type; the limit is applied before the shuffle."""
    model, market = F.col("predicted") == F.col("y"), F.col("market_pick") == F.col("y")
    kind = F.when(~model & ~market, "both_wrong").when(~model & market, "only_model_wrong").when(model & ~market, "only_market_wrong")
    rows = joined.withColumn("error_type", kind).where(F.col("error_type").isNotNull())
    first = Window.partitionBy("error_type").orderBy(*order)
    return (rows.withColumn("position", F.row_number().over(first)).where(F.col("position") <= limit)
            .select("error_type", "position", *keep, "y", "predicted", "market_pick", F.greatest(*P_COLS).alias("model_confidence"),
                    F.greatest(*Q_COLS).alias("market_confidence")))


def best_worst(bracket_table: DataFrame) -> DataFrame:
    """Bracket with the largest and with the smallest accuracy gain."""
    return bracket_table.agg(F.max_by("bracket", F.struct("delta_acc", -F.col("bracket"))).alias("best_bracket"), F.max("delta_acc").alias("best_delta"),
                             F.min_by("bracket", F.struct("delta_acc", "bracket")).alias("worst_bracket"), F.min("delta_acc").alias("worst_delta"))
