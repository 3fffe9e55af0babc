"""Splits by time and season, and the checks that keep them honest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import single_row
from ..plans.blocks import BEFORE, ROWS_PER_BLOCK, dated_rank


def _cut(df: DataFrame, shares: Sequence[float]) -> list:
    """int(N * share) as columns, from one scalar subquery."""
    n = single_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    return n, [F.floor(n * F.lit(s) + F.lit(1e-9)).cast("bigint") for s in shares]


def temporal_split(df: DataFrame, test_ratio: float = 0.2, min_train: int = 100, date: str = "match_date",
                   id_col: str = "match_id", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Role 'train' for the first int(N * (1 - ratio)) rows by date, at least min_train; else 'test'."""
    ranked = dated_rank(df, [], date, id_col, "_rank", rows_per_block)
    _, (cut,) = _cut(df, [1.0 - test_ratio])
    return (ranked.withColumn("role", F.when(F.col("_rank") <= F.greatest(cut, F.lit(min_train)), "train").otherwise("test"))
            .drop("_rank"))


def three_way_split(df: DataFrame, val_ratio: float = 0.1, test_ratio: float = 0.1, date: str = "match_date",
                    id_col: str = "match_id", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    ranked = dated_rank(df, [], date, id_col, "_rank", rows_per_block)
    _, (first, second) = _cut(df, [1.0 - val_ratio - test_ratio, 1.0 - test_ratio])
    role = (F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= second, "validation").otherwise("test"))
    return ranked.withColumn("role", role).drop("_rank")


def season_split(df: DataFrame, test_seasons: Sequence, season: str = "season") -> DataFrame:
    return df.withColumn("role", F.when(F.col(season).isin(*test_seasons), "test").otherwise("train"))


def _per_season(df: DataFrame, season: str, date: str) -> DataFrame:
    return df.groupBy(season).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def walk_forward(df: DataFrame, seasons: Sequence[int] | None = None, min_train: int = 1, min_test: int = 1,
                 season: str = "season", date: str = "match_date") -> DataFrame:
    """Folds as a small table: test season, sizes and boundary dates of the seasons before it.

    Fold rows come from per-season counts; use `season_expanding` or plain filters
    to get the matches of a fold.
    """
    per = _per_season(df, season, date)
    w = Window.orderBy(season).rowsBetween(*BEFORE)  # one row per season
    folds = per.select(F.col(season).alias("fold"), F.sum("n").over(w).alias("n_train"), F.col("n").alias("n_test"),
                       F.max("last_date").over(w).alias("train_last_date"), F.col("first_date").alias("test_first_date"),
                       F.col("last_date").alias("test_last_date"))
    if seasons is not None:
        folds = folds.where(F.col("fold").isin(*seasons))
    return folds.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))


def fold_guard(df: DataFrame, role: str = "role", fold: str = "fold", season: str = "season", date: str = "match_date") -> DataFrame:
    """Broken folds: no training rows, training holds the test season, or training reaches the test dates."""
    train, test = F.col(role) == "train", F.col(role) == "test"
    per = df.groupBy(fold).agg(
        F.count_if(train).alias("n_train"), F.max(F.when(train, F.col(date))).alias("train_last"),
        F.min(F.when(test, F.col(date))).alias("test_first"), F.max(F.when(train, F.col(season))).alias("train_season"),
        F.min(F.when(test, F.col(season))).alias("test_season"))
    problem = (F.when(F.col("n_train") == 0, "empty_train")
               .when(F.col("train_season") >= F.col("test_season"), "season_overlap")
               .when(F.col("train_last") >= F.col("test_first"), "date_overlap"))
    return per.select(fold, problem.alias("problem")).where(F.col("problem").isNotNull())


def check_fold(train: DataFrame, test: DataFrame, season: str = "season", date: str = "match_date") -> None:
    """Raise before a fit whose training rows overlap the test season (one small job)."""
    both = (train.select(season, date, F.lit("train").alias("role"))
            .unionByName(test.select(season, date, F.lit("test").alias("role"))).withColumn("fold", F.lit(0)))
    bad = fold_guard(both, season=season, date=date).collect()  # at most one row
    if bad:
        raise ValueError(f"training rows overlap the test season: {bad[0]['problem']}")


def fold_table(df: DataFrame, folds: Sequence[int], season: str = "season", date: str = "match_date") -> DataFrame:
    """Per fold: training seasons, sizes, boundary dates, teams of the test season unseen before."""
    base = walk_forward(df, folds, season=season, date=date)
    per = _per_season(df, season, date)
    w = Window.orderBy(season).rowsBetween(*BEFORE)
    seasons = per.select(F.col(season).alias("fold"),
                         F.concat_ws(",", F.sort_array(F.collect_list(F.col(season).cast("string")).over(w))).alias("train_seasons"))
    debut = (df.select(season, F.explode(F.array("home_team", "away_team")).alias("team"))
             .groupBy("team").agg(F.min(season).alias("fold")))
    new = debut.groupBy("fold").agg(F.count(F.lit(1)).alias("unknown_teams"))
    return base.join(seasons, "fold").join(new, "fold", "left").na.fill(0, subset=["unknown_teams"])
