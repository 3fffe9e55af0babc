"""Seasons, targets and checks on match tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import letter_class

SOURCE_NAME = r"^E([0-3])(\d{2})(\d{2})\.csv$"


def add_targets(df: DataFrame, home: str = "home_goals_full", away: str = "away_goals_full",
                result: str = "result_full", null_as_zero: bool = True) -> DataFrame:
    """Class, total goals, over-2.5 and home-win flags.

    Missing goals make both flags 0 (a comparison with a missing number is false);
    null_as_zero=False keeps them null.
    """
    total = F.col(home) + F.col(away)
    over, win = (total > 2.5).cast("int"), (F.col(home) > F.col(away)).cast("int")
    if null_as_zero:
        over, win = F.coalesce(over, F.lit(0)), F.coalesce(win, F.lit(0))
    return (df.withColumn("target_result", letter_class(result)).withColumn("total_goals", total)
            .withColumn("target_over_2_5", over).withColumn("home_win", win))


def season_start(date) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.year(d) - F.when(F.month(d) >= 8, 0).otherwise(1)


def season_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_from_date(date) -> Column:
    """'2022-23' for a day from August 2022 to July 2023."""
    return season_label(season_start(date))


def season_from_source(name, strict: bool = True) -> Column:
    """Season of a file named E<level><YY><YY+1>.csv; other names raise (strict) or give null."""
    n = F.col(name) if isinstance(name, str) else name
    first = F.try_to_number(F.nullif(F.regexp_extract(n, SOURCE_NAME, 2), F.lit("")), F.lit("99")).cast("int")
    second = F.try_to_number(F.nullif(F.regexp_extract(n, SOURCE_NAME, 3), F.lit("")), F.lit("99")).cast("int")
    label = F.concat(F.lit("20"), F.regexp_extract(n, SOURCE_NAME, 2), F.lit("-"), F.regexp_extract(n, SOURCE_NAME, 3))
    good = second == first + 1
    if strict:
        bad = F.raise_error(F.concat(F.lit("Invalid source season: "), F.coalesce(n, F.lit("<null>")))).cast("string")
        return F.when(F.coalesce(good, F.lit(False)), label).otherwise(bad)
    return F.when(good, label)


def season_mismatch_report(df: DataFrame, source: str = "source_file", date: str = "date") -> DataFrame:
    """Rows whose calendar season is not the season of their file."""
    return (df.withColumn("source_season", season_from_source(source))
            .withColumn("calendar_season", season_from_date(date))
            .where(F.col("source_season") != F.col("calendar_season")))


def source_file_audit(df: DataFrame, source: str = "source_file", date: str = "date",
                      hashes: DataFrame | None = None) -> DataFrame:
    out = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("matches"), F.min(date).alias("date_min"), F.max(date).alias("date_max"),
        F.count_if(F.month(date) == 7).alias("july_matches"))
    out = out.withColumn("assigned_season", season_from_source(source, strict=False))
    return out.join(hashes, source, "left") if hashes is not None else out


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key: which side has it, how often, and how many listed fields differ.

    Both sides are reduced to one row per key first, so a repeated key costs one
    row in the join, not a product.
    """
    def side(df, mark):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{mark}"),
                                     *[F.min(f).alias(f"{f}_{mark}") for f in fields],
                                     *[F.max(f).alias(f"{f}_{mark}_max") for f in fields])
    a, b = side(left, "left"), side(right, "right")
    joined = a.join(b, list(keys), "full_outer")
    differ = F.lit(0)
    for f in fields:
        same = (F.col(f"{f}_left").eqNullSafe(F.col(f"{f}_right"))
                & F.col(f"{f}_left_max").eqNullSafe(F.col(f"{f}_right_max")))
        differ = differ + F.when(same, 0).otherwise(1)
    both = F.col("n_left").isNotNull() & F.col("n_right").isNotNull()
    status = (F.when(F.col("n_right").isNull(), "left_only").when(F.col("n_left").isNull(), "right_only")
              .when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated_key")
              .when(differ > 0, "mismatch").otherwise("same"))
    return joined.select(*keys, "n_left", "n_right", F.when(both, differ).otherwise(0).alias("n_differ"),
                         status.alias("status"))


def reconcile_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s)
                      for s in ("same", "mismatch", "left_only", "right_only", "repeated_key")],
                    F.coalesce(F.sum("n_differ"), F.lit(0)).alias("fields_differ"))


def _violation(df: DataFrame, rule: str, detail: Column, n: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"), n.cast("bigint").alias("n_rows"))


def contract_checks(df: DataFrame, rules: Sequence[str] = ("not_null", "unique_fixture", "once_a_day", "score_agrees", "file_division"),
                    date: str = "match_date", target: str = "y", home: str = "home_team", away: str = "away_team",
                    home_goals: str = "home_goals", away_goals: str = "away_goals",
                    division: str = "division", source: str | None = None) -> DataFrame:
    """Broken rules as rows (rule, detail, n_rows); empty when the table is sound."""
    parts = []
    one = F.lit(1)
    if "not_null" in rules:
        bad = df.agg(F.count_if(F.col(date).isNull() | F.col(target).isNull()).alias("n")).where("n > 0")
        parts.append(_violation(bad, "not_null", F.lit("date or target"), F.col("n")))
    if "unique_fixture" in rules:
        dup = df.groupBy(date, home, away).count().where("count > 1")
        parts.append(_violation(dup, "unique_fixture", F.concat_ws("|", date, home, away), F.col("count")))
    if "once_a_day" in rules:
        # count per fixture first: a busy day is reduced before the two sides are stacked
        per = df.groupBy(date, home, away).count()
        apps = per.select(F.col(date).alias("_d"), F.explode(F.array(home, away)).alias("_t"), "count")
        dup = apps.groupBy("_d", "_t").agg(F.sum("count").alias("n")).where("n > 1")
        parts.append(_violation(dup, "once_a_day", F.concat_ws("|", "_d", "_t"), F.col("n")))
    if "score_agrees" in rules:
        hg, ag = F.col(home_goals), F.col(away_goals)
        by_score = F.when(hg > ag, 2).when(hg == ag, 1).otherwise(0)
        bad = df.where(by_score != F.col(target)).groupBy(F.col(target).alias("_t")).agg(F.count(one).alias("n"))
        parts.append(_violation(bad, "score_agrees", F.col("_t"), F.col("n")))
    if "file_division" in rules and source:
        bad = df.where(F.substring(source, 1, 2) != F.col(division)).groupBy(source).agg(F.count(one).alias("n"))
        parts.append(_violation(bad, "file_division", F.col(source), F.col("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_audit(df: DataFrame, n_features: int, season: str = "season", date: str = "match_date") -> DataFrame:
    """Overall row (season null) and one row per season."""
    return (df.rollup(season).agg(F.count(F.lit(1)).alias("matches"), F.min(date).alias("date_min"),
                                  F.max(date).alias("date_max"))
            .withColumn("n_features", F.lit(n_features)))


def coverage_report(df: DataFrame, col: str, by: Sequence[str] = ("season", "division")) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(col).alias("n_present"),
                               F.avg(F.col(col).isNotNull().cast("double")).alias("share_present"))
