"""Enrichment and comparison joins. All are equi-joins.

No side is broadcast by hint: Spark broadcasts a side when its measured size is
below `spark.sql.autoBroadcastJoinThreshold`, and AQE splits hot keys of the
larger side when it is not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import map_names
from ..sources.quality import reconcile, reconcile_summary

__all__ = ["enrich_by_date", "enrich_by_fixture", "squad_join", "paired_models", "reconcile", "reconcile_summary",
           "orphans", "team_param_join", "season_expanding"]


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest value of every other column per key: a repeatable choice, combined map-side."""
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in df.columns if c not in keys])


def enrich_by_date(matches: DataFrame, feed: DataFrame, name_map: DataFrame | Mapping, extras: Sequence[str] | None = None,
                   date: str = "match_date") -> DataFrame:
    """Add feed columns by (day, mapped home, mapped away); unmatched rows get null."""
    keys = ["feed_date", "home_name", "away_name"]
    extras = list(extras) if extras else [c for c in feed.columns if c not in (*keys, "feed_season")]
    side = one_per_key(feed.select(*keys, *extras), keys)
    named = map_names(matches, ["home_team", "away_team"], name_map)
    cond = ((named[date] == side["feed_date"]) & (named["home_team_mapped"] == side["home_name"])
            & (named["away_team_mapped"] == side["away_name"]))
    return named.join(side, cond, "left").select(*matches.columns, *extras)


def enrich_by_fixture(matches: DataFrame, side: DataFrame, keys: Sequence[str] = ("season", "home_team", "away_team")) -> DataFrame:
    """Add columns by fixture: a moved match day still finds its row."""
    return matches.join(one_per_key(side, keys), list(keys), "left")


def squad_join(matches: DataFrame, squads: DataFrame, id_cols: Mapping[str, str], season: str = "season",
               squad_id: str = "club_id") -> DataFrame:
    """Squad columns for both sides, prefixed home_ / away_. `id_cols` maps side -> team id column."""
    out = matches
    for prefix, id_col in id_cols.items():
        values = [c for c in squads.columns if c not in (season, squad_id)]
        part = squads.select(F.col(season), F.col(squad_id).alias(id_col), *[F.col(c).alias(f"{prefix}_{c}") for c in values])
        out = out.join(part, [season, id_col], "left")
    return out


def paired_models(per_match: DataFrame, base: str, selected: str, keys: Sequence[str], metrics: Sequence[str],
                  label: str = "actual") -> DataFrame:
    """Metrics of one model minus another's on the same keys, in a single shuffle.

    `sound` is 0 where a key lacks one of the models or the labels disagree.
    """
    def value(model, m):
        return F.max(F.when(F.col("model") == model, F.col(m)))
    aggs = [(value(selected, m) - value(base, m)).alias(f"d_{m}") for m in metrics]
    both = (F.count_if(F.col("model") == base) == 1) & (F.count_if(F.col("model") == selected) == 1)
    return (per_match.where(F.col("model").isin(base, selected)).groupBy(*keys)
            .agg(*aggs, (both & (F.min(label) == F.max(label))).cast("int").alias("sound")))


def orphans(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Distinct keys of `left` that `right` lacks."""
    keys = [key] if isinstance(key, str) else list(key)
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def team_param_join(matches: DataFrame, params: DataFrame, cols: Sequence[str] = ("attack", "defence"), default: float = 0.0) -> DataFrame:
    """Fitted parameters of both teams; unknown teams get the default."""
    out = matches
    for side in ("home", "away"):
        part = params.select(F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in cols])
        out = out.join(part, f"{side}_team", "left").na.fill(default, subset=[f"{side}_{c}" for c in cols])
    return out


def season_expanding(matches: DataFrame, folds: Sequence[int], season: str = "season") -> DataFrame:
    """Rows repeated per fold: role 'train' where season < test season, 'test' where equal.

    The fold list is a literal array that each row filters, so nothing is joined.
    """
    usable = F.filter(F.array(*[F.lit(f) for f in sorted(folds)]), lambda f: f >= F.col(season))
    return (matches.withColumn("fold", F.explode(usable))
            .withColumn("role", F.when(F.col(season) == F.col("fold"), "test").otherwise("train")))
