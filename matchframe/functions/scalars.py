"""Row-wise features: odds, classes, names, flags, imputation, scaling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("away", "draw", "home")
P_COLS = ("p_away", "p_draw", "p_home")
ODDS_COLS = ("odds_away", "odds_draw", "odds_home")
LETTERS = ("A", "D", "H")
# match statistics known only after the match: never features (fixed values)
CURRENT_MATCH_STATS = (
    "home_shots", "away_shots", "home_shots_target", "away_shots_target",
    "home_fouls", "away_fouls", "home_corners", "away_corners",
    "home_yellow", "away_yellow", "home_red", "away_red",
)
KEY_COLUMNS = ("match_id", "match_date", "date", "time", "season", "season_id", "division", "home_team", "away_team",
               "referee", "source", "source_file", "league_level_text")
TARGET_COLUMNS = ("y", "target_result", "target_over_2_5", "home_win", "total_goals", "result_full", "result_half",
                  "home_goals", "away_goals", "home_goals_full", "away_goals_full",
                  "home_goals_half", "away_goals_half", "home_sot", "away_sot")


def _num(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def devig_odds(df: DataFrame, odds_cols: Mapping[str, str], prefix: str = "impl_", overround: str | None = "overround") -> DataFrame:
    """Implied probabilities (1/o) / sum(1/o), and the margin sum - 1. Null odds give null."""
    inverse = {name: 1.0 / F.nullif(_num(c), F.lit(0.0)) for name, c in odds_cols.items()}
    total = sum(list(inverse.values())[1:], next(iter(inverse.values())))
    out = df.select("*", *[(v / total).alias(f"{prefix}{n}") for n, v in inverse.items()])
    return out.withColumn(overround, total - 1.0) if overround else out


def market_probs(df: DataFrame, cols: Sequence[str] = ODDS_COLS, on_invalid: str = "uniform",
                 out: Sequence[str] = ("q_away", "q_draw", "q_home")) -> DataFrame:
    """Market probabilities in class order, with a rule for unusable odds.

    uniform: all three odds finite and > 1, else 1/3 each; floor: odds raised to
    1.01; null: 0 counts as missing; payout: bad rows get 1/3 and odds of 999;
    drop: bad rows are removed.
    """
    valid = F.lit(True)
    for c in cols:
        # NaN sorts above infinity, so the two comparisons leave finite odds only
        valid = valid & (F.col(c) > 1) & (F.col(c) < float("inf"))
    if on_invalid == "floor":
        odds = [F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(1.01))) for c in cols]  # greatest() alone skips nulls
    elif on_invalid == "null":
        odds = [F.nullif(F.col(c), F.lit(0.0)) for c in cols]
    else:
        odds = [F.when(valid, F.col(c)) for c in cols]
    inv = [1.0 / o for o in odds]
    total = inv[0] + inv[1] + inv[2]
    probs = [i / total for i in inv]
    if on_invalid in ("uniform", "payout"):
        probs = [F.coalesce(p, F.lit(1.0 / 3.0)) for p in probs]
    if on_invalid == "drop":
        df = df.where(valid)
    result = df.select("*", *[p.alias(n) for p, n in zip(probs, out)])
    if on_invalid == "payout":
        result = result.select("*", *[F.when(valid, F.col(c)).otherwise(999.0).alias(f"pay_{n}")
                                      for c, n in zip(cols, CLASSES)])
    return result


def arg_max(cols: Sequence[Column | str], values: Sequence[int]) -> Column:
    """Value belonging to the largest column; the earliest listed wins ties, null if any is null."""
    cols = [_num(c) for c in cols]
    whole = cols[0].isNotNull()
    for c in cols[1:]:
        whole = whole & c.isNotNull()
    first = F.array_position(F.array(*cols), F.greatest(*cols)).cast("int")
    if list(values) != list(range(len(cols))):
        first = F.element_at(F.array(*[F.lit(v) for v in values]), first)
    else:
        first = first - 1
    return F.when(whole, first)


def market_pick(df: DataFrame, cols: Sequence[str] = ("q_away", "q_draw", "q_home"), tie: str = "away",
                out: str = "market_pick") -> DataFrame:
    """Favourite class. Ties: 'away' = first in (away, draw, home) order, 'home' = the reverse."""
    order = list(zip(cols, (0, 1, 2)))
    if tie == "home":
        order.reverse()
    return df.withColumn(out, arg_max([c for c, _ in order], [v for _, v in order]))


def predicted_class(df: DataFrame, p_cols: Sequence[str] = P_COLS, out: str = "predicted") -> DataFrame:
    return df.withColumn(out, arg_max(p_cols, (0, 1, 2)))


def map_names(df: DataFrame, cols: Sequence[str], names: DataFrame | Mapping, lenient: bool = False,
              suffix: str = "_mapped") -> DataFrame:
    """Translate names. Unmapped: null (strict) or the original text (lenient).

    A dict becomes a literal map; a two-column DataFrame is joined (Spark broadcasts
    it when its measured size allows).
    """
    if isinstance(names, Mapping):
        pairs = [F.lit(x) for kv in names.items() for x in kv]
        lookup = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        for c in cols:
            got = F.try_element_at(lookup, F.col(c))
            df = df.withColumn(c + suffix, F.coalesce(got, F.col(c)) if lenient else got)
        return df
    key, value = names.columns[:2]
    for c in cols:
        side = names.select(F.col(key).alias(f"__k_{c}"), F.col(value).alias(f"__v_{c}")).dropDuplicates([f"__k_{c}"])
        got = F.col(f"__v_{c}")
        df = (df.join(side, F.col(c) == F.col(f"__k_{c}"), "left")
              .withColumn(c + suffix, F.coalesce(got, F.col(c).cast("string")) if lenient else got)
              .drop(f"__k_{c}", f"__v_{c}"))
    return df


def diff_columns(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.select("*", *[(F.col(a) - F.col(b)).alias(n) for n, (a, b) in pairs.items()])


def availability_flags(df: DataFrame, cols: Sequence[str], prefix: str = "has_") -> DataFrame:
    return df.select("*", *[F.coalesce((F.col(c) > 0).cast("double"), F.lit(0.0)).alias(prefix + c) for c in cols])


def one_hot_league(df: DataFrame, values: Iterable[str], col: str = "division", prefix: str = "league_") -> DataFrame:
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)).alias(prefix + v)
                            for v in sorted(values)])


def league_level(df: DataFrame, col: str = "division", out: str = "league_level") -> DataFrame:
    """E0..E3 -> 0..3, anything else null."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for i in range(4) for x in (f"E{i}", i)]), F.col(col))
    return df.withColumn(out, code)


def pair_key(df: DataFrame, home: str = "home_team", away: str = "away_team") -> DataFrame:
    return df.withColumn("team_low", F.least(home, away)).withColumn("team_high", F.greatest(home, away))


def class_letter(c) -> Column:
    chain = F.when(_num(c) == 0, LETTERS[0])
    return chain.when(_num(c) == 1, LETTERS[1]).when(_num(c) == 2, LETTERS[2])


def letter_class(c) -> Column:
    return F.when(_num(c) == "A", 0).when(_num(c) == "D", 1).when(_num(c) == "H", 2)


def labels_text(df: DataFrame, actual: str = "y", predicted: str = "predicted", home: str = "home_goals",
                away: str = "away_goals") -> DataFrame:
    return (df.withColumn("actual_letter", class_letter(actual))
            .withColumn("predicted_letter", class_letter(predicted))
            .withColumn("score_text", F.concat_ws("-", F.col(home).cast("int").cast("string"), F.col(away).cast("int").cast("string")))
            .withColumn("correct", (F.col(actual) == F.col(predicted)).cast("int")))


def feature_names(columns: Iterable[str]) -> list[str]:
    """Names that may be used before a match: no keys, targets, raw odds, in-match statistics."""
    banned = {*KEY_COLUMNS, *TARGET_COLUMNS, *CURRENT_MATCH_STATS}
    raw_odds = ("odds_", "over_", "under_", "ah_", "asian_")
    return [c for c in columns if c not in banned and not c.startswith(raw_odds) and not c.startswith("_")]


def select_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in feature_names(df.columns) if c not in keep])


def column_stats(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean (0 for an all-null column) and population deviation per column."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m_{i}") for i, c in enumerate(cols)]
    sds = [F.stddev_pop(c).alias(f"_s_{i}") for i, c in enumerate(cols)]
    return train.agg(*means, *sds)


def single_row(df: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery (no join needed)."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def impute_mean(train: DataFrame, test: DataFrame, cols: Sequence[str], own_means: bool = False) -> DataFrame:
    """Fill nulls of `test` with training means; own_means=True uses the test set's own."""
    stats = single_row(column_stats(test if own_means else train, cols))
    filled = {c: F.coalesce(F.col(c), stats[f"_m_{i}"]) for i, c in enumerate(cols)}
    return test.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in test.columns])


def standardize(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of the training rows; deviation 0 divides by 1."""
    stats = single_row(column_stats(train, cols))
    scaled = {}
    for i, c in enumerate(cols):
        sd = F.coalesce(F.nullif(stats[f"_s_{i}"], F.lit(0.0)), F.lit(1.0))
        scaled[c] = (F.col(c) - stats[f"_m_{i}"]) / sd
    return test.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in test.columns])


def filter_rows(df: DataFrame, seasons: Sequence | None = None, before: int | None = None, valid_odds: Sequence[str] = (),
                min_edge: float | None = None, not_null: Sequence[str] = (), season: str = "season",
                edge: str = "edge") -> DataFrame:
    """The row filters in use; each one is a plain predicate Spark can push to the scan."""
    if seasons is not None:
        df = df.where(F.col(season).isin(*seasons))
    if before is not None:
        df = df.where(F.col(season) < before)
    for c in valid_odds:
        df = df.where(F.col(c).isNotNull() & (F.col(c) > 1))
    if min_edge is not None:
        df = df.where(F.col(edge) > min_edge)
    return df.na.drop(subset=list(not_null)) if not_null else df
