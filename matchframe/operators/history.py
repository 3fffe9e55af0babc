"""History features: what was known about a team, pair or league before a match.

Four rules for "the previous n" are kept apart:
  venue rows   last n rows at the same venue           venue_form, venue_shots
  team rows    last n rows at any venue                prior_row_form, last_k_sequences
  prior days   last n rows on earlier days             prior_day_form, h2h_clean
  calendar     a span of days                          rolling_time_accuracy
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import devig_odds, one_hot_league, pair_key, single_row
from ..plans.blocks import (BEFORE, ROWS_PER_BLOCK, block_window, day_tails, null_safe_join, prior_day_state,
                            running_totals, with_carry)

FORM_METRICS = ("team_state_points", "attack_strength", "defense_strength", "goals_for", "goals_against",
                "goal_differential", "win_rate", "draw_rate", "loss_rate", "win_margin_goals", "loss_margin_goals")
SHOT_METRICS = ("avg_shots", "avg_sot", "shot_accuracy", "conversion_rate")
H2H_COLUMNS = ("h2h_home_wins", "h2h_away_wins", "h2h_draws", "h2h_home_avg_goals", "h2h_away_avg_goals")
RELATIVE_METRICS = ("avg_goals_for", "avg_goals_against", "avg_goal_diff", "avg_points", "win_rate", "draw_rate",
                    "loss_rate", "avg_shots", "avg_sot", "shot_accuracy", "conversion_rate")


def to_team_rows(m: DataFrame) -> DataFrame:
    """Two rows per match, one from each side's point of view."""
    def view(side, other):
        return F.struct(F.lit(side).alias("venue"), F.col(f"{side}_team").alias("team"),
                        F.col(f"{other}_team").alias("opponent"),
                        F.col(f"{side}_goals").cast("double").alias("gf"),
                        F.col(f"{other}_goals").cast("double").alias("ga"),
                        F.col(f"{side}_shots").alias("shots"), F.col(f"{side}_sot").alias("sot"))
    # explode reads the source once, a union of two projections would read it twice
    rows = m.select("match_id", "match_date", "season", "division",
                    F.explode(F.array(view("home", "away"), view("away", "home"))).alias("t"))
    diff = F.col("gf") - F.col("ga")
    return (rows.select("match_id", "match_date", "season", "division", "t.*")
            .withColumn("goal_diff", diff)
            .withColumn("points", F.when(diff > 0, 3.0).when(diff == 0, 1.0).when(diff < 0, 0.0))
            .withColumn("result", F.signum(diff))
            .withColumn("win_margin", F.greatest(diff, F.lit(0.0)))
            .withColumn("loss_margin", F.greatest(-diff, F.lit(0.0))))


def by_venue(rows: DataFrame, cols: Sequence[str], id_col: str = "match_id") -> DataFrame:
    """Back to one row per match: home_<col>, away_<col>."""
    return rows.groupBy(id_col).agg(*[
        F.max(F.when(F.col("venue") == side, F.col(c))).alias(f"{side}_{c}") for side in ("home", "away") for c in cols])


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _share(value: float) -> Column:
    return F.avg((F.col("result") == value).cast("double"))


_FORM_AGGREGATES = {
    "team_state_points": lambda: F.avg("points"), "goals_for": lambda: F.avg("gf"), "goals_against": lambda: F.avg("ga"),
    "goal_differential": lambda: F.avg("goal_diff"), "win_rate": lambda: _share(1.0), "draw_rate": lambda: _share(0.0),
    "loss_rate": lambda: _share(-1.0), "win_margin_goals": lambda: F.avg("win_margin"),
    "loss_margin_goals": lambda: F.avg("loss_margin"),
}
_SHOT_AGGREGATES = {"avg_shots": lambda: F.avg("shots"), "avg_sot": lambda: F.avg("sot"),
                    "_gf_sum": lambda: F.sum("gf"), "_shot_sum": lambda: F.sum("shots")}


def _finish_shots(df: DataFrame, n: int) -> DataFrame:
    shots, conv = F.col(f"_shot_sum_{n}"), F.col(f"_gf_sum_{n}")
    return (df.withColumn(f"shot_accuracy_{n}", _ratio(F.col(f"avg_sot_{n}"), F.col(f"avg_shots_{n}")))
            .withColumn(f"conversion_rate_{n}", F.when(shots > 0, conv / F.when(shots > 0, shots)))
            .drop(f"_shot_sum_{n}", f"_gf_sum_{n}"))


# ---------------------------------------------------------------- prior days

def prior_day_form(team_rows: DataFrame, windows: Sequence[int] = (5, 10)) -> DataFrame:
    """Form of a team at the start of a day: one row per (team, day), 13 metrics per window.

    Strengths need the league mean of the day as well, see `with_strengths`.
    """
    tails = day_tails(team_rows, ["team"], "match_date", "match_id", max(windows))
    state = {f"{name}_{n}": (n, make()) for n in windows
             for name, make in {**_FORM_AGGREGATES, **_SHOT_AGGREGATES}.items()}
    out = prior_day_state(tails, ["team"], "match_date", "match_id", state)
    for n in windows:
        out = _finish_shots(out, n)
    return out


def expanding_league_mean(m: DataFrame) -> DataFrame:
    """Mean goals per team and match over all earlier days: one row per day, null on the first."""
    days = m.groupBy("match_date").agg(F.sum(F.col("home_goals") + F.col("away_goals")).cast("double").alias("g"),
                                       (2 * F.count(F.lit(1))).alias("n"))
    before = Window.orderBy("match_date").rowsBetween(*BEFORE)  # one row per calendar day
    return days.select("match_date", (F.sum("g").over(before) / F.sum("n").over(before)).alias("league_avg"))


def expanding_league_mean_rows(m: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The row-order form: mean over all earlier rows in (date, id) order."""
    goals = (F.col("home_goals") + F.col("away_goals")).cast("double")
    totals = running_totals(m.select("match_id", "match_date", "home_goals", "away_goals"), [], "match_date", "match_id",
                            {"_g": goals, "_k": F.lit(2.0)}, rows_per_block)
    return totals.select("match_id", _ratio(F.col("_g"), F.col("_k")).alias("league_avg"))


def strengths(df: DataFrame, windows: Sequence[int] = (5, 10), prefix: str = "", league: str = "league_avg") -> DataFrame:
    """attack/defence = team mean / league mean; null when the league mean is null or 0."""
    for n in windows:
        for out, src in (("attack_strength", "goals_for"), ("defense_strength", "goals_against")):
            df = df.withColumn(f"{prefix}{out}_{n}", _ratio(F.col(f"{prefix}{src}_{n}"), F.col(league)))
    return df


def history_lookup(team_rows: DataFrame, m: DataFrame, n: int = 10) -> DataFrame:
    """State of both teams strictly before the day of each match (an as-of lookup by equi-join)."""
    state = prior_day_form(team_rows, (n,))
    out = m
    for side in ("home", "away"):
        renamed = state.select(F.col("team").alias(f"{side}_team"), "match_date",
                               *[F.col(c).alias(f"{side}_{c}") for c in state.columns if c not in ("team", "match_date")])
        out = out.join(renamed, [f"{side}_team", "match_date"], "left")
    return out


# ---------------------------------------------------------------- team rows

def prior_row_form(team_rows: DataFrame, league: DataFrame, windows: Sequence[int] = (5, 10), shots: bool = False,
                   rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Form over the previous n rows at any venue, one row per (match, side).

    `league` is `expanding_league_mean_rows` (match_id, league_avg).
    """
    rows = with_carry(team_rows, ["team"], "match_date", "match_id", max(windows), rows_per_block)
    w = block_window(["team"], "match_date", "match_id")
    aggregates = {**_FORM_AGGREGATES, **(_SHOT_AGGREGATES if shots else {})}
    cols = [make().over(w.rowsBetween(-n, -1)).alias(f"{name}_{n}") for n in windows for name, make in aggregates.items()]
    out = rows.select("match_id", "venue", "team", "_carry", *cols).where("_carry = 0").drop("_carry")
    if shots:
        for n in windows:
            out = _finish_shots(out, n)
    return strengths(out.join(league, "match_id", "left"), windows).drop("league_avg")


def venue_form(m: DataFrame, windows: Sequence[int] = (5,), rates: str = "clean",
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Same-venue means of the last n rows: goals for/against, difference, points, result rates.

    rates='clean' divides by the rows present. rates='literal' counts the missing
    row before a debut as "not a win": wins(last n) / least(prior rows + 1, n).
    """
    rows = with_carry(to_team_rows(m).select("match_id", "match_date", "venue", "team", "gf", "ga", "points", "result"),
                      ["team", "venue"], "match_date", "match_id", max(windows), rows_per_block)
    w = block_window(["team", "venue"], "match_date", "match_id")
    cols = []
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        cols += [F.avg("gf").over(frame).alias(f"avg_goals_for_{n}"),
                 F.avg("ga").over(frame).alias(f"avg_goals_against_{n}"),
                 (F.avg("gf").over(frame) - F.avg("ga").over(frame)).alias(f"avg_goal_diff_{n}"),
                 F.avg("points").over(frame).alias(f"avg_points_{n}")]
        for name, value in (("win", 1.0), ("draw", 0.0), ("loss", -1.0)):
            hits = F.sum((F.col("result") == value).cast("double")).over(frame)
            seen = F.count(F.lit(1)).over(frame)
            rate = (F.coalesce(hits, F.lit(0.0)) / F.least(seen + 1, F.lit(n)) if rates == "literal"
                    else hits / F.nullif(seen, F.lit(0)))
            cols.append(rate.alias(f"{name}_rate_{n}"))
    out = rows.select("match_id", "venue", "_carry", *cols).where("_carry = 0")
    return by_venue(out, [c for c in out.columns if c not in ("match_id", "venue", "_carry")])


def venue_shots(m: DataFrame, windows: Sequence[int] = (5,), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Same-venue shot means, accuracy (ratio of means) and conversion (goals / shots)."""
    rows = with_carry(to_team_rows(m).select("match_id", "match_date", "venue", "team", "gf", "shots", "sot"),
                      ["team", "venue"], "match_date", "match_id", max(windows), rows_per_block)
    w = block_window(["team", "venue"], "match_date", "match_id")
    cols = []
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        shots, sot = F.avg("shots").over(frame), F.avg("sot").over(frame)
        cols += [shots.alias(f"avg_shots_{n}"), sot.alias(f"avg_sot_{n}"),
                 _ratio(sot, shots).alias(f"shot_accuracy_{n}"),
                 _ratio(F.sum("gf").over(frame), F.sum("shots").over(frame)).alias(f"conversion_rate_{n}")]
    out = rows.select("match_id", "venue", "_carry", *cols).where("_carry = 0")
    return by_venue(out, [c for c in out.columns if c not in ("match_id", "venue", "_carry")])


# ---------------------------------------------------------------- pairs

def _pair_rows(m: DataFrame) -> DataFrame:
    """Each meeting seen from the lower-named team of the pair."""
    p = pair_key(m.select("match_id", "match_date", "home_team", "away_team", "home_goals", "away_goals"))
    low_home = F.col("home_team") == F.col("team_low")
    low = F.when(low_home, F.col("home_goals")).otherwise(F.col("away_goals"))
    high = F.when(low_home, F.col("away_goals")).otherwise(F.col("home_goals"))
    return p.select("match_id", "match_date", "team_low", "team_high", low_home.alias("low_home"),
                    low.cast("double").alias("g_low"), high.cast("double").alias("g_high"))


def _pair_aggregates(frame=None) -> dict[str, Column]:
    aggs = {"w_low": F.count_if(F.col("g_low") > F.col("g_high")), "w_high": F.count_if(F.col("g_low") < F.col("g_high")),
            "draws": F.count_if(F.col("g_low") == F.col("g_high")), "m_low": F.avg("g_low"), "m_high": F.avg("g_high")}
    return {k: (v.over(frame) if frame is not None else v) for k, v in aggs.items()}


def _oriented(low_first: Column) -> list[Column]:
    zero = F.lit(0.0)
    sources = (("h2h_home_wins", "w_low", "w_high", "int"), ("h2h_away_wins", "w_high", "w_low", "int"),
               ("h2h_draws", "draws", "draws", "int"), ("h2h_home_avg_goals", "m_low", "m_high", "double"),
               ("h2h_away_avg_goals", "m_high", "m_low", "double"))
    return [F.coalesce(F.when(low_first, F.col(a)).otherwise(F.col(b)), zero).cast(t).alias(out) for out, a, b, t in sources]


def h2h_clean(m: DataFrame, n: int = 5) -> DataFrame:
    """Last n meetings on earlier days, counted for the current home and away team; 0 when none."""
    pairs = _pair_rows(m)
    keys = ["team_low", "team_high"]
    tails = day_tails(pairs, keys, "match_date", "match_id", n)
    state = prior_day_state(tails, keys, "match_date", "match_id", {k: (n, a) for k, a in _pair_aggregates().items()})
    joined = pairs.select("match_id", "match_date", *keys, "low_home").join(state, [*keys, "match_date"], "left")
    return joined.select("match_id", *_oriented(F.col("low_home")))


def h2h_legacy(m: DataFrame, n: int = 5, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Previous n rows of the pair; 'home' counters always belong to the lower-named team."""
    keys = ["team_low", "team_high"]
    rows = with_carry(_pair_rows(m), keys, "match_date", "match_id", n, rows_per_block)
    frame = block_window(keys, "match_date", "match_id").rowsBetween(-n, -1)
    state = rows.select("match_id", "_carry", *[a.alias(k) for k, a in _pair_aggregates(frame).items()])
    return state.where("_carry = 0").select("match_id", *_oriented(F.lit(True)))


# ---------------------------------------------------------------- matrices

def matrix_columns(windows: Sequence[int] = (5, 10), shots: bool = True) -> list[str]:
    names = [*FORM_METRICS, *(SHOT_METRICS if shots else ())]
    return [f"{side}_{c}_{n}" for n in windows for side in ("home", "away") for c in names]


def feature_matrix_66(m: DataFrame, windows: Sequence[int] = (5, 10), keep: Sequence[str] = ()) -> DataFrame:
    """Keys, class and 66 pre-match features: 2 sides x 2 windows x 15, five pair features, the level."""
    keys = ["match_id", "match_date", "season", "division", "home_team", "away_team", "y"]
    state = prior_day_form(to_team_rows(m), windows)
    # joins that need a shuffle go from narrow to wide rows; what follows from joined columns comes last
    out = m.select(*keys, "league_level", *keep).join(h2h_clean(m), "match_id", "left")
    metrics = [c for c in state.columns if c not in ("team", "match_date")]
    for side in ("home", "away"):
        out = out.join(state.select(F.col("team").alias(f"{side}_team"), "match_date",
                                    *[F.col(c).alias(f"{side}_{c}") for c in metrics]),
                       [f"{side}_team", "match_date"], "left")
    # one row per calendar day, so its size is bounded by the calendar
    out = out.join(F.broadcast(expanding_league_mean(m)), "match_date", "left")
    for side in ("home", "away"):
        out = strengths(out, windows, f"{side}_")
    return out.select(*keys, *keep, *matrix_columns(windows), *[F.col(c).cast("double").alias(c) for c in H2H_COLUMNS],
                      F.col("league_level").cast("double").alias("league_level"))


def feature_matrix_44(m: DataFrame, windows: Sequence[int] = (5, 10), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Row-order layout without shots: 2 sides x 2 windows x 11."""
    form = prior_row_form(to_team_rows(m), expanding_league_mean_rows(m, rows_per_block), windows,
                          rows_per_block=rows_per_block)
    wide = by_venue(form, [f"{c}_{n}" for n in windows for c in FORM_METRICS])
    return wide.select("match_id", *matrix_columns(windows, shots=False))


def feature_matrix_65(m: DataFrame, windows: Sequence[int] = (5, 10), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The 44 columns, 16 same-venue shot columns and the five legacy pair columns."""
    return (feature_matrix_44(m, windows, rows_per_block)
            .join(venue_shots(m, windows, rows_per_block), "match_id")
            .join(h2h_legacy(m, rows_per_block=rows_per_block), "match_id"))


def league_relative(df: DataFrame, cols: Sequence[str], mode: str = "prior_days", date: str = "match_date",
                    division: str = "division") -> DataFrame:
    """rel_<col> = value minus its division mean, over earlier days or (mode='full') the whole table."""
    if mode == "full":
        means = df.groupBy(division).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
        # one row per division; a shuffled join would deal each division's rows to one task
        joined = null_safe_join(df, F.broadcast(means), [division], "left")
    else:
        days = df.groupBy(division, date).agg(*[F.sum(c).alias(f"_s_{c}") for c in cols],
                                              *[F.count(c).alias(f"_n_{c}") for c in cols])
        w = Window.partitionBy(division).orderBy(date).rowsBetween(*BEFORE)
        means = days.select(division, date, *[
            (F.sum(f"_s_{c}").over(w) / F.nullif(F.sum(f"_n_{c}").over(w), F.lit(0))).alias(f"_m_{c}") for c in cols])
        joined = null_safe_join(df, means, [division, date], "left")
    return joined.select(*df.columns, *[(F.col(c) - F.col(f"_m_{c}")).alias(f"rel_{c}") for c in cols])


def build_features(m: DataFrame, windows: Sequence[int] = (5, 10), shots: bool = True, odds: bool = True, h2h: bool = True,
                   divisions: Sequence[str] | None = None, relative: str | None = None, rating: DataFrame | None = None,
                   feed: DataFrame | None = None, rates: str = "clean") -> DataFrame:
    """Assemble column groups by option; shots use the first two windows only.

    `rating` and `feed` are tables keyed by match_id (see rating_features, enrich_by_date).
    """
    out = m.join(venue_form(m, windows, rates), "match_id")
    if shots:
        out = out.join(venue_shots(m, tuple(windows)[:2]), "match_id")
    if odds:
        out = devig_odds(out, {"home_prob": "odds_home", "draw_prob": "odds_draw", "away_prob": "odds_away"})
    if h2h:
        out = out.join(h2h_legacy(m), "match_id")
    if divisions:
        out = one_hot_league(out, divisions)
    if relative:
        cols = [c for c in out.columns if c.split("_", 1)[-1].rsplit("_", 1)[0] in RELATIVE_METRICS]
        out = league_relative(out, cols, relative)
    for extra in (rating, feed):
        if extra is not None:
            out = out.join(extra, "match_id", "left")
    return out


# ---------------------------------------------------------------- points per game, sequences, snapshots

def cumulative_ppg(m: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Points per game before each match in row order; 0 on debut, unplayed rows do not count."""
    rows = to_team_rows(m).select("match_id", "match_date", "venue", "team", "points")
    played = F.col("points").isNotNull().cast("double")
    totals = running_totals(rows, ["team"], "match_date", "match_id",
                            {"_p": F.coalesce("points", F.lit(0.0)), "_k": played}, rows_per_block)
    ppg = totals.withColumn("ppg", F.coalesce(_ratio(F.col("_p"), F.col("_k")), F.lit(0.0)))
    wide = by_venue(ppg, ["ppg"])
    return wide.withColumn("ppg_diff", F.col("home_ppg") - F.col("away_ppg"))


def static_ppg(train: DataFrame, target: DataFrame) -> DataFrame:
    """Points per game over the training span, joined to both sides; unknown teams get the mean of teams."""
    teams = to_team_rows(train).where(F.col("team").isNotNull()).groupBy("team").agg(F.avg("points").alias("ppg"))
    fallback = single_row(teams.agg(F.avg("ppg").alias("m")))["m"]
    out = target
    for side in ("home", "away"):
        out = (out.join(teams.select(F.col("team").alias(f"{side}_team"), F.col("ppg").alias("_p")), f"{side}_team", "left")
               .withColumn(f"{side}_static_ppg", F.coalesce("_p", fallback)).drop("_p"))
    return out


def last_k_sequences(m: DataFrame, k: int = 10, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The last k results of each side, oldest first, left-padded with zeros, and the shared mask."""
    rows = to_team_rows(m).select("match_id", "match_date", "venue", "team", F.coalesce("gf", F.lit(0.0)).alias("gf"),
                                  F.coalesce("ga", F.lit(0.0)).alias("ga"))
    rows = with_carry(rows, ["team"], "match_date", "match_id", k, rows_per_block)
    item = F.struct("gf", "ga", (F.col("venue") == "home").cast("double").alias("is_home"))
    seq = F.collect_list(item).over(block_window(["team"], "match_date", "match_id").rowsBetween(-k, -1))
    pad = F.struct(F.lit(0.0).alias("gf"), F.lit(0.0).alias("ga"), F.lit(0.0).alias("is_home"))
    out = rows.withColumn("seq", seq).where("_carry = 0").withColumn("n", F.size("seq"))
    out = out.withColumn("seq", F.concat(F.array_repeat(pad, F.lit(k) - F.col("n")), F.col("seq")))
    wide = by_venue(out, ["seq", "n"])
    longest = F.greatest("home_n", "away_n")
    mask = F.concat(F.array_repeat(F.lit(0.0), F.lit(k) - longest), F.array_repeat(F.lit(1.0), longest))
    return wide.select("match_id", "home_seq", "away_seq", mask.alias("mask"))


SNAPSHOT_STATS = ("avg_goals_for", "avg_goals_against", "avg_goal_diff", "avg_points", "win_rate", "draw_rate", "loss_rate")


def recent_form_snapshot(m: DataFrame, fixtures: DataFrame, n: int = 5, promoted: Sequence = (), top_division: str = "E0") -> DataFrame:
    """Means of the last n home (away) rows for upcoming fixtures.

    Fallback: the team's career means in the top division (always for promoted
    teams), then 0.
    """
    rows = to_team_rows(m).where(F.col("division") == top_division)

    def stats(df, tail):
        share = {"win": 1.0, "draw": 0.0, "loss": -1.0}
        return df.groupBy("team", "venue").agg(
            F.avg("gf").alias(f"avg_goals_for{tail}"), F.avg("ga").alias(f"avg_goals_against{tail}"),
            F.avg("goal_diff").alias(f"avg_goal_diff{tail}"), F.avg("points").alias(f"avg_points{tail}"),
            *[_share(v).alias(f"{k}_rate{tail}") for k, v in share.items()])

    latest = Window.partitionBy("team", "venue").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    current = rows.where(F.col("season") == single_row(rows.agg(F.max("season").alias("s")))["s"])
    recent = stats(current.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n), "")
    career = stats(rows, "_career")
    table = career.join(recent, ["team", "venue"], "left")
    old = F.col("team").isin(*promoted) if promoted else F.lit(False)
    table = table.select("team", "venue", *[
        F.when(old, F.col(f"{c}_career")).otherwise(F.coalesce(c, f"{c}_career")).alias(c) for c in SNAPSHOT_STATS])
    out = fixtures
    for side in ("home", "away"):
        part = table.where(F.col("venue") == side).select(
            F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in SNAPSHOT_STATS])
        out = out.join(part, f"{side}_team", "left")
    return out.na.fill(0.0, subset=[f"{s}_{c}" for s in ("home", "away") for c in SNAPSHOT_STATS])


def season_ratings(m: DataFrame) -> DataFrame:
    """Per season and team: scoring rate over the season's home mean, conceding rate over its away mean.

    Both are 1 in a season whose home mean is zero; without any away goal the defence is 1
    (a rate over zero would be infinite or undefined).
    """
    league = m.groupBy("season").agg(F.avg("home_goals").alias("_h"), F.avg("away_goals").alias("_a"))
    teams = to_team_rows(m).groupBy("season", "team").agg(F.avg("gf").alias("_f"), F.avg("ga").alias("_g"))
    home, away = F.col("_h") > 0, F.col("_a") > 0
    return teams.join(league, "season").select(
        "season", "team",
        F.when(home, _ratio(F.col("_f"), F.col("_h"))).otherwise(1.0).alias("attack"),
        F.when(home & away, _ratio(F.col("_g"), F.col("_a"))).otherwise(1.0).alias("defence"))


def last_season_ratings(ratings: DataFrame) -> DataFrame:
    """Each team's ratings of its latest season."""
    return ratings.groupBy("team").agg(F.max_by("attack", "season").alias("attack"),
                                       F.max_by("defence", "season").alias("defence"))


# ---------------------------------------------------------------- calendar and ranks

def rolling_time_accuracy(preds: DataFrame, span_days: int = 30, min_rows: int = 5, by: Sequence[str] = ("model",),
                          date: str = "match_date", id_col: str = "match_id", hit: str = "correct", ties: str = "row",
                          rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Mean of `hit` over the trailing span (t - span, t], null with fewer than min_rows rows.

    ties='row' ends the span at the row itself in (date, id) order; ties='day'
    takes the whole day. All counts are exact differences of running totals.
    """
    by = list(by)
    days = preds.groupBy(*by, date).agg(F.count(F.lit(1)).alias("_dn"), F.sum(hit).cast("double").alias("_dh"))
    days = days.withColumn("_day", F.unix_date(date))
    w = Window.partitionBy(*by).orderBy("_day")
    upto, old = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -span_days)
    days = days.select(*by, date, *[
        F.coalesce(F.sum(src).over(frame), F.lit(0)).alias(out)
        for out, src, frame in (("_un", "_dn", upto), ("_uh", "_dh", upto), ("_on", "_dn", old), ("_oh", "_dh", old))])
    if ties == "day":
        out = null_safe_join(preds, days, [*by, date])
        n, h = F.col("_un") - F.col("_on"), F.col("_uh") - F.col("_oh")
    else:
        totals = running_totals(preds, by, date, id_col, {"_rn": F.lit(1).cast("long"), "_rh": F.col(hit).cast("double")},
                                rows_per_block)
        out = null_safe_join(totals, days, [*by, date])
        n, h = F.col("_rn") + 1 - F.col("_on"), F.col("_rh") + F.col(hit) - F.col("_oh")
    return out.select(*preds.columns, n.alias("rolling_n"),
                      F.when(n >= min_rows, h / F.nullif(n, F.lit(0))).alias("rolling_accuracy"))


def row_ranking(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank",
                limit: int | None = None) -> DataFrame:
    """1..n within a group; with a limit Spark keeps only the top rows before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col(name) <= limit) if limit else out
