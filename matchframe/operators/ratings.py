"""Sequential ratings as keyed folds.

A rating update couples two teams of a league, so a match waits for its teams'
earlier matches. Within a block, matches without a common team are one array step
for up to 25 parameter sets (`kernels`). Leagues and groups of parameter sets run side by
side, and a long league is cut into blocks of `rows_per_block` matches.
Each round folds one block of every league; the team states go from round to
round through the shared scratch folder, so no task ever holds more than a block
and a lost executor costs one block.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import KERNELS, WAVES
from ..plans.blocks import ordered_blocks
from ..plans.session import materialize, scratch_dir

RATING_BLOCK = 200_000
SETS_PER_TASK = (4, 25)  # of a search, least and most; they share a task's array steps
PARTS = 4          # groups of sets of a league that run side by side, where the most per task allows it
LOSS_CELLS = 40_000  # probabilities (matches x sets) a search holds at once
NO_DAY = -2**31   # a missing date comes first, as in the blocks' order
SCHEMA = ("tag string, league string, param_id int, match_id long, match_date date, y int, home_team string, "
          "away_team string, learned boolean, team string, vals array<double>")
# search grids (fixed values)
PI_VALUES = (0.001, 0.003, 0.005, 0.008, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.1)
PI_GRID = {
    "pi": (0.001, 0.003, 0.005, 0.008, 0.01, 0.012, 0.015, 0.02, 0.03, 0.05, 0.08, 0.1),
    "delta": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5),
    "home_adv": (0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0),
    "sigma_match": (0.5, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.5),
    "sigma_decay": (0.99, 0.992, 0.995, 0.997, 0.998, 0.999, 0.9995, 1.0),
}
POISSON_GRID = {
    "learning_rate": (0.005, 0.008, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5),
    "home_adv": (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5),
    "l2_reg": (0.0, 1e-5, 3e-5, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2),
    "initial_rating": (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3),
    "rho": (-0.3, -0.25, -0.2, -0.18, -0.15, -0.12, -0.1, -0.08, -0.05, -0.02, 0.0),
}


def _set_size(n: int, losses: bool) -> int:
    """Parameter sets of a task: more of them cost little more, fewer tasks run side by side."""
    least, most = SETS_PER_TASK
    return min(most, max(least, -(-n // PARTS))) if losses else 1


def _folder(kind: str, params: Sequence[Mapping], losses: bool):
    """The per-(league, part of the parameter sets, block) function for cogrouped frames."""
    table = [dict(p) for p in params]
    size = _set_size(len(table), losses)

    def fold(key, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        league, part = key
        first = int(part) * size
        sets = table[first:first + size]
        ids = range(first, first + len(sets))
        wave = WAVES[kind](sets)
        rows = rows.sort_values(["_day", "match_id"], kind="stable")
        n = len(rows)
        codes, names = pd.factorize(np.concatenate([state["team"].to_numpy(object), rows["home_team"].to_numpy(object), rows["away_team"].to_numpy(object)]),
                                    use_na_sentinel=False)
        known, home, away = np.split(codes, [len(state), len(state) + n])
        # width numbers per team and set, and games per team
        vals = np.repeat(wave.new_team()[:, None], len(names), axis=1)
        games = np.zeros(len(names))
        if len(state):
            before = np.stack(state["vals"].to_numpy())
            vals[:, known, state["param_id"].to_numpy() - first] = before[:, :-1].T
            games[known] = before[:, -1]
        learn = rows["learn"].to_numpy(bool)
        out = []
        if n:
            y = rows["y"].to_numpy(np.int64)
            seen = wave.fold(vals, home, away, rows["home_goals"].to_numpy(float), rows["away_goals"].to_numpy(float), y, learn)
            if losses:
                step, nll = max(1, LOSS_CELLS // len(sets)), np.zeros(len(sets))
                for at in range(0, n, step):
                    nll -= np.log(np.choose(y[at:at + step, None], wave.probabilities(seen[:, at:at + step]))).sum(axis=0)
                out.append(pd.DataFrame({"tag": "loss", "param_id": list(ids), "vals": [[float(n), v] for v in nll.tolist()]}))
            else:
                p, more = wave.probabilities(seen), wave.details(seen)
                if kind == "poisson":
                    played = _games_before(games, home, away, learn)
                    more = np.concatenate([more, np.repeat(played[:, :, None], len(sets), axis=2)])
                values = np.concatenate([p, more])
                shown = rows[["match_id", "match_date", "y", "home_team", "away_team"]].assign(tag="match", learned=learn)
                out += [shown.assign(param_id=i, vals=list(np.ascontiguousarray(values[:, :, k].T))) for k, i in enumerate(ids)]
        games += np.bincount(np.concatenate([home[learn], away[learn]]), minlength=len(names))
        teams = [None if pd.isna(t) else t for t in names]
        out += [pd.DataFrame({"tag": "team", "param_id": i, "team": teams, "vals": list(np.column_stack([vals[:, :, k].T, games]))}) for k, i in enumerate(ids)]
        frame = pd.concat([f.astype({"param_id": "int32"}) for f in out]).assign(league=league)
        frame = frame.reindex(columns=["tag", "league", "param_id", "match_id", "match_date", "y", "home_team", "away_team", "learned", "team", "vals"])
        for c in ("match_date", "home_team", "away_team", "team"):
            frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
        return frame.astype({"match_id": "Int64", "y": "Int32", "learned": "boolean"})

    return fold


def _games_before(games: np.ndarray, home: np.ndarray, away: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Games that the home and the away team of each match, given in order, had learned from."""
    sides = pd.Series(np.repeat(learn, 2).astype(float))
    at = np.column_stack([home, away])
    before = (sides.groupby(at.ravel()).cumsum() - sides).to_numpy().reshape(-1, 2) + games[at]
    before[home == away, 1] = before[home == away, 0]
    return before.T


def fold_matches(matches: DataFrame, params: Sequence[Mapping], kind: str = "pi", league_col: str = "division",
                 cut_date: str | None = None, update: bool = True, rows_per_block: int = RATING_BLOCK, losses: bool = False) -> DataFrame:
    """Match and team rows of every (league, parameter set).

    With a cut date and update=False, matches from that date on are predicted with frozen ratings.
    With losses=True a block's match rows are added up in its task: one row (matches, negative log
    likelihood) per league, block and set takes their place.
    """
    spark = matches.sparkSession
    learn = F.lit(True) if update or cut_date is None else F.col("match_date") < F.lit(cut_date).cast("date")
    rows = matches.select(
        F.col(league_col).cast("string").alias("league"), "match_id", "match_date", F.col("home_team").cast("string").alias("home_team"),
        F.col("away_team").cast("string").alias("away_team"), F.col("home_goals").cast("double").alias("home_goals"),
        F.col("away_goals").cast("double").alias("away_goals"),
        F.when(F.col("home_goals") > F.col("away_goals"), 2).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(0).alias("y"),
        F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.unix_date(F.col("match_date").cast("date")), F.lit(NO_DAY)).alias("_day"))
    # a round reads its own block's files
    blocked = ordered_blocks(rows, ["league"], "match_date", "match_id", rows_per_block).repartition("league", "_block")
    blocked = materialize(blocked, "_block")
    rounds = (blocked.agg(F.max("_block")).first()[0] or 0) + 1
    size = _set_size(len(params), losses)
    parts = F.explode(F.array(*[F.lit(i) for i in range(-(-len(params) // size))]))
    unused = ["_block", *(["match_date"] if losses else [])]
    state = spark.createDataFrame([], SCHEMA)
    fold = _folder(kind, params, losses)
    base = scratch_dir(spark)
    folders = [f"{base}/{r}" for r in range(rounds)]
    for r, folder in enumerate(folders):
        block = blocked.where(F.col("_block") == r).drop(*unused).withColumn("_part", parts)
        before = state.where("tag = 'team'").withColumn("_part", F.floor(F.col("param_id") / size).cast("int"))
        block.groupBy("league", "_part").cogroup(before.groupBy("league", "_part")).applyInPandas(fold, SCHEMA).write.parquet(folder)
        state = spark.read.schema(SCHEMA).parquet(folder)
    # every round's match or loss rows, and the last round's teams
    return spark.read.schema(SCHEMA).parquet(*folders).where("tag <> 'team'").unionByName(state.where("tag = 'team'"))


def _history(folded: DataFrame, kind: str) -> DataFrame:
    v = F.col("vals")
    names = ("p_away", "p_draw", "p_home", *KERNELS[kind].columns)
    return folded.where("tag = 'match'").select("league", "param_id", "match_id", "match_date", "home_team", "away_team", "y", "learned",
                                                *[v[i].alias(n) for i, n in enumerate(names)])


def pi_rating(matches: DataFrame, params: Sequence[Mapping] = ({},), league_col: str = "division", **kw) -> DataFrame:
    """Pre-match mu, sigma and probabilities of the ordered-probit rating, one row per (match, parameter set)."""
    return _history(fold_matches(matches, params, "pi", league_col, **kw), "pi")


def poisson_rating(matches: DataFrame, params: Sequence[Mapping] = ({},), league_col: str = "division", **kw) -> DataFrame:
    """Pre-match goal rates and low-score-corrected probabilities of the four-parameter rating."""
    return _history(fold_matches(matches, params, "poisson", league_col, **kw), "poisson")


def sample_params(grid: Mapping[str, Sequence[float]], n: int, seed: int = 42) -> list[dict]:
    """n distinct points of a parameter grid, drawn with a fixed seed."""
    keys = list(grid)
    size = 1
    for k in keys:
        size *= len(grid[k])
    picks = random.Random(seed).sample(range(size), min(n, size))
    combos = []
    for pick in picks:
        point = {}
        for k in keys:
            pick, i = divmod(pick, len(grid[k]))
            point[k] = grid[k][i]
        combos.append(point)
    return combos


def full_grid(grid: Mapping[str, Sequence[float]]) -> list[dict]:
    return [dict(zip(grid, point)) for point in itertools.product(*grid.values())]


def rating_search(matches: DataFrame, params: Sequence[Mapping], kind: str = "pi", league_col: str = "division", **kw) -> DataFrame:
    """Walk-forward negative log likelihood per parameter set; `best` marks the smallest."""
    losses = fold_matches(matches, params, kind, league_col, losses=True, **kw).where("tag = 'loss'")
    nll = losses.groupBy("param_id").agg(F.sum(F.col("vals")[0]).cast("long").alias("n"), F.sum(F.col("vals")[1]).alias("nll"))
    # one row per parameter set
    return nll.withColumn("best", (F.row_number().over(Window.orderBy("nll", "param_id")) == 1).cast("int"))


def rating_eval(matches: DataFrame, cut_date: str, params: Mapping | None = None, kind: str = "pi", update: bool = True,
                league_col: str = "division", **kw) -> DataFrame:
    """Predictions from the cut date on: ratings frozen at the cut, or updated after every match."""
    h = _history(fold_matches(matches, [params or {}], kind, league_col, cut_date=cut_date, update=update, **kw), kind)
    return h.where(F.col("match_date") >= F.lit(cut_date).cast("date")).drop("learned")


def rating_features(matches: DataFrame, history: DataFrame, param_id: int = 0) -> DataFrame:
    """Join pre-match rating columns by match."""
    h = history.where(F.col("param_id") == param_id)
    cols = [F.col(f"p_{o}").alias(f"rating_p_{o}") for o in ("away", "draw", "home")]
    if "home_mu" in history.columns:
        cols += [F.col(c).alias(f"rating_{c}") for c in KERNELS["pi"].columns]
        cols.append((F.col("home_mu") - F.col("away_mu")).alias("rating_mu_diff"))
    else:
        cols += [F.col(c).alias(f"rating_{c}") for c in ("lambda_home", "lambda_away")]
    return matches.join(h.select("match_id", *cols), "match_id", "left")


def team_strengths(matches: DataFrame, params: Mapping | None = None, kind: str = "poisson", league_col: str = "division", **kw) -> DataFrame:
    """Final parameters per team with net attack and defence (Poisson) or mu and sigma (pi)."""
    t = fold_matches(matches, [params or {}], kind, league_col, **kw).where("tag = 'team'")
    v = F.col("vals")
    if kind == "pi":
        return t.select("league", "team", v[0].alias("mu"), v[1].alias("sigma"), v[2].cast("int").alias("games"))
    return t.select("league", "team", v[0].alias("home_attack"), v[1].alias("home_defence"), v[2].alias("away_attack"),
                    v[3].alias("away_defence"), (v[0] + v[2]).alias("net_attack"), (v[1] + v[3]).alias("net_defence"),
                    v[4].cast("int").alias("games"))
