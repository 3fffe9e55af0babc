"""Score-line distributions.

A grid is one array column per match (`grid`, row-major home x away). Every
operator is a projection, vectorised over Arrow batches: no shuffle, and the
hundreds of cells of a match exist as rows only if `explode_grid` is asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import grids as N
from ..functions.stats import MAX_GOALS_SUPPORT

ATOL = 3e-12
CLASS_NAMES = N.CLASS_NAMES
STATS_TYPE = ("struct<expected_home_goals: double, expected_away_goals: double, mode_home_goals: int, mode_away_goals: int, "
              "true_score_nll: double, actual_outside_grid: int>")


def _struct(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _doubles(values: np.ndarray) -> pa.Array:
    """NaN, the mark of a row without a usable grid, as null."""
    return pa.array(values, mask=np.isnan(values))


def _batch(part, rows=slice(None)) -> np.ndarray:
    return N.numbers(part)[rows]


def score_grid_fixed(rates: DataFrame, max_goals: int = 10, renormalise: bool = True, lh: str = "lambda_home",
                     la: str = "lambda_away") -> DataFrame:
    """Independent Poisson scores 0..max_goals, divided by the kept mass."""
    @arrow_udf("array<double>")
    def build(h: pa.Array, a: pa.Array) -> pa.Array:
        x, y = _batch(h), _batch(a)
        rows = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))  # a missing rate has no grid
        return N.to_lists([(rows, N.fixed(x[rows], y[rows], max_goals, renormalise))] if len(rows) else [], len(h))

    return rates.select("*", build(lh, la).alias("grid"), F.lit(max_goals).alias("grid_max"))


def score_grid_adaptive(rates: DataFrame, tol: float = 1e-12, cap: int = MAX_GOALS_SUPPORT, lh: str = "lambda_home",
                        la: str = "lambda_away") -> DataFrame:
    """Support chosen from the rates alone: the omitted joint mass is at most `tol`.

    A rate that needs more than `cap` goals raises an error.
    """
    @arrow_udf("struct<grid: array<double>, grid_max: int, omitted_mass: double>")
    def build(h: pa.Array, a: pa.Array) -> pa.Array:
        x, y = _batch(h), _batch(a)
        top = N.adaptive_support(x, y, tol, cap) if len(x) else np.zeros(0, dtype=int)
        blocks, kept = [], np.ones(len(x))
        for n in np.unique(top):
            rows = np.flatnonzero(top == n)
            raw = N.fixed(x[rows], y[rows], int(n), False)
            kept[rows] = raw.sum(axis=(1, 2))
            blocks.append((rows, raw / kept[rows][:, None, None]))
        return _struct(grid=N.to_lists(blocks, len(x)), grid_max=top.astype(np.int32), omitted_mass=np.maximum(0.0, 1.0 - kept))

    return rates.withColumn("_g", build(lh, la)).select(*rates.columns, "_g.grid", "_g.grid_max", "_g.omitted_mass")


def explode_grid(grids: DataFrame, id_col: str = "match_id", grid: str = "grid") -> DataFrame:
    side = F.round(F.sqrt(F.size(grid).cast("double"))).cast("int")
    cells = grids.select(id_col, side.alias("_n"), F.posexplode(grid).alias("_k", "p"))
    return cells.select(id_col, F.floor(F.col("_k") / F.col("_n")).cast("int").alias("hg"), (F.col("_k") % F.col("_n")).alias("ag"), "p")


def grid_to_outcome(grids: DataFrame, prefix: str = "s_", grid: str = "grid") -> DataFrame:
    """Masses of away win, draw, home win."""
    @arrow_udf("struct<away: double, draw: double, home: double>")
    def outcome(g: pa.Array) -> pa.Array:
        out = np.full((len(g), 3), np.nan)
        for rows, t in N.tensors(g):
            out[rows] = N.masses(t)
        return _struct(away=_doubles(out[:, 0]), draw=_doubles(out[:, 1]), home=_doubles(out[:, 2]))

    return grids.withColumn("_o", outcome(grid)).select(*grids.columns, *[F.col(f"_o.{n}").alias(f"{prefix}{n}") for n in CLASS_NAMES])


def dixon_coles(grids: DataFrame, rho: float = -0.2, lh: str = "lambda_home", la: str = "lambda_away") -> DataFrame:
    """Adjust the four low cells, clip at 0, renormalise. rho = 0 leaves the grid as it is."""
    if rho == 0:
        return grids

    @arrow_udf("array<double>")
    def adjust(g: pa.Array, h: pa.Array, a: pa.Array) -> pa.Array:
        return N.to_lists([(rows, N.low_score_factors(t, _batch(h, rows), _batch(a, rows), rho)) for rows, t in N.tensors(g)], len(g))

    return grids.withColumn("grid", adjust("grid", lh, la))


def reweight_grid(grids: DataFrame, probs=("p_away", "p_draw", "p_home"), out: str = "grid") -> DataFrame:
    """Scale each outcome class of the grid to a given probability, keeping ratios within the class.

    A class without mass is an error if its probability is positive, and stays 0 otherwise.
    """
    @arrow_udf("array<double>")
    def scale(g: pa.Array, qa: pa.Array, qd: pa.Array, qh: pa.Array) -> pa.Array:
        return N.to_lists([(rows, N.reweight(t, np.stack([_batch(q, rows) for q in (qa, qd, qh)], axis=1))) for rows, t in N.tensors(g)], len(g))

    return grids.withColumn(out, scale("grid", *probs))


def _closed_form(t, h, a, x, y, q) -> np.ndarray:
    """Log probability of scores outside the grid, without growing it."""
    n = t.shape[1] - 1
    lgam = np.vectorize(lambda k: float(math.lgamma(k + 1.0)), otypes=[float])
    lp = h * np.log(x) - x - lgam(h) + a * np.log(y) - y - lgam(a)
    raw = N.fixed(x, y, n, False)
    if q is None:
        return lp - np.log(raw.sum(axis=(1, 2)))
    cls = (np.sign(h - a) + 1).astype(int)
    pick = np.arange(len(h)), cls
    return np.log(q[pick]) + lp - np.log(N.masses(raw)[pick])


def score_stats(grids: DataFrame, hg: str = "home_goals", ag: str = "away_goals", target: tuple[str, str, str] | None = None,
                lh: str = "lambda_home", la: str = "lambda_away", grid: str = "grid") -> DataFrame:
    """Expected goals, modal score, probability of the true score, hits and absolute errors.

    A true score outside the grid gets the closed form; the grid is not grown to
    reach it. `target` names the class probabilities a re-weighted grid was set to.
    """
    @arrow_udf(STATS_TYPE)
    def stats(g: pa.Array, h: pa.Array, a: pa.Array, x: pa.Array, y: pa.Array, *q: pa.Array) -> pa.Array:
        m = len(g)
        mean, mode, log_p, outside = np.full((m, 2), np.nan), np.zeros((m, 2), dtype=np.int32), np.full(m, np.nan), np.zeros(m, dtype=np.int32)
        for rows, t in N.tensors(g):
            n = t.shape[1]
            axis = np.arange(n, dtype=float)
            mean[rows, 0], mean[rows, 1] = t.sum(axis=2) @ axis, t.sum(axis=1) @ axis
            first = t.reshape(len(rows), -1).argmax(axis=1)  # first maximum in row-major order
            mode[rows, 0], mode[rows, 1] = first // n, first % n
            hh, aa = _batch(h, rows), _batch(a, rows)
            far = (hh >= n) | (aa >= n)
            outside[rows] = far
            near = np.flatnonzero(~far)
            with np.errstate(divide="ignore"):
                log_p[rows[near]] = np.log(t[near, hh[near].astype(int), aa[near].astype(int)])
            if far.any():
                k = np.flatnonzero(far)
                probs = np.stack([_batch(c, rows[k]) for c in q], axis=1) if q else None
                log_p[rows[k]] = _closed_form(t, hh[k], aa[k], _batch(x, rows[k]), _batch(y, rows[k]), probs)
        none = np.isnan(mean[:, 0])
        return _struct(expected_home_goals=_doubles(mean[:, 0]), expected_away_goals=_doubles(mean[:, 1]), mode_home_goals=pa.array(mode[:, 0], mask=none), mode_away_goals=pa.array(mode[:, 1], mask=none),
                       true_score_nll=_doubles(-log_p), actual_outside_grid=pa.array(outside, mask=none))

    out = grids.withColumn("_s", stats(grid, hg, ag, lh, la, *(target or ()))).select(*grids.columns, "_s.*")
    h, a = F.col(hg), F.col(ag)
    eh, ea = F.col("expected_home_goals"), F.col("expected_away_goals")
    home, away, total = F.abs(eh - h), F.abs(ea - a), F.abs(eh + ea - (h + a))
    return out.select(
        "*", F.exp(-F.col("true_score_nll")).alias("true_score_probability"),
        ((F.col("mode_home_goals") == h) & (F.col("mode_away_goals") == a)).cast("int").alias("exact_score_hit"),
        home.alias("home_abs_error"), away.alias("away_abs_error"), (home <= 1).cast("int").alias("home_within_1"),
        (away <= 1).cast("int").alias("away_within_1"), total.alias("total_abs_error"), (total <= 1).cast("int").alias("total_within_1"))


def nll_identity_check(df: DataFrame, fused_nll: str, base_nll: str, y: str = "y",
                       s=("s_away", "s_draw", "s_home"), q=("p_away", "p_draw", "p_home"), tol: float = 5e-10) -> DataFrame:
    """Rows where NLL(fused) - NLL(base) differs from ln S(y) - ln q(y)."""
    def pick(cols):
        return F.when(F.col(y) == 0, F.col(cols[0])).when(F.col(y) == 1, F.col(cols[1])).otherwise(F.col(cols[2]))
    gap = (F.col(fused_nll) - F.col(base_nll)) - (F.ln(pick(s)) - F.ln(pick(q)))
    # a list of at most one violation per row; a filter would be pushed below the grid
    # computations and repeat them
    bad = F.filter(F.array(gap), lambda g: g.isNull() | F.isnan(g) | (F.abs(g) > tol))
    return df.select("*", F.explode(bad).alias("identity_gap"))


def over_under_prob(grids: DataFrame, threshold: float = 2.5, out: str = "p_over") -> DataFrame:
    @arrow_udf("double")
    def over(g: pa.Array) -> pa.Array:
        p = np.full(len(g), np.nan)
        for rows, t in N.tensors(g):
            side = np.arange(t.shape[1])
            p[rows] = np.minimum(1.0, t[:, side[:, None] + side[None, :] > threshold].sum(axis=1))
        return pa.array(p, mask=np.isnan(p))

    return grids.withColumn(out, over("grid"))


def grid_validate(grids: DataFrame, probs: tuple[str, str, str] | None = None, atol: float = ATOL, id_col: str = "match_id") -> DataFrame:
    """Broken grids (and probability triples) as rows (id, problem)."""
    @arrow_udf("string")
    def problem(g: pa.Array, *q: pa.Array) -> pa.Array:
        found = np.full(len(g), "not_square", dtype=object)
        for rows, t in N.tensors(g):
            flat = t.reshape(len(rows), -1)
            bad = ~(np.isfinite(flat) & (flat >= 0)).all(axis=1)
            with np.errstate(invalid="ignore"):
                off = ~(np.abs(flat.sum(axis=1) - 1) <= atol)
            found[rows] = np.where(bad, "negative_or_not_finite", np.where(off, "not_normalised", None))
        if q:
            p = np.stack([_batch(c) for c in q], axis=1)
            bad = ~(np.isfinite(p) & (p >= 0)).all(axis=1)
            label = np.where(bad, "bad_probability", np.where(~(np.abs(p.sum(axis=1) - 1) <= atol), "probabilities_not_normalised", None))
            found = np.where(found == None, label, found)  # noqa: E711 - elementwise
        return pa.array(found, type=pa.string())

    # exploding the list of problems emits broken rows only, without a filter that
    # would be pushed below the grid computation
    found = F.filter(F.array(problem("grid", *(probs or ()))), lambda p: p.isNotNull())
    return grids.select(id_col, F.explode(found).alias("problem"))


def poisson_outcome_tail(rates: DataFrame, max_goals: int = 8, lh: str = "lambda_home", la: str = "lambda_away") -> DataFrame:
    """Home and draw masses of an unnormalised grid; away takes the rest, tail included."""
    g = grid_to_outcome(score_grid_fixed(rates, max_goals, renormalise=False, lh=lh, la=la), "_s_")
    kept = [c for c in rates.columns if c not in ("p_away", "p_draw", "p_home")]
    return g.select(*kept, (1.0 - F.col("_s_home") - F.col("_s_draw")).alias("p_away"),
                    F.col("_s_draw").alias("p_draw"), F.col("_s_home").alias("p_home"))
