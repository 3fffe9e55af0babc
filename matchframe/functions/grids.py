"""Batch arithmetic on score grids (used inside tasks, on Arrow batches).

A grid column is array<double>: the square home x away matrix in row-major order.
Grids of one size in a batch are handled as one (matches, home, away) tensor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from .stats import MAX_GOALS_SUPPORT

CLASS_NAMES = ("away", "draw", "home")
LOG_FACT = np.array([math.lgamma(k + 1.0) for k in range(MAX_GOALS_SUPPORT + 1)])


def pmf(rate: np.ndarray, top: int) -> np.ndarray:
    """(matches, top + 1) Poisson probabilities."""
    k = np.arange(top + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.exp(k * np.log(rate)[:, None] - rate[:, None] - LOG_FACT[: top + 1])


def classes(n: int) -> np.ndarray:
    """0 away, 1 draw, 2 home for every cell."""
    side = np.arange(n)
    return np.sign(side[:, None] - side[None, :]) + 1


def numbers(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def tensors(grid: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, tensor) per grid size; null or non-square grids are left out."""
    lengths = np.diff(grid.offsets.to_numpy())
    starts = grid.offsets.to_numpy()[:-1]
    valid = grid.is_valid().to_numpy(zero_copy_only=False)
    values = grid.values.to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[valid]):
        side = math.isqrt(int(size))
        if side < 2 or side * side != size:
            continue
        rows = np.flatnonzero(valid & (lengths == size))
        yield rows, values[starts[rows][:, None] + np.arange(size)].reshape(-1, side, side)


def to_lists(blocks: Sequence[tuple[np.ndarray, np.ndarray]], n_rows: int) -> pa.ListArray:
    """Blocks of equal-sized grids back to one list column in row order (null where no block has the row)."""
    lengths = np.zeros(n_rows, dtype=np.int64)
    for rows, t in blocks:
        lengths[rows] = t[0].size
    ends = np.cumsum(lengths)
    starts = ends - lengths
    values = np.empty(int(ends[-1]) if n_rows else 0)
    for rows, t in blocks:
        values[starts[rows][:, None] + np.arange(t[0].size)] = t.reshape(len(rows), -1)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(lengths == 0))


def masses(t: np.ndarray) -> np.ndarray:
    """(matches, 3) outcome masses."""
    cls = classes(t.shape[1])
    return np.stack([t[:, cls == k].sum(axis=1) for k in range(3)], axis=1)


def fixed(lh: np.ndarray, la: np.ndarray, top: int, renormalise: bool) -> np.ndarray:
    t = pmf(lh, top)[:, :, None] * pmf(la, top)[:, None, :]
    return t / t.sum(axis=(1, 2), keepdims=True) if renormalise else t


def tails(rate: np.ndarray, cap: int) -> np.ndarray:
    """(matches, cap + 1): mass above every number of goals, added up from the far end, so that it
    is accurate where one minus a cumulated sum would have no digits left."""
    p = pmf(rate, cap)
    with np.errstate(divide="ignore", invalid="ignore"):
        # ratios of later terms fall, so the rest is below a geometric series
        beyond = np.where(rate < cap + 1, p[:, -1] * rate / (cap + 1 - rate), 1.0)
    return np.cumsum(np.column_stack([beyond, p[:, :0:-1]]), axis=1)[:, ::-1]


def adaptive_support(lh: np.ndarray, la: np.ndarray, tol: float, cap: int) -> np.ndarray:
    """Smallest n >= 10 that leaves at most tol/4 of either side out, and so at most tol of the joint mass."""
    if not (np.isfinite(lh).all() and np.isfinite(la).all() and (lh > 0).all() and (la > 0).all()):
        raise ValueError("rates must be positive and finite")
    enough = (tails(lh, cap) <= tol / 4) & (tails(la, cap) <= tol / 4)
    enough[:, :10] = False
    if not enough.any(axis=1).all():
        raise ValueError(f"score support above {cap} goals")
    return enough.argmax(axis=1)


def low_score_factors(t: np.ndarray, lh: np.ndarray, la: np.ndarray, rho: float) -> np.ndarray:
    out = t.copy()
    for i, j, factor in ((0, 0, 1 - lh * la * rho), (1, 1, np.full_like(lh, 1 - rho)), (0, 1, 1 + lh * rho), (1, 0, 1 + la * rho)):
        out[:, i, j] *= np.maximum(factor, 0.0)
    return out / out.sum(axis=(1, 2), keepdims=True)


def reweight(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Every class scaled to its probability q[:, class]."""
    mass = masses(t)
    for k, name in enumerate(CLASS_NAMES):
        if ((mass[:, k] == 0) & (q[:, k] > 0)).any():
            raise ValueError(f"no score mass for {name}")
    cls = classes(t.shape[1])
    # divide first: q / mass could overflow when the mass is subnormal
    share = np.divide(t, mass[:, cls], out=np.zeros_like(t), where=mass[:, cls] > 0)
    return share * q[:, cls]
