"""Second-order fits of linear models, many at once.

Rows are written once in compressed blocks (`plans/packed`) and a pass is one scan of them: every
task adds up loss and gradient of all fits that are asked for, and one Hessian per group of fits
(same rows, label and family), that of the widest. All fits of a group step by their part of it;
one that does not gain enough that way gets a Hessian of its own in the next pass. Vectors are added
in two levels and the driver takes the steps. A pass needs no shuffle of rows, and about ten passes
reach the optimum where first-order methods take hundreds. What returns to the driver is a few
hundred numbers per fit, and a Hessian where one was made.

Fits may differ in columns, training seasons, penalty and family and still share scans. Columns
are centred and scaled inside a fit (the penalty is put back to the caller's units), so raw
columns of any size are solved accurately.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.packed import blocks, packed
from ..plans.session import scratch_scope

SLOTS = 32        # partial sums of a fit that a task adds up, per level
MAX_PASSES = 60
HALVINGS = 30
CLASSES = 3
STRIP = 1024      # rows and
TOGETHER = 16     # fits whose margins a task works on at once: they stay in the processor's cache
GAIN = 0.05       # a step by a shared Hessian that leaves more of the slope calls for an own one
SHARED_TOL = 1e-4  # a step by a shared Hessian does not square the distance, so it has to be this much closer
PROXIMAL = 1e-9   # of the diagonal: pull of a lasso step to where it starts
ACTIVE_CHANGES = 5000


@dataclass(frozen=True)
class Fit:
    """One model. `until` keeps seasons before it as training rows, `positive` is the class a
    logistic fit tells from the rest, `c` weighs the total loss against the penalty."""

    name: str
    cols: tuple[str, ...]
    family: str = "softmax"      # softmax, logistic, poisson
    penalty: str = "l2"          # l2, l1, none
    c: float = 1.0
    scaled: bool = False         # the penalty is on coefficients of standardised columns
    label: str = "y"
    positive: int = 1
    until: int | None = None
    weight: str | None = None


@dataclass(frozen=True)
class Solution:
    """Coefficients (outputs x columns) and intercepts in units of the filled columns."""

    fit: Fit
    n: int
    means: np.ndarray
    sds: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray
    loss: float
    passes: int
    converged: bool


# ---- column statistics

def _merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Rows (in the first column) and per column count, mean and squared deviations of both parts."""
    if a is None:
        return b
    count = a[0] + b[0]
    gap, share = b[1] - a[1], b[0] / np.maximum(count, 1.0)
    return np.stack([count, a[1] + gap * share, a[2] + b[2] + gap * gap * a[0] * share])


def _season_parts(when: np.ndarray, x: np.ndarray, total: dict[float | None, np.ndarray]) -> None:
    """Add to the sums per season (a null one is None) those of a (columns, rows) array."""
    for s in np.unique(when):
        part = x if when[0] == s and (when == s).all() else x[:, np.isnan(when) if np.isnan(s) else when == s]
        there = ~np.isnan(part)
        count = there.sum(1).astype(float)
        mean = np.where(there, part, 0.0).sum(1) / np.maximum(count, 1.0)
        key = None if np.isnan(s) else float(s)
        total[key] = _merged(total.get(key), np.stack([count, mean, (np.where(there, part - mean[:, None], 0.0) ** 2).sum(1)]))


def _sums_batch(total: dict[float | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["season", "v"])


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per season of a task's rows (season, columns): count, mean and squared deviations of each
    column; the last column is a one for every row."""
    total: dict[float | None, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            when, *values = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            _season_parts(when, np.stack([*values, np.ones(batch.num_rows)]), total)
    yield from _sums_batch(total)


def _packed_sums(width: int, k: int, label: int, season: int | None):
    """The same over packed rows: the first k columns of those with a label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[float | None, np.ndarray] = {}
        for block in blocks(batches, width):
            keep = ~np.isnan(block[label])
            if not keep.any():
                continue
            rows = block if keep.all() else block[:, keep]
            _season_parts(rows[season] if season is not None else np.zeros(rows.shape[1]), np.vstack([rows[:k], np.ones(rows.shape[1])]), total)
        yield from _sums_batch(total)
    return run


def _add_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[float | None, np.ndarray] = {}
    for batch in batches:
        for key, v in zip(*(c.to_pylist() for c in batch.columns)):
            total[key] = _merged(total.get(key), np.frombuffer(v).reshape(3, -1))
    yield from _sums_batch(total)


def _moments(df: DataFrame, cols: Sequence[str], season: str | None) -> list[dict]:
    """Count of rows and, per column, count, mean and variance: one entry per season. Tasks add up
    vectors; hundreds of aggregates in one projection would run as code that is too long to compile."""
    when = F.col(season).cast("double") if season else F.lit(0.0)
    sums = df.select(when.alias("season"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).mapInArrow(_column_sums, "season double, v binary")
    return _entries(sums, len(cols))


def _entries(sums: DataFrame, k: int) -> list[dict]:
    out = []
    for row in sums.repartition(8, "season").mapInArrow(_add_columns, "season double, v binary").collect():
        count, mean, square = np.frombuffer(row.v).reshape(3, -1)
        entry = {"season": row.season, "n": int(count[-1])}
        for i in range(k):
            entry |= {f"c{i}": int(count[i]), f"m{i}": float(mean[i]), f"v{i}": float(square[i] / max(count[i], 1.0))}
        out.append(entry)
    return out


def _pooled(rows: list, k: int, until: int | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and deviations of the mean-filled columns over the seasons before `until`."""
    rows = [r for r in rows if until is None or (r["season"] is not None and r["season"] < until)]
    n = sum(r["n"] for r in rows)
    means, sds = np.zeros(k), np.ones(k)
    for i in range(k):
        parts = [(r[f"c{i}"], r[f"m{i}"], r[f"v{i}"]) for r in rows if r[f"c{i}"]]
        count = sum(p[0] for p in parts)
        if count:
            means[i] = math.fsum(p[0] * p[1] for p in parts) / count
            spread = math.fsum(p[0] * (p[2] + (p[1] - means[i]) ** 2) for p in parts) / n
            sds[i] = math.sqrt(spread) if spread > 1e-20 * max(1.0, means[i] ** 2) else 1.0
    return n, means, sds


# ---- one pass

@dataclass
class _State:
    """Where a fit stands: `theta` is to be evaluated; `best` is the last accepted point."""

    fit: Fit
    index: np.ndarray          # its columns among all, and the column of ones behind them
    means: np.ndarray
    sds: np.ndarray
    ridge: np.ndarray          # penalty per column inside, zero for the intercept
    theta: np.ndarray          # (columns + 1) x outputs, the intercept last
    best: np.ndarray | None = None
    step: np.ndarray | None = None
    value: float = math.inf
    slope: float = 0.0
    halved: int = 0
    passes: int = 0
    done: bool = False
    own: bool = False          # the Hessian of the next pass is its own


def _outputs(fit: Fit) -> int:
    return CLASSES - 1 if fit.family == "softmax" else 1


def _group(fit: Fit) -> tuple:
    """Fits of one group have one Hessian wherever their probabilities are the same."""
    return fit.until, fit.label, fit.family, fit.positive if fit.family == "logistic" else None, fit.weight


def _softmax(eta: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Probabilities of all classes and the log of their common divisor from the margins (..., outputs, rows) of all but
    the last. Softmax coefficients add up to zero over the classes: the last class is minus the sum of the others."""
    last = eta.sum(-2)
    e = [eta[..., c, :] + last for c in range(eta.shape[-2])]
    far = max((max(u.max(initial=0.0), -u.min(initial=0.0)) for u in e), default=0.0)
    if far < 300.0:
        for u in e:
            np.exp(u, out=u)
        total = sum(e) + 1.0
        share = 1.0 / total
        norm = np.log(total) - last
    else:
        top = np.maximum(np.maximum.reduce(e), 0.0)
        e = [np.exp(u - top) for u in e]
        rest = np.exp(-top)
        total = sum(e) + rest
        norm, share = np.log(total) + top - last, rest / total
        return [*[u / total for u in e], share], norm
    for u in e:
        u *= share
    return [*e, share], norm


def _gradients(fit: Fit, x: np.ndarray, y: np.ndarray, w: np.ndarray | None, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss (fits) and gradient (fits, outputs, columns) of many fits like `fit`; x holds columns
    and ones (columns, rows), theta is (fits, outputs, columns)."""
    many, k, d = theta.shape
    eta = (theta.reshape(many * k, d) @ x).reshape(many, k, -1)
    weight = np.ones(len(y)) if w is None else w
    if fit.family == "softmax":
        p, loss = _softmax(eta)
        err = np.empty_like(eta)
        loss = loss @ weight
        last = (y == CLASSES - 1).astype(float)
        for c in range(k):
            own = (y == c) - last
            loss -= eta[:, c] @ (own * weight)
            np.subtract(p[c], p[-1], out=err[:, c])
            err[:, c] -= own
    elif fit.family == "logistic":
        t = (y == fit.positive).astype(float)
        e = np.exp(-np.abs(eta))
        loss = (np.maximum(eta, 0) - t * eta + np.log(1.0 + e))[:, 0] @ weight
        err = np.where(eta >= 0, 1.0, e) / (1.0 + e) - t
    else:
        z = np.clip(eta, -700, 60)
        mu = np.exp(z)
        loss, err = (mu - y * z)[:, 0] @ weight, mu - y
    if w is not None:
        err *= w
    return loss, (err.reshape(many * k, -1) @ x.T).reshape(many, k, d)


def _hessian(fit: Fit, x: np.ndarray, w: np.ndarray | None, theta: np.ndarray) -> np.ndarray:
    """Hessian blocks (pairs of outputs, columns, columns) of the rows at one theta (outputs, columns)."""
    eta = theta @ x
    if fit.family == "softmax":
        p = _softmax(eta)[0]
        a = [q - p[-1] for q in p[:-1]]
        bends = [((p[i] if i == j else 0.0) + p[-1] - a[i] * a[j]) for i in range(CLASSES - 1) for j in range(i, CLASSES - 1)]
    elif fit.family == "logistic":
        p = 1.0 / (1.0 + np.exp(-np.clip(eta[0], -700, 700)))
        bends = [p * (1 - p)]
    else:
        bends = [np.exp(np.clip(eta[0], -700, 60))]
    return np.stack([(x * (b if w is None else b * w)) @ x.T for b in bends])


SUMS = pa.schema([("part", pa.int32()), ("slot", pa.int32()), ("v", pa.binary())])


@dataclass
class _Ask:
    """What a pass adds up for one group: loss and gradient of its fits as one part, the Hessian at
    the widest fit and those of single fits as parts of their own (part, columns, theta)."""

    fit: Fit
    part: int
    theta: np.ndarray          # (fits, outputs, columns and ones), zero for columns that a fit does not have
    hessians: list[tuple[int, np.ndarray, np.ndarray]]


def _scan(asks: list[_Ask], centres: dict, k: int, places: dict[str, int], season: int | None, width: int):
    """Sums of all groups over a task's blocks (columns, then the extra ones). Groups of the same
    training rows share one centred array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() % SLOTS
        sums: dict[int, np.ndarray] = {}

        def add(part: int, v: np.ndarray) -> None:
            if part in sums:
                sums[part] += v
            else:
                sums[part] = v
        for block in (b[:, i:i + STRIP] for b in blocks(batches, width) for i in range(0, b.shape[1], STRIP)):
            for (until, label), (means, sds) in centres.items():
                members = [a for a in asks if (a.fit.until, a.fit.label) == (until, label)]
                keep = ~np.isnan(block[places[label]])
                if until is not None:
                    keep &= block[season] < until  # a null season compares as false
                if not members or not keep.any():
                    continue
                rows = block if keep.all() else block[:, keep]
                x = np.ones((k + 1, rows.shape[1]))
                np.subtract(rows[:k], means[:, None], out=x[:k])
                x[:k] /= sds[:, None]
                for i in np.flatnonzero(np.isnan(x.sum(1))):
                    x[i, np.isnan(x[i])] = 0.0
                target = rows[places[label]]
                for a in members:
                    w = rows[places[a.fit.weight]] if a.fit.weight else None
                    found = [_gradients(a.fit, x, target, w, a.theta[i:i + TOGETHER]) for i in range(0, len(a.theta), TOGETHER)]
                    add(a.part, np.concatenate([*[f[0] for f in found], *[f[1].ravel() for f in found]]))
                    for part, index, theta in a.hessians:
                        add(part, _hessian(a.fit, x if len(index) == k + 1 else x[index], w, theta).ravel())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([slot] * len(sums), pa.int32()),
                                              pa.array([v.tobytes() for v in sums.values()], pa.binary())], schema=SUMS)
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, _, v in zip(*(c.to_pylist() for c in batch.columns)):
            v = np.frombuffer(v)
            total[part] = total[part] + v if part in total else v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()),
                                          pa.array([v.tobytes() for v in total.values()], pa.binary())], schema=SUMS)


def _full(v: np.ndarray, k: int, d: int) -> np.ndarray:
    """The Hessian (outputs, columns, outputs, columns) from its blocks."""
    hess, at = np.zeros((k, d, k, d)), 0
    for i in range(k):
        for j in range(i, k):
            block = v[at:at + d * d].reshape(d, d)
            hess[i, :, j], hess[j, :, i] = block, block.T
            at += d * d
    return hess


def _coupling(k: int) -> np.ndarray:
    """Second derivatives of half the squared norm over outputs; softmax has one more, dependent."""
    return np.eye(1) if k == 1 else np.eye(k) + np.ones((k, k))


def _lasso_step(grad: np.ndarray, hess: np.ndarray, theta: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The step to the least value of the quadratic model with an absolute penalty, by active sets: the
    signed columns are solved as one linear system up to the best change of sign on the way, and the
    column with the largest violation joins. Columns that are sums of others make coordinate descent
    creep, not this; a small pull to theta (proximal, it moves no optimum) keeps their system solvable."""
    curve = np.diag(hess)
    scale = np.sqrt(np.where(curve > 1e-14 * curve.max(initial=0.0), curve, 1.0))  # a constant column has none
    h = hess / np.outer(scale, scale)
    h[np.diag_indices_from(h)] += PROXIMAL
    q, start, pull = grad / scale, theta * scale, lam / scale
    w, free = start.copy(), pull == 0
    slope = q.copy()                                  # of the quadratic part at w
    small = 1e-12 * max(np.abs(q).max(), pull.max(initial=0.0), 1e-300)
    sign = np.sign(w)
    for _ in range(ACTIVE_CHANGES):
        on = np.flatnonzero(free | (sign != 0))
        gap = slope[on] + pull[on] * sign[on]
        if np.abs(gap).max(initial=0.0) <= small:
            off = np.abs(slope) - pull
            off[on] = 0.0
            j = int(off.argmax())
            if off[j] <= small:
                break
            sign[j] = -np.sign(slope[j])
            continue
        move = np.linalg.solve(h[np.ix_(on, on)], -gap)
        # the model along the move is a parabola between the points where a column changes its sign
        at = np.divide(-w[on], move, out=np.full(len(on), np.inf), where=(move != 0) & ~free[on])
        turns = np.unique(np.append(at[(at > 0) & (at < 1)], 1.0))
        g0, bend = slope[on] @ move, move @ h[np.ix_(on, on)] @ move
        points = w[on] + turns[:, None] * move
        points[at == turns[:, None]] = 0.0
        value = turns * g0 + 0.5 * turns ** 2 * bend + (np.abs(points) - np.abs(w[on])) @ pull[on]
        best = points[int(value.argmin())]
        if value.min() >= 0.0:                        # rounding is all that is left
            sign[on[w[on] == 0]] = 0.0
            break
        slope += h[:, on] @ (best - w[on])
        w[on] = best
        sign[on] = np.where(free[on], 0.0, np.sign(best))
    return np.where(w == start, 0.0, np.where(w == 0, -theta, (w - start) / scale))


def _newton_step(s: _State, loss: float, grad: np.ndarray, hess: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Objective at theta, the slope along the next step, and the step; gradient (outputs one after
    the other) and Hessian are without the penalty."""
    d, k = s.theta.shape
    flat = s.theta.T.ravel()
    if s.fit.penalty == "l1":
        lam = np.tile(s.ridge, k)
        step = _lasso_step(grad, hess, flat, lam)
        slope = grad @ step + lam @ (np.abs(flat + step) - np.abs(flat))
        return loss + lam @ np.abs(flat), slope, step.reshape(k, d).T
    bend = np.kron(_coupling(k), np.diag(s.ridge))
    grad, total = grad + bend @ flat, hess + bend
    scale = np.sqrt(np.maximum(np.diag(total), 1e-300))
    step = -np.linalg.lstsq(total / np.outer(scale, scale), grad / scale, rcond=1e-13)[0] / scale
    return loss + 0.5 * flat @ bend @ flat, grad @ step, step.reshape(k, d).T


def _advance(s: _State, value: float, slope: float, step: np.ndarray, tol: float, exact: bool = True) -> None:
    """Take the evaluated point if it is good enough, else go back half of the way. The step comes
    from the fit's own Hessian if `exact`, else from that of its group."""
    s.passes += 1
    enough = s.best is None or value <= s.value + 1e-4 * (0.5 ** s.halved) * s.slope + 1e-12 * abs(s.value)
    if not (enough and math.isfinite(value)):
        s.halved += 1
        s.own = True  # where it goes on from an accepted point
        s.done = s.halved > HALVINGS
        s.theta = s.best + 0.5 ** s.halved * s.step if not s.done else s.best
        return
    s.own = s.halved > 0 or (s.own if exact else s.best is not None and -slope > GAIN * -s.slope)
    s.best, s.value, s.slope, s.step, s.halved = s.theta, value, slope, step.reshape(s.theta.shape), 0
    # the slope along a Newton step is minus twice the expected gain; so near the optimum a full
    # step squares the distance and needs no further look
    s.done = -slope <= tol * (1.0 if exact else SHARED_TOL) * (1.0 + abs(value))
    s.theta = s.best + s.step
    if s.done:
        s.best = s.theta


def fit_many(df: DataFrame, fits: Sequence[Fit], season: str = "season", tol: float = 1e-12, max_passes: int = MAX_PASSES) -> list[Solution]:
    """Solutions of all fits, in order. `df` is scanned once per pass: it should be a written table.

    Rows with a null label are left out of a fit, null inputs take the column's training mean
    (zero without any value), and a constant column gets its coefficient from the penalty alone.
    """
    cols = list(dict.fromkeys(c for f in fits for c in f.cols))
    dated = any(f.until is not None for f in fits)
    places = {c: len(cols) + i for i, c in enumerate(dict.fromkeys([*(f.label for f in fits), *(f.weight for f in fits if f.weight), *([season] if dated else [])]))}
    if all(f.until is not None for f in fits):
        df = df.where(F.col(season) < max(f.until for f in fits))
    with scratch_scope(df.sparkSession):
        table = packed(df, [F.col(f"`{c}`") for c in (*cols, *places)])
        return _fit_packed(table, fits, cols, places, season if dated else None, tol, max_passes)


def _fit_packed(table: DataFrame, fits: Sequence[Fit], cols: list[str], places: dict[str, int], season: str | None, tol: float, max_passes: int) -> list[Solution]:
    """fit_many() over packed rows: `cols`, then the labels, weights and the season at their `places`."""
    width, k = len(cols) + len(places), len(cols)
    when = places[season] if season else None
    moments = {label: _entries(table.mapInArrow(_packed_sums(width, k, places[label], when), "season double, v binary"), k) for label in {f.label for f in fits}}
    where = {c: i for i, c in enumerate(cols)}
    pooled = {(until, label): _pooled(moments[label], k, until) for until, label in {(f.until, f.label) for f in fits}}
    states: list[_State] = []
    for f in fits:
        n, means, sds = pooled[f.until, f.label]
        if not n:
            raise ValueError(f"no training rows for {f.name}")
        index = np.array([where[c] for c in f.cols], int)
        means, sds = means[index], sds[index]
        power = 0 if f.scaled else 2 if f.penalty == "l2" else 1
        ridge = np.append((0.0 if f.penalty == "none" else 1.0 / f.c) / sds ** power, 0.0)
        states.append(_State(f, np.append(index, k), means, sds, ridge, np.zeros((len(f.cols) + 1, _outputs(f)))))
    centres = {key: (means, sds) for key, (_, means, sds) in pooled.items()}
    groups: dict[tuple, list[_State]] = {}
    for s in states:
        groups.setdefault(_group(s.fit), []).append(s)
    shared: dict[tuple, np.ndarray] = {}  # the last Hessian of a group, over all columns
    many = table.rdd.getNumPartitions() > 2 * SLOTS
    for _ in range(max_passes):
        asks, back = [], {}
        for key, members in groups.items():
            open_ = [s for s in members if not s.done]
            if not open_:
                continue
            outputs, widest = _outputs(open_[0].fit), max(open_, key=lambda s: len(s.index))
            thetas = np.zeros((len(open_), outputs, k + 1))
            for theta, s in zip(thetas, open_):
                theta[:, s.index] = s.theta.T
            a = _Ask(open_[0].fit, len(back), thetas, [])
            back[a.part] = (key, open_, widest)
            alone = [s for s in open_ if s.own and s is not widest]
            a.hessians.append((len(back), np.arange(k + 1), thetas[next(i for i, s in enumerate(open_) if s is widest)]))
            back[len(back)] = key
            for s in alone:
                a.hessians.append((len(back), s.index, s.theta.T))
                back[len(back)] = s
            asks.append(a)
        if not asks:
            break
        sums = table.mapInArrow(_scan(asks, centres, k, places, when, width), "part int, slot int, v binary")
        if many:
            sums = sums.repartition("part", "slot").mapInArrow(_add, "part int, slot int, v binary")
        found = {row.part: np.frombuffer(row.v) for row in sums.repartition(min(len(back), 64), "part").mapInArrow(_add, "part int, slot int, v binary").collect()}
        own = {}
        for a in asks:
            for part, index, _ in a.hessians:
                hess = _full(found[part], a.theta.shape[1], len(index))
                if isinstance(back[part], _State):
                    own[id(back[part])] = hess
                else:
                    shared[back[part]] = hess
        for a in asks:
            key, open_, widest = back[a.part]
            losses, gradients = found[a.part][:len(open_)], found[a.part][len(open_):].reshape(a.theta.shape)
            # at the start all fits of a group have the same probabilities
            same = all(not s.passes for s in open_)
            for s, loss, grad in zip(open_, losses, gradients):
                hess, size = own.get(id(s)), s.theta.size
                exact = hess is not None or s is widest or same
                if hess is None:
                    hess = shared[key][:, s.index][:, :, :, s.index]
                _advance(s, *_newton_step(s, loss, grad[:, s.index].ravel(), hess.reshape(size, size)), tol, exact)
    return [_solution(s, pooled[s.fit.until, s.fit.label][0]) for s in states]


def _solution(s: _State, n: int) -> Solution:
    best = s.best if s.best is not None else s.theta
    inner = best.T if _outputs(s.fit) == 1 else np.vstack([best.T, -best.T.sum(0)])
    coef = inner[:, :-1] / s.sds
    return Solution(s.fit, n, s.means, s.sds, coef, inner[:, -1] - coef @ s.means, s.value, s.passes, s.done and s.halved <= HALVINGS)
