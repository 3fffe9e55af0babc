"""Predict-then-update steps of the two rating systems (used inside tasks).

The kernels take one match: a state maps a team to a list of numbers with the count of
games at the end. The waves take many: a match depends on its teams' earlier matches only,
so matches are dealt into waves without a common team, and a wave is one array step for
all its matches and parameter sets.
"""

from __future__ import annotations

import math

import numpy as np

# default parameters (fixed values)
PI_DEFAULTS = {"pi": 0.015, "initial_mu": 0.0, "initial_sigma": 2.0, "home_adv": 0.3, "delta": 0.5, "sigma_match": 1.2,
               "sigma_decay": 0.999}
POISSON_DEFAULTS = {"learning_rate": 0.03, "home_adv": 0.1, "l2_reg": 1e-4, "initial_rating": 0.0, "rho": -0.2, "max_goals": 8}
EPS = 1e-15
MAX_LOG_RATE = 700.0  # a goal rate stays finite where a learning rate makes ratings diverge
FAR_RATE = 300.0      # beyond, the mass of the grid is scaled by its largest cell before it is set to one
_SQRT2, _ROOT2PI = math.sqrt(2.0), math.sqrt(2.0 * math.pi)


def _cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / _SQRT2)


def _pdf(z: float) -> float:
    return math.exp(-0.5 * z * z) / _ROOT2PI


def _clip(p: float) -> float:
    return min(max(p, EPS), 1.0 - EPS)


class PiKernel:
    """Ordered-probit rating: strength N(mu, sigma^2) per team."""

    columns = ("home_mu", "away_mu", "home_sigma", "away_sigma")

    def __init__(self, params: dict):
        self.p = {**PI_DEFAULTS, **params}

    def new_team(self) -> list[float]:
        return [self.p["initial_mu"], self.p["initial_sigma"], 0.0]

    def step(self, home: list, away: list, hg: float, ag: float, learn: bool) -> list[float]:
        p = self.p
        (mh, sh), (ma, sa) = home[:2], away[:2]
        tau = math.sqrt(sh * sh + sa * sa + p["sigma_match"] ** 2)
        lead = mh - ma + p["home_adv"]
        upper, lower = (p["delta"] - lead) / tau, (-p["delta"] - lead) / tau
        f_up, f_low = _cdf(upper), _cdf(lower)
        out = [_clip(f_low), _clip(f_up - f_low), _clip(1.0 - f_up), mh, ma, sh, sa]
        if learn:
            if hg > ag:
                slope = _pdf(upper) / (tau * (1.0 - f_up + EPS))
            elif hg == ag:
                slope = (_pdf(lower) - _pdf(upper)) / (tau * (f_up - f_low + EPS))
            else:
                slope = -_pdf(lower) / (tau * (f_low + EPS))
            move = p["pi"] * slope
            home[:] = [mh + move * sh * sh, sh * p["sigma_decay"], home[2] + 1]
            away[:] = [ma - move * sa * sa, sa * p["sigma_decay"], away[2] + 1]
        return out


class PoissonKernel:
    """Log-linear goal rates: home attack, home defence, away attack, away defence per team."""

    columns = ("lambda_home", "lambda_away", "home_games", "away_games")

    def __init__(self, params: dict):
        self.p = {**POISSON_DEFAULTS, **params}
        n = int(self.p["max_goals"])
        self._k = np.arange(n + 1)
        self._log_fact = np.array([math.lgamma(k + 1.0) for k in range(n + 1)])

    def new_team(self) -> list[float]:
        return [self.p["initial_rating"]] * 4 + [0.0]

    def _masses(self, rate: float) -> np.ndarray:
        if rate <= 0:
            return (self._k == 0).astype(float)
        logs = self._k * math.log(rate) - self._log_fact
        return np.exp(logs - (logs[-1] if self.p["rho"] and rate > max(FAR_RATE, self._k[-1]) else rate))

    def outcome(self, lh: float, la: float) -> tuple[float, float, float]:
        rho = self.p["rho"]
        ph, pa = self._masses(lh), self._masses(la)
        # class masses of the independent grid, from cumulative sums
        below = np.concatenate(([0.0], np.cumsum(pa)[:-1]))
        home, draw = float(ph @ below), float(ph @ pa)
        away = float(ph.sum() * pa.sum()) - home - draw
        if rho:
            # change of each low cell, never below minus its own mass
            def extra(i, j, factor):
                cell = float(ph[i] * pa[j])
                return cell * (max(factor, 0.0) - 1.0) if cell else 0.0
            draw += extra(0, 0, 1 - lh * la * rho) + extra(1, 1, 1 - rho)
            away += extra(0, 1, 1 + lh * rho)
            home += extra(1, 0, 1 + la * rho)
            total = home + draw + away
            home, draw, away = home / total, draw / total, away / total
        return _clip(away), _clip(draw), _clip(home)

    def step(self, home: list, away: list, hg: float, ag: float, learn: bool) -> list[float]:
        p = self.p
        lh = math.exp(min(home[0] + away[3] + p["home_adv"], MAX_LOG_RATE))
        la = math.exp(min(away[2] + home[1], MAX_LOG_RATE))
        out = [*self.outcome(lh, la), lh, la, home[4], away[4]]
        if learn:
            rate, l2 = p["learning_rate"], p["l2_reg"]
            for team, i, err in ((home, 0, hg - lh), (away, 3, hg - lh), (away, 2, ag - la), (home, 1, ag - la)):
                team[i] += rate * (err - l2 * team[i])
            home[4] += 1
            away[4] += 1
        return out


def deal_waves(home: np.ndarray, away: np.ndarray, n_teams: int) -> np.ndarray:
    """The wave of each match: one after the later of its teams' last waves."""
    last, wave = [0] * n_teams, []
    for h, a in zip(home.tolist(), away.tolist()):
        w = last[h] if last[h] > last[a] else last[a]
        wave.append(w)
        last[h] = last[a] = w + 1
    return np.array(wave, dtype=np.int64)


class _Wave:
    """Parameters as one array per name, over the sets; states are arrays (width, teams, sets)."""

    def __init__(self, sets: list[dict], defaults: dict):
        full = [{**defaults, **s} for s in sets]
        self.p = {k: np.array([float(s[k]) for s in full]) for k in defaults}

    def fold(self, state: np.ndarray, home: np.ndarray, away: np.ndarray, hg: np.ndarray, ag: np.ndarray, y: np.ndarray,
             learn: np.ndarray) -> np.ndarray:
        """Learns the matches, given in order, into the state; returns what each saw before, (values, matches, sets)."""
        wave = deal_waves(home, away, state.shape[1])
        order = np.argsort(wave, kind="stable")
        ends = np.cumsum(np.bincount(wave)).tolist()
        seen = np.empty((self.seen, len(home), state.shape[2]))
        seen[:, order] = self._waves(state, home[order], away[order], hg[order, None], ag[order, None], y[order, None], learn[order, None], ends)
        return seen


class PiWave(_Wave):
    width, seen = 2, 6

    def __init__(self, sets: list[dict]):
        super().__init__(sets, PI_DEFAULTS)

    def new_team(self) -> np.ndarray:
        return np.stack([self.p["initial_mu"], self.p["initial_sigma"]])

    def _waves(self, state, home, away, hg, ag, y, learn, ends) -> np.ndarray:
        p, (mu, sigma) = self.p, state
        rate, decay = np.where(learn, p["pi"], 0.0), np.where(learn, p["sigma_decay"], 1.0)
        # the outcome has mass own - (by_up * F(upper) + by_low * F(lower))
        own, by_up, by_low = (y == 2) * 1.0, np.choose(y, (0.0, -1.0, 1.0)), np.choose(y, (-1.0, 1.0, 0.0))
        edges = np.stack([p["delta"], -p["delta"]])[:, None]
        noise, adv = p["sigma_match"] ** 2, p["home_adv"]
        out = np.empty((self.seen, len(home), state.shape[2]))
        start = 0
        for end in ends:
            at = slice(start, end)
            h, a, up, low = home[at], away[at], by_up[at], by_low[at]
            mh, ma, sh, sa = mu[h], mu[a], sigma[h], sigma[a]
            tau = np.sqrt(sh * sh + sa * sa + noise)
            z = (edges - (mh - ma + adv)) / tau
            f = 0.5 * np.fromiter(map(math.erfc, (z / -_SQRT2).ravel().tolist()), float, z.size).reshape(z.shape)
            d = np.exp(-0.5 * z * z) / _ROOT2PI
            mass = own[at] - (up * f[0] + low * f[1])
            move = rate[at] * ((up * d[0] + low * d[1]) / (tau * (mass + EPS)))
            keep = decay[at]
            out[:2, at] = f
            out[2, at], out[3, at], out[4, at], out[5, at] = mh, ma, sh, sa
            mu[h], sigma[h] = mh + move * sh * sh, sh * keep
            mu[a], sigma[a] = ma - move * sa * sa, sa * keep
            start = end
        return out

    def probabilities(self, seen: np.ndarray) -> np.ndarray:
        """(away, draw, home) of each match and set."""
        up, low = seen[:2]
        return np.clip(np.stack([low, up - low, 1.0 - up]), EPS, 1.0 - EPS)

    def details(self, seen: np.ndarray) -> np.ndarray:
        return seen[2:]


class PoissonWave(_Wave):
    width, seen = 4, 2

    def __init__(self, sets: list[dict]):
        super().__init__(sets, POISSON_DEFAULTS)

    def new_team(self) -> np.ndarray:
        return np.stack([self.p["initial_rating"]] * 4)

    def _waves(self, state, home, away, hg, ag, y, learn, ends) -> np.ndarray:
        p, (home_att, home_def, away_att, away_def) = self.p, state
        rate, adv, l2 = np.where(learn, p["learning_rate"], 0.0), p["home_adv"], p["l2_reg"]
        out = np.empty((self.seen, len(home), state.shape[2]))
        start = 0
        for end in ends:
            at = slice(start, end)
            h, a, r = home[at], away[at], rate[at]
            ha, hd, aa, ad = home_att[h], home_def[h], away_att[a], away_def[a]
            log_h, log_a = np.minimum(ha + ad + adv, MAX_LOG_RATE), np.minimum(aa + hd, MAX_LOG_RATE)
            out[0, at], out[1, at] = log_h, log_a
            err_h, err_a = hg[at] - np.exp(log_h), ag[at] - np.exp(log_a)
            home_att[h], away_def[a] = ha + r * (err_h - l2 * ha), ad + r * (err_h - l2 * ad)
            away_att[a], home_def[h] = aa + r * (err_a - l2 * aa), hd + r * (err_a - l2 * hd)
            start = end
        return out

    def probabilities(self, seen: np.ndarray, rows: int = 10_000) -> np.ndarray:
        """(away, draw, home) of each match and set; the grids of some rows are held at a time."""
        out = np.empty((3, *seen.shape[1:]))
        for goals in np.unique(self.p["max_goals"]):
            sets = np.flatnonzero(self.p["max_goals"] == goals)
            for at in range(0, seen.shape[1], rows):
                some = slice(at, at + rows)
                out[:, some, sets] = self._grids(seen[:, some][:, :, sets], int(goals), self.p["rho"][sets])
        return out

    @staticmethod
    def _grids(logs: np.ndarray, goals: int, rho: np.ndarray) -> np.ndarray:
        fact = np.array([math.lgamma(k + 1.0) for k in range(goals + 1)])
        scaled = rho != 0
        rates = np.exp(logs)
        shift = np.where(scaled & (rates > max(FAR_RATE, goals)), goals * logs - fact[-1], rates)
        ph, pa = (np.exp(np.arange(goals + 1)[:, None, None] * log - fact[:, None, None] - s) for log, s in zip(logs, shift))
        home = (ph[1:] * np.cumsum(pa, axis=0)[:-1]).sum(axis=0)
        draw = (ph * pa).sum(axis=0)
        away = ph.sum(axis=0) * pa.sum(axis=0) - home - draw
        lh, la = rates
        with np.errstate(over="ignore", invalid="ignore"):
            def extra(i, j, factor):
                cell = ph[i] * pa[j]
                return np.where(scaled & (cell > 0), cell * (np.maximum(factor, 0.0) - 1.0), 0.0)
            draw = draw + extra(0, 0, 1 - lh * la * rho) + extra(1, 1, 1 - rho)
            away = away + extra(0, 1, 1 + lh * rho)
            home = home + extra(1, 0, 1 + la * rho)
        total = np.where(scaled, home + draw + away, 1.0)
        return np.clip(np.stack([away, draw, home]) / total, EPS, 1.0 - EPS)

    def details(self, seen: np.ndarray) -> np.ndarray:
        return np.exp(seen)


KERNELS = {"pi": PiKernel, "poisson": PoissonKernel}
WAVES = {"pi": PiWave, "poisson": PoissonWave}
