"""Logistic regression with Firth's penalty on a grouped design: the table of covariate patterns is small, the corpus is not
read again.

The penalised log-likelihood is l(b) + 1/2 log det(X' W X). With W^(1/2) X = Q R it is l(b) + sum log |R_jj|, and its gradient
is X' (y - n p + h (1/2 - p)), where h are the squared row norms of Q (Firth, 1993; Heinze and Schemper, 2002). Coefficients
may be held at given values; the penalty is that of the whole design then, too.

`newton` and `lbfgs` climb it and raise FitError where they don't get there: a design without full rank, no step that raises
the value, or too many rounds. `firth` is Newton's way, and the other one where that fails.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np


class FitError(RuntimeError):
    """No maximum was found."""


@dataclass
class Fit:
    beta: np.ndarray
    value: float
    rounds: int
    method: str


@dataclass
class Grouped:
    """y successes in n for each row of x. held: coefficients that stay at these values."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray
    held: dict[int, float] = field(default_factory=dict)

    def __post_init__(self):
        self.free = np.array([j for j in range(self.x.shape[1]) if j not in self.held], int)
        if not all(np.isfinite(a).all() for a in (self.x, self.y, self.n)):
            raise FitError("the design holds values that are not finite")

    def start(self, beta: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(self.x.shape[1]) if beta is None else np.array(beta, float)
        for j, v in self.held.items():
            out[j] = v
        return out

    def at(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(penalised log-likelihood, its gradient, R of the weighted design); -inf without full rank."""
        eta = self.x @ beta
        p = np.exp(-np.logaddexp(0, -eta))
        q, r = np.linalg.qr(np.sqrt(self.n * p * (1 - p))[:, None] * self.x)
        scale = np.abs(np.diag(r))
        if not np.isfinite(scale).all() or len(self.x) < len(scale) or scale.min(initial=1) <= 1e-12 * max(1.0, scale.max(initial=0)):
            return -math.inf, np.zeros_like(beta), r
        value = float((self.y * eta - self.n * np.logaddexp(0, eta)).sum() + np.log(scale).sum())
        return value, self.x.T @ (self.y - self.n * p + (q * q).sum(axis=1) * (0.5 - p)), r

    def flat(self, gradient: np.ndarray) -> bool:
        return bool(np.abs(gradient[self.free]).max(initial=0) <= 1e-8 * (1 + self.n.sum()) ** 0.5)


def _climbed(design: Grouped, beta: np.ndarray, value: float, gradient: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """The first of the shortened steps that raises the value by a fair part of what its slope promises."""
    slope, length = float(gradient @ step), min(1.0, 5.0 / max(np.abs(step).max(initial=0), 1e-300))
    while length > 1e-12:
        new = beta + length * step
        there, g, r = design.at(new)
        if there >= value + 1e-4 * length * slope - 1e-13 * (1 + abs(value)):
            return new, there, g, r
        length /= 2
    raise FitError("no step raises the penalised likelihood")


def newton(design: Grouped, start: np.ndarray | None = None, rounds: int = 200) -> Fit:
    """Steps of Fisher's scoring in the free coefficients."""
    beta = design.start(start)
    value, gradient, r = design.at(beta)
    for k in range(rounds):
        if value == -math.inf:
            raise FitError("the design has no full rank")
        if design.flat(gradient):
            return Fit(beta, value, k, "newton")
        information = r.T @ r
        step = np.zeros_like(beta)
        step[design.free] = np.linalg.lstsq(information[np.ix_(design.free, design.free)], gradient[design.free], rcond=None)[0]
        beta, value, gradient, r = _climbed(design, beta, value, gradient, step)
    raise FitError(f"not converged in {rounds} rounds")


def lbfgs(design: Grouped, start: np.ndarray | None = None, rounds: int = 2000, memory: int = 8, bound: float = 30.0) -> Fit:
    """Limited-memory quasi-Newton steps (Nocedal, 1980), with coefficients kept between -bound and bound."""
    beta = np.clip(design.start(start), -bound, bound)
    value, gradient, _ = design.at(beta)
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    mask = np.zeros(len(beta))
    mask[design.free] = 1
    for k in range(rounds):
        if value == -math.inf:
            raise FitError("the design has no full rank")
        g = gradient * mask
        g[(beta >= bound) & (g > 0) | (beta <= -bound) & (g < 0)] = 0
        if np.abs(g).max(initial=0) <= 1e-7 * (1 + design.n.sum()) ** 0.5:
            return Fit(beta, value, k, "lbfgs")
        step, weights = g.copy(), []
        for s, d in reversed(past):
            weights.append(a := (s @ step) / (s @ d))
            step -= a * d
        if past:
            s, d = past[-1]
            step *= (s @ d) / (d @ d)
        for (s, d), a in zip(past, reversed(weights), strict=True):
            step += s * (a - (d @ step) / (s @ d))
        if step @ g <= 0:
            past.clear()
            step = g / max(1.0, np.abs(g).max())
        old, old_g = beta, g
        beta, _, _, _ = _climbed(design, beta, value, g, step)
        beta = np.clip(beta, -bound, bound)
        value, gradient, _ = design.at(beta)
        s, d = beta - old, old_g - gradient * mask
        if s @ d > 1e-12 * (d @ d):
            past.append((s, d))
    raise FitError(f"not converged in {rounds} rounds")


def firth(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, held: dict[int, float] | None = None, start: np.ndarray | None = None) -> Fit:
    """The maximum by Newton's steps, or by the quasi-Newton ones where these fail."""
    design = Grouped(x, y, np.ones(len(y)) if n is None else n, held or {})
    try:
        return newton(design, start)
    except FitError:
        return lbfgs(design)


def controlled(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """Probabilities if all and if none were treated (column 1), by the fit with the other columns as covariates. NaN with fewer
    than five observations beside the coefficients, or outcomes of one kind."""
    size, hits = float(n.sum()), float(y.sum())
    if size < x.shape[1] + 5 or hits in (0.0, size):
        return dict.fromkeys(("untreated", "treated", "difference", "log_odds"), math.nan)
    beta = firth(x, y, n).beta
    low, high = standardised(x, n, beta)
    return {"untreated": low, "treated": high, "difference": high - low, "log_odds": float(beta[1])}


def profile_interval(x: np.ndarray, y: np.ndarray, fit: Fit, j: int, n: np.ndarray | None = None, critical: float = 3.841458820694124) -> tuple[float, float, float]:
    """(low, high, p) of one coefficient by the profile likelihood, with bisection for both ends."""

    def drop(v: float) -> float:
        return 2 * (fit.value - firth(x, y, n, {j: v}, fit.beta).value)

    ends = []
    for side in (-1, 1):
        inner, width = float(fit.beta[j]), 1.0
        while drop(inner + side * width) < critical and width < 64:
            width *= 2
        outer = inner + side * width
        for _ in range(50):
            middle = (inner + outer) / 2
            inner, outer = (middle, outer) if drop(middle) < critical else (inner, middle)
        ends.append((inner + outer) / 2)
    return ends[0], ends[1], math.erfc(math.sqrt(max(drop(0.0), 0.0) / 2))


def standardised(x: np.ndarray, n: np.ndarray, beta: np.ndarray) -> tuple[float, float]:
    """Mean probabilities if none and if all were treated (column 1)."""
    out = []
    for treated in (0.0, 1.0):
        z = x.copy()
        z[:, 1] = treated
        out.append(float((n * np.exp(-np.logaddexp(0, -(z @ beta)))).sum() / n.sum()))
    return out[0], out[1]


def risk_difference(x: np.ndarray, n: np.ndarray, beta: np.ndarray) -> float:
    low, high = standardised(x, n, beta)
    return high - low


def resampled(x: np.ndarray, y: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, n) of a bootstrap draw of rows within each treatment (column 1): patterns that drew no row and columns that then depend
    on those before them are left out."""
    new_y, new_n = np.zeros(len(y)), np.zeros(len(n))
    for treated in np.unique(x[:, 1]):
        at = np.flatnonzero(x[:, 1] == treated)
        cells = np.concatenate([y[at], n[at] - y[at]])
        hits, misses = np.split(rng.multinomial(int(cells.sum()), cells / cells.sum()).astype(float), 2)
        new_y[at], new_n[at] = hits, hits + misses
    design, kept = x[new_n > 0], []
    for j in range(design.shape[1]):
        if np.linalg.matrix_rank(design[:, [*kept, j]]) > len(kept):
            kept.append(j)
    return design[:, kept], new_y[new_n > 0], new_n[new_n > 0]


def dummies(values: list, levels: list) -> np.ndarray:
    """One column for each level but the first."""
    return np.array([[float(v == l) for l in levels[1:]] for v in values]).reshape(len(values), max(0, len(levels) - 1))
