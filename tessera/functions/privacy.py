"""Accounting of differential privacy for the subsampled Gaussian mechanism: by Renyi moments, and by the privacy loss's distribution."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..errors import ParameterError

ORDERS = (*[1 + x / 10 for x in range(1, 100)], *range(11, 64), 128, 256, 512)
MOST_NOISE = 100.0


def default_delta(n: int) -> float:
    return 0.1 / n if n < 100 else n**-1.2


def sampling_probability(batch: int, entities: int) -> float:
    return min(1.0, batch / entities)


def steps_of(epochs: float, q: float) -> int:
    return int(epochs * (1 / q + 1))


def _log_add(a: float, b: float) -> float:
    a, b = max(a, b), min(a, b)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _rdp(q: float, sigma: float, alpha: float) -> float:
    """Renyi divergence of one step at an order; at a broken order the one of the next whole number holds."""
    if q == 1.0:
        return alpha / (2 * sigma**2)
    order, total = math.ceil(alpha), -math.inf
    for k in range(order + 1):
        log_comb = math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1)
        total = _log_add(total, log_comb + (k * math.log(q) if k else 0.0) + (order - k) * math.log1p(-q) + (k * k - k) / (2 * sigma**2))
    return total / (order - 1)


def epsilon(q: float, sigma: float, steps: int, delta: float) -> float:
    """The smallest epsilon over the orders."""
    best = math.inf
    for a in ORDERS:
        order = math.ceil(a) if q < 1.0 else a
        if order > 1:
            best = min(best, steps * _rdp(q, sigma, order) + math.log1p(-1 / order) - math.log(delta * order) / (order - 1))
    return max(0.0, best)


@dataclass(frozen=True)
class Epsilon:
    """Bounds between which epsilon lies, and the value in between."""

    lower: float
    estimate: float
    upper: float


_normal = np.frompyfunc(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), 1, 1)


def _below(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function."""
    return _normal(x).astype(np.float64)


class _Loss:
    """The privacy loss of one step, log p(x) / p'(x), where a record is in one batch of the two: with it against without (added), or the other way."""

    def __init__(self, q: float, sigma: float, added: bool):
        self.q, self.sigma, self.added = q, sigma, added

    def _of(self, x: np.ndarray) -> np.ndarray:
        shifted = (2 * x - 1) / (2 * self.sigma**2)
        return shifted if self.q == 1 else np.logaddexp(math.log1p(-self.q), math.log(self.q) + shifted)

    def _at(self, loss: np.ndarray) -> np.ndarray:
        """Where the loss has this value; it ascends."""
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            # log(exp(loss) - (1 - q)) without exp of large losses
            inner = loss if self.q == 1 else np.where(loss > 30, loss, np.log(np.maximum(np.expm1(np.minimum(loss, 30)) + self.q, 0)))
            return self.sigma**2 * (inner - math.log(self.q)) + 0.5

    def _outcomes(self, x: np.ndarray) -> np.ndarray:
        """Distribution function of the outcomes from which the loss is drawn."""
        return (1 - self.q) * _below(x / self.sigma) + self.q * _below((x - 1) / self.sigma) if self.added else _below(x / self.sigma)

    def below(self, loss: np.ndarray) -> np.ndarray:
        """Probability of a loss of at most this."""
        return self._outcomes(self._at(loss)) if self.added else 1 - self._outcomes(self._at(-loss))

    def mean(self) -> float:
        x = np.linspace(-14 * self.sigma, 1 + 14 * self.sigma, 400_001)
        density = lambda c: np.exp(-((x - c) ** 2) / (2 * self.sigma**2)) / (self.sigma * math.sqrt(2 * math.pi))
        weight = (1 - self.q) * density(0) + self.q * density(1) if self.added else density(0)
        y = self._of(x) * weight
        return float((y[:-1] + y[1:]).sum() / 2 * (x[1] - x[0])) * (1 if self.added else -1)


def _composed(loss: _Loss, steps: int, width: float, half: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, probabilities, what was cut off): the sum of ``steps`` losses on a grid.

    A loss counts as the middle of its cell, and the grid is moved so that the mean is the loss's own; then rounding errors
    have mean 0 and are at most a cell each.
    """
    n = 1 << math.ceil(math.log2(2 * half / width))
    grid = (np.arange(n) - n // 2) * width
    mass = np.diff(loss.below(np.concatenate([grid - width / 2, [grid[-1] + width / 2]])))
    cut = max(0.0, 1 - float(mass.sum()))
    move = loss.mean() - float((mass * grid).sum())
    spectrum = np.fft.rfft(np.roll(mass, -(n // 2)))
    total = np.roll(np.fft.irfft(spectrum**steps, n), n // 2)
    return grid + steps * move, np.maximum(total, 0), cut * steps


def _least_epsilon(values: np.ndarray, mass: np.ndarray, delta: float) -> float:
    """The smallest epsilon of at least 0 on the grid whose delta is at most this."""
    if delta <= 0:
        return math.inf
    at = values > 0
    y, p = values[at], mass[at]
    above = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1][1:], [0.0]])
    # losses close to epsilon count little, so delta is a sum over (1 - exp(epsilon - loss))
    deltas = above(p) - np.exp(y) * above(p * np.exp(-y))
    if p.sum() - (p * np.exp(-y)).sum() <= delta:
        return 0.0
    fine = np.flatnonzero(deltas <= delta)
    return float(y[fine[0]]) if len(fine) else math.inf


def epsilon_bounds(q: float, sigma: float, steps: int, delta: float, error: float = 0.01) -> Epsilon:
    """Epsilon by composing the privacy loss's distribution with Fourier transforms.

    The estimate is within ``error`` of the true value but for a thousandth of delta, which both bounds allow for: cells are so
    narrow that the steps' rounding errors add up to more than ``error`` with a smaller chance (Hoeffding), and the grid reaches as
    far as losses lie by the Renyi bound.  Deltas below about 1e-12 are beyond the transforms' precision.
    """
    if not 0 < q <= 1 or sigma <= 0 or steps < 1 or not 0 < delta < 1:
        raise ParameterError("q is above 0 and at most 1, sigma above 0, steps at least 1, and delta between 0 and 1")
    slip = delta / 1000
    width = error / math.sqrt(steps / 2 * math.log(4 / slip))
    half = epsilon(q, sigma, steps, slip / 4) + 3 + steps * width / 2
    if half / width > 1 << 25:
        raise ParameterError("too little noise or too small an error for this many steps")
    found = []
    for added in (True, False):
        values, mass, cut = _composed(_Loss(q, sigma, added), steps, width, half)
        upper = _least_epsilon(values, mass, delta - slip - cut) + error
        found.append((max(0.0, _least_epsilon(values, mass, delta + slip) - error), _least_epsilon(values, mass, delta), upper))
    return Epsilon(*map(max, zip(*found)))


def noise_multiplier(target: float, q: float, steps: int, delta: float, tolerance: float = 0.01, error: float = 0.01) -> float:
    """The least noise whose epsilon, by its upper bound, is at most the target.

    Renyi moments, which are quick and never say too little, give noise that is enough; halving below it uses the distribution.
    """
    high = 1.0
    while epsilon(q, high, steps, delta) > target:
        high *= math.sqrt(2)
        if high > MOST_NOISE:
            raise ParameterError("no noise up to the limit reaches the target")
    low = 0.0
    while high - low > tolerance * high:
        mid = (low + high) / 2
        enough = epsilon(q, mid, steps, delta) <= target or (mid > high / 4 and epsilon_bounds(q, mid, steps, delta, error).upper <= target)
        low, high = (low, mid) if enough else (mid, high)
    return high
