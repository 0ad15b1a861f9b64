"""Saturation families on x = ln(1 + effort): distribution functions, their inverses, and least-squares fits.

Called for one sample at a time, on the few dozen points of its curve.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Intervals of Simpson's rule for areas under a survival curve.
INTERVALS = 4096
#: A sample is fitted from so many usable points on, those with a coverage in (0, HIGHEST).
LEAST_POINTS, HIGHEST = 5, 0.9
#: Bounds of the parameters.
SHAPE, RATE = (0.05, 5000.0), (1e-5, 1000.0)
GG_SCALE, GG_POWER = (1e-4, 500.0), (0.2, 20.0)
BURR_SCALE, BURR_C, BURR_H = (0.1, 200.0), (0.2, 100.0), (0.05, 2000.0)


def gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularized lower incomplete gamma function by its power series, all terms of all x at once.

    Twelve deviations above its mean the function is 1 to double precision; up
    to there so many terms suffice that the rest is below it.
    """
    x = np.atleast_1d(np.asarray(x, float))
    end = a + 12 * math.sqrt(a) + 40
    terms = int(12 * math.sqrt(a) + 9 * math.sqrt(end)) + 60
    result = np.where(x >= end, 1.0, 0.0)
    inner = (x > 0) & (x < end)
    if inner.any():
        log_x = np.log(x[inner])
        falling = np.concatenate(([0.0], np.cumsum(np.log(a + np.arange(1, terms)))))
        log_terms = np.outer(log_x, np.arange(terms)) - falling
        front = a * log_x - x[inner] - math.lgamma(a + 1)
        result[inner] = np.exp(log_terms + front[:, None]).sum(axis=1)
    return np.clip(result, 0, 1)


def inverse(cdf: Callable[[np.ndarray], np.ndarray], p: float) -> float | None:
    """The x at which a distribution function reaches p, by doubling and halving."""
    high = 1.0
    while cdf(np.array([high]))[0] < p:
        high *= 2
        if high > 1e6:
            return None
    low = 0.0
    for _ in range(120):
        middle = (low + high) / 2
        if cdf(np.array([middle]))[0] < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


@dataclass(frozen=True)
class Family:
    """A family: its name, the names and bounds of its parameters, and what follows from parameter values."""

    name: str
    parameters: tuple[str, ...]
    bounds: tuple[tuple[float, float], ...]
    cdf: Callable[[tuple, np.ndarray], np.ndarray]
    mean: Callable[[tuple], float | None]
    mode: Callable[[tuple], float | None]


def _gg_cdf(p, x):
    return gamma_p(p[0], np.power(np.maximum(x, 0) / p[1], p[2]))


def _burr_cdf(p, x):
    return -np.expm1(-p[2] * np.log1p(np.power(np.maximum(x, 0) / p[0], p[1])))


def _mixture_cdf(p, x):
    return p[0] * gamma_p(p[1], p[2] * x) + (1 - p[0]) * gamma_p(p[3], p[4] * x)


GAMMA = Family("gamma", ("shape", "rate"), (SHAPE, RATE), lambda p, x: gamma_p(p[0], p[1] * np.asarray(x)), lambda p: p[0] / p[1], lambda p: (p[0] - 1) / p[1] if p[0] > 1 else None)
GENERALIZED = Family(
    "generalized_gamma", ("shape", "scale", "power"), (SHAPE, GG_SCALE, GG_POWER), _gg_cdf,
    lambda p: p[1] * math.exp(math.lgamma(p[0] + 1 / p[2]) - math.lgamma(p[0])),
    lambda p: p[1] * ((p[0] * p[2] - 1) / p[2]) ** (1 / p[2]) if p[0] * p[2] > 1 else None,
)
BURR = Family(
    "burr_xii", ("scale", "c", "h"), (BURR_SCALE, BURR_C, BURR_H), _burr_cdf,
    lambda p: p[0] * math.exp(math.lgamma(1 + 1 / p[1]) + math.lgamma(p[2] - 1 / p[1]) - math.lgamma(p[2])) if p[1] * p[2] > 1 else None,
    lambda p: p[0] * ((p[1] - 1) / (p[1] * p[2] + 1)) ** (1 / p[1]) if p[1] > 1 else None,
)
MIXTURE = Family("gamma_mixture2", ("weight", "shape1", "rate1", "shape2", "rate2"), ((0.01, 0.99), SHAPE, RATE, SHAPE, RATE), _mixture_cdf, lambda p: p[0] * p[1] / p[2] + (1 - p[0]) * p[3] / p[4], lambda p: None)
FAMILIES = (GAMMA, GENERALIZED, BURR, MIXTURE)
PRODUCTION = MIXTURE.name


def starts(family: Family, centre: float, gamma: tuple | None) -> list[tuple]:
    """Where fits begin, around the effort at which the curve crosses one half."""
    if family is GAMMA:
        return [(shape, shape / (centre * f)) for shape in (3.0, 20.0, 120.0, 800.0) for f in (0.8, 1.0, 1.3, 1.8)]
    if family is GENERALIZED:
        return [(shape, centre * f / shape ** (1 / power), power) for shape in (1.0, 6.0, 40.0) for power in (1.0, 3.0, 8.0) for f in (0.9, 1.2, 1.6)]
    if family is BURR:
        return [(centre * f, c, h) for f in (0.8, 1.1, 1.5) for c in (4.0, 12.0, 30.0) for h in (0.5, 2.0, 20.0)]
    mean = gamma[0] / gamma[1] if gamma else centre
    return [(w, s, s / (mean * low), s, s / (mean * high)) for w in (0.2, 0.5, 0.8) for low in (0.7, 0.9) for high in (1.1, 1.4) for s in (20.0, 120.0)]


def simplex(loss: Callable[[np.ndarray], float], start: np.ndarray, iterations: int) -> tuple[float, np.ndarray]:
    """Downhill simplex search."""
    points = [start] + [start + 0.25 * unit for unit in np.eye(len(start))]
    scored = sorted(((loss(p), n, p) for n, p in enumerate(points)), key=lambda s: s[:2])
    count = len(scored)
    for _ in range(iterations):
        if scored[-1][0] - scored[0][0] < 1e-10:
            break
        centre = np.mean([p for _, _, p in scored[:-1]], axis=0)
        worst = scored[-1][2]

        def at(factor: float):
            p = centre + factor * (worst - centre)
            return loss(p), p

        value, point = at(-1.0)
        if value < scored[0][0]:
            further, beyond = at(-2.0)
            if further < value:
                value, point = further, beyond
        elif value >= scored[-2][0]:
            value, point = min((at(0.5), at(-0.5)), key=lambda s: s[0])
            if value >= scored[-1][0]:
                best = scored[0][2]
                shrunk = [best + 0.5 * (p - best) for _, _, p in scored[1:]]
                scored = sorted([scored[0], *((loss(p), count + i, p) for i, p in enumerate(shrunk))], key=lambda s: s[:2])
                count += len(shrunk)
                continue
        scored[-1] = (value, count, point)
        count += 1
        scored.sort(key=lambda s: s[:2])
    return scored[0][0], scored[0][2]


def fitted(family: Family, x: np.ndarray, y: np.ndarray, centre: float, gamma: tuple | None = None) -> tuple[tuple, float]:
    """Parameters and squared error of the best fit: all starts are screened, the best few are refined within the bounds."""
    low, high = np.log([b[0] for b in family.bounds]), np.log([b[1] for b in family.bounds])

    def parameters(z: np.ndarray) -> tuple:
        return tuple(np.exp(np.clip(z, low, high)).tolist())

    def loss(z: np.ndarray) -> float:
        error = float(np.sum((family.cdf(parameters(z), x) - y) ** 2))
        return error if math.isfinite(error) else 1e300

    screened = sorted((np.log(np.clip(s, [b[0] for b in family.bounds], [b[1] for b in family.bounds])) for s in starts(family, centre, gamma)), key=loss)
    error, z = min((simplex(loss, s, 80 * len(s)) for s in screened[: 6 if family is MIXTURE else 3]), key=lambda r: r[0])
    for _ in range(2):  # a fresh simplex gets away from where the first one collapsed
        error, z = min((error, z), simplex(loss, z, 80 * len(z)), key=lambda r: r[0])
    found = parameters(z)
    if family is MIXTURE and found[1] / found[2] > found[3] / found[4]:
        found = (1 - found[0], found[3], found[4], found[1], found[2])
    return found, error


def survival_area(family: Family, p: tuple, end: float) -> float:
    """Area under the survival curve from 0 to ``end`` by Simpson's rule."""
    if end <= 0:
        return 0.0
    x = np.linspace(0, end, INTERVALS + 1)
    weight = np.where(np.arange(INTERVALS + 1) % 2, 4.0, 2.0)
    weight[0] = weight[-1] = 1
    return float(np.sum(weight * (1 - family.cdf(p, x))) * end / INTERVALS / 3)


def half_crossing(x: np.ndarray, y: np.ndarray) -> float:
    """Where the curve first crosses one half, by interpolation; else its last x."""
    for i in range(1, len(x)):
        if (y[i - 1] - 0.5) * (y[i] - 0.5) <= 0 and y[i] != y[i - 1]:
            return float(x[i - 1] + (0.5 - y[i - 1]) * (x[i] - x[i - 1]) / (y[i] - y[i - 1]))
    return float(x[-1])


def criterion(error: float, n: int, penalty: float) -> float:
    return n * math.log(max(error, 1e-300) / n) + penalty


def family_reports(effort: np.ndarray, coverage: np.ndarray, observed: float, target: float = 0.95, quantile: float = 0.99) -> list[dict]:
    """A report for each family, by ascending BIC; none with too few usable points."""
    if not 0 < target < 1 or not 0 < quantile < 1:
        raise ValueError("target and quantile lie in (0, 1)")
    usable = (coverage > 0) & (coverage < HIGHEST) & (effort > 0)
    if usable.sum() < LEAST_POINTS:
        return []
    order = np.argsort(effort[usable], kind="stable")
    x, y = np.log1p(effort[usable][order]), coverage[usable][order]
    centre, n = half_crossing(x, y), len(x)
    reports, gamma = [], None
    for family in FAMILIES:
        p, error = fitted(family, x, y, centre, gamma)
        gamma = p if family is GAMMA else gamma
        predicted = family.cdf(p, x)
        spread = float(np.std(predicted) * np.std(y))
        at, cut, mean = inverse(lambda v, f=family, p=p: f.cdf(p, v), target), inverse(lambda v, f=family, p=p: f.cdf(p, v), quantile), family.mean(p)
        now = math.log1p(observed) if observed > 0 else None
        reports.append(
            {
                "family": family.name, "parameters": ";".join(f"{name}={value:.8g}" for name, value in zip(family.parameters, p)), "values": list(p), "k": len(p), "n": n, "sse": error, "rmse": math.sqrt(error / n),
                "model_r": float(np.mean((predicted - predicted.mean()) * (y - y.mean())) / spread) if spread > 0 else None,
                "aic": criterion(error, n, 2 * len(p)), "bic": criterion(error, n, len(p) * math.log(n)),
                "effort_at_target": math.expm1(at) if at is not None and at <= 700 else None, "mode_diversity": family.mode(p), "area_diversity": mean,
                "area_diversity_q99": survival_area(family, p, cut) if cut is not None else None,
                "coverage_at_observed_effort": float(family.cdf(p, np.array([now]))[0]) if now is not None else None,
                "remaining_area_at_observed_effort": max(mean - survival_area(family, p, now), 0.0) if now is not None and mean is not None else None,
            }
        )
    return sorted(reports, key=lambda r: r["bic"])


def curve_coverage(name: str, values: list[float], effort: np.ndarray) -> np.ndarray:
    """Coverage that a family with these parameter values gives at efforts."""
    family = next(f for f in FAMILIES if f.name == name)
    return family.cdf(tuple(values), np.log1p(np.asarray(effort, float)))
