"""Window and minimum hits of a sample from its mean read length: statistics of k-mer sketches.

A read of ``length`` bases sketched by s k-mers shares about s * J of them with
a read at a distance d, where J = exp(-k d) / (2 - exp(-k d)). The least s is
taken at which so many common k-mers are unlikely by chance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Confidence of the bound by which the minimum of hits is relaxed.
CONFIDENCE = 0.9


@dataclass(frozen=True)
class FilterParameters:
    window: int
    sketch_size: int
    minimum_hits: int
    p_value: float


def similarity_at(distance: float, k: int) -> float:
    survival = math.exp(-k * distance)
    return survival / (2 - survival)


def distance_at(similarity: float, k: int) -> float:
    if similarity <= 0:
        return 1.0
    if similarity >= 1:
        return 0.0
    return -math.log(2 * similarity / (1 + similarity)) / k


def upper_tail(n: int, p: float, least: int) -> float:
    """P(X >= least) for X binomial(n, p), summed from logarithms of the terms."""
    if least <= 0:
        return 1.0
    if least > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(least, n + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def lower_distance(distance: float, s: int, k: int) -> float:
    """Lower confidence bound of the distance of two reads whose sketches suggest ``distance``."""
    p = similarity_at(distance, k)
    hits = max(1, math.ceil(s * p))
    while hits <= s and upper_tail(s, p, hits) >= (1 - CONFIDENCE) / 2:
        hits += 1
    return distance_at(min(max(hits - 1, 1), s) / s, k)


def least_hits(s: int, k: int, identity: float) -> int:
    """Hits expected at the identity, lowered as long as the confidence bound still reaches it."""
    hits = math.ceil(s * similarity_at(1 - identity, k))
    relaxed = hits
    for fewer in range(hits, -1, -1):
        if 100 * (1 - lower_distance(distance_at(fewer / s, k), s, k)) < 100 * identity:
            break
        relaxed = fewer
    return relaxed


def chance(s: int, k: int, identity: float, length: int, reference: int) -> float:
    """Expected number of places of the reference that reach the minimum of hits by chance."""
    hits = least_hits(s, k, identity)
    present = 1 / (1 + 4.0**k / length)
    common = present * present / (2 * present - present * present)
    return max(reference, 1) * (1.0 if hits == 0 else upper_tail(s, common, hits))


def filter_parameters(length: int, k: int = 16, identity: float = 0.95, p_value: float = 0.001, reference: int = 100_000) -> FilterParameters:
    """The least sketch size out of 1, 2, 5 and the tens under ``length`` whose chance hits stay under ``p_value``, else ``length``."""
    found, reached = length, 1.0
    for size in (1, 2, 5, *range(10, length, 10)):
        expected = chance(size, k, identity, length, reference)
        if expected <= p_value:
            found, reached = size, expected
            break
    window = min(max(2 * length // found, 1), length)
    return FilterParameters(window, found, least_hits(found, k, identity), reached)


def fragment_length(reads: int, bases: int, k: int) -> int:
    """Mean read length, rounded, at least k + 1."""
    mean = math.floor(bases / reads + 0.5) if reads else 0
    return max(mean, k + 1, 1)
