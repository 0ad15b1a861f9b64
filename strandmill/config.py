"""Settings of a run and their checks."""

from __future__ import annotations

from dataclasses import dataclass


def normalized_identity(value: float) -> float:
    """An identity given as a fraction or in percent, as a fraction."""
    if 0 <= value <= 1:
        return value
    if 1 < value <= 100:
        return value / 100
    raise ValueError(f"an identity lies in [0, 1] or (1, 100], not at {value}")


def odd_span_window(k: int, window: int) -> int:
    """The window itself or a neighbour of it, such that k + window - 1 is odd."""
    if (k + window - 1) % 2:
        return window
    return window - 1 if window > 1 else window + 1


@dataclass(frozen=True)
class Settings:
    """Thresholds of the mate search, the curve and the model.

    ``window`` and ``minimum_hits`` are derived from the mean read length where
    they are None. ``alignment_targets`` 0 decides by sketches alone, a
    ``band`` of -1 aligns without a band.
    """

    k: int = 16
    sketch_size: int = 128
    identity: float = 0.95
    p_value: float = 0.001
    reference_size: int = 100_000
    least_ratio: float = 0.50
    least_coverage: float = 0.75
    prefilter_targets: int = 16
    alignment_targets: int = 3
    band: int = 256
    most_occurrences: int = 128
    diagonal_bin: int = 1000
    radius: int = 3000
    step: int = 500
    replicates: int = 32
    divide: float = 0.70
    seed: int = 1
    hash_seed: int = 0
    window: int | None = None
    minimum_hits: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "identity", normalized_identity(self.identity))
        if not 0 <= self.alignment_targets <= 16:
            raise ValueError("alignment_targets lies in 0 .. 16")
        if self.band < -1:
            raise ValueError("band is -1 or more")
        if not 1 <= self.k <= 31:
            raise ValueError("k lies in 1 .. 31")
