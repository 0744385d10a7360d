"""Search parameters and their bounds."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the method.
SPAN_SIGMA = 0.1
STOP_SCORE = 1e-3
POOL_WIDTH = 16


@dataclass(frozen=True)
class AlignParams:
    """How pairs are aligned; ``bfactor=0`` asks for the corner-anchored ("global") alignment."""

    window: int = 15
    min_span: int = 25
    gap: float = 0.5
    bfactor: int = 2
    sigma: float = 2.0
    enhance: bool = False
    normalise: bool = False
    filter_hits: bool = True

    def __post_init__(self) -> None:
        if self.window < 1 or self.min_span < 1:
            raise ValueError("window and min_span must be at least 1")
        if self.gap < 0 or self.sigma <= 0 or self.bfactor < 0:
            raise ValueError("gap and bfactor mustn't be negative, sigma must be positive")

    @property
    def mode(self) -> str:
        return "local" if self.bfactor else "global"

    @property
    def span(self) -> int:
        return max(self.min_span, self.window)

    @property
    def threshold(self) -> float:
        return self.sigma * SPAN_SIGMA


@dataclass(frozen=True)
class ScreenParams:
    """How pairs are screened: the share of targets to leave out, and the folds."""

    percentile: float = 70
    kernel: int = 30
    stride: int = 10
    least_targets: int = 10
    only_scan: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.percentile < 100 or self.kernel < 1 or self.stride < 1:
            raise ValueError("percentile must be in [0, 100), kernel and stride positive")
