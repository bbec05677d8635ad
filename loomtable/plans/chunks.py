"""Sizes of steps: the adaptive controller and the split of a key range."""

from __future__ import annotations

from dataclasses import dataclass

from loomtable.errors import EngineError


@dataclass(frozen=True)
class AdaptiveChunk:
    """Steers a step's size towards a target time: a dead band of 15 %, steps of 2/3 to 3/2, half when far too slow."""

    enabled: bool = False
    least: int = 10_000
    most: int = 200_000
    target_ms: int = 250
    max_ms: int = 2_000

    def __post_init__(self):
        if self.least <= 0 or self.most <= 0:
            raise EngineError("chunk size bounds must be positive")

    def clamp(self, size: int) -> int:
        low, high = sorted((self.least, self.most))
        return min(max(size, low), high)

    def next(self, size: int, took_ms: int) -> int:
        if not self.enabled:
            return size
        size, took, target = self.clamp(size), max(1, took_ms), max(1, self.target_ms)
        if took >= max(self.max_ms, target):
            return self.clamp(size // 2)
        if target * 85 // 100 <= took <= target * 115 // 100:
            return size
        return self.clamp(min(max(size * target // took, size * 2 // 3), size * 3 // 2))


def split_range(low: int, high: int, workers: int) -> list[tuple[int, int]]:
    """Closed ranges of equal steps over [low, high]; workers are limited to 1..64, and empty ranges left out."""
    n = min(max(workers, 1), 64)
    step = -(-(high - low + 1) // n)
    return [(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] if step > 0 else []
