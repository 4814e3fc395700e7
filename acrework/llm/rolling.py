"""Rolling polynomial hashes of byte arrays modulo 2**64, in whole-array numpy operations."""

from __future__ import annotations

from functools import cache

import numpy as np

from acrework.llm.common import mix64

BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, extended as longer texts come."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 19)
            for name, base in (("up", BASE), ("down", INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Prefix:
    """Prefix sums from which the hash of any byte range follows."""

    def __init__(self, data: np.ndarray):
        up, self.down = _POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all ranges of this length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of given ranges; ranges of different lengths get different seeds."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
