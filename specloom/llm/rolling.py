"""Vectorised 64-bit polynomial hashes of substrings."""

from __future__ import annotations

import numpy as np

from specloom.llm.common import mix64

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64, kept between calls."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _P), ("q", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"][:n], _powers["q"][:n]


class Prefix:
    """Hashes of any substrings of ``data`` (uint8, or uint64 hashes of words)."""

    def __init__(self, data: np.ndarray):
        p, self.q = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate((_TABLE[data] if data.dtype == np.uint8 else mix64(data)) * p[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.q[starts])

    def all(self, length: int) -> np.ndarray:
        """Of every substring of this length."""
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.q[:n])
