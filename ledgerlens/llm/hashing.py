"""Rolling hashes over the words of a text, for whole arrays at once."""

from __future__ import annotations

import numpy as np
import xxhash

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2**64
_U = np.uint64


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), _U)


def mixed(v: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all bits."""
    v = v ^ (v >> _U(33))
    v = v * _U(0xFF51AFD7ED558CCD)
    v = v ^ (v >> _U(33))
    v = v * _U(0xC4CEB9FE1A85EC53)
    return v ^ (v >> _U(33))


class Powers:
    """Powers of a base and of its inverse, grown as longer texts come."""

    def __init__(self, which: int):
        self._base = _BASES[which]
        self._inverse = pow(self._base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U))]) for b in (self._base, self._inverse))


class Rolling:
    """Hashes of any word ranges of one text."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        powers.reach(len(hashes) + 1)
        self._down = powers.down
        with np.errstate(over="ignore"):
            self._sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * powers.up[: len(hashes)])])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start..end-1, for arrays of starts and ends."""
        with np.errstate(over="ignore"):
            return mixed((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(_U))
