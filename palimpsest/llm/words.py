"""Words of texts as 64-bit hashes, and hashes of spans of them, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = 0x9E3779B97F4A7C15
_WRAP = 1 << 64


class WordHashes(dict):
    """xxh3 hashes of words (bytes); emptied at ``most`` entries."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Spans:
    """Hashes of word spans from prefix sums of hash times power, modulo 2**64."""

    def __init__(self, multiplier: int = _MULTIPLIER):
        self.multiplier, self.inverse = multiplier, pow(multiplier, -1, _WRAP)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.size = n
        power = np.empty(n, dtype=np.uint64)
        back = np.empty(n, dtype=np.uint64)
        power[0] = back[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            power[done : done + step] = power[:step] * np.uint64(pow(self.multiplier, done, _WRAP))
            back[done : done + step] = back[:step] * np.uint64(pow(self.inverse, done, _WRAP))
            done += step
        self.power, self.back = power, back

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        if len(hashes) + 1 > self.size:
            self._grow(2 * (len(hashes) + 1))
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.power[: len(hashes)], out=sums[1:])
        return sums

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.back[start])

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` words."""
        if len(hashes) < width:
            return np.empty(0, dtype=np.uint64)
        p = self.prefix(hashes)
        return mixed((p[width:] - p[:-width]) * self.back[: len(hashes) - width + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, so that low and high bits are equally random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
