"""64-bit hashes of words and of all runs of words, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


class Hashes(dict):
    """Word to 64-bit hash; starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxh3_64_intdigest(word)
        return found


def hash_words(words: list[bytes], cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(h) + 1)
    return np.r_[np.uint64(0), np.cumsum(h * up[: len(h)])], down


def range_hash(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hash of the words from start on; equal runs of words have equal hashes."""
    return mix((prefix[start + size] - prefix[start]) * down[start] + np.asarray(size, np.uint64))
