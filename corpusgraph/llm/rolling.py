"""Rolling 64-bit hashes of byte strings, a whole text at a time."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n + 1 of each at least."""
    if len(_POWERS[0]) <= n:
        m = 1 << (n + 1).bit_length()
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Hashes of any substrings of one byte string, each in constant time."""

    def __init__(self, data: bytes):
        codes = np.frombuffer(data, np.uint8)
        self.data, self.size = data, len(codes)
        ahead, self.back = _powers(self.size)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(_LETTERS[codes] * ahead[: self.size], out=self.sums[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Of all substrings of k bytes."""
        m = max(0, self.size - k + 1)
        return mix((self.sums[k : k + m] - self.sums[:m]) * self.back[:m] + np.uint64(k))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of *k* words; of all words together if there are fewer.

    A-Z are lower-cased first. Null and texts without a word have none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    return np.unique(Words(parts).runs(k))


class Words(Rolling):
    """Words (one at least) in their string with single spaces, and where each starts and ends."""

    def __init__(self, parts: list[bytes]):
        super().__init__(b" ".join(parts))
        # No word holds a space, so each space stands between two.
        self.ends = np.append(np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32), self.size)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])

    def runs(self, k: int) -> np.ndarray:
        """Of all runs of *k* words; of all words together if there are fewer."""
        n = max(1, len(self.ends) - k + 1)
        return self.between(self.starts[:n], self.ends[min(k, len(self.ends)) - 1 :])
