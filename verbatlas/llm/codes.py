"""Texts as arrays of code points, and hashes of any stretch of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x2545F4914F6CDD1D


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(4)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full((1 << log2) + 1, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scrambled one to one."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


class Stretches:
    """Hashes of stretches [a, b) of one array: equal for equal content, wherever it stands."""

    def __init__(self, values: np.ndarray):
        """values: one scrambled 64-bit number per element."""
        self.up, self.down = _powers(max(12, int(len(values)).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)])])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def slices(texts: list[str], longest: int, overlap: int, chars: int):
    """Groups texts, the longest cut into overlapping slices, into batches of about `chars` characters.

    Yields lists of (index of the text, offset in it, slice); a slice starts every `longest` characters
    and runs on for `overlap` characters more.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        for at in range(0, len(t), longest) if len(t) > longest + overlap else (0,):
            s = t[at : at + longest + overlap] if len(t) > longest + overlap else t
            held.append((i, at, s))
            size += len(s)
            if size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held
