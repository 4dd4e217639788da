"""Hashes of words and of runs of words, for many texts at a time and without an object per word."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n2 = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                steps = np.full(n2, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = {b: Powers(b) for b in (0x100000001B3, *BASES)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of anything but ASCII white space), and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _POWERS[0x100000001B3](len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
    h = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASES[0]))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, bounds), prepend=0)


def run_hashes(words: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every *n* consecutive words; runs across the end of a text are for the caller to mask."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, down = _POWERS[base](len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(base)) * up, out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def sliding(x: np.ndarray, n: int, f=np.minimum) -> np.ndarray:
    """Minimum (or *f*) over every *n* consecutive values."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out
