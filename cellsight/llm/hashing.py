"""Vectorised 64-bit hashes of byte ranges: prefix sums of a polynomial modulo 2**64, then a mixing step."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = BASE if which == "up" else INVERSE
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Ranges:
    """Hashes of any byte ranges of one text."""

    def __init__(self, raw: np.ndarray) -> None:
        terms = (raw.astype(np.uint64) + np.uint64(1)) * _power("up", len(raw))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.down = _power("down", len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all ``n``-byte windows."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def word_ranges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~SPACE[raw]
    change = np.diff(solid)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive element hashes."""
    count = len(h) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    for k in range(n):
        out = (out * BASE) + h[k : k + count] if count > 0 else out
    return mix(out)


def raw_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask over ``n`` places of the union of half-open ranges."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0
