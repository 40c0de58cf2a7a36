"""Words of UTF-8 texts as 64-bit hashes, all in array arithmetic.

A word's hash is a polynomial over random values of its bytes, read off running sums, so its
cost does not depend on the number of words. Words are runs of bytes other than blank and
tab to carriage return; A-Z count as a-z where asked.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of texts that lie one after another; a text's end ends its last word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    opens[first] = inside[first]
    start = np.flatnonzero(opens)
    closes = np.zeros(len(data) + 1, bool)
    closes[1:-1] = inside[:-1] & (~inside[1:] | opens[1:])
    closes[-1] = inside[-1]
    return start, np.flatnonzero(closes)


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, ends: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of every word, and each text's first word (n + 1 numbers). ``ends`` may be given if known."""
    start, end = word_ends(data, offsets) if ends is None else ends
    if not len(data):
        return np.empty(0, np.uint64), start, np.zeros(len(offsets), np.int64)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * up, out=total[1:])
    # the length is mixed in, so that no byte value acts like an absent one
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, start, np.searchsorted(start, offsets)
