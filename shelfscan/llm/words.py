"""Words of many texts at once, as numpy arrays over an Arrow buffer.

A word's hash is a polynomial over its bytes modulo 2**64, so all words of a chunk come from one
running sum. Hashes do not depend on the process or the chunk.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes that make up words between white space, and bytes of digits, a-z and everything beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_letters: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 21)
        steps = np.full(size, U(_BASE[seed]))
        steps[0] = U(1)
        back = np.full(size, U(pow(_BASE[seed], -1, 1 << 64)))
        back[0] = U(1)
        have = (np.cumprod(steps, dtype=U), np.cumprod(back, dtype=U))
        if size <= 1 << 22:
            _powers[seed] = have
    if seed not in _letters:
        _letters[seed] = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93) + U(seed))
    return have[0], have[1], _letters[seed]


def bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the words before each row (one more entry than rows)."""
    n = len(data)
    mask = np.zeros(n + 2, bool)
    mask[1:-1] = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(mask[1:] & (~mask[:-1] | edge))
    ends = np.flatnonzero(mask[:-1] & (~mask[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word."""
    power, back, letter = _tables(seed, len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(letter[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U))


def runs(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``length`` consecutive words; entry i starts at word i."""
    if len(words) < length:
        return np.zeros(0, U)
    power, back, _ = _tables(seed, len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[length:] - total[:-length]) * back[: len(words) - length + 1])
