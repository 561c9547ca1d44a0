"""Word tokens of many texts at once: positions by byte class, 64-bit hashes by prefix sums."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240117)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_POW: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _POW.get(int(base))
    if have is None or len(have) <= n:
        full = np.full(max(n, 1 << 20) + 1, base, np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            have = _POW[int(base)] = np.multiply.accumulate(full)
        if n > 1 << 23:
            del _POW[int(base)]
    return have[: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], each value a 64-bit number; equal spans have equal hashes."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(_BASE, n)[:n], out=total[1:])
        h = (total[ends] - total[starts]) * powers(_BACK, n)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h)


#: Word bytes once A-Z are lower-cased: 0-9, a-z and every byte of a longer code point.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def word_spans(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of the lower-cased texts low[off[i]:off[i + 1]], and token offsets by text."""
    w = WORD[low]
    if not w.any():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64)
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    s = w.copy()
    s[1:] &= ~w[:-1] | edge[1:-1]
    e = w.copy()
    e[:-1] &= ~w[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return span_hashes(_VALUE[low], starts, ends), starts, ends, np.searchsorted(starts, off)
