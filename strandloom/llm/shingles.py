"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import SPACES

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES.encode())] = True
#: A random number for each byte, the same for A-Z as for a-z.
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C13)
#: Bytes that are hashed at once, but for longer words.
CHUNK = 1 << 19
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> list[np.ndarray]:
    """Powers of _P and of its inverse modulo 2^64, n at least."""
    if not _powers or len(_powers[0]) < n:
        steps = (_P, np.uint64(pow(int(_P), -1, 1 << 64)))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK), x)]), dtype=np.uint64) for x in steps]
    return _powers


def count_words(texts: list[bytes]) -> np.ndarray:
    """The number of words of each text."""
    space = _SPACE[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    starts = ~space
    starts[1:] &= space[:-1]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.add.reduceat(starts, ends - [len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each text's words start and stop); A-Z are lower-cased.

    A word's hash is a polynomial of its bytes' random numbers, taken from running sums, so no word is made an object."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    gaps = np.flatnonzero(space)
    # Chunks end at white space.
    cuts = gaps[np.minimum(np.searchsorted(gaps, np.arange(CHUNK, len(data), CHUNK)), len(gaps) - 1)] + 1
    found, places = [], []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(data)], strict=True):
        if lo >= hi:
            continue
        power, inverse = _powers_of(hi - lo)
        change = np.flatnonzero(np.diff(space[lo:hi], prepend=True))
        start, stop = change[::2], change[1::2]
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=total[1:])
        found.append(mix((total[stop] - total[start]) * inverse[start]))
        places.append(start + lo)
    starts = np.concatenate(places)
    ends = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64))
    return np.concatenate(found), ends.astype(np.int64)


def shingles(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, where each text's runs start and stop); a text with 1 to k - 1 words is one run."""
    n = np.diff(ends)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_ends = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(ends[:-1] - out_ends[:-1], runs) + np.arange(out_ends[-1])
    stop = np.repeat(ends[1:], runs)
    out = np.zeros(len(first), dtype=np.uint64)
    for j in range(k):
        at = first + j
        word = np.where(at < stop, h[np.minimum(at, max(0, len(h) - 1))] if len(h) else 0, np.uint64(0))
        out = mix(out ^ (word + np.uint64(j + 1)))
    return out, out_ends


def sets(s: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, and where they start and stop."""
    s = s.copy()
    at = ends.tolist()
    for a, b in zip(at, at[1:]):
        s[a:b].sort()
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(ends) - 1))]).astype(np.int64)


def sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's values, modulo 2^64; 0 without values."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    return total[ends[1:]] - total[ends[:-1]]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[a], up[b])
        before = up.copy()
        np.minimum.at(up, a, low)
        np.minimum.at(up, b, low)
        np.minimum.at(up, before, up)
        up = up[up]
        if (up == before).all():
            return up
