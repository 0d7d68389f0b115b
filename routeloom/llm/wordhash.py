"""Hashes of words and shingles for many texts at once, in NumPy.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z in lower case. A word's hash is a polynomial of
its bytes modulo 2**64, taken as a difference of running sums, so the cost is a few passes over the bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WIDTH_SALT = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F8861B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words start (one more entry than texts)."""
    raws = [(t or "").encode() for t in texts]
    a = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    edges = np.cumsum([0, *(len(r) + 1 for r in raws)])
    upper = (a >= 65) & (a <= 90)
    a = np.where(upper, a + np.uint8(32), a)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    p, q = powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * q[starts])
    return hashes, np.searchsorted(starts, edges)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of the whole sequence if it has fewer words."""
    words, at = word_hashes(texts)
    n = len(words)
    salts = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * salts[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            length = np.array([b - a], dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
            out.append(mix((words[a:b] * salts[: b - a]).sum(dtype=np.uint64, keepdims=True) + length))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


_T, _CHUNK = 256, 2048
_MULTIPLIERS = mix(np.arange(1000, 1000 + _T, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix(np.arange(5000, 5000 + _T, dtype=np.uint64))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """256 minwise values of a set, 64 bits each; an empty set has zeros."""
    if not len(shingles):
        return np.zeros(_T, dtype=np.uint64)
    low = None
    for i in range(0, len(shingles), _CHUNK):
        x = shingles[i : i + _CHUNK]
        m = (x[None, :] * _MULTIPLIERS[:, None] + _OFFSETS[:, None]).min(axis=1)
        low = m if low is None else np.minimum(low, m)
    return mix(low)
