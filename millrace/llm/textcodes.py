"""Texts as arrays of code points, and hashes of their substrings from prefix sums."""

from __future__ import annotations

import numpy as np

_BASE = 0x9FB21C651E98DF25  # odd
_kept: list[np.ndarray] = []


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least 0 to n; kept and grown as needed."""
    if not _kept or len(_kept[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _kept[:] = out
    return _kept[0], _kept[1]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums s with s[0] = 0, so that (s[b] - s[a]) * inverse[a] depends on codes[a:b] alone."""
    power, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    weighted = codes.astype(np.uint64)
    weighted += np.uint64(0x632BE59BD9B4E019)
    weighted *= power[: len(codes)]
    np.cumsum(weighted, out=out[1:])
    return out
