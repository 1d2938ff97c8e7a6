"""Hashes of any slice of a sequence from one prefix sum, modulo 2^64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5
_powers: dict[str, np.ndarray] = {}
#: What a byte counts as: fixed pseudo-random 64-bit values, so that equal sums need equal bytes.
BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int, base: int, name: str) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """n + 1 sums for slice_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values), _BASE, "up"), dtype=np.uint64, out=out[1:])
    return out


def slice_hash(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The hash of values[low:high], the same wherever the slice lies; lengths count."""
    inverse = _power(len(sums), pow(_BASE, -1, 1 << 64), "down")
    low, high = np.asarray(low), np.asarray(high)
    return mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """slice_hash of every slice of that size."""
    n = max(len(sums) - size, 0)
    h = sums[size:] - sums[:n]
    h *= _power(len(sums), pow(_BASE, -1, 1 << 64), "down")[:n]
    h += np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return mix(h)


def first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of width values, the place of its minimum by the upper 36 bits, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # the place fills the low bits; every window is a suffix of one aligned row of width and a prefix of the next
    low = np.uint64((1 << 28) - 1)
    padded = np.full(-(-len(values) // width) * width, ~np.uint64(0), np.uint64)
    padded[: len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
