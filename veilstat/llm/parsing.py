"""Prefix-free parsing of bytes by rolling hashes: triggers, phrases and hashes of any stretch, in NumPy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 20


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k:k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    return _powers(int(BASE), size), _powers(int(INVERSE), size)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """Rolling hashes of one text: any stretch in constant time."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        # a byte stands for an odd 64-bit number of its own, so that runs of equal bytes don't cancel
        np.cumsum(_letters()[data] * up[:self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, width: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Hashes of all stretches of `width` that start in [first, last)."""
        last = self.n - width + 1 if last is None else last
        return mix((self.sums[first + width:last + width] - self.sums[first:last]) * self.down[first:last])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    rows = -(-n // width)
    pad = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    pad = pad.reshape(rows, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def phrases(h: Hashed, window: int, trigger: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, at): runs of window starts first..last that have their trigger at `at`.

    The trigger of a window is the leftmost of its `trigger`-byte stretches with the least rolling hash, so equal windows have it at
    equal offsets wherever they stand; a run, with the window's length after it, is a phrase of the parse with its lookahead.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    reach = window - trigger + 1
    total = h.n - window + 1
    for lo in range(0, max(total, 0), BLOCK):
        hi = min(lo + BLOCK, total)
        keys = h.every(trigger, lo, hi - 1 + reach)
        keys = (keys & ~np.uint64((1 << 21) - 1)) | np.arange(len(keys), dtype=np.uint64)
        at = (sliding_min(keys, reach) & np.uint64((1 << 21) - 1)).astype(np.int64) + lo
        new = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], new)) + lo
        last = np.concatenate((new - 1, [hi - lo - 1])) + lo
        out.append((first, last, at[first - lo]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last, at = (np.concatenate(x) for x in zip(*out))
    if len(out) > 1:  # a run over a block's edge is one run
        split = np.concatenate(([True], at[1:] != at[:-1]))
        first, at, last = first[split], at[split], last[np.append(np.flatnonzero(split)[1:] - 1, len(last) - 1)]
    return first, last, at
