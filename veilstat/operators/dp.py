"""Noise on collected cluster statistics, and the accountant of the private basis."""

from __future__ import annotations

import math

import numpy as np

from veilstat.params import Params


def streams(seed: int, iteration: int) -> tuple[np.random.Generator, np.random.Generator]:
    """Independent generators for sums and counts of a round."""
    a, b = np.random.SeedSequence([seed, iteration]).spawn(2)
    return np.random.default_rng(a), np.random.default_rng(b)


def noise(params: Params, iteration: int) -> tuple[np.ndarray, np.ndarray]:
    """Noise of sums (k, d) and counts (k)."""
    shape = (params.k, params.dim)
    if params.dp == "none":
        return np.zeros(shape), np.zeros(params.k)
    sums, counts = params.noise_scales(iteration)
    a, b = streams(params.seed, iteration)
    if params.dp == "laplace":
        return a.laplace(0, sums, shape), b.laplace(0, counts, params.k)
    return a.normal(0, sums, shape), b.normal(0, counts, params.k)


def add_noise(totals: np.ndarray, counts: np.ndarray, params: Params, iteration: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point totals and counts with truncated noise; 64-bit, so that large noise doesn't overflow."""
    s, c = noise(params, iteration)
    return totals + np.trunc(s * 65536).astype(np.int64), counts + np.trunc(c).astype(np.int64)


def rdp_subsampled_gaussian(sigma: float, q: float, alpha: int) -> float:
    """Renyi privacy of one Poisson-subsampled Gaussian step at integer order (Mironov, Talwar and Zhang 2019)."""
    if q == 1:
        return alpha / (2 * sigma**2)
    terms = [math.lgamma(alpha + 1) - math.lgamma(j + 1) - math.lgamma(alpha - j + 1) + (alpha - j) * math.log1p(-q) + (j * math.log(q) if j else 0.0) + (j * j - j) / (2 * sigma**2) for j in range(alpha + 1)]
    top = max(terms)
    return (top + math.log(sum(math.exp(t - top) for t in terms))) / (alpha - 1)


def rdp_epsilon(sigma: float, n: int, batch: int, epochs: int, delta: float, steps: str = "ceil", accountant: str = "subsampled") -> float:
    """Budget spent by all steps; `accountant` "linear" multiplies the plain Gaussian's cost by q."""
    per = -(-n // batch) if steps == "ceil" else max(1, n // batch)
    t, q = epochs * per, min(1.0, batch / n)
    cost = (lambda a: q * a / (2 * sigma**2)) if accountant == "linear" else (lambda a: rdp_subsampled_gaussian(sigma, q, a))
    return min(t * cost(a) + math.log(1 / delta) / (a - 1) for a in range(2, 256))


def find_sigma(eps: float, delta: float, n: int, batch: int, epochs: int, steps: str = "ceil", accountant: str = "subsampled") -> float:
    """Least noise multiplier for a budget, by 64 halvings of [0.01, 1000]."""
    lo, hi = 0.01, 1000.0
    for _ in range(64):
        mid = (lo + hi) / 2
        if rdp_epsilon(mid, n, batch, epochs, delta, steps, accountant) > eps:
            lo = mid
        else:
            hi = mid
    return hi
