"""Parameters of a clustering run and the formulas that follow from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

# fixed values: share of the noise on counts, and names of methods, mechanisms, post-processing and bases
RHO = 0.225
METHODS = ("none", "diagonal_then_frac", "frac_stay")
MECHANISMS = ("none", "laplace", "gaussiananalytic")
POSTS = ("none", "fold", "truncate", "none_unclipped", "fold_unclipped", "truncate_unclipped")
BASES = ("random", "svd_pca", "dpsgd_pca")


def comm_bytes(clients, k, d):
    """Bytes of one round over all ranks, of numbers or columns: 64-bit totals and counts, gathered and sent back."""
    return 2 * clients * 8 * k * (d + 1)


def phi(x: float) -> float:
    """Standard normal distribution function."""
    return 0.5 * math.erfc(-x / math.sqrt(2))


def analytic_gaussian_scale(eps: float, delta: float, sensitivity: float = 1.0) -> float:
    """Least standard deviation for (eps, delta)-privacy (Balle and Wang 2018, algorithm 1)."""
    if eps <= 0 or not 0 < delta < 1 or sensitivity < 0:
        raise ValueError("eps must be positive, delta between 0 and 1, sensitivity not negative")

    def plus(v: float) -> float:
        return phi(math.sqrt(eps * v)) - math.exp(eps) * phi(-math.sqrt(eps * (v + 2)))

    def minus(v: float) -> float:
        return phi(-math.sqrt(eps * v)) - math.exp(eps) * phi(-math.sqrt(eps * (v + 2)))

    at_zero = phi(0) - math.exp(eps) * phi(-math.sqrt(2 * eps))
    rising = delta >= at_zero
    ok = (lambda v: plus(v) <= delta) if rising else (lambda v: minus(v) > delta)
    lo, hi = 0.0, 1.0
    while ok(hi):
        lo, hi = hi, 2 * hi
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    v = lo if rising else hi
    alpha = math.sqrt(1 + v / 2) + (-1 if rising else 1) * math.sqrt(v / 2)
    return alpha * sensitivity / math.sqrt(2 * eps)


@dataclass(frozen=True)
class Params:
    """One configuration; values are validated, and unknown names raise TypeError."""

    k: int
    dim: int
    data_size: int
    num_clients: int = 2
    dp: str = "none"
    eps: float = 0.0
    method: str = "none"
    post: str = "none"
    alpha: float = 2.0
    fixed: bool = True
    seed: int = 1337
    iters: int | None = None
    delay: float = 0.0
    phantom: bool = True
    d_prime: int = 3
    sigma: float = 0.0
    basis_method: str = "dpsgd_pca"
    basis_epsilon: float = 0.5
    basis_delta: float = 1e-5
    basis_clip_norm: float = 1.0
    basis_data_fraction: float = 0.1

    def __post_init__(self):
        if self.method == "stay_frac":  # both spellings are in use
            object.__setattr__(self, "method", "frac_stay")
        for value, allowed, name in ((self.dp, MECHANISMS, "dp"), (self.method, METHODS, "method"), (self.post, POSTS, "post"), (self.basis_method, BASES, "basis_method")):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {value!r}")
        if min(self.k, self.dim, self.data_size, self.num_clients) < 1:
            raise ValueError("k, dim, data_size and num_clients must be positive")
        if self.dp != "none" and self.eps <= 0:
            raise ValueError("a private run needs eps > 0")
        if self.iters is None:
            object.__setattr__(self, "iters", self.iterations())

    @property
    def delta(self) -> float:
        return 1 / (self.data_size * math.log(self.data_size)) if self.data_size > 1 else 0.5

    @property
    def diagonal(self) -> float:
        return 2 * math.sqrt(self.dim)

    @property
    def frac(self) -> float:
        return self.alpha / (2 * self.k ** (1 / self.dim))

    def iterations(self) -> int:
        """Rounds that the budget allows: 7 without privacy, else 2 to 7."""
        k, d, n = self.k, self.dim, self.data_size
        if self.dp == "none":
            return 7
        if self.dp == "laplace":
            m = self.eps / math.sqrt(500 * k**3 / n**2 * (d + (4 * d * RHO**2) ** (1 / 3)) ** 3)
        else:
            s = analytic_gaussian_scale(self.eps, self.delta)
            if self.method == "none":
                m = 0.004 * n**2 / (k**3 * d * (2 * RHO + math.sqrt(d)) ** 2 * s**2)
            else:
                m = 0.016 * n**2 / (k**3 * (self.diagonal * self.frac) ** 2 * (1 + math.sqrt(4 * d)) ** 2 * s**2) if self.frac else 7
        return min(7, max(2, int(m)))

    def laplace_least_eps(self) -> float:
        """Budget at which the Laplace mechanism affords one round."""
        k, d, n = self.k, self.dim, self.data_size
        return math.sqrt(500 * k**3 / n**2 * (d + (4 * d * RHO**2) ** (1 / 3)) ** 3)

    def max_dist(self, iteration: int) -> float:
        """Radius of the assignment in a round."""
        if self.method == "none":
            return self.diagonal
        r = self.diagonal * self.frac if "stay" in self.method or iteration > 0 else self.diagonal / 2
        limit = self.dim if self.dp == "laplace" else self.diagonal
        return self.diagonal if r >= limit else r

    def split_epsilon(self) -> tuple[float, float]:
        """Budget of sums and of counts in one round."""
        sums, counts = float(self.dim), (4 * self.dim * RHO**2) ** (1 / 3)
        per = self.eps / self.iters / (sums + counts)
        return sums * per, counts * per

    def noise_scales(self, iteration: int) -> tuple[float, float]:
        """Scales of the noise on sums and counts in a round: Laplace scales, or standard deviations."""
        d, r = self.dim, self.max_dist(iteration)
        if self.dp == "none":
            return 0.0, 0.0
        if self.dp == "laplace":
            sums, counts = self.split_epsilon()
            return (min(2.0, r) if self.method != "none" else 1.0) * d / sums, 1 / counts
        s = analytic_gaussian_scale(self.eps, self.delta) * math.sqrt(self.iters)
        if self.method != "none":
            f = math.sqrt(1 + math.sqrt(4 * d))
            return s * f / (4 * d) ** 0.25 * min(self.diagonal, r), s * f
        f = math.sqrt(2 * RHO + math.sqrt(d))
        return s * f / d**0.25 * math.sqrt(d), s * f / math.sqrt(2 * RHO)

    def comm_bytes(self) -> int:
        return comm_bytes(self.num_clients, self.k, self.dim)

    def as_row(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# fixed values: radius factors of the ablation
ABLATION_ALPHAS = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0, 1.1, 1.2, 1.25, 1.3, 1.4, 1.5, 1.6, 1.7, 1.75, 1.8, 1.9, 2.0)
_EPS = (0.1, 0.25, 0.5, 0.75, 1.0)
#: fixed values: parameter lists of the named experiments
PRESETS = {
    "test": {"dps": ("none", "gaussiananalytic"), "methods": ("none", "diagonal_then_frac"), "posts": ("none", "fold"), "eps_budgets": (1.0,), "alphas": (0.8,), "delays": (0.0,)},
    "timing": {"dps": ("gaussiananalytic",), "methods": ("diagonal_then_frac",), "posts": ("fold",), "eps_budgets": (0.1,), "alphas": (0.8,), "delays": (0.000125, 0.025)},
    "accuracy": {"dps": MECHANISMS, "methods": ("none", "diagonal_then_frac"), "posts": ("none", "fold"), "eps_budgets": _EPS, "alphas": (0.8,), "delays": (0.0,)},
    "scale": {"dps": MECHANISMS, "methods": ("none", "diagonal_then_frac"), "posts": ("none", "fold"), "eps_budgets": _EPS, "alphas": (0.8,), "delays": (0.0,)},
    "ablation": {"dps": ("gaussiananalytic",), "methods": METHODS, "posts": POSTS, "eps_budgets": (0.1,), "alphas": ABLATION_ALPHAS, "delays": (0.0,)},
}
