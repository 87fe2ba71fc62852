import math

import numpy as np
import pytest

from veilstat.operators import dp
from veilstat.operators.analytics import t_quantile
from veilstat.operators.hungarian import assignment
from veilstat.params import Params, analytic_gaussian_scale


@pytest.mark.parametrize("eps,delta,want", [(0.1, 1e-5, 30.749566), (1, 1e-5, 3.730632), (0.5, 1 / (150 * math.log(150)), 4.438898), (1, 0.4, 0.587230)])
def test_analytic_gaussian_scale(eps, delta, want):
    assert analytic_gaussian_scale(eps, delta) == pytest.approx(want, abs=2e-6)


def test_formulas():
    p = Params(k=3, dim=4, data_size=150, dp="laplace", eps=1.0)
    assert p.laplace_least_eps() == pytest.approx(8.48462, abs=1e-5)
    assert p.iters == 2
    assert p.split_epsilon() == pytest.approx((0.405501, 0.094499), abs=1e-6)
    q = Params(k=3, dim=4, data_size=150, method="diagonal_then_frac", alpha=0.8)
    assert q.frac == pytest.approx(0.303934, abs=1e-6)
    assert (q.max_dist(0), q.max_dist(1)) == (2.0, pytest.approx(1.215737, abs=1e-6))
    assert Params(k=15, dim=2, data_size=10).comm_bytes() == 1440


@pytest.mark.parametrize("kwargs,want", [
    (dict(k=3, dim=2, data_size=1500, dp="gaussiananalytic", eps=0.25, method="diagonal_then_frac", alpha=0.8), 2),
    (dict(k=3, dim=2, data_size=5000, dp="gaussiananalytic", eps=0.25, method="diagonal_then_frac", alpha=0.8), 7),
    (dict(k=3, dim=2, data_size=2000, dp="gaussiananalytic", eps=0.25), 2),
    (dict(k=3, dim=2, data_size=12000, dp="laplace", eps=0.25), 5),
    (dict(k=3, dim=2, data_size=10), 7),
])
def test_rounds(kwargs, want):
    """Each branch of the budget, against the formulas written out."""
    p = Params(**kwargs)
    k, d, n, e = p.k, p.dim, p.data_size, p.eps
    if p.dp == "none":
        m = 7
    elif p.dp == "laplace":
        m = e / np.sqrt(500 * k**3 / n**2 * (d + np.cbrt(4 * d * 0.225**2)) ** 3)
    else:
        s = analytic_gaussian_scale(e, 1 / (n * np.log(n)))
        m = 0.004 * n**2 / (k**3 * d * (0.45 + np.sqrt(d)) ** 2 * s**2) if p.method == "none" else 0.004 * 4 * n**2 / (k**3 * (2 * np.sqrt(d) * p.frac) ** 2 * (1 + np.sqrt(4 * d)) ** 2 * s**2)
    assert p.iters == int(max(min(m, 7), 2)) == want


@pytest.mark.parametrize("bad", [{"dp": "x"}, {"method": "x"}, {"post": "x"}, {"k": 0}, {"dp": "laplace", "eps": 0}])
def test_validation(bad):
    with pytest.raises(ValueError):
        Params(**{"k": 2, "dim": 2, "data_size": 10} | bad)
    with pytest.raises(TypeError):
        Params(k=2, dim=2, data_size=10, unknown=1)


def test_accountant():
    a = dict(delta=1e-5, n=1000, batch=128, epochs=10)
    assert dp.find_sigma(1, **a, steps="floor") == pytest.approx(5.529555, abs=1e-5)
    assert dp.find_sigma(1, **a) == pytest.approx(5.874411, abs=1e-5)
    assert dp.find_sigma(1, **a, steps="floor", accountant="linear") == pytest.approx(14.671830, abs=1e-5)
    s = dp.find_sigma(1, **a)
    assert dp.rdp_epsilon(s, 1000, 128, 10, 1e-5) <= 1 < dp.rdp_epsilon(s / 2, 1000, 128, 10, 1e-5)
    assert dp.find_sigma(0.5, **a) > s > dp.find_sigma(2, **a)


def test_noise():
    p = Params(k=2000, dim=3, data_size=10**6, dp="gaussiananalytic", eps=1.0)
    s, c = dp.noise(p, 1)
    want = p.noise_scales(1)
    assert s.std() == pytest.approx(want[0], rel=0.05) and c.std() == pytest.approx(want[1], rel=0.1)
    assert (dp.noise(p, 1)[0] == s).all() and (dp.noise(p, 2)[0] != s).any()
    assert abs(np.corrcoef(s[:, 0], c)[0, 1]) < 0.1


def test_small_helpers():
    assert t_quantile(99) == pytest.approx(1.98422, abs=1e-5)
    rng = np.random.default_rng(0)
    from itertools import permutations

    for _ in range(20):
        c = rng.random((5, 5))
        got = assignment(c)
        assert sorted(got) == list(range(5))
        assert c[np.arange(5), got].sum() == pytest.approx(min(c[np.arange(5), list(p)].sum() for p in permutations(range(5))))
