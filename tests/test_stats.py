import itertools
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from riskweave.functions import stats as S


def test_known_tails():
    assert S.normal_sf2(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert S.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert S.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-12)
    assert S.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.beta_i(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_fisher_tea_tasting():
    assert S.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert S.fisher_exact(8, 2, 1, 5) == pytest.approx(0.0349650350)
    assert S.fisher_exact(0, 0, 0, 0) == 1.0


@given(st.integers(0, 12), st.integers(0, 12), st.integers(0, 12))
def test_hypergeometric_sums_to_one(good, bad, drawn):
    total = good + bad
    drawn = min(drawn, total)
    assert S.hypergeom_cdf(good, total, good, drawn) == pytest.approx(1.0)


def test_binomial_half_by_enumeration():
    for n in range(1, 9):
        for k in range(n + 1):
            p = [math.comb(n, i) / 2**n for i in range(n + 1)]
            want = sum(x for x in p if x <= p[k] * (1 + 1e-9))
            assert S.binom_test_half(k, n) == pytest.approx(min(1, want))


def test_hardy_weinberg_by_enumeration():
    for het, a, b in itertools.product(range(0, 9), range(0, 6), range(0, 6)):
        n, x = het + a + b, 2 * a + het
        if n == 0:
            continue
        p = {}
        for h in range(x % 2, min(x, 2 * n - x) + 1, 2):
            i, j = (x - h) // 2, n - h - (x - h) // 2
            p[h] = 2**h / (math.factorial(h) * math.factorial(i) * math.factorial(j))
        want = sum(v for v in p.values() if v <= p[het] * (1 + 1e-9)) / sum(p.values())
        assert S.hwe_exact(het, a, b) == pytest.approx(want), (het, a, b)


def test_mcnemar():
    x, p = S.mcnemar(10, 20)
    assert x == pytest.approx(81 / 30) and p == pytest.approx(math.erfc(math.sqrt(81 / 60)))
    assert S.mcnemar(0, 0) == (0.0, 1.0)
