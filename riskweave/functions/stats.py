"""Tails and closed forms of the comparison statistics, for frames of the size of a result."""

from __future__ import annotations

import math


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, Lentz's continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * front


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The value of Student's t below which a share p lies, p above one half, by halving."""
    low, high = 0.0, 1.0
    while t_sf2(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_sf2(middle, df) > 2 * (1 - p) else (low, middle)
    return (low + high) / 2


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeom_pmf(k: int, total: int, good: int, drawn: int) -> float:
    return math.exp(log_choose(good, k) + log_choose(total - good, drawn - k) - log_choose(total, drawn))


def hypergeom_cdf(k: int, total: int, good: int, drawn: int) -> float:
    low = max(0, drawn - (total - good))
    return min(1.0, sum(hypergeom_pmf(i, total, good, drawn) for i in range(low, min(k, good, drawn) + 1)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the sum of the probabilities of all tables with these margins that are no likelier than this one."""
    total, good, drawn = a + b + c + d, a + b, a + c
    if total == 0:
        return 1.0
    here = hypergeom_pmf(a, total, good, drawn)
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    return min(1.0, sum(p for i in range(low, high + 1) if (p := hypergeom_pmf(i, total, good, drawn)) <= here * (1 + 1e-7)))


def binom_test_half(k: int, n: int) -> float:
    """Two-sided test of a share of one half."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    tail = sum(math.exp(log_choose(n, i) - n * math.log(2)) for i in range(low + 1))
    return min(1.0, 2 * tail - (math.exp(log_choose(n, low) - n * math.log(2)) if 2 * low == n else 0.0) if 2 * low == n else 2 * tail)


def mcnemar(b: int, c: int) -> tuple[float, float]:
    """Statistic with continuity correction and its p-value; no discordant pairs: 0 and 1."""
    if b + c == 0:
        return 0.0, 1.0
    x = (abs(b - c) - 1) ** 2 / (b + c)
    return x, math.erfc(math.sqrt(x / 2))


def hwe_exact(het: int, hom1: int, hom2: int) -> float:
    """Exact test of Hardy-Weinberg proportions: tables no likelier than the observed count of heterozygotes."""
    rare, n = 2 * min(hom1, hom2) + het, het + hom1 + hom2
    if n == 0:
        return 1.0
    probability = {}
    middle = int(rare * (2 * n - rare) / (2 * n))
    middle += (middle ^ rare) & 1
    probability[middle] = 1.0
    h, r, c = middle, (rare - middle) // 2, n - middle - (rare - middle) // 2
    while h > 1:
        probability[h - 2] = probability[h] * h * (h - 1) / (4 * (r + 1) * (c + 1))
        h, r, c = h - 2, r + 1, c + 1
    h, r, c = middle, (rare - middle) // 2, n - middle - (rare - middle) // 2
    while h <= rare - 2:
        probability[h + 2] = probability[h] * 4 * r * c / ((h + 2) * (h + 1))
        h, r, c = h + 2, r - 1, c - 1
    total, here = sum(probability.values()), probability.get(het, 0.0)
    return min(1.0, sum(p for p in probability.values() if p <= here * (1 + 1e-9)) / total)
