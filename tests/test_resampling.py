"""Intervals by resampling against plain loops over replicates, and against closed forms."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.stats import t_quantile, t_sf2
from riskweave.operators import resampling as Z


@pytest.fixture(scope="module")
def people(spark):
    r = np.random.default_rng(3)
    n = 250
    x, z = r.normal(size=n) * 3, r.integers(0, 2, n)
    y = (r.random(n) < 1 / (1 + np.exp(-(0.4 * x - 1)))).astype(int)
    p = np.round(1 / (1 + np.exp(-0.3 * x)), 6)
    rows = spark.createDataFrame([(i, m, int(y[i]), float(x[i] * s), float(z[i]), float(p[i])) for i in range(n) for m, s in (("a", 1.0), ("b", -20.0))], "iid long, model string, y int, x double, z double, p double").repartition(5)
    key = np.array([r["k"] for r in rows.filter("model = 'a'").select("iid", F.xxhash64("iid").alias("k")).orderBy("iid").collect()])
    return rows, key, x, z, y, p


def test_weights_are_poisson():
    w = Z.poisson_weights(np.arange(4000) * 7919, np.arange(300)).astype(float)
    assert (w[:, 0] == 1).all()
    w = w[:, 1:]
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25
    assert (Z.poisson_weights(np.arange(50), np.arange(5, 9)) == Z.poisson_weights(np.arange(50), np.arange(9))[:, 5:]).all()


def fit(x, y, w):
    """Newton steps for one data set; Nagelkerke's and Tjur's R-squared."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x, x.T @ (w * (y - p)))
        b += step
    p = 1 / (1 + np.exp(-x @ b))
    n, r = w.sum(), (w * y).sum() / w.sum()
    ll, ll0 = (w * np.where(y == 1, np.log(p), np.log(1 - p))).sum(), n * (r * math.log(r) + (1 - r) * math.log(1 - r))
    return (1 - math.exp(2 * (ll0 - ll) / n)) / (1 - math.exp(2 * ll0 / n)), (w * y * p).sum() / (w * y).sum() - (w * (1 - y) * p).sum() / (w * (1 - y)).sum()


def plain_bca(estimate, drawn, without, level):
    normal = NormalDist()
    z0 = normal.inv_cdf(sum(d < estimate for d in drawn) / len(drawn))
    mean = sum(without) / len(without)
    a = sum((mean - j) ** 3 for j in without) / (6 * sum((mean - j) ** 2 for j in without) ** 1.5)
    out, ordered = [], sorted(drawn)
    for tail in ((1 - level) / 2, (1 + level) / 2):
        q = normal.cdf(z0 + (z0 + normal.inv_cdf(tail)) / (1 - a * (z0 + normal.inv_cdf(tail))))
        k = q * (len(drawn) + 1)
        lo = min(max(int(k), 1), len(drawn) - 1)
        out.append(ordered[lo - 1] + (k - lo) * (ordered[lo] - ordered[lo - 1]))
    return out


@pytest.mark.parametrize("columns", [["x"], ["x", "z"]])
def test_refits_and_their_bounds_like_a_loop(people, columns):
    rows, key, x, z, y, _ = people
    got = {r["model"]: r for r in Z.refit_r2(rows, columns, replicates=120, groups=10, level=0.8).collect()}
    design = np.column_stack([*([x, z][: len(columns)]), np.ones(len(y))])
    w = Z.poisson_weights(key, np.arange(121)).astype(float)
    fits = np.array([fit(design, y, w[:, r]) for r in range(121)])
    without = np.array([fit(design, y, (key % 10 != g).astype(float)) for g in range(10)])
    for k, name in enumerate(("nagelkerke", "tjur")):
        low, high = plain_bca(fits[0, k], fits[1:, k], without[:, k], 0.8)
        for model in "ab":  # the scale of a score makes no difference
            r = got[model]
            assert (r[name], r[f"{name}_low"], r[f"{name}_high"], r[f"{name}_se"]) == pytest.approx((fits[0, k], low, high, fits[1:, k].std(ddof=1)), abs=1e-9)
    assert got["a"]["n"] == len(y)


def test_no_replicates_no_bounds(people):
    r = Z.refit_r2(people[0], ["x"], replicates=0).head()
    assert r["nagelkerke_low"] is None and r["nagelkerke"] > 0 and Z.refit_r2(people[0].limit(0), ["x"], 5).count() == 0


@pytest.mark.parametrize("kind", ["tjur", "nagelkerke", "gain"])
def test_bootstrap_like_a_loop(people, kind):
    rows, key, _, z, y, p = people
    rows = rows.withColumn("p2", (F.col("p") + F.col("z") / 10) / 1.2)
    p2 = (p + z / 10) / 1.2
    mean = lambda w, v, k: (w * v * (y == k)).sum() / (w * (y == k)).sum()
    r2 = lambda w: (lambda n, r, ll: (1 - math.exp(2 * (n * (r * math.log(r) + (1 - r) * math.log(1 - r)) - ll) / n)) / (1 - math.exp(2 * (r * math.log(r) + (1 - r) * math.log(1 - r)))))(w.sum(), (w * y).sum() / w.sum(), (w * np.where(y == 1, np.log(p), np.log(1 - p))).sum())
    statistic, plain = {
        "tjur": (Z.tjur(), lambda w: mean(w, p, 1) - mean(w, p, 0)), "nagelkerke": (Z.nagelkerke(), r2),
        "gain": (Z.discrimination_gain("p", "p2"), lambda w: mean(w, p2, 1) - mean(w, p2, 0) - mean(w, p, 1) + mean(w, p, 0)),
    }[kind]
    w = Z.poisson_weights(key, np.arange(701)).astype(float)
    values = np.array([plain(w[:, r]) for r in range(701)])
    for r in Z.bootstrap(rows, statistic, 700).collect():
        assert (r["estimate"], r["mean"], r["se"]) == pytest.approx((values[0], values[1:].mean(), values[1:].std(ddof=1)))
        assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(values[1:], [0.025, 0.975])))
    if kind == "tjur":  # the error of a difference of means
        assert values[1:].std() == pytest.approx(math.sqrt(p[y == 1].var() / (y == 1).sum() + p[y == 0].var() / (y == 0).sum()), rel=0.12)


def test_bins_are_drawn_as_people_would_be(spark):
    sizes = {1: (400, 100), 2: (50, 3), 3: (8, 2), 4: (60, 0)}
    rows = [("m", b, 2 if i < c else 1) for b, (n, c) in sizes.items() for i in range(n)]
    binned = spark.createDataFrame(rows, "model string, bin int, phenotype int")
    for r in Z.bootstrap_prevalence(binned, 4, 4, 20_000).collect():
        n, c = sizes[r["grp"]]
        p = c / n
        assert (r["n"], r["cases"], r["prevalence"]) == (n, c, p)
        if n <= 10:
            assert r["ci_low"] == r["ci_high"] == p
        else:  # quantiles of the binomial itself
            tail = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
            want = [int(np.searchsorted(tail, q)) / n for q in (0.025, 0.975)]
            assert (r["ci_low"], r["ci_high"]) == pytest.approx(want, abs=1.01 / n)


def test_mean_over_bins(spark):
    r = np.random.default_rng(1)
    counts = {b: (20, int(r.integers(0, 8))) for b in range(1, 201)}
    binned = spark.createDataFrame([("m", b, 2 if i < c else 1) for b, (n, c) in counts.items() for i in range(n)], "model string, bin int, phenotype int")
    rates = np.array([c / n for n, c in counts.values()])
    got = Z.mean_prevalence(binned, 20_000).head()
    assert got["mean_rate"] == pytest.approx(rates.mean()) and got["bins"] == 200
    error = rates.std() / math.sqrt(200)  # of the mean of so many rates drawn with replacement
    assert (got["boot_high"] - got["boot_low"]) / (2 * 1.959964) == pytest.approx(error, rel=0.03)
    half = rates.std(ddof=1) / math.sqrt(200) * 1.971957  # fixed value: the 0.975 quantile of Student's t, 199 degrees
    assert (got["t_low"], got["t_high"]) == pytest.approx((rates.mean() - half, rates.mean() + half), abs=1e-6)
    assert str(Z.mean_prevalence(binned, 500).head()) == str(Z.mean_prevalence(binned.repartition(3), 500).head())


def test_quantiles_of_t():
    assert t_quantile(0.975, 9) == pytest.approx(2.262157163) and t_quantile(0.975, 1) == pytest.approx(12.706204736)
    assert all(t_sf2(t_quantile(p, df), df) == pytest.approx(2 * (1 - p)) for p in (0.6, 0.9, 0.999) for df in (1, 3, 50, 1e4))


def test_people_who_are_alike_are_fitted_as_one_row(spark, monkeypatch):
    rows = spark.range(9000).select(F.col("id").alias("iid"), F.lit("m").alias("model"), (F.col("id") % 7).cast("double").alias("x"), (F.crc32(F.col("id").cast("string").cast("binary")) % 11 < F.col("id") % 7).cast("int").alias("y"))
    seen = []
    monkeypatch.setattr(Z, "_refit_pass", lambda data, *a, f=Z._refit_pass: seen.append(data) or f(data, *a))
    got = Z.refit_r2(rows, ["x"], replicates=50, groups=10).head()
    assert 14 <= seen[-1].count() < 9000 / Z.FEW
    monkeypatch.setattr(Z, "FEW", 10**9)  # each on their own
    want = Z.refit_r2(rows, ["x"], replicates=50, groups=10).head()
    assert seen[-1].count() == 9000
    assert all(a == b if isinstance(b, str) else abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
