"""Contributions by permutations against the definition, a linear model's closed form, and their sum."""

from itertools import permutations

import numpy as np
import pytest

from riskweave.operators import permutation_shap as S


def model(m):
    return 1 / (1 + np.exp(-(m[:, 0] - 2 * m[:, 1] * m[:, 2] + np.maximum(m[:, 3], 0))))


def test_exact_like_all_orders():
    r = np.random.default_rng(1)
    x, base = r.normal(size=(3, 4)), r.normal(size=(5, 4))
    inside, weights = S.coalitions(4, 0)
    got, error = S.explain(model, x, base, inside, weights)
    value = lambda row, s: model(np.where(s, row, base)).mean()
    for i, row in enumerate(x):
        want, n = np.zeros(4), 0
        for order in permutations(range(4)):
            s = np.zeros(4, bool)
            for j in order:
                before = value(row, s)
                s[j] = True
                want[j] += value(row, s) - before
            n += 1
        assert got[i] == pytest.approx(want / n) and (error == 0).all()


@pytest.mark.parametrize("k", [8, 9, 14])
def test_sums_and_errors(spark, k, monkeypatch):
    r = np.random.default_rng(k)
    names, x, beta = [f"x{j}" for j in range(k)], r.normal(size=(20, k)), r.normal(size=k)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(99, *[None] * k)], "iid long, " + ", ".join(f"{n} double" for n in names))
    base = rows.filter("iid < 6")

    def linear(m):
        return m @ beta

    got = S.permutation_shap(linear, rows, names, base, pairs=3).toPandas().pivot(index="iid", columns="feature", values="shap")[names].to_numpy()
    assert got == pytest.approx(beta * (x - x[:6].mean(0)))  # whatever the permutations

    def crossed(m):
        return np.tanh(m @ beta) + m[:, 0] * m[:, 1]

    few, many = (S.permutation_shap(crossed, rows, names, base, pairs=p).toPandas() for p in (8, 60))
    for t in (few, many):
        assert t.groupby("iid")["shap"].sum().to_numpy() == pytest.approx(crossed(x) - crossed(x[:6]).mean())
    if k > S.EXACT:
        gap = np.abs(few["shap"] - many["shap"])
        assert many["error"].mean() < few["error"].mean() and (gap <= 5 * np.hypot(few["error"], many["error"]) + 1e-9).mean() > 0.95
    else:
        assert few["error"].max() == 0


def test_shared_coalitions_are_scored_once():
    inside, weights = S.coalitions(12, 30)
    assert len(np.unique(inside, axis=0)) == len(inside) < 30 * 2 * 13 and len(weights) == 30
    assert all(w.sum(1) == pytest.approx(0) for w in weights)
