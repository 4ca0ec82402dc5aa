"""L1 logistic paths against a plain solver, and their conditions at the minimum."""

import inspect
import zlib

import numpy as np
import pytest

from riskweave import queries
from riskweave.operators import penalised


def plain(x, y, penalty, steps=60_000):
    """Accelerated proximal gradient on scaled columns, the intercept last; the penalty is of scaled coefficients."""
    mean, sd = x.mean(0), x.std(0)
    z = np.column_stack([(x - mean) / np.where(sd > 0, sd, 1) * (sd > 0), np.ones(len(x))])
    p, b = np.append(penalty, 0.0), np.zeros(z.shape[1])
    step = 4 * len(x) / np.linalg.norm(z, 2) ** 2
    a, t = b.copy(), 1.0
    for _ in range(steps):
        g = z.T @ (y - 1 / (1 + np.exp(-z @ a))) / len(x)
        u = a + step * g
        new = np.sign(u) * np.maximum(np.abs(u) - step * p, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        a = new + (t - 1) / t2 * (new - b)
        if (new - b) @ (a - new) < 0:
            a, t2 = new.copy(), 1.0
        moved, b, t = np.abs(new - b).max(), new, t2
        if moved < 1e-13:
            break
    coefs = b[:-1] / np.where(sd > 0, sd, 1)
    return np.append(coefs, b[-1] - coefs @ mean)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(7)
    n, k = 300, 9
    x = r.normal(size=(n, k)) * np.array([1, 40, 0.1] * 3) + r.integers(0, 3, k)
    x[r.random((n, k)) < 0.4] = 0
    x[:, 8], x[:, 7] = 2, x[:, 0] + r.normal(size=n) * 0.05
    y = (r.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.02 * x[:, 1] + 4 * x[:, 2] - 1)))).astype(int)
    rows = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(k) if x[i, j]], "iid long, feature string, x double")
    people = spark.createDataFrame([(i, int(v) + 1) for i, v in enumerate(y)], "iid long, phenotype int")
    return x, y, rows, people


SETS = {"all": [f"f{j}" for j in range(9)], "some": ["f4", "f0", "f2"], "free": ["f0", "f1"]}


def test_paths_like_a_plain_solver(data):
    x, y, rows, people = data
    fits = penalised.fit_paths(rows, people, SETS, ["f0", "f1"], lambdas=5, folds=3)
    got = {(r["model"], r["feature"]): r for r in fits.coefficients.collect()}
    losses = fits.losses.collect()
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in range(len(y))])
    for model, names in SETS.items():
        at = [int(f[1:]) for f in names]
        loose = np.isin(names, ["f0", "f1"])
        path = sorted((r for r in losses if r["model"] == model), key=lambda r: r["step"])
        chosen = next(r for r in path if r["chosen"])
        assert chosen["loss"] == min(r["loss"] for r in path) and len(path) == (1 if model == "free" else 6)
        penalty = np.where(loose, 0.0, chosen["lambda"])
        want = plain(x[:, at], y, penalty)
        assert [got[model, f]["coefs"] for f in [*names, "(Intercept)"]] == pytest.approx(want, abs=1e-5)
        assert [got[model, f]["penalty"] for f in names] == pytest.approx(penalty * x[:, at].std(0))
        # the loss of the chosen penalty: each fold under the fit on the others, with everybody's means and deviations
        total, mean, sd = 0.0, x[:, at].mean(0), x[:, at].std(0)
        z = (x[:, at] - mean) / np.where(sd > 0, sd, 1) * (sd > 0)
        for f in range(3):
            own = plain_scaled(z[fold != f], y[fold != f], penalty)
            eta = z[fold == f] @ own[:-1] + own[-1]
            total += (np.logaddexp(0, eta) - y[fold == f] * eta).sum()
        assert chosen["loss"] == pytest.approx(total / len(y), abs=1e-6)


def plain_scaled(z, y, penalty):
    z = np.column_stack([z, np.ones(len(z))])
    p, b, step = np.append(penalty, 0.0), np.zeros(z.shape[1]), 4 * len(z) / np.linalg.norm(z, 2) ** 2
    for _ in range(40_000):
        u = b + step * z.T @ (y - 1 / (1 + np.exp(-z @ b))) / len(z)
        new = np.sign(u) * np.maximum(np.abs(u) - step * p, 0)
        if np.abs(new - b).max() < 1e-13:
            break
        b = new
    return b


def test_conditions_from_the_rows(data):
    x, y, rows, people = data
    fits = penalised.fit_paths(rows, people, {"all": SETS["all"]}, ["f0"], lambdas=2, folds=2)
    found = {r["feature"]: r for r in penalised.slopes(rows, people, fits.coefficients).collect()}
    assert all(r["off"] < 1e-6 for r in found.values()) and found["f8"]["coefs"] == 0 and found["f1"]["n"] == int((x[:, 1] != 0).sum())
    wrong = fits.coefficients.withColumn("coefs", fits.coefficients["coefs"] * 1.01)
    assert max(r["off"] for r in penalised.slopes(rows, people, wrong).collect()) > 1e-4


def test_people_without_features_and_too_many_features(spark, data):
    _, _, rows, people = data
    alone = people.unionByName(spark.createDataFrame([(9999, 1)], "iid long, phenotype int"))
    assert penalised.vectors(rows, alone, ["f0"], 3).filter("iid = 9999").head()["at"] == []
    with pytest.raises(ValueError):
        penalised.vectors(rows, people, [f"g{i}" for i in range(penalised.MOST_FEATURES + 1)], 3)


def test_sums_of_many_tasks_meet_in_lanes(data, monkeypatch):
    _, _, rows, people = data
    want = sorted(map(str, penalised.fit_paths(rows, people, {"some": SETS["some"]}, [], lambdas=2, folds=2).losses.select("step", "chosen").collect()))
    monkeypatch.setattr(penalised, "LANES", 2)
    assert sorted(map(str, penalised.fit_paths(rows, people, {"some": SETS["some"]}, [], lambdas=2, folds=2).losses.select("step", "chosen").collect())) == want


def test_conditions_of_the_written_people_are_those_of_the_rows(data):
    _, _, rows, people = data
    twice = rows.unionByName(rows.filter("feature = 'f3'"))  # rows of one feature of a person add up
    fits = penalised.fit_paths(twice, people, SETS, ["f0", "f1"], lambdas=3, folds=3)
    got = {(r["model"], r["feature"]): r for r in fits.conditions().collect()}
    want = {(r["model"], r["feature"]): r for r in penalised.slopes(twice, people, fits.coefficients).collect()}
    assert got.keys() == want.keys() and all(r["off"] < 1e-6 for r in got.values())
    for key, r in want.items():
        assert got[key]["n"] == r["n"] and got[key]["slope"] == pytest.approx(r["slope"], abs=1e-9) and got[key]["off"] == pytest.approx(r["off"], abs=1e-9)


def test_rows_are_shuffled_once_for_vectors(data):
    _, _, rows, people = data
    plan = penalised.vectors(rows, people, ["f0", "f1"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(iid") <= 2  # rows, people


def test_lasso_walks_the_whole_path(spark, monkeypatch):
    """A hundred penalties down to 1e-4 of the first, or to 0.01 with more features than people, as glmnet's; the query asks for no fewer."""
    rows = spark.createDataFrame([(i, f"f{j}", float((i * 7 + j * 3) % 5)) for i in range(40) for j in range(2)], "iid long, feature string, x double")
    people = spark.createDataFrame([(i, 1 + (i % 3 == 0)) for i in range(40)], "iid long, phenotype int")
    losses = lambda some, names: penalised.fit_paths(rows, some, {"s": names}, [], folds=0).losses.orderBy("step").toPandas()
    path = losses(people, ["f0", "f1"])
    assert len(path) == 100 and np.isclose(path["lambda"].iloc[-1], 1e-4 * path["lambda"].iloc[0])
    asked, fit = [], penalised.fit_paths
    monkeypatch.setattr(penalised, "fit_paths", lambda *a, **b: asked.append(inspect.signature(fit).bind(*a, **b)) or fit(rows, people, {"s": ["f0"]}, [], lambdas=1, folds=0))
    queries.QUERIES["lasso_logistic"](spark, "/root/testdata/sf0.001")
    asked[0].apply_defaults()
    assert {k: asked[0].arguments[k] for k in ("lambdas", "ratio", "folds")} == {"lambdas": 99, "ratio": None, "folds": 5} and len(asked[0].arguments["sets"]) == 10
