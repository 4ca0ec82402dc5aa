"""A forest for several labels against a plain one that tries every cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import forest
from riskweave.operators.resampling import poisson_weights


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    n, k = 160, 5
    x = np.round(r.normal(size=(n, k)), 1)
    x[r.random((n, k)) < 0.3] = 0
    y = np.column_stack([x[:, 0] + r.normal(size=n) * 0.5 > 0.3, x[:, 1] - x[:, 2] + r.normal(size=n) * 0.5 > 0]).astype(int)
    rows = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(k) if x[i, j]], "iid long, feature string, x double").repartition(3)
    labels = spark.createDataFrame([(i, name, int(y[i, j])) for i in range(n) for j, name in enumerate(("p", "q"))], "iid long, label string, y int")
    key = np.array([v["k"] for v in spark.range(n).select(F.xxhash64("id").alias("k"), "id").orderBy("id").collect()])
    return x, y, rows, labels, key


def grow(x, y, w, t, node, depth, least, out):
    out[node] = (w[:, None] * y).sum(0) / w.sum()
    if depth == 0:
        return
    impurity = lambda m: sum(2 * c * (1 - c / w[m].sum()) for c in (w[m][:, None] * y[m]).sum(0)) if w[m].sum() else 0.0
    best, allowed = (1e-9, None, None), forest.drawn_columns(1, t, node, x.shape[1])
    for j in np.flatnonzero(allowed):
        for e in np.unique(np.append(x[:, j], 0.0)):
            m = x[:, j] <= e
            if w[m].sum() >= least and w[~m].sum() >= least:
                gain = impurity(np.ones(len(x), bool)) - impurity(m) - impurity(~m)
                if gain > best[0] + 1e-7:
                    best = (gain, j, e)
    if best[1] is not None:
        m = x[:, best[1]] <= best[2]
        out["cut", node] = best[1:]
        grow(x[m], y[m], w[m], t, 2 * node + 1, depth - 1, least, out)
        grow(x[~m], y[~m], w[~m], t, 2 * node + 2, depth - 1, least, out)


def test_votes_like_a_plain_forest(data):
    x, y, rows, labels, key = data
    tested = np.arange(len(x)) % 4 == 3
    fitted = forest.fit_forest(rows, labels, [f"f{j}" for j in range(5)], trees=12, depth=3, least=5, tested=F.col("iid") % 4 == 3)
    w = poisson_weights(key, np.arange(1, 13))
    total, n = np.zeros(y.shape), np.zeros(len(x))
    for t in range(12):
        own, tree = ~tested & (w[:, t] > 0), {}
        grow(x[own], y[own].astype(float), w[own, t].astype(float), t, 0, 3, 5, tree)
        for i in np.flatnonzero(~own):
            node = 0
            while ("cut", node) in tree:
                j, e = tree["cut", node]
                node = 2 * node + 1 + (x[i, j] > e)
            total[i] += tree[node]
            n[i] += 1
    got = {(r["iid"], r["label"]): r for r in fitted.votes().collect()}
    off = 0
    for i in range(len(x)):
        for j, name in enumerate("pq"):
            r = got[i, name]
            assert r["trees"] == n[i] and r["tested"] == tested[i] and r["y"] == y[i, j]
            off += n[i] > 0 and abs(r["p"] - total[i, j] / n[i]) > 1e-9
    assert off <= 0.05 * y.size  # cuts whose gains tie may be told apart by the order of a sum
    share = {(r["label"], r["feature"]): r["importance"] for r in fitted.importance().collect()}
    for name, best in (("p", ["f0"]), ("q", ["f1", "f2"])):
        assert sum(share[name, f"f{j}"] for j in range(5)) == pytest.approx(1) and max((v, f) for (l, f), v in share.items() if l == name)[1] in best
    for r in forest.report(fitted).collect():
        own = [v for (_, name), v in got.items() if name == r["label"] and v["tested"] == r["tested"] and v["trees"]]
        pairs = [(a["p"] > b["p"]) + 0.5 * (a["p"] == b["p"]) for a in own if a["y"] for b in own if not b["y"]]
        assert r["auc"] == pytest.approx(np.mean(pairs)) and r["auc"] > 0.6 and r["n"] == len(own) == (40 if r["tested"] else int(((n > 0) & ~tested).sum()))
        assert r["accuracy"] == pytest.approx(np.mean([(v["p"] > 0.5) == v["y"] for v in own]))


def test_gain_is_over_all_labels():
    h = np.zeros((2, 2, 3))
    h[0] = [[10, 5, 10], [0, 5, 10]]  # tells the first label apart
    h[1] = [[5, 7, 10], [5, 3, 10]]
    gains, feature, cut = forest.best_split(h, np.ones(2, bool), 1)
    assert (feature, cut) == (0, 0) and gains == pytest.approx([10, 0])
    assert forest.best_split(h, np.array([False, True]), 1)[1] == 1 and np.isinf(forest.best_split(h, np.ones(2, bool), 11)[0]).all()


def test_passes_sum_what_a_node_may_split_on(spark, monkeypatch):
    """Of 16 features a node draws 4: no pass lays out sums of the others, and no weights of more than a slice of people at once."""
    sizes, people, n = [], [], 5000
    zeros, weights = np.zeros, forest.poisson_weights
    frame = pd.DataFrame({"key": np.arange(n), "tested": False, "ys": [np.array([float(i % 3 == 0)]) for i in range(n)], "bin": [np.array([i >> j & 1 for j in range(16)], np.uint16).tobytes() for i in range(n)]})

    class Rows:
        """What a pass asks of the people, here one frame."""

        def mapInPandas(self, f, schema):
            monkeypatch.setattr(forest.np, "zeros", lambda size, *a, **k: sizes.append(size) or zeros(size, *a, **k))
            monkeypatch.setattr(forest, "poisson_weights", lambda key, *a: people.append(len(key)) or weights(key, *a))
            out = pd.concat(f(iter([frame])))
            monkeypatch.undo()
            return spark.createDataFrame(out, schema)

    blank = [(np.full(3, -1), np.zeros(3, int), np.zeros((3, 1)), np.zeros((3, 1))) for _ in range(2)]
    found = forest._grow(Rows(), False, blank, {0: [0], 1: [0]}, 2, 16, 1, 1, 1)
    assert sizes[:2] == [4 * 2 * 2] * 2 and sum(people) == n and max(people) <= forest.SLICE
    assert {r["tree"] for r in found} == {0, 1} and all(r["feature"] in np.flatnonzero(forest.drawn_columns(1, r["tree"], 0, 16)) for r in found if r["feature"] >= 0)
