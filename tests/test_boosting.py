"""Histogram boosting against a plain booster that tries every cut."""

import zlib

import numpy as np
import pytest

from riskweave.operators import boosting as H


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(11)
    n, k = 260, 6
    x = np.round(r.normal(size=(n, k)), 1) * [1, 1, 10, 1, 1, 1]
    x[:, 3], x[:, 4], x[:, 5] = r.integers(0, 3, n), x[:, 0], 0  # few values, a copy, nothing
    x[r.random((n, k)) < 0.3] = 0
    y = (r.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + 0.1 * x[:, 2] * (x[:, 3] > 0) - 0.5)))).astype(int)
    rows = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(k) if x[i, j]], "iid long, feature string, x double").repartition(4)
    people = spark.createDataFrame([(i, int(v) + 1) for i, v in enumerate(y)], "iid long, phenotype int")
    return x, y, rows, people, [f"f{j}" for j in range(k)]


def lot(word, n):
    return np.array([zlib.crc32(f"{word}{i}".encode()) % n for i in range(260)])


def grow(x, g, h, edges, setting, allowed, depth, node, tree, rows):
    """Every cut of every feature; the first of the best."""
    if depth == 0:
        return
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + setting.l2) if h[m].sum() + setting.l2 > 0 else 0.0
    best = (1e-12, None, None)
    for j in range(x.shape[1]):
        for b, e in enumerate(edges[j]):
            left, right = rows & (x[:, j] <= e), rows & (x[:, j] > e)
            if allowed[j] and left.sum() >= setting.least and right.sum() >= setting.least:
                gain = score(left) + score(right) - score(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, j, e)
    if best[1] is None:
        return
    tree[node] = best[1:]
    for child, side in ((2 * node + 1, rows & (x[:, best[1]] <= best[2])), (2 * node + 2, rows & (x[:, best[1]] > best[2]))):
        tree["value", child] = -setting.rate * g[side].sum() / (h[side].sum() + setting.l2)
        grow(x, g, h, edges, setting, allowed, depth - 1, child, tree, side)


def ends(x, tree):
    out = np.zeros(len(x))
    for i in range(len(x)):
        node = 0
        while node in tree:
            j, e = tree[node]
            node = 2 * node + 1 + (x[i, j] > e)
        out[i] = tree["value", node]
    return out


def plain(x, y, fold, back, side, setting, rounds, edges, fit):
    own = fold != side
    start = y[own].mean()
    f, losses, kept, stopped = np.full(len(y), np.log(start / (1 - start))), [], [], False
    for _ in range(rounds):
        if not stopped:
            p = 1 / (1 + np.exp(-f))
            learn = own & ~back if setting.patience else own
            out = own & back
            losses.append((np.logaddexp(0, f[out]) - y[out] * f[out]).sum())
            g, h = p - y, p * (1 - p)
            tree = {("value", 0): -setting.rate * g[learn].sum() / (h[learn].sum() + setting.l2)}
            grow(x, g, h, edges, setting, H._allowed(fit, x.shape[1]), setting.depth, 0, tree, learn)
            fit.trees.append(None)
            f = f + ends(x, tree)
            k = setting.patience
            stopped = bool(k and len(losses) > k and min(losses[-k:]) >= min(losses[:-k]) - 1e-7)
        kept.append(f)
    return kept


def auc(score, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in np.round(score[y == 1], 9) for b in np.round(score[y == 0], 9)])


SETTINGS = [H.Setting(0.3, 0.0, 2, 5), H.Setting(1.0, 0.5, 3, 10), H.Setting(0.5, 1.0, 2, 5, columns=0.5), H.Setting(1.0, 0.0, 2, 2, patience=2)]


@pytest.mark.parametrize("bins", [255, 8])
def test_like_a_plain_booster(data, monkeypatch, bins):
    x, y, rows, people, features = data
    monkeypatch.setattr(H, "CUT", 2)
    model, found = H.fit_boosted(rows, people, features, SETTINGS, [2, 5], folds=2, bins=bins)
    fold, back = lot("", 2), lot("back", 10) == 0
    want = {}
    for s, setting in enumerate(SETTINGS):
        for side in range(2):
            scores = plain(x, y, fold, back, side, setting, 5, model.edges, H.Fit(2 * s + side, setting, side))
            for i in (2, 5):
                want.setdefault((setting.rate, setting.l2, i), []).append(auc(scores[i - 1][fold == side], y[fold == side]))
    got = {(r["rate"], r["l2"], r["iterations"]): r["auc"] for r in found.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(np.mean(values), abs=2e-3), key
    assert sum(model.importance().values()) == sum(int((f >= 0).sum()) for t in model.fits for f, _, _ in t.trees) > 0 == model.importance()["f5"]
    assert sum(t.stopped for t in model.fits) == 0 or all(t.setting.patience for t in model.fits if t.stopped)


def test_lanes_and_whole_people(data, monkeypatch):
    _, _, rows, people, features = data
    one = H.fit_boosted(rows, people, features, SETTINGS[:1], [3], folds=0)[1].head()
    monkeypatch.setattr(H, "LANES", 2)
    assert H.fit_boosted(rows, people, features, SETTINGS[:1], [3], folds=0)[1].head()["auc"] == pytest.approx(one["auc"], abs=1e-9) and one["auc"] > 0.8


def test_best_split_prefers_the_first():
    h = np.zeros((3, 4, 3))
    h[:, :, 2] = 5
    h[1:, 0, 0], h[1:, 1:, 0], h[:, :, 1] = -4, 2, 1
    gain, feature, cut = H.best_split(h, H.Setting(least=1), np.array([True, True, True]))
    assert (feature, cut) == (1, 0) and gain > 0
    assert H.best_split(h, H.Setting(least=6), np.array([True, True, True]))[2] != 0
    assert H.best_split(h, H.Setting(least=1), np.array([True, False, False]))[0] == pytest.approx(0)


def test_columns_are_drawn_anew_for_each_tree():
    t = H.Fit(3, H.Setting(columns=0.25), -1)
    seen = set()
    for _ in range(20):
        seen.add(tuple(np.flatnonzero(H._allowed(t, 12))))
        t.trees.append(None)
    assert all(len(s) == 3 for s in seen) and len(seen) > 10


def test_histograms_are_the_same_by_products_and_by_counts(monkeypatch):
    r = np.random.default_rng(3)
    sizes = [3, 1, 7, 2]
    x = np.column_stack([r.integers(0, n, 2500) for n in sizes]).astype(np.uint16)
    w = r.normal(size=(2500, 5)) * (r.random((2500, 5)) < 0.6)
    want = np.zeros((4, 7, 5))
    for j in range(4):
        np.add.at(want[j], x[:, j], w)
    h = H.Histograms(sizes, 7)
    products = h.sums(x, w)
    monkeypatch.setattr(H, "MOST_CELLS", 5)
    for got in (products, h.sums(x, w)):
        assert np.allclose(got.reshape(4, 7, 5), want)


def test_bins_of_people_add_rows_and_take_absence_as_zero(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "b", -1.0), (2, "a", None)], "iid long, feature string, x double")
    people = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "iid long, phenotype int")
    found = H.binned_people(rows, people, ["a", "b"], [np.array([0.0, 2.5]), np.array([-2.0, -0.5, 0.0])], 2).orderBy("iid").toPandas()
    assert H._matrix(found).tolist() == [[2, 2], [0, 1], [0, 2]]
