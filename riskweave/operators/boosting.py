"""Gradient boosting on binned columns: histograms of slopes, many fits in the same passes over the people.

A person is a row of bin numbers. A pass gives, for each fit and each node that is open, sums of slopes and curvatures by feature and bin; splits
follow from these alone. Of two children only the smaller is summed, the other is what is left of the parent. Sums meet in lanes, then
by parent, where the split is chosen: no histogram comes to the driver. Scores are written with the people every few rounds, in between trees are applied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import released, written
from .binning import quantiles
from .evaluation import rank_auc

#: Bins of a column; features of one model; rounds after which scores are written; lanes of partial sums.
BINS, MOST_FEATURES, CUT, LANES = 255, 3000, 10, 64
#: People laid out at once; cells (bins of all features) up to which sums are products of matrices.
SLICE, MOST_CELLS = 1024, 4096
#: Of ten people of a fit, one is kept back where it may stop early.
KEPT_BACK = 10


@dataclass(frozen=True)
class Setting:
    rate: float = 0.1
    l2: float = 0.0
    depth: int = 3
    least: int = 20  # people in a leaf
    columns: float = 1.0  # share of the features that a tree may use
    patience: int = 0  # rounds without a better loss on those kept back after which it stops; 0: never

    def leaf(self, slope: float, curvature: float) -> float:
        return -self.rate * slope / (curvature + self.l2) if curvature + self.l2 > 0 else 0.0


@dataclass
class Fit:
    """A model on its way: all people but one fold (-1: all). A tree is arrays (feature, bin, value) over the nodes of a full binary tree; feature -1 is a leaf."""

    number: int
    setting: Setting
    fold: int
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    stopped: bool = False

    def blank(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.setting.depth + 1) - 1
        return np.full(size, -1), np.zeros(size, int), np.zeros(size)


def column_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Inner edges of each feature's bins, right-closed: 0, which people without a row have, and quantiles of the other values."""
    found = {r["feature"]: r["q"] for r in quantiles(rows.filter(F.col("feature").isin(features)).withColumn("x", F.col("x").cast("double")), "x", bins - 2, ["feature"]).collect()}  # BINS numbers for each feature
    return [np.unique([0.0, *found.get(f, [])])[: bins - 1] for f in features]


def binned_people(rows: DataFrame, people: DataFrame, features: list[str], edges: list[np.ndarray], folds: int) -> DataFrame:
    """(iid, y, fold, back, bin): the bins of all features as bytes; folds, and who is kept back, by hashes of the id."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"{len(features)} features; fit them in batches of {MOST_FEATURES}")
    table = rows.sparkSession.createDataFrame(list(enumerate(features)), "at int, feature string")
    each = rows.filter(F.col("x").isNotNull()).join(F.broadcast(table), "feature")
    packed = each.groupBy("iid").agg(F.collect_list(F.struct("at", F.col("x").cast("double").alias("x"))).alias("v"))
    lot = lambda word, n: F.pmod(F.crc32(F.concat(F.lit(word), F.col("iid").cast("string")).cast("binary")), F.lit(max(n, 1))).cast("int")
    out = people.select("iid", (F.col("phenotype") - 1).cast("double").alias("y"), lot("", folds).alias("fold"), (lot("back", KEPT_BACK) == 0).alias("back")).join(packed, "iid", "left")
    out = out.select("iid", "y", "fold", "back", F.coalesce("v.at", F.array().cast("array<int>")).alias("at"), F.coalesce("v.x", F.array().cast("array<double>")).alias("x"))
    k = len(features)

    def dense(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), SLICE):
                f = frame.iloc[lo : lo + SLICE]
                x, sizes = np.zeros(len(f) * k), [len(a) for a in f["at"]]
                if sum(sizes):
                    cell = np.repeat(np.arange(len(f)), sizes) * k + np.concatenate(list(f["at"])).astype(int)
                    x = np.bincount(cell, np.concatenate(list(f["x"])).astype(float), len(x))
                x = x.reshape(len(f), k)
                bin_ = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.uint16) if k else np.zeros((len(f), 0), np.uint16)
                yield f[["iid", "y", "fold", "back"]].assign(bin=[r.tobytes() for r in bin_])

    return out.mapInPandas(dense, f"iid {dict(people.dtypes)['iid']}, y double, fold int, back boolean, bin binary")


def _matrix(f: pd.DataFrame) -> np.ndarray:
    """(people, features): bins, each feature's together."""
    return np.asfortranarray(np.frombuffer(b"".join(f["bin"]), np.uint16).reshape(len(f), -1))


def _leaf(x: np.ndarray, tree: tuple) -> np.ndarray:
    """The node of a tree that each person ends in."""
    feature, cut, _ = tree
    node = np.zeros(len(x), np.int32)
    for n in np.flatnonzero(feature >= 0):  # parents come before their children
        node = np.where(node == n, 2 * n + 1 + (x[:, feature[n]] > cut[n]), node)
    return node


class Histograms:
    """Sums by feature and bin of many columns at once: cells that people are in times what is summed, or, of very many cells, one by one."""

    def __init__(self, sizes: list[int], bins: int):
        self.k, self.bins, self.sizes = len(sizes), bins, np.array(sizes, int)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.cells = int(self.sizes.sum())
        self.place = np.concatenate([np.arange(n) + j * bins for j, n in enumerate(sizes)]) if sizes else np.zeros(0, int)

    def sums(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """(features times bins, columns of w)."""
        out = np.zeros((self.k * self.bins, w.shape[1]))
        if self.cells > MOST_CELLS:
            key = (x + np.arange(self.k) * self.bins).astype(int)
            for i in range(w.shape[1]):
                own = np.flatnonzero(w[:, i])
                out[:, i] = np.bincount(key[own].ravel(), np.repeat(w[own, i], self.k), len(out))
            return out
        for lo in range(0, len(x), SLICE):
            out[self.place] += self.inside(x[lo : lo + SLICE]).T @ w[lo : lo + SLICE]
        return out

    def inside(self, x: np.ndarray) -> np.ndarray:
        """(people, cells): 1 where a person is."""
        z = np.zeros((len(x), self.cells))
        z[np.arange(len(x))[:, None], x + self.first] = 1
        return z


def _scores(f: pd.DataFrame, x: np.ndarray, fits: list[Fit], since: int) -> np.ndarray:
    """(people, fits): what stands in the table and what the trees since then add."""
    base = np.frombuffer(b"".join(f["base"])).reshape(len(f), -1)[:, [t.number for t in fits]].copy()
    for i, t in enumerate(fits):
        for tree in t.trees[since:]:
            base[:, i] += tree[2][_leaf(x, tree)]
    return base


def best_split(histogram: np.ndarray, setting: Setting, allowed: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut after a bin, of sums (features, bins, 3: slopes, curvatures, people); ties: the first feature, the lowest bin."""
    left = np.cumsum(histogram, 1)
    whole = left[:1, -1:]
    right = whole - left
    score = lambda s: np.divide(s[..., 0] ** 2, s[..., 1] + setting.l2, out=np.zeros(s.shape[:-1]), where=s[..., 1] + setting.l2 > 0)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[..., 2] >= setting.least) & (right[..., 2] >= setting.least) & allowed[:, None], gain, -np.inf)
    at = int(gain.argmax())
    return float(gain.ravel()[at]), *divmod(at, gain.shape[1])


def _allowed(t: Fit, features: int) -> np.ndarray:
    if t.setting.columns >= 1:
        return np.ones(features, bool)
    drawn = np.random.Generator(np.random.Philox(key=[t.number, len(t.trees)])).permutation(features)[: int(np.ceil(t.setting.columns * features))]
    return np.isin(np.arange(features), drawn)


_SPLITS = "fit int, node int, feature int, bin int, gain double, slope double, curvature double, people double, left_slope double, left_curvature double, held_out double, first boolean, histogram binary"


def _level(data: DataFrame, many: bool, fits: list[Fit], since: int, growing: dict[int, tuple], wanted: dict[int, list[tuple[int, int]]], parents: DataFrame | None, sizes: list[int], bins: int) -> DataFrame:
    """Splits of the children of the parents, and their histograms. wanted: fit -> (parent, the smaller of its children); the root is its own."""
    k = len(sizes)
    plan = [t for t in fits if wanted.get(t.number)]
    allowed = {t.number: _allowed(t, k) for t in plan}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {(t.number, *w): np.zeros(k * bins * 3 + 1) for t in plan for w in wanted[t.number]}
        histograms = Histograms(sizes, bins)
        for f in frames:
            x, y = _matrix(f), f["y"].to_numpy(float)
            eta, fold, back = _scores(f, x, plan, since), f["fold"].to_numpy(), f["back"].to_numpy(bool)
            terms = []
            for i, t in enumerate(plan):
                own, p = fold != t.fold, 1 / (1 + np.exp(-eta[:, i]))
                kept = own & back if t.setting.patience else np.zeros(len(f), bool)
                node = _leaf(x, growing[t.number])
                for parent, child in wanted[t.number]:
                    here = (node == child) & own & ~kept
                    terms += [(p - y) * here, p * (1 - p) * here, here]
                    if parent == child and kept.any():
                        total[t.number, parent, child][-1] += (np.logaddexp(0, eta[kept, i]) - y[kept] * eta[kept, i]).sum()
            sums = histograms.sums(x, np.column_stack(terms).astype(float))
            for i, t in enumerate(total.values()):
                t[:-1] += sums[:, 3 * i : 3 * i + 3].ravel()
        yield pd.DataFrame({"fit": [a for a, _, _ in total], "parent": [b for _, b, _ in total], "node": [c for *_, c in total], "histogram": [s.tobytes() for s in total.values()]})

    def add(key, frame):
        return pd.DataFrame({"fit": [key[0]], "parent": [key[1]], "node": [frame["node"].iloc[0]], "histogram": [sum(np.frombuffer(b) for b in frame["histogram"]).tobytes()]})

    rules = {t.number: t.setting for t in plan}

    def split(key, frame):
        number, parent = map(int, key)
        setting = rules[number]
        own = frame[~frame["whole"]]
        node, sums = int(own["node"].iloc[0]), sum(np.frombuffer(b) for b in own["histogram"])
        found = [(node, sums)]
        if node != parent:
            whole = np.frombuffer(frame[frame["whole"]]["histogram"].iloc[0])
            found.append((4 * parent + 3 - node, whole - sums))  # the sibling: 2 p + 1 and 2 p + 2 sum to that
        rows = []
        for n, s in found:
            h = s[:-1].reshape(k, bins, 3)
            slope, curvature, people = h[0].sum(0)
            gain, feature, cut = best_split(h, setting, allowed[number])
            left = h[feature, : cut + 1].sum(0)
            first = bool(2 * left[2] <= people)  # the left child is the smaller
            rows.append((number, n, feature if gain > 1e-12 else -1, cut, gain if np.isfinite(gain) else 0.0, slope, curvature, people, left[0], left[1], s[-1], first, s.tobytes()))
        return pd.DataFrame(rows, columns=["fit", "node", "feature", "bin", "gain", "slope", "curvature", "people", "left_slope", "left_curvature", "held_out", "first", "histogram"])

    sums = data.mapInPandas(partial, "fit int, parent int, node int, histogram binary")
    if many:
        sums = sums.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES))).groupBy("fit", "parent", "lane").applyInPandas(add, "fit int, parent int, node int, histogram binary")
    sums = sums.withColumn("whole", F.lit(False))
    if parents is not None:
        split_ones = data.sparkSession.createDataFrame([(t.number, p) for t in plan for p, _ in wanted[t.number]], "fit int, node int")
        sums = sums.unionByName(parents.join(F.broadcast(split_ones), ["fit", "node"]).select("fit", F.col("node").alias("parent"), "node", "histogram", F.lit(True).alias("whole")))
    return written(sums.groupBy("fit", "parent").applyInPandas(split, _SPLITS), "splits")


def _round(data: DataFrame, many: bool, fits: list[Fit], since: int, sizes: list[int], bins: int) -> None:
    """One more tree for each fit that hasn't stopped."""
    growing = {t.number: t.blank() for t in fits}
    wanted, parents = {t.number: [(0, 0)] for t in fits}, None
    for depth in range(max(t.setting.depth for t in fits)):
        table = _level(data, many, fits, since, growing, wanted, parents, sizes, bins)
        released(parents)
        wanted, parents = {}, table
        found: dict[int, list] = {}
        for r in table.drop("histogram").collect():  # a row for each open node
            found.setdefault(r["fit"], []).append(r)
        for t in fits:
            feature, cut, value = growing[t.number]
            for r in found.get(t.number, []):
                n = r["node"]
                if n == 0:
                    value[0] = t.setting.leaf(r["slope"], r["curvature"])
                    t.losses.append(r["held_out"])
                if depth < t.setting.depth and r["feature"] >= 0:
                    feature[n], cut[n] = r["feature"], r["bin"]
                    value[2 * n + 1] = t.setting.leaf(r["left_slope"], r["left_curvature"])
                    value[2 * n + 2] = t.setting.leaf(r["slope"] - r["left_slope"], r["curvature"] - r["left_curvature"])
                    wanted.setdefault(t.number, []).append((n, 2 * n + (1 if r["first"] else 2)))
        if not wanted:
            break
    released(parents)
    for t in fits:
        t.trees.append(growing[t.number])
        if t.setting.patience and len(t.losses) > t.setting.patience and min(t.losses[-t.setting.patience :]) >= min(t.losses[: -t.setting.patience]) - 1e-7:
            t.stopped = True


def _with_scores(data: DataFrame, fits: list[Fit], since: int, width: int) -> DataFrame:
    """The people with the scores that all trees give by now."""

    def rescore(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new = np.frombuffer(b"".join(f["base"])).reshape(len(f), width).copy()
            new[:, [t.number for t in fits]] = _scores(f, _matrix(f), fits, since)
            yield f.assign(base=[r.tobytes() for r in new])

    return written(data.mapInPandas(rescore, data.schema), "scored")


@dataclass
class Boosted:
    """Fits with what they need to score people."""

    features: list[str]
    edges: list[np.ndarray]
    fits: list[Fit]

    def importance(self) -> dict[str, int]:
        """How many nodes split on each feature."""
        counts = dict.fromkeys(self.features, 0)
        for t in self.fits:
            for feature, _, _ in t.trees:
                for j in feature[feature >= 0]:
                    counts[self.features[j]] += 1
        return counts


def fit_boosted(rows: DataFrame, people: DataFrame, features: list[str], settings: list[Setting], iterations: list[int], folds: int = 3, bins: int = BINS) -> tuple[Boosted, DataFrame]:
    """The fits, and (rate, l2, iterations, auc, rounds): each setting's mean AUC over the folds left out, after each number of iterations.

    rows: (iid, feature, x), no row is 0; people: (iid, phenotype 1 or 2). Every setting is fitted without each fold (folds 0: once, on all people, and
    the AUC is theirs). Iterations ascend; a fit that stops early keeps its trees. rounds is the mean number of trees. All fits share the passes:
    one for each level of a tree. Ties between splits go to the first feature and the lowest cut, so reruns agree.
    """
    edges = column_edges(rows, features, bins)
    sizes = [len(e) + 1 for e in edges]
    bins = max(len(e) for e in edges) + 1 if edges else 1
    data = binned_people(rows, people, features, edges, folds)
    sides = range(folds) if folds else (-1,)
    fits = [Fit(i * len(sides) + j, s, fold) for i, s in enumerate(settings) for j, fold in enumerate(sides)]
    start = {r["fold"]: (r["n"], r["c"]) for r in data.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("c")).collect()}
    for t in fits:
        n, c = (sum(v[i] for fold, v in start.items() if fold != t.fold) for i in range(2))
        t.start = float(np.log(c / (n - c))) if 0 < c < n else 0.0
    base = np.array([t.start for t in fits]).tobytes()
    data = written(data.withColumn("base", F.lit(base)), "boosted")
    many = data.select(F.spark_partition_id().alias("task")).distinct().count() > LANES

    since, parts = 0, []
    for i in range(1, max(iterations) + 1):
        if left := [t for t in fits if not t.stopped]:
            _round(data, many, left, since, sizes, bins)
        if i % CUT == 0 or i in iterations:
            before, data, since = data, _with_scores(data, fits, since, len(fits)), i
            released(before)
            for t in fits:
                if len(t.trees) < i:  # one that has stopped has nothing to add from now on
                    t.trees += [t.blank()] * (i - len(t.trees))
        if i in iterations:
            parts += _aucs(data, fits, i)
    mean = {}
    for number, i, auc in parts:
        mean.setdefault((fits[number].setting, i), []).append((auc, sum(bool((t[0] >= 0).any()) for t in fits[number].trees[:i])))
    found = [(s.rate, s.l2, i, float(np.mean([a for a, _ in v])), float(np.mean([r for _, r in v]))) for (s, i), v in mean.items()]
    return Boosted(features, edges, fits), rows.sparkSession.createDataFrame(found, "rate double, l2 double, iterations int, auc double, rounds double")


def _aucs(data: DataFrame, fits: list[Fit], i: int) -> list[tuple[int, int, float]]:
    """AUC of each fit among the people it left out, or all if it left out nobody."""
    sides = [(t.number, t.fold) for t in fits]

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            base, fold = np.frombuffer(b"".join(f["base"])).reshape(len(f), -1), f["fold"].to_numpy()
            for number, side in sides:
                own = (fold == side) | (side < 0)
                yield pd.DataFrame({"fit": number, "y": f["y"].to_numpy()[own].astype(int), "score": base[own, number]}).astype({"fit": "int32"})

    return [(r["fit"], i, r["auc"]) for r in rank_auc(data.mapInPandas(held, "fit int, y long, score double"), "score", ["fit"]).collect()]  # one for each fit


def root_gains(rows: DataFrame, people: DataFrame, features: list[str], setting: Setting) -> DataFrame:
    """(feature, cut, gain): the best first split of each feature on its own, from the histogram of the root."""
    edges = column_edges(rows, features)
    bins = max(len(e) for e in edges) + 1
    data = binned_people(rows, people, features, edges, 0)
    n, c = data.agg(F.count("*"), F.sum("y")).head()
    t = Fit(0, setting, -1, float(np.log(c / (n - c))))
    data = written(data.withColumn("base", F.lit(np.array([t.start]).tobytes())), "boosted")
    table = _level(data, False, [t], 0, {0: t.blank()}, {0: [(0, 0)]}, None, [len(e) + 1 for e in edges], bins)

    def gains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b in f["histogram"]:
                h = np.frombuffer(b)[:-1].reshape(len(features), bins, 3)
                best = [best_split(h[j : j + 1], setting, np.ones(1, bool)) for j in range(len(features))]
                yield pd.DataFrame({"feature": features, "cut": [float(edges[j][cut]) if np.isfinite(g) else None for j, (g, _, cut) in enumerate(best)], "gain": [g if np.isfinite(g) else None for g, _, _ in best]})

    return table.select("histogram").mapInPandas(gains, "feature string, cut double, gain double")
