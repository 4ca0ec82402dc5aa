"""One forest for several labels: a split is chosen by its gain over all of them, a leaf has a share for each.

All trees grow together, a level in each pass over the people. A tree's sample is Poisson weights by a hash of person and tree, so nobody is copied
and who is out of a tree's sample is known wherever it is asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .boosting import BINS, LANES, _leaf, _matrix, binned_people, column_edges
from .resampling import poisson_weights

#: People laid out at once: their weights in all trees stay small, whatever a batch holds.
SLICE = 4096


@dataclass
class Forest:
    """Trees are arrays over the nodes of a full binary tree: feature (-1: leaf), bin, shares (nodes, labels), gains (nodes, labels)."""

    features: list[str]
    labels: list[str]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    data: DataFrame
    seed: int

    def importance(self) -> DataFrame:
        """(label, feature, importance): the share of a label's gain that splits on a feature have."""
        gain = np.zeros((len(self.features), len(self.labels)))
        for feature, _, _, gains in self.trees:
            inner = feature >= 0
            np.add.at(gain, feature[inner], gains[inner])
        share = gain / np.where(gain.sum(0) > 0, gain.sum(0), 1)
        rows = [(label, f, float(share[i, j])) for j, label in enumerate(self.labels) for i, f in enumerate(self.features)]
        return self.data.sparkSession.createDataFrame(rows, "label string, feature string, importance double")

    def votes(self) -> DataFrame:
        """(iid, tested, label, y, p, trees): mean shares of the trees that haven't learnt from the person; p is null where all have."""
        trees, labels, seed = self.trees, self.labels, self.seed

        def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x, tested = _matrix(f), f["tested"].to_numpy(bool)
                key, total, n = f["key"].to_numpy(np.int64), np.zeros((len(f), len(labels))), np.zeros(len(f), int)
                for lo in range(0, len(f), SLICE):
                    here = slice(lo, lo + SLICE)
                    weights = poisson_weights(key[here], np.arange(1, len(trees) + 1), seed)
                    for t, tree in enumerate(trees):
                        out = (weights[:, t] == 0) | tested[here]
                        total[here][out] += tree[2][_leaf(x[here], tree[:3])[out]]
                        n[here] += out
                y = np.array(list(f["ys"])).reshape(len(f), -1)
                for j, label in enumerate(labels):
                    yield pd.DataFrame({"iid": f["iid"], "tested": tested, "label": label, "y": y[:, j].astype(int), "p": np.where(n > 0, total[:, j] / np.maximum(n, 1), np.nan), "trees": n})

        out = self.data.mapInPandas(vote, f"iid {dict(self.data.dtypes)['iid']}, tested boolean, label string, y int, p double, trees int")
        return out.withColumn("p", F.when(F.col("trees") > 0, F.col("p")))


def _impurity(cases: np.ndarray, people: np.ndarray) -> np.ndarray:
    return 2 * cases * (1 - np.divide(cases, people, out=np.zeros_like(cases), where=people > 0))


def best_split(histogram: np.ndarray, allowed: np.ndarray, least: int) -> tuple[np.ndarray, int, int]:
    """(gain of each label, feature, bin) of the cut with the most gain over all labels, of sums (features, bins, labels + 1: cases, people); ties: the first feature, the lowest bin."""
    left = np.cumsum(histogram, 1)
    whole = left[:1, -1:]
    right = whole - left
    score = lambda s: _impurity(s[..., :-1], s[..., -1:])
    gain = score(whole) - score(left) - score(right)
    total = np.where((left[..., -1] >= least) & (right[..., -1] >= least) & allowed[:, None], gain.sum(-1), -np.inf)
    feature, cut = divmod(int(np.round(total, 9).argmax()), total.shape[1])
    return (gain[feature, cut] if np.isfinite(total[feature, cut]) else np.full(gain.shape[-1], -np.inf)), feature, cut


def drawn_columns(seed: int, tree: int, node: int, features: int) -> np.ndarray:
    """Which features a node may split on: the square root of them, drawn anew for each node."""
    drawn = np.random.Generator(np.random.Philox(key=[seed * 1_000_003 + tree, node])).permutation(features)[: int(np.ceil(np.sqrt(features)))]
    return np.isin(np.arange(features), drawn)


def fit_forest(rows: DataFrame, labels: DataFrame, features: list[str], trees: int = 100, depth: int = 6, least: int = 2, tested: Column | None = None, seed: int = 1, bins: int = BINS) -> Forest:
    """A forest of rows (iid, feature, x), no row is 0, for labels (iid, label, y of 0 or 1); a person without a row for a label hasn't it.

    Who is `tested`, a condition on iid, takes no part in the fit. least: people (by weight) in a leaf. A pass sums, for each tree and open node,
    cases of every label by bin of the features that the node has drawn; the driver gets the splits. Reruns agree.
    """
    names = sorted(r["label"] for r in labels.select("label").distinct().collect())
    edges = column_edges(rows, features, bins)
    bins = max(len(e) for e in edges) + 1
    wide = labels.groupBy("iid").pivot("label", names).agg(F.max(F.col("y").cast("double"))).fillna(0.0, names)
    marked = wide.select("iid", F.xxhash64("iid").alias("key"), F.array(*(F.col(f"`{n}`") for n in names)).alias("ys"), (F.lit(False) if tested is None else tested).alias("tested"))
    vectors = binned_people(rows, wide.select("iid", F.lit(1).alias("phenotype")), features, edges, 0).select("iid", "bin")
    data = written(marked.join(vectors, "iid"), "forest")
    many = data.select(F.spark_partition_id().alias("task")).distinct().count() > LANES
    size, k, n_labels = 2 ** (depth + 1) - 1, len(features), len(names)
    grown = [(np.full(size, -1), np.zeros(size, int), np.zeros((size, n_labels)), np.zeros((size, n_labels))) for _ in range(trees)]
    open_ = dict.fromkeys(range(trees), [0])
    for level in range(depth):
        found = _grow(data, many, grown, open_, bins, k, n_labels, least, seed)
        open_ = {}
        for r in found:
            feature, cut, shares, gains = grown[r["tree"]]
            n = r["node"]
            shares[n], left, right, gain = (np.frombuffer(r[c]) for c in ("here", "left", "right", "gains"))
            if r["feature"] >= 0:
                feature[n], cut[n], gains[n] = r["feature"], r["bin"], gain
                shares[2 * n + 1], shares[2 * n + 2] = left, right
                open_.setdefault(r["tree"], []).extend((2 * n + 1, 2 * n + 2))
        if not open_:
            break
    return Forest(features, names, grown, data, seed)


def _grow(data: DataFrame, many: bool, grown: list, open_: dict[int, list[int]], bins: int, k: int, n_labels: int, least: int, seed: int) -> list:
    """The splits of all open nodes."""
    width = n_labels + 1
    drawn = {t: np.stack([np.flatnonzero(drawn_columns(seed, t, n, k)) for n in nodes]) for t, nodes in open_.items()}  # (nodes, columns)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {t: np.zeros(drawn[t].size * bins * width) for t in open_}
        place = {t: np.full(len(grown[t][0]), -1) for t in open_}
        for t, nodes in open_.items():
            place[t][nodes] = np.arange(len(nodes))
        for frame in frames:
            frame = frame[~frame["tested"].to_numpy(bool)]
            for lo in range(0, len(frame), SLICE):
                f = frame.iloc[lo : lo + SLICE]
                x, cases = _matrix(f), np.array(list(f["ys"])).reshape(len(f), -1)
                weights = poisson_weights(f["key"].to_numpy(np.int64), np.arange(1, len(grown) + 1), seed)
                for t in open_:
                    at = place[t][_leaf(x, grown[t][:3])]
                    own = np.flatnonzero((weights[:, t] > 0) & (at >= 0))
                    columns = drawn[t][at[own]]
                    key = (at[own, None] * columns.shape[1] + np.arange(columns.shape[1])) * bins + x[own[:, None], columns]
                    w, y = weights[own, t].astype(float), cases[own]
                    for j in range(width):
                        some = np.flatnonzero(y[:, j]) if j < n_labels else slice(None)
                        each = w[some] * y[some, j] if j < n_labels else w
                        total[t][j::width] += np.bincount(key[some].ravel(), np.repeat(each, key.shape[1]), drawn[t].size * bins)
        yield pd.DataFrame({"tree": list(total), "sums": [s.tobytes() for s in total.values()]})

    def add(key, frame):
        return pd.DataFrame({"tree": [key[0]], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

    def split(key, frame):
        t, out = int(key[0]), []
        sums = sum(np.frombuffer(b) for b in frame["sums"]).reshape(*drawn[t].shape, bins, width)
        for n, columns, h in zip(open_[t], drawn[t], sums, strict=True):
            gains, best, cut = best_split(h, np.ones(len(columns), bool), least)
            feature, whole, left = int(columns[best]), h[0].sum(0), h[best, : cut + 1].sum(0)
            share = lambda s: (s[:-1] / max(s[-1], 1e-300)).tobytes()
            out.append((t, n, feature if gains.sum() > 1e-9 else -1, cut, gains.tobytes(), share(whole), share(left), share(whole - left)))
        return pd.DataFrame(out, columns=["tree", "node", "feature", "bin", "gains", "here", "left", "right"])

    sums = data.mapInPandas(partial, "tree int, sums binary")
    if many:
        sums = sums.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES))).groupBy("tree", "lane").applyInPandas(add, "tree int, sums binary")
    return sums.groupBy("tree").applyInPandas(split, "tree int, node int, feature int, bin int, gains binary, here binary, left binary, right binary").collect()


def report(forest: Forest) -> DataFrame:
    """(label, tested, n, auc and the numbers of evaluation.classification): on those tested, and on all others by the trees they aren't in."""
    from .evaluation import classification, rank_auc

    votes = written(forest.votes().filter("p is not null").withColumn("side", F.concat_ws("|", "label", F.col("tested").cast("string"))), "votes")
    found = votes.groupBy("side").agg(F.count("*").alias("n")).join(rank_auc(votes, "p", ["side"]), "side").join(classification(votes, by="side"), "side")
    return found.withColumn("label", F.substring_index("side", "|", 1)).withColumn("tested", F.substring_index("side", "|", -1) == "true").drop("side")
