"""Shapley contributions of tree models: exact, by the share of training rows that a branch saw (path-dependent)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(model) -> list[list[tuple]]:
    """Trees as rows (feature or -1, threshold, left, right, value, cover), scaled by the trees' weights."""
    weights = list(getattr(model, "treeWeights", [1.0] * len(model.trees)))
    classes = hasattr(model, "numClasses") and not hasattr(model, "getMaxIter")
    out = []
    for tree, weight in zip(model.trees, weights, strict=True):
        rows: list = []

        def walk(node) -> int:
            at = len(rows)
            rows.append(None)
            stats = list(node.impurityStats().stats())
            value = (stats[1] / max(sum(stats[:2]), 1e-12) if classes else node.prediction()) * weight
            cover = float(node.impurityStats().count())
            if node.subtreeDepth() == 0:
                rows[at] = (-1, 0.0, -1, -1, float(value), cover)
            else:
                split = node.split()
                rows[at] = (int(split.featureIndex()), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()), float(value), cover)
            return at

        walk(tree._call_java("rootNode"))
        out.append(rows)
    return out


def contributions(tree: list[tuple], x: np.ndarray, n_features: int) -> np.ndarray:
    """phi by weights of subset sizes, kept along the path and undone where a feature comes again."""
    phi = np.zeros(n_features)

    def extend(path, zero, one, feature):
        w = [p[3] for p in path] + [1.0 if not path else 0.0]
        n = len(path)
        for i in range(n - 1, -1, -1):
            w[i + 1] += one * w[i] * (i + 1) / (n + 1)
            w[i] *= zero * (n - i) / (n + 1)
        return [(*p[:3], v) for p, v in zip([*path, (feature, zero, one)], w, strict=True)]

    def unwind(path, i):
        n, (_, zero, one, _) = len(path) - 1, path[i]
        w, carry = [p[3] for p in path], path[n][3]
        for j in range(n - 1, -1, -1):
            if one:
                kept = w[j]
                w[j] = carry * (n + 1) / ((j + 1) * one)
                carry = kept - w[j] * zero * (n - j) / (n + 1)
            else:
                w[j] = w[j] * (n + 1) / (zero * (n - j))
        rest = [p[:3] for k, p in enumerate(path) if k != i]
        return [(*p, v) for p, v in zip(rest, w[:n], strict=True)]

    def walk(at, path, zero, one, feature):
        path = extend(path, zero, one, feature)
        split, threshold, left, right, value, cover = tree[at]
        if split < 0:
            for i in range(1, len(path)):
                f, z, o, _ = path[i]
                phi[f] += sum(p[3] for p in unwind(path, i)) * (o - z) * value
            return
        hot, cold = (left, right) if x[split] <= threshold else (right, left)
        z, o = 1.0, 1.0
        for i in range(1, len(path)):
            if path[i][0] == split:
                z, o = path[i][1], path[i][2]
                path = unwind(path, i)
                break
        walk(hot, path, z * tree[hot][5] / cover, o, split)
        walk(cold, path, z * tree[cold][5] / cover, 0.0, split)

    walk(0, [], 1.0, 1.0, -1)
    return phi


#: Ways through the splits of one tree whose contributions a task keeps.
MOST_KNOWN = 20_000


def tree_shap(model, data: DataFrame, features: list[str]) -> DataFrame:
    """(iid, feature, shap) of a fitted forest or boosted model for rows (iid, features vector)."""
    trees = flatten(model)
    share = 1.0 if hasattr(model, "getMaxIter") else 1.0 / sum(getattr(model, "treeWeights", [1.0] * len(trees)))

    def explain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[dict[bytes, np.ndarray]] = [{} for _ in trees]  # a tree's contributions depend on the sides of its splits only
        for frame in frames:
            x, phis = np.stack(frame["x"].to_list()), np.zeros((len(frame), len(features)))
            for tree, seen in zip(trees, known, strict=True):
                splits = [(r[0], r[1]) for r in tree if r[0] >= 0]
                sides, of = np.unique(np.stack([x[:, f] <= t for f, t in splits], 1) if splits else np.zeros((len(x), 1), bool), axis=0, return_inverse=True)
                first = np.zeros(len(sides), np.int64)
                first[of.ravel()] = np.arange(len(x))
                if len(seen) + len(sides) > MOST_KNOWN:
                    seen.clear()
                for side, row in zip(sides, first.tolist(), strict=True):
                    if side.tobytes() not in seen:
                        seen[side.tobytes()] = contributions(tree, x[row], len(features))
                phis += np.stack([seen[side.tobytes()] for side in sides])[of.ravel()]
            yield pd.DataFrame({"iid": np.repeat(frame["iid"].to_numpy(), len(features)), "feature": features * len(frame), "shap": (phis * share).ravel()})

    return data.select("iid", vector_to_array("features").alias("x")).mapInPandas(explain, "iid long, feature string, shap double")


def expected(tree: list[tuple]) -> float:
    """Mean value over the tree's leaves by cover."""
    leaves = [(r[4], r[5]) for r in tree if r[0] < 0]
    return sum(v * c for v, c in leaves) / sum(c for _, c in leaves)


def mean_shap(contribution: DataFrame) -> DataFrame:
    return contribution.groupBy("feature").agg(F.avg("shap").alias("mean_shap"))
