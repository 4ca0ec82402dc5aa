"""Shapley contributions of any model, by permutations of its features against a background, for models that aren't trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many features all coalitions are looked at, and contributions are exact; bounds of what a task scores at once.
EXACT, SCORED = 8, 1 << 20


def coalitions(k: int, pairs: int, seed: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """(coalitions, features) of booleans, and for each pair of permutations a matrix that turns their values into contributions.

    With few features there is one matrix, of the exact weights. Else a permutation goes with its reverse; what several pass through
    is scored once.
    """
    known: dict[bytes, int] = {}
    rows: list[np.ndarray] = []

    def number(s: np.ndarray) -> int:
        if s.tobytes() not in known:
            known[s.tobytes()] = len(rows)
            rows.append(s.copy())
        return known[s.tobytes()]

    steps: list[list[tuple[int, int, int, float]]] = []  # feature, coalition without it, with it, weight
    if k <= EXACT:
        exact = []
        for size in range(k):
            for chosen in combinations(range(k), size):
                s = np.isin(np.arange(k), chosen)
                for j in np.flatnonzero(~s):
                    more = s.copy()
                    more[j] = True
                    exact.append((int(j), number(s), number(more), 1 / (k * comb(k - 1, size))))
        steps.append(exact)
    else:
        draw = np.random.Generator(np.random.Philox(key=seed))
        for _ in range(pairs):
            order, own = draw.permutation(k), []
            for way in (order, order[::-1]):
                s = np.zeros(k, bool)
                for j in way:
                    before = number(s)
                    s[j] = True
                    own.append((int(j), before, number(s), 0.5))
            steps.append(own)
    out = []
    for own in steps:
        w = np.zeros((k, len(rows)))
        for j, a, b, x in own:
            w[j, b] += x
            w[j, a] -= x
        out.append(w)
    return np.array(rows).reshape(-1, k), out


def explain(score: Callable[[np.ndarray], np.ndarray], x: np.ndarray, background: np.ndarray, inside: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(contributions, errors) of rows: a coalition's value is the mean score with the row's features in it and the others of each background row."""
    values = np.empty((len(x), len(inside)))
    step = max(1, SCORED // max(1, len(x) * len(background)))
    for at in range(0, len(inside), step):
        s = inside[at : at + step]
        mixed = np.where(s[None, :, None, :], x[:, None, None, :], background[None, None])
        values[:, at : at + step] = score(mixed.reshape(-1, x.shape[1])).reshape(len(x), len(s), len(background)).mean(2)
    each = np.stack([values @ w.T for w in weights])
    error = each.std(0, ddof=1) / np.sqrt(len(weights)) if len(weights) > 1 else np.zeros(each.shape[1:])
    return each.mean(0), error


def permutation_shap(score: Callable[[np.ndarray], np.ndarray], rows: DataFrame, features: list[str], background: DataFrame, pairs: int = 20, key: str = "iid", seed: int = 1) -> DataFrame:
    """(key, feature, shap, error) of a model, score(matrix) -> one number a row, for rows with a column for each feature.

    background: some rows of the same kind, a bounded sample that the caller chooses; a feature that isn't in a coalition has its values.
    Contributions add up to the score less the mean score of the background. Up to eight features they are exact and errors are 0; beyond, errors
    are those of the mean over pairs of permutations. Rows with a null feature are left out. Nothing is shuffled.
    """
    base = np.array([list(r) for r in background.select(*features).na.drop().collect()], float).reshape(-1, len(features))
    if not len(base):
        raise ValueError("no background")
    inside, weights = coalitions(len(features), pairs, seed)
    few = max(1, SCORED // (len(base) * 8))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), few):
                f = frame.iloc[lo : lo + few]
                phi, error = explain(score, f[features].to_numpy(float), base, inside, weights)
                yield pd.DataFrame({key: np.repeat(f[key].to_numpy(), len(features)), "feature": features * len(f), "shap": phi.ravel(), "error": error.ravel()})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, *(F.col(c).cast("double").alias(c) for c in features)).na.drop().mapInPandas(run, f"`{key}` {kind}, feature string, shap double, error double")
