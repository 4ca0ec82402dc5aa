"""Imputation by the exact nearest neighbours, found in cells around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Pivots at most; the number grows with the square root of the points that can be neighbours. What a task holds of them is bounded.
MOST_PIVOTS = 4096
#: Distances of rows to pivots that a task lays out at once.
CELLS = 1 << 19


def _numbers(df: DataFrame, features: list[str]) -> list[Column]:
    return [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]


def _distance(features: list[str]) -> Column:
    return F.sqrt(sum(((F.col(f"f{i}") - F.col(f"g{i}")) * (F.col(f"f{i}") - F.col(f"g{i}")) for i in range(len(features))), F.lit(0.0)))


def _parts(frames: Iterator[pd.DataFrame], pivots: int) -> Iterator[pd.DataFrame]:
    """The frames in parts of so many rows that their distances to all pivots are at most CELLS."""
    step = max(1, CELLS // max(pivots, 1))
    for f in frames:
        for lo in range(0, len(f), step):
            yield f.iloc[lo : lo + step]


def _to_pivots(f: pd.DataFrame, pivots: np.ndarray) -> np.ndarray:
    x = f[[f"f{i}" for i in range(pivots.shape[1])]].to_numpy(float)
    return np.sqrt(sum((x[:, None, i] - pivots[None, :, i]) ** 2 for i in range(pivots.shape[1])))


def _best(met: DataFrame, k: int, key: str) -> DataFrame:
    """The k nearest of each, points that stand for several counted as often: (key, d, t, n); equal distances by the value."""
    order = Window.partitionBy(key).orderBy("d", "t")
    before = met.withColumn("ahead", F.sum("n").over(order) - F.col("n"))
    return before.filter(F.col("ahead") < k).select(key, "d", "t", F.least("n", k - F.col("ahead")).alias("n"))


def nearest_means(known: DataFrame, asked: DataFrame, target: str, features: list[str], k: int = 5, key: str = "iid") -> DataFrame:
    """(key, fill): for each row that is asked for the mean target of its k nearest known rows (all, if there are fewer), by Euclidean distance.

    Rows of known with a null target or feature are no neighbours; asked rows with a null feature get no mean. Of neighbours at the same
    distance those with the lowest targets come first. Equal points are one with a count, so a point that many share meets each row once.

    Known points go to the cell of their nearest pivot. A row first looks into the cells nearest to it until they hold k rows; the distance of
    the k-th bounds the rest: by the triangle inequality a cell whose pivot is further than that bound and the cell's radius together has
    nothing nearer, nor has a point whose distance to its pivot differs from the row's by more. Only rows whose bound crosses such a border look on.
    """
    spark, names = known.sparkSession, [f"f{i}" for i in range(len(features))]
    points = known.select(F.col(target).cast("double").alias("t"), *_numbers(known, features)).na.drop().groupBy("t", *names).agg(F.count("*").alias("n"))
    points = written(points, "points")
    total = points.count()
    rows = asked.select(F.col(key).alias("key"), *_numbers(asked, features)).na.drop()
    if not total:
        return rows.limit(0).select(F.col("key").alias(key), F.lit(0.0).alias("fill"))
    wanted = min(MOST_PIVOTS, max(1, int(np.sqrt(total))))
    drawn = points.select(*names).distinct().orderBy(F.xxhash64(*names)).limit(wanted).collect()  # MOST_PIVOTS rows at most
    pivots = np.array([list(r) for r in drawn], float).reshape(-1, len(features))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _parts(frames, len(pivots)):
            d = _to_pivots(f, pivots)
            yield f.assign(cell=d.argmin(1).astype(np.int32), r=d.min(1))

    kinds = ", ".join(f"{x} double" for x in names)
    placed = written(points.mapInPandas(place, f"t double, {kinds}, n long, cell int, r double"), "cells")
    sizes, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in placed.groupBy("cell").agg(F.sum("n").alias("n"), F.max("r").alias("r")).collect():  # one for each pivot
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]

    def look(first: bool):
        def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _parts(frames, len(pivots)):
                d = _to_pivots(f, pivots)
                order = np.argsort(d, 1, kind="stable")
                held = np.cumsum(sizes[order], 1)
                taken = held - sizes[order] < k  # the cells of the first look, in the order of distance
                for i in range(len(f)):
                    near = order[i][taken[i]]
                    if not first:
                        open_ = np.flatnonzero((sizes > 0) & (d[i] - radius <= f["bound"].iloc[i] * (1 + 1e-9) + 1e-12))
                        near = np.setdiff1d(open_, near)
                    if len(near):
                        yield pd.DataFrame({c: f[c].iloc[i] for c in f.columns} | {"cell": near.astype(np.int32), "away": d[i][near]})

        return cells

    kind = dict(rows.dtypes)["key"]
    bare = placed.select("cell", "t", "n", "r", *(F.col(f"f{i}").alias(f"g{i}") for i in range(len(features))))
    schema = f"key {kind}, {kinds}"
    once = written(rows.mapInPandas(look(True), f"{schema}, cell int, away double").join(bare, "cell").select("key", _distance(features).alias("d"), "t", "n").transform(lambda x: _best(x, k, "key")), "nearest")
    bound = once.groupBy("key").agg(F.when(F.sum("n") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    more = rows.join(bound, "key").mapInPandas(look(False), f"{schema}, bound double, cell int, away double").join(bare, "cell")
    more = more.filter(F.abs(F.col("away") - F.col("r")) <= F.col("bound") * (1 + 1e-9) + 1e-12).select("key", _distance(features).alias("d"), "t", "n")
    best = _best(once.unionByName(more), k, "key")
    return best.groupBy("key").agg((F.sum(F.col("t") * F.col("n")) / F.sum("n")).alias("fill")).withColumnRenamed("key", key)


def knn_impute(train: DataFrame, rows: DataFrame, target: str, features: list[str], k: int = 5, key: str = "iid") -> DataFrame:
    """rows with null targets filled by the mean of their k nearest training rows; see nearest_means."""
    means = nearest_means(train, rows.filter(F.col(target).isNull()), target, features, k, key).withColumnRenamed("fill", "__fill")
    return rows.join(means, key, "left").withColumn(target, F.coalesce(target, "__fill")).drop("__fill")
