"""Intervals by resampling, without a resampled row: weights are drawn from hashes where they are used, fits of all replicates share their passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if, ratio
from ..functions.stats import t_quantile
from ..sources.shared import written

#: People whose weights are laid out at once, and replicates; lanes in which partial sums meet first.
SLICE, BLOCK, LANES = 2048, 512, 64
#: Lots in which people who are alike are summed; people for each such row from which on it is worth it; people in a task.
SALT, FEW, PEOPLE = 8, 4, 100_000
#: A Poisson(1) weight for each of 65536 equal parts of a hash; the mean is right to 1e-4.
POISSON = np.searchsorted(np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(12)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def poisson_weights(key: np.ndarray, replicates: np.ndarray, seed: int = 1) -> np.ndarray:
    """(people, replicates): how often each person is drawn in each replicate, by a hash of both; once in replicate 0."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (replicates.astype(np.uint64) + np.uint64(seed) * np.uint64(1 << 32))[None] * np.uint64(0xC2B2AE3D27D4EB4F)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    out = POISSON[(x >> np.uint64(48)).astype(np.intp)]
    out[:, replicates == 0] = 1
    return out


@dataclass
class Statistic:
    """A function of weighted sums of terms. value takes the sums by name, as columns."""

    terms: dict[str, Column]
    value: Callable[[dict[str, Column]], Column]


def _case(p: str = "p") -> tuple[Column, Column]:
    return F.col("y") * F.col(p), (1 - F.col("y")) * F.col(p)


def tjur() -> Statistic:
    """Mean probability of cases less that of controls."""
    up, down = _case()
    return Statistic({"c": F.col("y"), "d": 1 - F.col("y"), "up": up, "down": down}, lambda s: s["up"] / s["c"] - s["down"] / s["d"])


def discrimination_gain(first: str, second: str) -> Statistic:
    """Integrated discrimination of second over first."""
    (a, b), (c, d) = _case(first), _case(second)
    return Statistic({"c": F.col("y"), "d": 1 - F.col("y"), "up1": a, "down1": b, "up2": c, "down2": d}, lambda s: (s["up2"] - s["up1"]) / s["c"] - (s["down2"] - s["down1"]) / s["d"])


def nagelkerke() -> Statistic:
    """Nagelkerke's R-squared of given probabilities."""
    q = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))

    def value(s: dict[str, Column]) -> Column:
        r = s["c"] / s["n"]
        ll0 = s["n"] * (r * F.log(r) + (1 - r) * F.log(1 - r))
        return (1 - F.exp(2 * (ll0 - s["ll"]) / s["n"])) / (1 - F.exp(2 * ll0 / s["n"]))

    return Statistic({"n": F.lit(1), "c": F.col("y"), "ll": F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))}, value)


def bootstrap(rows: DataFrame, statistic: Statistic, replicates: int, by: str = "model", seed: int = 1) -> DataFrame:
    """(by, estimate, mean, se, ci_low, ci_high): a statistic with its bootstrap mean, error and 95 % percentile interval.

    rows: iid, by and what the terms use. No row is repeated: a task multiplies its terms by the weights of all replicates and gives one row of
    sums for each group and replicate. Weights are Poisson(1) by a hash of person and replicate, the same for all groups.
    """
    names = list(statistic.terms)
    data = rows.select(by, F.xxhash64("iid").alias("__key"), *(c.cast("double").alias(f"__{n}") for n, c in statistic.terms.items()))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for frame in frames:
            for group, f in frame.groupby(by, sort=False, dropna=False):
                t = total.setdefault(group, np.zeros((replicates + 1, len(names))))
                for lo in range(0, len(f), SLICE):
                    part = f.iloc[lo : lo + SLICE]
                    key, terms = part["__key"].to_numpy(np.int64), part[[f"__{n}" for n in names]].to_numpy(float)
                    for r in range(0, replicates + 1, BLOCK):
                        some = np.arange(r, min(replicates + 1, r + BLOCK))
                        t[some] += poisson_weights(key, some, seed).T.astype(float) @ terms
        for group, t in total.items():
            yield pd.DataFrame({by: group, "replicate": range(replicates + 1)} | {n: t[:, i] for i, n in enumerate(names)})

    kind = dict(rows.dtypes)[by]
    each = data.mapInPandas(sums, f"`{by}` {kind}, replicate int, " + ", ".join(f"{n} double" for n in names)).groupBy(by, "replicate").agg(*(F.sum(n).alias(n) for n in names))
    each = each.select(by, "replicate", statistic.value({n: F.col(n) for n in names}).alias("value"))
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    return each.groupBy(by).agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"), F.avg(drawn).alias("mean"), F.stddev_samp(drawn).alias("se"), F.percentile(drawn, F.lit(0.025)).alias("ci_low"), F.percentile(drawn, F.lit(0.975)).alias("ci_high"))


# Refits: logistic models on few columns, of all replicates and of all people but one group, together.


def _added(sums: DataFrame, many: bool) -> DataFrame:
    """(model, sums) added over tasks, in lanes first where there are many."""

    def add(key, frame):
        return pd.DataFrame({"model": [key[0]], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

    if many:
        sums = sums.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES))).groupBy("model", "lane").applyInPandas(add, "model string, sums binary")
    return sums.groupBy("model").applyInPandas(add, "model string, sums binary")


#: Sums of a fit that come before slopes and curvatures.
_PLAIN = ("n", "c", "ll", "up", "down")


def _fit_weights(key: np.ndarray, fits: np.ndarray, drawn: int, groups: int, seed: int) -> np.ndarray:
    """(people, fits): each person's weight in some of the fits; those from `drawn` on leave out a group each."""
    w = poisson_weights(key, fits, seed)
    left_out = fits >= drawn
    if left_out.any():
        w[:, left_out] = (key[:, None] % max(groups, 1)) != (fits[left_out] - drawn)[None]
    return w


def _alike(data: DataFrame, columns: list[str], drawn: int, groups: int, seed: int) -> DataFrame:
    """(model, y, columns, weights): people of a model with equal y and columns as one row with the sums of their weights in all fits.

    Sums are whole numbers, so fits are those of the people. Many that are alike are dealt by a hash of the person too, and summed in stretches of a sorted
    task; a row for each stretch. Where there would be less than FEW people to a row they stay as they are: the weights of all fits are long.
    """
    own, n = ["model", "y", *columns], data.count()
    lot = F.pmod("key", F.lit(SALT)).alias("lot")
    if data.groupBy(*own, lot).agg(F.count("*").alias("n")).count() * FEW > n:
        return data
    every = np.arange(drawn + groups)

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), SLICE):
                part = frame.iloc[lo : lo + SLICE]
                new = (part[own] != part[own].shift()).any(axis=1).to_numpy()
                new[0] = True
                first, key = np.flatnonzero(new), part["key"].to_numpy(np.int64)
                w = np.concatenate([np.add.reduceat(_fit_weights(key, every[r : r + BLOCK], drawn, groups, seed), first, axis=0, dtype=np.uint32) for r in range(0, len(every), BLOCK)], 1)
                yield part[own].iloc[first].assign(weights=[x.tobytes() for x in w])

    tasks = max(2 * data.sparkSession.sparkContext.defaultParallelism, n // PEOPLE + 1)
    kinds = ", ".join(f"`{c}` double" for c in columns)
    return written(data.select(*own, "key").repartition(tasks, *own, lot).sortWithinPartitions(*own).mapInPandas(stretches, f"model string, y double, {kinds}, weights binary"), "alike")


def _refit_pass(data: DataFrame, many: bool, columns: list[str], betas: dict[str, np.ndarray], means: dict, scales: dict, groups: int, seed: int) -> dict[str, np.ndarray]:
    """Model -> (fits, sums): weighted sums of all fits where they stand. Fits: all people, the replicates, all people but one group."""
    k, fits = len(columns) + 1, len(next(iter(betas.values())))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if "weights" in data.columns:
        weights = lambda part, some: np.frombuffer(b"".join(part["weights"]), np.uint32).reshape(len(part), -1)[:, some]
    else:
        weights = lambda part, some: _fit_weights(part["key"].to_numpy(np.int64), some, fits - groups, groups, seed)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for model, f in frame.groupby("model", sort=False):
                t = total.setdefault(model, np.zeros((fits, len(_PLAIN) + k + len(pairs))))
                for lo in range(0, len(f), SLICE):
                    part = f.iloc[lo : lo + SLICE]
                    y = part["y"].to_numpy(float)[:, None]
                    x = np.column_stack([(part[columns].to_numpy(float) - means[model]) * scales[model], np.ones(len(part))])
                    cross = np.column_stack([x[:, i] * x[:, j] for i, j in pairs])
                    for r in range(0, fits, BLOCK):
                        some = np.arange(r, min(fits, r + BLOCK))
                        w = weights(part, some).astype(float)
                        eta = x @ betas[model][some].T
                        p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                        wy = w * y
                        t[some, 0] += w.sum(0)
                        t[some, 1] += wy.sum(0)
                        t[some, 2] += (wy * eta - w * np.logaddexp(0, eta)).sum(0)
                        t[some, 3] += (wy * p).sum(0)
                        t[some, 4] += ((w - wy) * p).sum(0)
                        t[some, 5 : 5 + k] += (wy - w * p).T @ x
                        t[some, 5 + k :] += (w * p * (1 - p)).T @ cross
        yield pd.DataFrame({"model": list(total), "sums": [t.tobytes() for t in total.values()]})

    added = _added(data.mapInPandas(sums, "model string, sums binary"), many)
    return {r["model"]: np.frombuffer(r["sums"]).reshape(fits, -1) for r in added.collect()}  # one row of fixed size for each model


def _newton(t: np.ndarray, k: int) -> np.ndarray:
    slope, packed = t[:, 5 : 5 + k], t[:, 5 + k :]
    h = np.zeros((len(t), k, k))
    i, j = np.triu_indices(k)
    h[:, i, j] = h[:, j, i] = packed
    n = np.maximum(t[:, :1, None], 1.0)
    return np.linalg.solve(h / n + 1e-12 * np.eye(k), (slope / n[:, 0])[:, :, None])[:, :, 0]


def r_squared(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nagelkerke's and Tjur's R-squared of fits from their sums."""
    n, c, ll, up, down = t[:, :5].T
    r = c / n
    with np.errstate(divide="ignore", invalid="ignore"):
        ll0 = c * np.log(r) + (n - c) * np.log(1 - r)
        return (1 - np.exp(2 * (ll0 - ll) / n)) / (1 - np.exp(2 * ll0 / n)), up / c - down / (n - c)


def bca(estimate: float, drawn: np.ndarray, left_out: np.ndarray, level: float = 0.95) -> tuple[float, float, float, float]:
    """(low, high, bias correction, acceleration): bias-corrected and accelerated bounds from replicates and from the values without one group.

    Bounds are order statistics of the replicates, between two of them by line.
    """
    normal, drawn = NormalDist(), np.sort(drawn)
    share = (drawn < estimate).mean() + (drawn == estimate).mean() / 2
    bias = normal.inv_cdf(min(max(share, 0.5 / len(drawn)), 1 - 0.5 / len(drawn)))
    gap = left_out.mean() - left_out
    spread = (gap**2).sum() ** 1.5
    speed = float((gap**3).sum() / (6 * spread)) if spread > 0 else 0.0
    out = []
    for tail in ((1 - level) / 2, (1 + level) / 2):
        z = bias + normal.inv_cdf(tail)
        at = normal.cdf(bias + z / (1 - speed * z)) * (len(drawn) + 1) - 1
        out.append(float(np.interp(at, np.arange(len(drawn)), drawn)))
    return *out, float(bias), speed


def refit_r2(rows: DataFrame, columns: list[str], replicates: int = 2000, groups: int = 100, seed: int = 1, level: float = 0.95, most_steps: int = 30) -> DataFrame:
    """(model, n, nagelkerke, nagelkerke_se, nagelkerke_low, nagelkerke_high, tjur, tjur_se, tjur_low, tjur_high, replicates) of logistic models that
    are fitted anew in every replicate, with bias-corrected and accelerated bounds; the acceleration is from fits without one of `groups` groups.

    rows: (iid, model, y, columns); people with a null among these don't count. All fits of all models take Newton steps in the same passes over the
    people: a pass gives sums of fixed size for each fit. People who are alike are one row with the weights of all, where there are many. Without replicates there are no bounds, and errors are null. The models' columns are few.
    """
    data = written(rows.select("model", F.col("y").cast("double").alias("y"), F.xxhash64("iid").alias("key"), *(F.col(c).cast("double").alias(c) for c in columns)).na.drop(), "refit")
    stats = data.groupBy("model").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{name}") for c in columns for name, f in (("m", F.avg), ("s", F.stddev_pop)))).collect()
    means = {r["model"]: np.array([r[f"{c}_m"] for c in columns]) for r in stats}
    scales = {r["model"]: np.array([1 / r[f"{c}_s"] if r[f"{c}_s"] else 0.0 for c in columns]) for r in stats}
    if replicates:
        data = _alike(data, columns, 1 + replicates, groups, seed)
    many = data.select(F.spark_partition_id().alias("task")).distinct().count() > LANES
    k, fitted = len(columns) + 1, {}
    for fits, left in ((1, 0), (1 + replicates + groups * (replicates > 0), groups * (replicates > 0))):  # the people themselves, then all from there
        betas = {m: np.repeat(fitted[m][None], fits, 0) if m in fitted else np.zeros((fits, k)) for m in means}
        for _ in range(most_steps):
            sums = _refit_pass(data, many, columns, betas, means, scales, left, seed) if betas else {}
            steps = {m: _newton(t, k) for m, t in sums.items()}
            betas = {m: betas[m] + steps[m] for m in betas}
            if all(np.abs(s).max() < 1e-6 for s in steps.values()):  # the step after that is below 1e-12
                break
        fitted = {m: b[0] for m, b in betas.items()}
    out = []
    for r in stats:
        line = [r["model"], r["n"]]
        for values in r_squared(sums[r["model"]]):
            drawn, without = values[1 : 1 + replicates], values[1 + replicates :]
            bounds = bca(float(values[0]), drawn, without, level)[:2] if replicates else (None, None)
            line += [float(values[0]), float(drawn.std(ddof=1)) if replicates > 1 else None, *bounds]
        out.append((*line, replicates))
    names = ", ".join(f"{s}{x} double" for s in ("nagelkerke", "tjur") for x in ("", "_se", "_low", "_high"))
    return rows.sparkSession.createDataFrame(out, f"model string, n long, {names}, replicates int")


# Prevalence by bins.


def _generator(*key) -> np.random.Generator:
    """A generator of its own for each key, so that reruns agree wherever they run."""
    import zlib

    return np.random.Generator(np.random.Philox(key=zlib.crc32("|".join(map(str, key)).encode())))


def bootstrap_prevalence(binned: DataFrame, groups: int, n_bins: int, replicates: int = 1000, by: str = "model", least: int = 10, seed: int = 1) -> DataFrame:
    """(by, grp, n, cases, prevalence, ci_low, ci_high): prevalence on bins regrouped into fewer, with 95 % percentile bounds by bootstrap.

    To draw n people with replacement out of n with so many cases is to draw a number of cases from a binomial, so counts are resampled, not people.
    Groups of at most `least` people get no bounds but the value itself.
    """
    from .epidemiology import is_case

    grouped = binned.withColumn("grp", F.ceil(F.col("bin") * groups / F.lit(n_bins)).cast("int"))
    counts = grouped.groupBy(by, "grp").agg(F.count("*").alias("n"), count_if(is_case()).alias("cases")).withColumn("prevalence", ratio(F.col("cases"), F.col("n")))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bounds = [
                np.quantile(_generator(seed, *key).binomial(n, p, replicates) / n, [0.025, 0.975]) if n > least else (p, p)
                for key, n, p in zip(f[[by, "grp"]].itertuples(index=False), f["n"], f["prevalence"], strict=True)
            ]
            yield f.assign(ci_low=[b[0] for b in bounds], ci_high=[b[1] for b in bounds])

    return counts.mapInPandas(draw, f"`{by}` {dict(binned.dtypes)[by]}, grp int, n long, cases long, prevalence double, ci_low double, ci_high double")


def mean_prevalence(binned: DataFrame, replicates: int = 10_000, by: str = "model", level: float = 0.95, seed: int = 1) -> DataFrame:
    """(by, bins, mean_rate, boot_low, boot_high, t_low, t_high): the mean over bins of their prevalence, bounds by bootstrap of the bins and by Student's t.

    How often each rate is drawn is multinomial; equal rates are drawn together, by chained binomials, so a replicate costs as many draws as
    there are different rates. Nothing is larger than the bins.
    """
    from .epidemiology import is_case

    per = binned.groupBy(by, "bin").agg(F.avg(is_case().cast("double")).alias("rate")).groupBy(by, "rate").agg(F.count("*").alias("times"))
    listed = per.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rate", "times"))).alias("rates"))  # as long as there are bins

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, rates in f.itertuples(index=False):
                x, times = np.array([r["rate"] for r in rates]), np.array([r["times"] for r in rates])
                n, g = int(times.sum()), _generator(seed, name)
                mean = float(x @ times / n)
                drawn = np.zeros(replicates)
                left, share = np.full(replicates, n), 1.0
                for rate, k in zip(x, times / n, strict=True):
                    m = g.binomial(left, min(1.0, k / share) if share > 0 else 1.0)
                    drawn += m * rate
                    left, share = left - m, share - k
                half = t_quantile((1 + level) / 2, n - 1) * math.sqrt(float(times @ (x - mean) ** 2) / (n - 1) / n) if n > 1 else math.nan
                rows.append((name, n, mean, *np.quantile(drawn / n, [(1 - level) / 2, (1 + level) / 2]), mean - half, mean + half))
            yield pd.DataFrame(rows, columns=[by, "bins", "mean_rate", "boot_low", "boot_high", "t_low", "t_high"])

    return listed.mapInPandas(draw, f"`{by}` {dict(binned.dtypes)[by]}, bins long, mean_rate double, boot_low double, boot_high double, t_low double, t_high double")
