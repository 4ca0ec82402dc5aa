"""L1 logistic regression with a penalty of its own for each feature: paths of penalties, cross-validated, of many feature sets at once.

Every person is one vector, written with others as a block. A pass over the blocks gives, for each set and each fold, slopes of all features and curvatures of the active ones
(those that aren't zero, those that ought not to be, and the free ones); a proximal Newton step follows from these sums alone. The fits of all sets and
folds share the passes, and each goes on to its next penalty, from where it stands, as soon as it has met the conditions of the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Features of all sets together; a person's vector has one number for each.
MOST_FEATURES = 3000
#: People whose vectors are laid out at once; lanes in which partial sums meet before they meet each other.
SLICE, LANES = 1024, 64
#: Steps under one penalty with curvatures that the folds of a set share.
SHARED_TRIES = 8
INTERCEPT = "(Intercept)"


def vectors(rows: DataFrame, people: DataFrame, features: list[str], folds: int) -> DataFrame:
    """(iid, y, fold, at, x): the people with the numbers and values of their features; folds by a hash of the id. rows: (iid, feature, x); rows of one feature of a person add up."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"{len(features)} features; fit them in batches of {MOST_FEATURES}")
    spark = rows.sparkSession
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(features)), "at int, feature string"))  # MOST_FEATURES rows at most
    packed = rows.filter(F.col("x").isNotNull()).join(numbers, "feature").groupBy("iid").agg(F.collect_list(F.struct("at", F.col("x").cast("double").alias("x"))).alias("v"))
    fold = F.pmod(F.crc32(F.col("iid").cast("string").cast("binary")), F.lit(max(folds, 1))).cast("int")
    return people.select("iid", (F.col("phenotype") - 1).cast("double").alias("y"), fold.alias("fold")).join(packed, "iid", "left").select("iid", "y", "fold", F.coalesce("v.at", F.array().cast("array<int>")).alias("at"), F.coalesce("v.x", F.array().cast("array<double>")).alias("x"))


def soft_newton(beta: np.ndarray, slope: np.ndarray, curvature: np.ndarray, active: np.ndarray, penalty: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """beta after the minimum of the quadratic model of the loss plus the penalties, over the active features, by coordinate descent."""
    out, h = beta.copy(), curvature + 1e-12 * np.eye(len(active))
    left, p = slope[active].copy(), penalty[active].tolist()  # slopes of the quadratic model where out stands
    b, bends = out[active].tolist(), np.diag(h).tolist()  # plain numbers: this is most of what a pass with many active features costs
    for _ in range(rounds):
        most = 0.0
        for k, bend in enumerate(bends):
            if bend > 1e-11:
                u = bend * b[k] + left.item(k)
                new = max(u - p[k], 0.0) / bend if u > 0 else min(u + p[k], 0.0) / bend
                if new != b[k]:
                    left -= h[k] * (new - b[k])  # h is symmetric
                    most = max(most, bend * (new - b[k]) ** 2)
                    b[k] = new
        if most < 1e-18:
            break
    out[active] = b
    return out


def residuals(beta: np.ndarray, slope: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """How far each feature is from its condition at the minimum."""
    with np.errstate(invalid="ignore"):  # 0 under no bound
        return np.where(beta != 0, np.abs(slope - penalty * np.sign(beta)), np.maximum(np.abs(slope) - penalty, 0))


@dataclass
class Problem:
    """One set without one fold (or -1), on its way along the penalties."""

    number: int
    columns: np.ndarray
    free: np.ndarray
    fold: int
    beta: np.ndarray
    active: np.ndarray
    at: int = -1  # the penalty it is fitted under; -1: none but the free features
    before: tuple[float, np.ndarray] | None = None
    tries: int = 0
    done: bool = False
    losses: list[float] = field(default_factory=list)
    path: list[np.ndarray] = field(default_factory=list)
    slope: np.ndarray | None = None

    def penalty(self, grid: np.ndarray | None, at: int) -> np.ndarray:
        level = np.inf if grid is None or at < 0 else grid[min(at, len(grid) - 1)]
        return np.where(self.free, 0.0, level)


def _blocks(people: DataFrame, width: int) -> DataFrame:
    """(y, fold, x): SLICE people at most to a row, by fold, as bytes of whole arrays: passes lay out nothing anew."""

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for frame in frames:
            left = frame if left is None else pd.concat([left, frame], ignore_index=True)
            while len(left) >= SLICE:
                yield block(left.iloc[:SLICE])
                left = left.iloc[SLICE:]
        if left is not None and len(left):
            yield block(left)

    def block(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("fold", kind="stable")
        x, sizes = np.zeros(len(f) * width), [len(a) for a in f["at"]]
        if sum(sizes):
            cell = np.repeat(np.arange(len(f)), sizes) * width + np.concatenate(list(f["at"])).astype(int)
            x = np.bincount(cell, np.concatenate(list(f["x"])).astype(float), len(x))
        return pd.DataFrame({"y": [f["y"].to_numpy(float).tobytes()], "fold": [f["fold"].to_numpy(np.int32).tobytes()], "x": [x.tobytes()]})

    return people.select("y", "fold", "at", "x").mapInPandas(lay, "y binary, fold binary, x binary")


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """y, fold and x of each block."""
    for frame in frames:
        for y, fold, x in frame[["y", "fold", "x"]].itertuples(index=False):
            y = np.frombuffer(y)
            yield y, np.frombuffer(fold, np.int32), np.frombuffer(x).reshape(len(y), -1)


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's people, and sums and squares of each feature."""
    n, total = 0, 0.0
    for y, _, x in _unpacked(frames):
        n, total = n + len(y), total + np.stack([x.sum(0), (x * x).sum(0)])
    if n:
        yield pd.DataFrame({"at": np.arange(total.shape[1]), "n": n, "s": total[0], "q": total[1]})


def _pass(data: DataFrame, many: bool, problems: list[Problem], grids: dict[int, np.ndarray], mean: np.ndarray, scale: np.ndarray, tolerance: float) -> list:
    """One row for each problem: its next coefficients, how far it was from its conditions, its losses and slopes.

    Slopes are exact. Curvatures only steer the step: the folds of a set share the weights of their mean predictor, so each person's products are
    summed once for all of them, in single precision. A problem that isn't done after SHARED_TRIES has curvatures of its own.
    """
    plan = [(p.number, p.columns, p.fold, p.beta, p.active, p.tries >= SHARED_TRIES) for p in problems]
    size = {p.number: 3 + len(p.beta) + len(p.active) ** 2 for p in problems}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {n: np.zeros(k) for n, k in size.items()}
        groups: dict[bytes, list] = {}
        for p in plan:
            groups.setdefault(p[1].tobytes(), []).append(p)
        sharing = {g: [m for m in members if not m[5]] for g, members in groups.items()}
        union = {g: np.unique(np.concatenate([m[4] for m in some])).astype(int) for g, some in sharing.items() if some}
        shared: dict[tuple[bytes, int], np.ndarray] = {}
        for y, fold, x in _unpacked(frames):
            x = np.column_stack([(x - mean) * scale, np.ones(len(y))])
            y, cuts = y[:, None], [*np.flatnonzero(np.diff(fold, prepend=-1)), len(fold)]
            for g, members in groups.items():
                own = x[:, np.append(members[0][1], x.shape[1] - 1)]
                eta = own @ np.column_stack([m[3] for m in members])
                p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                used = fold[:, None] != np.array([m[2] for m in members])
                loss = np.logaddexp(0, eta) - y * eta
                slope = own.T @ ((y - p) * used)
                n, inside, whole = used.sum(0), (loss * used).sum(0), loss.sum(0)
                for i, (number, _, _, beta, active, alone) in enumerate(members):
                    t = total[number]
                    t[:3] += n[i], whole[i] - inside[i], inside[i]
                    t[3 : 3 + len(beta)] += slope[:, i]
                    if alone:
                        a = own[:, active]
                        t[3 + len(beta) :] += ((a * (p[:, i] * (1 - p[:, i]) * used[:, i])[:, None]).T @ a).ravel()
                if g in union:
                    middle = 1 / (1 + np.exp(-np.clip(eta[:, [not m[5] for m in members]].mean(1), -500, 500)))
                    a = (own[:, union[g]] * np.sqrt(middle * (1 - middle))[:, None]).astype(np.float32)
                    for lo, hi in zip(cuts, cuts[1:], strict=False):
                        key = g, int(fold[lo])
                        shared[key] = shared.get(key, 0.0) + (a[lo:hi].T @ a[lo:hi]).astype(float)
        for g, some in sharing.items():
            parts = {f: s for (group, f), s in shared.items() if group == g}
            if some and parts:
                for number, _, fold, beta, active, _ in some:
                    at = np.searchsorted(union[g], active)
                    if rest := [s for f, s in parts.items() if f != fold]:
                        total[number][3 + len(beta) :] = sum(rest)[np.ix_(at, at)].ravel()
        yield pd.DataFrame({"problem": list(total), "sums": [t.tobytes() for t in total.values()]})

    def add(key, frame):
        return pd.DataFrame({"problem": [key[0]], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

    rules = {p.number: (p.beta, p.active, p.penalty(grids.get(p.number), p.at), p.penalty(grids.get(p.number), p.at + 1)) for p in problems}

    def solve(key, frame):
        beta, active, penalty, after = rules[int(key[0])]
        t = sum(np.frombuffer(b) for b in frame["sums"])
        n = max(t[0], 1.0)
        slope, curvature = t[3 : 3 + len(beta)] / n, t[3 + len(beta) :].reshape(len(active), -1) / n
        off = float(residuals(beta, slope, penalty).max())
        new = soft_newton(beta, slope, curvature, active, after if off <= tolerance else penalty)
        value = t[2] / n + float((penalty[beta != 0] * np.abs(beta[beta != 0])).sum())
        return pd.DataFrame({"problem": [key[0]], "off": [off], "value": [value], "held_out": [t[1]], "beta": [new.tobytes()], "slope": [slope.tobytes()]})

    sums = data.mapInPandas(partial, "problem int, sums binary")
    if many:  # more tasks than sums that may meet in one group
        sums = sums.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES))).groupBy("problem", "lane").applyInPandas(add, "problem int, sums binary")
    return sums.groupBy("problem").applyInPandas(solve, "problem int, off double, value double, held_out double, beta binary, slope binary").collect()


def _advance(p: Problem, r, grid: np.ndarray | None, tolerance: float) -> None:
    """Takes in what a pass found for a problem."""
    if p.before and r["value"] > p.before[0] + 1e-12 * (1 + abs(p.before[0])) and p.tries < 200:  # the step was too long
        p.beta, p.tries = (p.beta + p.before[1]) / 2, p.tries + 1
        return
    slope, new = np.frombuffer(r["slope"]), np.frombuffer(r["beta"])
    p.slope, p.tries = slope, p.tries + 1
    met = r["off"] <= tolerance or p.tries >= 200
    here = p.penalty(grid, p.at)
    if met:
        p.losses.append(r["held_out"])
        p.path.append(p.beta)
        p.before, p.tries = None, 0
        last = -1 if grid is None else len(grid) - 1
        if p.at >= last:
            p.done = True
            return
        p.at += 1
        after = p.penalty(grid, p.at)
        with np.errstate(invalid="ignore"):
            likely = np.abs(slope) >= np.where(np.isinf(here), after, 2 * after - here)
        p.active = np.flatnonzero((new != 0) | p.free | likely)
    else:
        p.before = r["value"], p.beta
        p.active = np.union1d(p.active, np.flatnonzero(np.abs(slope) > here))
    p.beta = new


@dataclass
class Fits:
    """coefficients: (model, feature, coefs, penalty), on the scale of the features; losses: (model, step, lambda, loss, chosen) of the paths."""

    coefficients: DataFrame
    losses: DataFrame
    passes: int
    data: DataFrame | None = None
    features: list[str] = field(default_factory=list)

    def conditions(self) -> DataFrame:
        """What `slopes` gives for the coefficients, from the written people: one pass for all models."""
        place, models = {f: i for i, f in enumerate(self.features)}, {}
        for r in self.coefficients.collect():  # one for each feature of each model
            models.setdefault(r["model"], []).append((r["feature"], r["coefs"], r["penalty"]))
        names, width = list(models), len(self.features)
        beta = np.zeros((width + 1, len(names)))
        for m, name in enumerate(names):
            for feature, coef, _ in models[name]:
                beta[place.get(feature, width), m] += coef

        def gaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width + 1, len(names) + 4))  # slopes of each model; people who have it, sums, squares, people
            for y, _, x in _unpacked(frames):
                gap = y[:, None] - 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -500, 500)))
                total[:-1, : len(names)] += x.T @ gap
                total[-1, : len(names)] += gap.sum(0)
                total[:-1, -4], total[:-1, -3], total[:-1, -2] = total[:-1, -4] + (x != 0).sum(0), total[:-1, -3] + x.sum(0), total[:-1, -2] + (x * x).sum(0)
                total[:, -1] += len(y)
            yield pd.DataFrame({"one": [0], "sums": [total.tobytes()]})

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"one": frame["one"].iloc[:1], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

        kinds = "one int, sums binary"
        lanes = self.data.mapInPandas(gaps, kinds).groupBy("one", F.pmod(F.spark_partition_id(), F.lit(LANES))).applyInPandas(add, kinds)
        sums = np.frombuffer(lanes.groupBy("one").applyInPandas(add, kinds).head()["sums"]).reshape(width + 1, -1)
        people, out = max(sums[-1, -1], 1.0), []
        for m, name in enumerate(names):
            for feature, coef, penalty in models[name]:
                j = place.get(feature, width)
                n, mean, square = sums[j, -4], sums[j, -3] / people, sums[j, -2] / people
                slope, variance = sums[j, m] / people, square - mean * mean
                deviation = 1.0 if j == width or variance <= 1e-12 * square else np.sqrt(variance)
                off = abs(slope - penalty * np.sign(coef)) if coef != 0 else max(abs(slope) - penalty, 0.0)
                out.append((name, feature, coef, penalty, int(people if j == width else n), float(slope), float(off / deviation)))
        return self.coefficients.sparkSession.createDataFrame(out, "model string, feature string, coefs double, penalty double, n long, slope double, off double")


def fit_paths(rows: DataFrame, people: DataFrame, sets: dict[str, list[str]], free: list[str] = (), lambdas: int = 99, ratio: float | None = None, folds: int = 5, tolerance: float = 1e-8) -> Fits:
    """L1 logistic models of several feature sets, each at the penalty with the least cross-validated loss.

    rows: (iid, feature, x), no row is 0; people: (iid, phenotype 1 or 2). The loss is the mean over people, a feature's penalty is lambda times its
    deviation among them, none for the free ones and the intercept. A path begins at the smallest
    lambda that leaves all others at 0, and goes down evenly in its logarithm, in so many steps, to `ratio` of that; none is 1e-4, or 0.01 for a set with more features than there are people, like glmnet's. Folds are by a hash of the id. Features that
    are the same for everybody get 0. Sets without other than free features are fitted plainly.

    The driver holds, for each set and fold, a few numbers for each feature; sums of curvatures meet in lanes and stay on executors.
    """
    features = sorted({f for names in sets.values() for f in names})
    data = written(_blocks(vectors(rows, people, features, folds), len(features)), "vectors")
    many = data.select(F.spark_partition_id().alias("task")).distinct().count() > LANES
    n, mean, square = 0, np.zeros(len(features)), np.zeros(len(features))
    for r in data.mapInPandas(_moments, "at int, n long, s double, q double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():  # one for each feature
        n, mean[r["at"]], square[r["at"]] = r["n"], r["s"] / r["n"], r["q"] / r["n"]
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    varies = deviation > 1e-9 * np.maximum(1, np.abs(mean))
    scale = np.where(varies, 1 / np.where(varies, deviation, 1), 0.0)

    place, names, problems = {f: i for i, f in enumerate(features)}, list(sets), []
    for s, name in enumerate(names):
        columns = np.array([place[f] for f in dict.fromkeys(sets[name])], int)
        loose = np.append(np.isin(np.array(features, object)[columns], list(free)) & varies[columns], True)
        for fold in (-1, *range(folds)):
            problems.append(Problem(s * (folds + 1) + fold + 1, columns, loose, fold, np.zeros(len(columns) + 1), np.flatnonzero(loose)))

    grids, passes = {}, 0
    for stage in ("free", "path"):
        if stage == "path":
            for s in range(len(names)):
                own = problems[s * (folds + 1) : (s + 1) * (folds + 1)]
                most = np.abs(own[0].slope[~own[0].free]).max(initial=0.0)
                if most > 0:
                    least = ratio or (1e-4 if n >= len(own[0].columns) else 0.01)
                    for p in own:
                        grids[p.number], p.done, p.losses, p.path = most * np.geomspace(1, least, lambdas + 1), False, [], []  # a fold may have others at the first
                        p.at, p.active = 0, np.flatnonzero(p.free | (np.abs(p.slope) >= 2 * grids[p.number][0] - most))
        while left := [p for p in problems if not p.done]:
            found = {r["problem"]: r for r in _pass(data, many, left, grids, mean, scale, tolerance)}
            passes += 1
            for p in left:
                _advance(p, found[p.number], grids.get(p.number), tolerance)

    out, losses = [], []
    for s, name in enumerate(names):
        own = problems[s * (folds + 1) : (s + 1) * (folds + 1)]
        total = np.sum([p.losses for p in own[1:]], 0) / max(n, 1) if folds else np.zeros(len(own[0].path))
        best, grid = int(np.argmin(total)), grids.get(own[0].number, np.empty(0))
        levels = grid if len(grid) else np.zeros(1)
        losses += [(name, k, float(levels[k]), float(total[k]), k == best) for k in range(len(total))]
        beta, columns = own[0].path[best], own[0].columns
        coefs = beta[:-1] * scale[columns]
        out += [(name, features[c], float(b), 0.0 if own[0].free[k] else float(levels[best] * deviation[c])) for k, (c, b) in enumerate(zip(columns, coefs, strict=True))]
        out.append((name, INTERCEPT, float(beta[-1] - coefs @ mean[columns]), 0.0))
    spark = rows.sparkSession
    return Fits(spark.createDataFrame(out, "model string, feature string, coefs double, penalty double"), spark.createDataFrame(losses, "model string, step int, lambda double, loss double, chosen boolean"), passes, data, features)


def slopes(rows: DataFrame, people: DataFrame, coefficients: DataFrame) -> DataFrame:
    """coefficients with n, the people who have a feature, slope, of the mean log-likelihood, and off, how far that is from the condition at the minimum.

    off is in deviations of the feature. All is recomputed from the rows, whatever made the coefficients. These are as few as the features of
    all models, and are broadcast.
    """
    few, models = F.broadcast(coefficients), coefficients.select("model").distinct()
    own = rows.select("iid", "feature", F.col("x").cast("double").alias("x")).join(people.select("iid"), "iid", "left_semi").groupBy("iid", "feature").agg(F.sum("x").alias("x"))
    part = own.join(few, "feature").groupBy("iid", "model").agg(F.sum(F.col("x") * F.col("coefs")).alias("eta"))
    base = F.broadcast(coefficients.filter(F.col("feature") == INTERCEPT).select("model", F.col("coefs").alias("base")))
    every = people.select("iid", (F.col("phenotype") - 1).alias("y")).join(F.broadcast(models)).join(base, "model").join(part, ["iid", "model"], "left")
    gap = written(every.select("iid", "model", (F.col("y") - 1 / (1 + F.exp(-(F.col("base") + F.coalesce("eta", F.lit(0.0)))))).alias("gap")), "gaps")
    whole = F.broadcast(gap.groupBy("model").agg(F.count("*").alias("people"), F.sum("gap").alias("whole")))
    x = F.col("x")
    sums = own.join(gap, "iid").join(F.broadcast(coefficients.select("model", "feature")), ["model", "feature"]).groupBy("model", "feature")
    sums = sums.agg(F.sum(x * F.col("gap")).alias("s"), F.sum((x != 0).cast("long")).alias("n"), F.sum(x).alias("m"), F.sum(x * x).alias("q"))
    found = coefficients.join(sums, ["model", "feature"], "left").join(whole, "model").fillna(0.0, ["s", "m", "q"]).fillna(0, ["n"])
    here, n = F.col("feature") == INTERCEPT, F.col("people")
    variance = F.col("q") / n - F.col("m") / n * F.col("m") / n
    found = found.withColumn("deviation", F.when(here | (variance <= 1e-12 * F.col("q") / n), 1.0).otherwise(F.sqrt(variance)))
    found = found.withColumn("slope", F.when(here, F.col("whole")).otherwise(F.col("s")) / n).withColumn("n", F.when(here, n).otherwise(F.col("n")))
    off = F.when(F.col("coefs") != 0, F.abs(F.col("slope") - F.col("penalty") * F.signum("coefs"))).otherwise(F.greatest(F.abs("slope") - F.col("penalty"), F.lit(0.0)))
    return found.withColumn("off", off / F.col("deviation")).drop("s", "m", "q", "people", "whole", "deviation")
