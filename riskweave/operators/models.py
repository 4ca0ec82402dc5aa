"""Model fitting on long feature rows, with MLlib where it has the model."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Timer

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import released, written

#: Features of one fit, as in the batches of the planner; a batch becomes one vector column.
MOST_FEATURES = 3000


def side_by_side(jobs: list, at_once: int = 4) -> list:
    """What the functions return, in order; each runs Spark jobs of its own, several at a time share the cluster."""
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(wrap(job)) for job in jobs]]


def assemble(rows: DataFrame, people: DataFrame, features: list[str]) -> DataFrame:
    """(iid, label, features): one vector for each person, zeros where a feature has no row."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"{len(features)} features; fit them in batches of {MOST_FEATURES}")
    wide = rows.filter(F.col("feature").isin(features)).groupBy("iid").pivot("feature", features).agg(F.sum("x").cast("double"))
    safe = [f"f{i}" for i in range(len(features))]
    full = people.select("iid", (F.col("phenotype") - 1).cast("double").alias("label")).join(wide.toDF("iid", *safe), "iid", "left").fillna(0.0, safe)
    return VectorAssembler(inputCols=safe, outputCol="features").transform(full).select("iid", "label", "features")


def logistic(rows: DataFrame, people: DataFrame, features: list[str]):
    """Plain logistic regression without a penalty."""
    return LogisticRegression(regParam=0.0, maxIter=50).fit(assemble(rows, people, features))


def complement_bayes(rows: DataFrame, people: DataFrame, features: list[str]) -> DataFrame:
    """(feature, lp0, lp1): log-weights of complement naive Bayes, keyed by name."""
    model = NaiveBayes(modelType="complement").fit(assemble(rows, people, features))
    theta = model.theta.toArray()
    return rows.sparkSession.createDataFrame([(f, float(theta[0, i]), float(theta[1, i])) for i, f in enumerate(features)], "feature string, lp0 double, lp1 double")


def _poisson(iid: np.ndarray, replicate: int) -> np.ndarray:
    """Poisson(1) weights by a hash of person and replicate; replicate 0 is the data themselves."""
    if replicate == 0:
        return np.ones(len(iid))
    with np.errstate(over="ignore"):
        x = iid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(replicate) * np.uint64(0xC2B2AE3D27D4EB4F)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    u = (x >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(12)])), u, side="right").astype(float)


def mixed_score(scores: DataFrame, models: list[str], replicates: int = 50, steps: int = 25) -> DataFrame:
    """(model, beta, se, t, ci_low, ci_high) of a logistic model without intercept on scaled scores, errors by bootstrap.

    All replicates are fitted together by Newton steps; a step is one pass that sums slopes and curvatures, of fixed size, over the people.
    """
    wide = scores.groupBy("iid", "phenotype").pivot("model", models).agg(F.first("scaled_prs"))
    rows = written(wide.select("iid", (F.col("phenotype") - 1).cast("double").alias("y"), *(F.col(f"`{m}`").alias(f"x{i}") for i, m in enumerate(models))).na.drop(), "mix")
    k, n = len(models), replicates + 1
    betas = np.zeros((n, k))
    for _ in range(steps):

        def sums(frames, betas=betas):
            total = np.zeros((n, k + k * k))
            for f in frames:
                x, y, iid = f[[f"x{i}" for i in range(k)]].to_numpy(float), f["y"].to_numpy(float), f["iid"].to_numpy(np.int64)
                for r in range(n):
                    w, p = _poisson(iid, r), 1 / (1 + np.exp(-np.clip(x @ betas[r], -30, 30)))
                    total[r, :k] += x.T @ (w * (y - p))
                    total[r, k:] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
            yield pd.DataFrame({"sums": [total.tobytes()]})

        parts = rows.mapInPandas(sums, "sums binary").collect()  # one row of fixed size for each partition
        total = sum(np.frombuffer(r["sums"]) for r in parts).reshape(n, -1)
        step = np.linalg.solve(total[:, k:].reshape(n, k, k) + 1e-8 * np.eye(k), total[:, :k, None])[:, :, 0]
        betas = betas + step
        if np.abs(step).max() < 1e-10:
            break
    se, low, high = betas[1:].std(0, ddof=1), *np.quantile(betas[1:], [0.025, 0.975], axis=0)
    out = [(m, *map(float, (betas[0, i], se[i], abs(betas[0, i] / se[i]), low[i], high[i]))) for i, m in enumerate(models)]
    return scores.sparkSession.createDataFrame(out, "model string, beta double, se double, t double, ci_low double, ci_high double")


def apply_mix(scores: DataFrame, betas: DataFrame) -> DataFrame:
    """(iid, phenotype, prs_cr): the sum of coefficient times scaled score, then z-scored on these people."""
    mixed = scores.join(F.broadcast(betas.select("model", "beta")), "model").groupBy("iid", "phenotype").agg(F.sum(F.col("scaled_prs") * F.col("beta")).alias("v"))
    s = mixed.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return mixed.join(F.broadcast(s)).select("iid", "phenotype", ((F.col("v") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("prs_cr"))


def forest_impute(train: DataFrame, rows: DataFrame, target: str, features: list[str], trees: int = 20) -> DataFrame:
    """rows with null targets filled by a regression forest on the features."""
    return _forest_filler(train, target, features, trees)(rows)


def _forest_filler(train: DataFrame, target: str, features: list[str], trees: int) -> Callable[[DataFrame], DataFrame]:
    """Fills null targets of any rows by one forest, fitted here."""
    from pyspark.ml.regression import RandomForestRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="__v", handleInvalid="keep")
    model = RandomForestRegressor(featuresCol="__v", labelCol=target, predictionCol="__p", numTrees=trees, seed=1).fit(assembler.transform(train.filter(F.col(target).isNotNull())))
    return lambda rows: model.transform(assembler.transform(rows)).withColumn(target, F.coalesce(target, "__p")).drop("__v", "__p")


def iterative_impute(train: DataFrame, rows: DataFrame, columns: list[str], rounds: int = 10, trees: int = 100) -> DataFrame:
    """rows with nulls in the columns filled: medians of train first, then in each round every column by a forest on the others.

    Forests learn from train's known values, with its other columns filled as rows' are; a column without nulls needs none.
    """
    from .binning import quantiles

    medians = {c: [r["q"][0] for r in quantiles(train, c, [0.5], []).collect()] for c in columns}  # one number each, none where train has no value

    def filled(frame: DataFrame) -> DataFrame:
        middle = lambda c: F.coalesce(F.col(c).cast("double"), *map(F.lit, medians[c])).alias(c)
        kept = [middle(c) if c in columns else F.col(f"`{c}`") for c in frame.columns]
        return written(frame.select(*kept, *(F.col(c).isNull().alias(f"__no_{c}") for c in columns)), "impute")

    known, wanted = filled(train), filled(rows)
    lacks = {c: F.col(f"__no_{c}") for c in columns}
    missing = [f.agg(*(F.coalesce(F.max(lacks[c]), F.lit(False)).alias(c) for c in columns)).head() for f in (known, wanted)]
    some = reduce(Column.__or__, lacks.values())
    (known, open_known), (wanted, open_wanted) = ((f.filter(~some), f.filter(some)) for f in (known, wanted))  # only rows with a gap change
    for _ in range(rounds):
        for c in (c for c in columns if any(m[c] for m in missing)):
            others = [o for o in columns if o != c]
            bare = lambda frame, c=c: frame.withColumn(c, F.when(~lacks[c], F.col(c)))
            fill = _forest_filler(bare(known.unionByName(open_known)), c, others, trees)
            before = open_known, open_wanted
            open_known, open_wanted = (written(fill(bare(frame)), "impute") for frame in before)
            released(*(f for f in before if hasattr(f, "_written_at")))
    return wanted.unionByName(open_wanted).select(rows.columns)


def fit_batches(rows: DataFrame, people: DataFrame, catalogue: DataFrame, fit, at_once: int = 4, seconds: float = 3600.0) -> DataFrame:
    """(batch, feature, coefs, status) of fit(rows, people, features) for each batch of (batch, feature); a batch that fails says why.

    Several batches run at a time, each as distributed jobs of a group of its own. One that takes longer than so many seconds is
    cancelled, and its status says so; neither that nor a failure ends the others.
    """
    spark = rows.sparkSession
    batches: dict[int, list[str]] = {}
    for r in catalogue.orderBy("batch", "feature").collect():
        batches.setdefault(r["batch"], []).append(r["feature"])
    run, schema = uuid.uuid4().hex, "batch long, feature string, coefs double, status string"

    def one(number: int, names: list[str]) -> list[tuple]:
        group = f"batch-{number}-{run}"
        spark.sparkContext.setJobGroup(group, f"batch {number}", interruptOnCancel=True)
        late = Timer(seconds, spark.sparkContext.cancelJobGroup, [group])
        late.start()
        began = time.monotonic()
        try:
            return [(number, r["feature"], r["coefs"], "ok") for r in fit(rows, people, names).select("feature", "coefs").collect()]  # a row for each feature
        except Exception as error:  # noqa: BLE001  the reason goes into the table
            return [(number, None, None, "timeout" if time.monotonic() - began >= seconds else str(error)[:200])]
        finally:
            late.cancel()

    parts = side_by_side([(lambda b=b, names=names: one(b, names)) for b, names in batches.items()], at_once)
    return spark.createDataFrame([row for part in parts for row in part], schema)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """A saved model of a class, or None where there is none."""
    try:
        return kind.load(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error) or "Input path" in str(error):
            return None
        raise


def feature_sets(parts: dict[str, list[str]], separate_hla: bool = False) -> dict[str, list[str]]:
    """The features of each association model, covariates last. parts: main, epi, cardio, hla, env_main, clinical, covariate.

    Covariates are in every model and unpenalised there. HLA alleles go with main, epi and epi+main, or form a model of their own.
    """
    of = lambda *names: list(dict.fromkeys(f for n in names for f in parts.get(n, [])))
    hla = () if separate_hla else ("hla",)
    wanted = {
        "main": ("main", *hla), "epi": ("epi", *hla), "epi+main": ("epi", "main", *hla), "cardio": ("cardio",), "all": ("cardio", "epi", "main", "hla"),
        "env_main": ("env_main",), "all+env_main": ("cardio", "epi", "main", "hla", "env_main"), "covariate": (),
    }
    wanted |= {"hla": ("hla",)} if separate_hla else {"clinical_main": ("clinical",), "all+env_main+clinical_main": ("cardio", "epi", "main", "hla", "env_main", "clinical")}
    return {model: of(*names, "covariate") for model, names in wanted.items()}
