"""Risk scores: weighted sums over long feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights up to this count (a name and a number each) are broadcast.
BROADCAST_ROWS = 200_000


def score(rows: DataFrame, weights: DataFrame, people: DataFrame, coef: str = "coef100", out: str = "prs100") -> DataFrame:
    """(iid, phenotype, model, out) for every person and model; no known feature sums to zero.

    Weights go to the rows if they are few (they are counted), so sums are partial before the shuffle on (iid, model); else both
    are shuffled by feature.
    """
    few = weights.select("feature").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    summed = rows.join(F.broadcast(weights) if few else weights, "feature").groupBy("iid", "model").agg(F.sum(F.col("x") * F.col(coef)).alias(out))
    models = weights.select("model").distinct()
    every = people.select("iid", "phenotype").join(F.broadcast(models))  # a handful of models
    return every.join(summed, ["iid", "model"], "left").select("iid", "phenotype", "model", F.coalesce(out, F.lit(0)).cast("long").alias(out))


def scale(scores: DataFrame, value: str = "prs100", out: str = "scaled_prs", fit: DataFrame | None = None) -> DataFrame:
    """z-scores by model: of the population itself, or with mean and sample deviation of fit."""
    v = F.col(value).cast("double")
    stats = (fit or scores).groupBy("model").agg(F.avg(v).alias("__m"), (F.stddev_samp(v) if fit is not None else F.stddev_pop(v)).alias("__s"))
    z = (F.col(value) - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return scores.join(F.broadcast(stats), "model").withColumn(out, z).drop("__m", "__s")


def mean_difference(scores: DataFrame, value: str = "prs100") -> DataFrame:
    """Mean of cases less mean of controls by model; null when a class is missing."""
    mean = lambda p: F.avg(F.when(F.col("phenotype") == p, F.col(value).cast("double")))
    return scores.groupBy("model").agg((mean(2) - mean(1)).alias("mean_diff"))


def directed(weights: DataFrame, coef: str = "coef100") -> DataFrame:
    """Weights by direction: risk (positive), protect (negative), mixed (both); zeros belong to none."""
    c = F.col(coef)
    kinds = F.when(c > 0, F.array(F.lit("risk"), F.lit("mixed"))).when(c < 0, F.array(F.lit("protect"), F.lit("mixed")))
    return weights.withColumn("direction", F.explode(kinds))


def directed_score(genotype: DataFrame, weights: DataFrame, environment: DataFrame, by: str, out: str = "prs100") -> DataFrame:
    """(iid, model, direction, out) of genotypes (iid, snp, dosage), from weights by variant (model, direction, snp, env, c).

    What goes with the environment (env is 1) is multiplied by the person's value in the column `by`, and isn't there without one. Weights are few. One sum by
    person stands before the join, so nothing larger than the scores is exchanged if genotypes lie by person.
    """
    part = lambda env: F.sum(F.when(F.col("env") == env, F.col("dosage") * F.col("c")))
    sums = genotype.join(F.broadcast(weights), "snp").groupBy("iid", "model", "direction").agg(part(0).alias("plain"), part(1).alias("times"))
    score = F.coalesce("plain", F.lit(0)) + F.coalesce(F.col("times") * F.col(by), F.lit(0))
    there = F.col("plain").isNotNull() | (F.col("times") * F.col(by)).isNotNull()
    return sums.join(environment.select("iid", by), "iid", "left").filter(there).select("iid", "model", "direction", score.cast("long").alias(out))


def saturation(rows: DataFrame, weights: DataFrame, people: DataFrame, step: int, coef: str = "coef100") -> DataFrame:
    """(model, direction, k, mean_diff): difference of means with the k strongest features, for k in steps and all.

    Each feature's own difference is summed along its rank; nothing is scored anew for each k. People without a row count as zero.
    """
    ranked = directed(weights, coef)
    order = Window.partitionBy("model", "direction").orderBy(F.desc(F.abs(coef)), "feature")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("model", "direction")))
    sizes = people.agg(F.sum((F.col("phenotype") == 2).cast("double")).alias("cases"), F.sum((F.col("phenotype") == 1).cast("double")).alias("controls"))
    sums = rows.join(people.select("iid", "phenotype"), "iid").groupBy("feature").agg(
        F.sum(F.when(F.col("phenotype") == 2, F.col("x")).otherwise(0)).alias("in_cases"), F.sum(F.when(F.col("phenotype") == 1, F.col("x")).otherwise(0)).alias("in_controls")
    )
    own = ranked.join(sums, "feature", "left").fillna(0, ["in_cases", "in_controls"])
    total = lambda c: F.sum(F.col(coef) * F.col(c)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    curve = own.withColumn("c", total("in_cases")).withColumn("d", total("in_controls")).filter((F.col("rank") % step == 0) | (F.col("rank") == F.col("n")))
    return curve.join(F.broadcast(sizes)).select("model", "direction", F.col("rank").cast("long").alias("k"), (F.col("c") / F.col("cases") - F.col("d") / F.col("controls")).alias("mean_diff"))


def combined(scores: DataFrame, models: list[str], value: str) -> DataFrame:
    """One row per person who has all models, one column per model (named <value>_<model>)."""
    wide = scores.groupBy("iid", "phenotype").pivot("model", models).agg(F.first(value))
    return wide.na.drop(subset=models).select("iid", "phenotype", *(F.col(f"`{m}`").alias(f"{value}_{m.replace('+', '_')}") for m in models))
