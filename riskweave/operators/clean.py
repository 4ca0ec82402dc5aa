"""Cleaning: hard calls, prevalence and missingness filters, imputation, clinical markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import quantiles


def hard_call(raw: Column) -> Column:
    return F.when(raw < 0.7, 0).when(raw < 1.7, 1).when(raw >= 1.7, 2)


def allele_prevalence(calls: DataFrame, least: float = 0.001) -> DataFrame:
    """Alleles of (iid, allele, call) that more than this share of the people with a call carry."""
    share = F.sum((F.col("call") > 0).cast("long")).cast("double") / F.count("call")
    return calls.groupBy("allele").agg(share.alias("prevalence"), F.count("call").alias("n_called")).filter(F.col("prevalence") > least)


def missingness(values: DataFrame, people: DataFrame, key: str, most: float = 0.05, strict: bool = True) -> DataFrame:
    """(key, missing): share of people without a value; kept below `most` (or at most, if not strict)."""
    n = people.count()
    have = values.join(people.select("iid"), "iid", "left_semi").groupBy(key).agg(F.count("value").alias("have"))
    share = 1 - F.col("have").cast("double") / n
    return have.select(key, share.alias("missing")).filter(F.col("missing") < most if strict else F.col("missing") <= most)


def mean_impute(values: DataFrame, fit: DataFrame, by: list[str], value: str = "value", fallback: float | None = 0.0) -> DataFrame:
    """Nulls of values become the mean of fit for the same `by`; without one, the fallback."""
    means = fit.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("__mean"))
    filled = F.coalesce(F.col(value).cast("double"), F.col("__mean"), *([F.lit(fallback)] if fallback is not None else []))
    return values.join(means, by, "left").withColumn(value, filled).drop("__mean")


def median_impute(values: DataFrame, fit: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    medians = quantiles(fit, value, [0.5], by).select(*by, F.col("q")[0].alias("__mid"))
    return values.join(medians, by, "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.col("__mid"))).drop("__mid")


def risk_direction(frame: DataFrame, marker: str, outcome: str) -> DataFrame:
    """direction 1 or -1: the sign of the correlation with the outcome, else of the skew, else 1."""
    stats = frame.agg(F.corr(marker, outcome).alias("corr"), F.skewness(marker).alias("skew"))
    sign = F.when(F.col("corr") != 0, F.signum("corr")).when(F.col("skew") != 0, F.signum("skew")).otherwise(1.0)
    return stats.select("corr", "skew", sign.cast("int").alias("direction"))


def binarise(frame: DataFrame, fit: DataFrame, marker: str, percentile: float = 0.2, threshold: float | None = None, higher_is_risk: bool = True) -> DataFrame:
    """flag: 1 on the risky side of a threshold, or of the percentile of fit. Null stays null."""
    cut = fit.agg(F.max(F.lit(threshold)).alias("__cut")) if threshold is not None else quantiles(fit, marker, [percentile], []).select(F.col("q")[0].alias("__cut"))
    risky = F.col(marker) >= F.col("__cut") if higher_is_risk else F.col(marker) <= F.col("__cut")
    return frame.join(F.broadcast(cut)).withColumn("flag", risky.cast("int")).drop("__cut")


def min_max(frame: DataFrame, column: str) -> DataFrame:
    """column in [0, 1]; left alone where it is already."""
    ends = frame.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    inside = (F.col("__lo") >= 0) & (F.col("__hi") <= 1) | (F.col("__lo") == F.col("__hi"))
    scaled = F.when(inside, F.col(column)).otherwise((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return frame.join(F.broadcast(ends)).withColumn(column, scaled).drop("__lo", "__hi")


#: Upper ends of what counts as healthy. Fixed values.
CUTOFFS = {"hba1c": 41.0, "bmi": 25.0, "glucose": 12.0}


def clinical_flags(values: DataFrame, cutoffs: dict[str, float] = CUTOFFS, key: str = "env_feature") -> DataFrame:
    """(iid, key, flag): 1 where a marker is at its cut-off or above; markers without one have no row. Null stays null."""
    cut = F.element_at(F.create_map(*(x for k, v in cutoffs.items() for x in (F.lit(k), F.lit(v)))), F.col(key))
    return values.filter(F.col(key).isin(list(cutoffs))).select("iid", key, (F.col("value") >= cut).cast("int").alias("flag"))
