"""The data behind the figures; drawing is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if
from .binning import quantiles


def histogram(scores: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """Counts of cases and controls in equal ranges of the value, with each range's lower end."""
    v = F.col(value).cast("double")
    ends = scores.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    rows = scores.join(F.broadcast(ends), by).withColumn("slot", slot).withColumn("start", F.col("lo") + slot * width)
    return rows.groupBy(*by, "slot", "start").agg(count_if(F.col("phenotype") == 2).alias("cases"), count_if(F.col("phenotype") == 1).alias("controls"))


def box(scores: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Five numbers of each box."""
    names = ("min", "q1", "median", "q3", "max")
    return quantiles(scores, value, 4, by).select(*by, *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def forest(odds: DataFrame, label: str) -> DataFrame:
    """Rows of a forest plot, strongest first."""
    return odds.select(label, "odds_ratio", "ci_low", "ci_high").orderBy(F.desc_nulls_last("odds_ratio"), label)


def heatmap(table: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    return table.groupBy(row).pivot(column, columns).agg(F.first(value)).fillna(0)


def pie(table: DataFrame, by: str, part: str, value: str) -> DataFrame:
    """Each part's share of its whole."""
    return table.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(by))).select(by, part, value, "share")


def agreement_groups(flags: DataFrame, first: str, second: str) -> DataFrame:
    """(iid, colour): which of two models find a person."""
    wide = flags.groupBy("iid").agg(F.max(F.when(F.col("model") == first, F.col("high"))).alias("a"), F.max(F.when(F.col("model") == second, F.col("high"))).alias("b"))
    return wide.select("iid", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), first).when(F.col("b"), second).otherwise("neither").alias("colour"))


def volcano(coefs: DataFrame, threshold: float) -> DataFrame:
    """Effect and its side, for points beyond the threshold."""
    side = F.when(F.col("coefs") > threshold, "risk").when(F.col("coefs") < -threshold, "protect").otherwise("none")
    return coefs.withColumn("odds", F.exp("coefs")).withColumn("side", side)


def coefficient_gap(scores: DataFrame, whole: str) -> DataFrame:
    """Mean coefficient of the features of each model, in the whole model less in the model itself."""
    own = scores.filter(F.col("model") != whole)
    full = scores.filter(F.col("model") == whole).select("feature", F.col("coefs").alias("full"))
    return own.join(full, "feature").groupBy("model").agg((F.avg("full") - F.avg("coefs")).alias("gap"))
