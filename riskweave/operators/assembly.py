"""Putting feature tables together: all over long rows (iid, feature, x), so a star of left joins is a union and one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_alleles(dosages: DataFrame, calls: DataFrame) -> DataFrame:
    """(iid, feature, x) of dosages (iid, snp, dosage) and of the allele calls (iid, allele, call) of the same people; others' calls fall away."""
    rows = dosages.select("iid", F.col("snp").cast("string").alias("feature"), F.col("dosage").cast("double").alias("x"))
    return rows.unionByName(calls.join(dosages.select("iid").distinct(), "iid", "left_semi").select("iid", F.col("allele").alias("feature"), F.col("call").cast("double").alias("x")))


def with_covariates(people: DataFrame, covariates: DataFrame) -> DataFrame:
    """Everybody, with covariates where there are some."""
    return people.join(covariates, "iid", "left")


def star(people: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(iid, split, source, feature, x) of the people in (iid, split): the rows of every part (iid, feature, x), named by part.

    The wide form would be one left join for each part; absent values are absent rows here, and nobody outside people has any.
    """
    tagged = [rows.select("iid", F.lit(name).alias("source"), "feature", F.col("x").cast("double").alias("x")) for name, rows in parts.items()]
    return people.select("iid", "split").join(reduce(DataFrame.unionByName, tagged), "iid")


def reindexed(people: DataFrame, values: DataFrame, key: str, value: str = "value") -> DataFrame:
    """A row for each person and each key that occurs at all, null where there is no value. Keys are names of columns: a short list."""
    keys = values.select(key).distinct()
    every = people.select("iid", "split").join(F.broadcast(keys))
    return every.join(values.select("iid", key, value), ["iid", key], "left")


def strict_labels(ids: DataFrame, people: DataFrame) -> DataFrame:
    """(iid, phenotype) of the ids, in which everybody must be known."""
    out = ids.select("iid").join(people.select("iid", "phenotype"), "iid", "left")
    missing = out.filter("phenotype is null").limit(5).collect()
    if missing:
        raise KeyError(f"no phenotype for {[r['iid'] for r in missing]}")
    return out


def beside(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Two tables of one key side by side; columns of the right one that the left has too get a suffix."""
    twice = [c for c in right.columns if c in left.columns and c not in on]
    return left.join(right.select(*on, *(F.col(c).alias(f"{c}_other" if c in twice else c) for c in right.columns if c not in on)), on, how)


def gated(scores: DataFrame, features: DataFrame, least: float = 0.51) -> DataFrame:
    """The features of models whose AUC is above the gate; scores: (model, auc)."""
    return features.join(scores.filter(F.col("auc") > least).select("model"), "model", "left_semi")
