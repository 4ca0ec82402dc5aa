"""Cohort definition, exact stratified split, withdrawals."""

from __future__ import annotations

import warnings
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if


def case_control(people: DataFrame, icd: str, words: str, self_reports: list[str], icd_column: str, dates: list[str]) -> DataFrame:
    """phenotype 2 for a case: a date or source is filled in, a self-report has the words, or the diagnosis has the code. Null is no."""
    filled = [F.coalesce(F.col(c) != "", F.lit(False)) for c in dates]
    said = [F.coalesce(F.col(c).contains(words), F.lit(False)) for c in self_reports]
    coded = F.coalesce(F.col(icd_column).contains(icd), F.lit(False))
    return people.withColumn("phenotype", F.when(reduce(or_, [*filled, *said, coded]), 2).otherwise(1))


def validate_cases(people: DataFrame, least: int = 10) -> int:
    """The number of cases; none at all is an error, fewer than least a warning."""
    cases = people.agg(count_if(F.col("phenotype") == 2)).head()[0] or 0
    if cases == 0:
        raise ValueError("the cohort has no cases")
    if cases < least:
        warnings.warn(f"the cohort has {cases} cases", stacklevel=2)
    return cases


def without_withdrawn(people: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """The list of withdrawals is short beside the cohort; Spark broadcasts it if it measures as small."""
    return people.join(withdrawn.select("iid"), "iid", "left_anti")


def stratified_split(people: DataFrame, seed: str = "1", train: float = 0.7, test_of_rest: float = 0.6666) -> DataFrame:
    """split: exact shares of each phenotype, in the order of a hash of seed and id.

    Ranks within a class are taken in slices of the hash first, so that no task sorts a whole class.
    """
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("iid").cast("string")))
    hashed = people.withColumn("key", key).withColumn("slice", F.substring("key", 1, 2))
    sizes = hashed.groupBy("phenotype", "slice").agg(F.count("*").alias("in_slice"))
    by_class = Window.partitionBy("phenotype")
    sizes = sizes.withColumn("before", F.sum("in_slice").over(by_class.orderBy("slice")) - F.col("in_slice")).withColumn("n", F.sum("in_slice").over(by_class).cast("double"))
    ranked = hashed.withColumn("in_rank", F.row_number().over(Window.partitionBy("phenotype", "slice").orderBy("key", "iid")))
    ranked = ranked.join(F.broadcast(sizes), ["phenotype", "slice"]).withColumn("rn", F.col("before") + F.col("in_rank"))
    n_train = F.round(F.lit(train) * F.col("n"))
    n_test = F.round(F.lit(test_of_rest) * (F.col("n") - n_train))
    split = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_test, "test").otherwise("holdout")
    return ranked.select("iid", "phenotype", split.alias("split"))
