"""Feature construction on long rows (iid, feature, x); a zero is the absence of a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import members


def member_names(features: DataFrame) -> DataFrame:
    """Distinct members of comma-joined names."""
    return features.select(F.explode(members(F.col("feature"))).alias("member")).distinct()


def pair_features(genotype: DataFrame, pairs: DataFrame, how: str = "sum", propagate_null: bool = False) -> DataFrame:
    """(iid, feature, x) of (feature) names with one or more members out of (iid, snp, dosage).

    how is sum or prod. A missing dosage counts as nothing (0 in a sum, 1 in a product), or makes the result null with
    propagate_null. A person without a row for a member has dosage 0 there.
    """
    wanted = pairs.select("feature", F.size(members(F.col("feature"))).alias("n"), F.explode(members(F.col("feature"))).alias("snp"))
    rows = genotype.select("iid", F.col("snp").cast("string").alias("snp"), "dosage").join(wanted, "snp")
    lost = F.max(F.col("dosage").isNull())
    if how == "sum":
        x = F.coalesce(F.sum("dosage"), F.lit(0))
        made = rows.groupBy("iid", "feature").agg(x.alias("x"), lost.alias("lost"))
    else:
        present = F.count("*") == F.first("n")
        x = F.when(F.min(F.coalesce("dosage", F.lit(1))) == 0, 0).otherwise(F.round(F.exp(F.sum(F.log(F.coalesce(F.col("dosage"), F.lit(1)).cast("double"))))))
        made = rows.groupBy("iid", "feature").agg(F.when(present, x).otherwise(0).cast("long").alias("x"), lost.alias("lost"))
    kept = made.filter((F.col("x") != 0) | F.col("lost"))
    return kept.select("iid", "feature", F.when(F.lit(propagate_null) & F.col("lost"), None).otherwise(F.col("x")).cast("long").alias("x"))


def gene_environment(genes: DataFrame, env: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(iid, feature, x): value times x under the name 'env,gene', for all combinations or the names given (env_feature, feature)."""
    rows = genes if names is None else genes.join(names.select("env_feature", "feature"), "feature")
    on = ["iid"] if names is None else ["iid", "env_feature"]
    return rows.join(env, on).select("iid", F.concat_ws(",", "env_feature", "feature").alias("feature"), (F.col("value") * F.col("x")).alias("x"))


def fit_scale(train: DataFrame, by: list[str], value: str = "x", sample: bool = False) -> DataFrame:
    """Mean and deviation of each feature; the deviation of the population, or of the sample. Zero counts as one."""
    sd = (F.stddev_samp if sample else F.stddev_pop)(F.col(value).cast("double"))
    return train.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


def apply_scale(rows: DataFrame, fitted: DataFrame, by: list[str], value: str = "x", centre_only: bool = False) -> DataFrame:
    centred = F.col(value) - F.col("mean")
    return rows.join(fitted, by).withColumn(value, centred if centre_only else centred / F.col("sd")).drop("mean", "sd")


def batches(features: DataFrame, size: int) -> DataFrame:
    """batch: consecutive numbers of `size` features in name order, without gaps. Over a catalogue of names, not rows."""
    from pyspark.sql import Window

    return features.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("feature")) - 1) / size).cast("long"))


def split_environment(names: DataFrame) -> DataFrame:
    """feature, env_feature (the first member), genetic (the rest)."""
    m = members(F.col("feature"))
    return names.select("feature", m[0].alias("env_feature"), F.array_join(F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(1))), ",").alias("genetic"))


def gene_names(features: DataFrame, gene_map: DataFrame) -> DataFrame:
    """feature, genes: mapped names of all members (without what follows a dash), the member itself where none is known."""
    rows = features.select("feature", F.posexplode(members(F.col("feature"))).alias("i", "member"))
    named = rows.join(gene_map.select(F.col("feature").alias("member"), "gene"), "member", "left")
    one = F.struct("i", F.coalesce(F.split("gene", "-")[0], "member").alias("g"))
    return named.groupBy("feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["g"]), ",").alias("genes"))
