"""Functional clusters by cohort, and the subtypes they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if


def long_clusters(genes: DataFrame, clusters: list[str], explode: bool = False) -> DataFrame:
    """(gene_id, cohort, cluster, effect): genes of one cohort only (or of each of several), and the clusters they are in."""
    rows = genes.withColumn("cohort", F.explode(F.split("cohort", ","))) if explode else genes.filter(~F.col("cohort").contains(","))
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("cluster"), F.col(c).alias("is_in")) for c in clusters)))
    effect = F.abs(F.log("or_value"))
    return rows.select("gene_id", "cohort", "or_value", effect.alias("effect"), named.alias("c")).filter("c.is_in = 1").select("gene_id", "cohort", "or_value", "effect", F.col("c.cluster").alias("cluster"))


def cluster_scores(genes: DataFrame, clusters: list[str]) -> DataFrame:
    """Sum of |ln OR| by the cohort's number of genes; risk and protective parts; majority direction; two ranks."""
    n = genes.filter(~F.col("cohort").contains(",")).groupBy("cohort").agg(F.count("*").alias("n_genes"))
    risk = F.col("or_value") > 1
    rows = long_clusters(genes, clusters).groupBy("cohort", "cluster").agg(
        F.sum("effect").alias("total"), F.sum(F.when(risk, F.col("effect")).otherwise(0.0)).alias("risk"), F.sum(F.when(~risk, F.col("effect")).otherwise(0.0)).alias("protective"),
        count_if(risk).alias("n_risk"), count_if(~risk).alias("n_protective"),
    )
    s = rows.join(F.broadcast(n), "cohort").withColumn("score", F.round(F.col("total") / F.col("n_genes"), 9))
    direction = F.when(F.col("n_risk") > F.col("n_protective"), "risk").when(F.col("n_risk") < F.col("n_protective"), "protective").otherwise("mixed")
    return s.withColumn("direction", direction).withColumn("rank_in_cohort", F.rank().over(Window.partitionBy("cohort").orderBy(F.desc("score")))).withColumn("rank_in_cluster", F.rank().over(Window.partitionBy("cluster").orderBy(F.desc("score"))))


def distinctiveness(scores: DataFrame, absolute: bool = False) -> DataFrame:
    """z across a cluster's cohorts (sample) times the percentile within the cohort, zero for scores of zero."""
    w, c = Window.partitionBy("cluster"), Window.partitionBy("cohort")
    sd = F.stddev_samp("score").over(w)
    z = F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0)
    ties = F.count("*").over(Window.partitionBy("cohort", "score"))
    pct = (F.rank().over(c.orderBy("score")) + (ties - 1) / 2) / F.count("*").over(c) * 100
    d = F.when(F.col("score") > 0, (F.abs("z") if absolute else F.col("z")) * F.col("pct") / 100).otherwise(0.0)
    return scores.select("cohort", "cluster", "score", z.alias("z"), pct.alias("pct")).withColumn("distinctiveness", d)


def signature(distinct: DataFrame, n: int) -> DataFrame:
    """The n most distinct clusters of each cohort."""
    return distinct.withColumn("rn", F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("distinctiveness"), "cluster"))).filter(F.col("rn") <= n)


def subtype_map(mapping: DataFrame) -> DataFrame:
    """(cluster, subtype) without unknown ones, lists taken apart."""
    rows = mapping.filter(F.col("subtype") != "UNKNOWN").select(F.col("functional_cluster").alias("cluster"), F.explode(F.split("subtype", ",")).alias("subtype"))
    return rows.withColumn("subtype", F.trim("subtype"))


def enrichment(rows: DataFrame, mapping: DataFrame, weight: str = "effect") -> DataFrame:
    """Weight of each subtype in each cohort, its risk and protective parts, and the cohort's share of the subtype's risk."""
    risk = F.col("or_value") > 1
    w = F.lit(1.0) if weight == "equal" else F.col(weight)
    s = rows.join(F.broadcast(mapping), "cluster").groupBy("subtype", "cohort").agg(
        F.count("*").alias("genes"), F.sum(w).alias("weight"), F.sum(F.when(risk, w).otherwise(0.0)).alias("risk_weight"), F.sum(F.when(~risk, w).otherwise(0.0)).alias("protective_weight")
    )
    total = F.sum("risk_weight").over(Window.partitionBy("subtype"))
    return s.withColumn("risk_percent", F.when(total > 0, F.col("risk_weight") / total * 100).otherwise(0.0))


def dominant(enriched: DataFrame) -> DataFrame:
    """The cohort with most genes, and that with most weight, of each subtype; the first name wins ties."""
    top = lambda c: F.min_by("cohort", F.struct((-F.col(c)).alias("x"), "cohort"))
    return enriched.groupBy("subtype").agg(top("genes").alias("by_count"), top("weight").alias("by_weight"))


def risk_protective(scores: DataFrame, eps: float = 0.001) -> DataFrame:
    return scores.groupBy("cohort").agg((F.sum("risk") / (F.sum("protective") + eps)).alias("ratio"))


def contributions(rows: DataFrame, mapping: DataFrame, enriched: DataFrame) -> DataFrame:
    """(subtype, cluster, cohort, contribution): a cohort's genes in a cluster times its risk weight in the subtype; no weight counts as none.

    rows: (gene_id, cohort, cluster); every cohort appears under every cluster of a subtype.
    """
    genes = rows.groupBy("cohort", "cluster").agg(F.count("*").alias("genes"))
    every = mapping.select("subtype", "cluster").distinct().join(rows.select("cluster").distinct(), "cluster", "left_semi").join(F.broadcast(rows.select("cohort").distinct()))
    met = every.join(genes, ["cohort", "cluster"], "left").join(enriched.select("subtype", "cohort", "risk_weight"), ["subtype", "cohort"], "left")
    return met.select("subtype", "cluster", "cohort", (F.coalesce("genes", F.lit(0)) * F.coalesce("risk_weight", F.lit(0.0))).alias("contribution"))
