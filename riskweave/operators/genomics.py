"""Variant quality control and linkage on long genotypes (iid, snp, dosage); no row is dosage 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if
from ..functions.stats import hwe_exact
from ..sources.shared import written
from .evaluation import with_p
from .prs import BROADCAST_ROWS


def genotype_counts(genotype: DataFrame, n_people: int) -> DataFrame:
    """snp, missing, n1, n2, n0: people without a call, with one and two alleles, and the rest."""
    d = F.col("dosage")
    c = genotype.groupBy("snp").agg(count_if(d.isNull()).alias("missing"), count_if(d == 1).alias("n1"), count_if(d == 2).alias("n2"))
    return c.withColumn("n0", F.lit(n_people) - F.col("missing") - F.col("n1") - F.col("n2"))


def variant_qc(genotype: DataFrame, n_people: int, most_missing: float = 0.05, least_maf: float = 1e-4, least_hwe: float | None = None) -> DataFrame:
    """Variants that pass the filters on missingness, minor allele frequency and (optionally) the exact Hardy-Weinberg test."""
    c = genotype_counts(genotype, n_people)
    f = (F.col("n1") + 2 * F.col("n2")).cast("double") / (2 * (F.col("n0") + F.col("n1") + F.col("n2")))
    c = c.withColumn("missing_rate", F.col("missing").cast("double") / n_people).withColumn("maf", F.least(f, 1 - f))
    kept = c.filter((F.col("missing_rate") <= most_missing) & (F.col("maf") >= least_maf))
    if least_hwe is None:
        return kept
    tested = with_p(kept, "hwe_p", ["n1", "n0", "n2"], lambda het, a, b: hwe_exact(int(het), int(a), int(b)))
    return tested.filter(F.col("hwe_p") >= least_hwe)


def outside_region(variants: DataFrame, first: int, last: int, position: str = "snp") -> DataFrame:
    return variants.filter(~F.col(position).between(first, last))


def ld_r2(genotype: DataFrame, n_people: int, reach: int) -> DataFrame:
    """(snp_a, snp_b, r2) of variants at most `reach` apart: squared correlation of dosages from sums over carriers.

    Only people who carry both meet in the join, and only within blocks of that length and the next; sums over all others are zero.
    """
    g = genotype.filter("dosage > 0")
    block = F.floor(F.col("snp") / max(1, reach))
    one = g.groupBy("snp").agg(F.sum("dosage").cast("double").alias("s"), F.sum(F.col("dosage") * F.col("dosage")).cast("double").alias("q"))
    x = g.select("iid", F.col("snp").alias("snp_a"), F.col("dosage").alias("a"), block.alias("block"))
    y = g.select("iid", F.col("snp").alias("snp_b"), F.col("dosage").alias("b"), F.explode(F.array(block, block - 1)).alias("block"))
    both = x.join(y, ["iid", "block"]).filter((F.col("snp_a") < F.col("snp_b")) & (F.col("snp_b") - F.col("snp_a") <= reach)).groupBy("snp_a", "snp_b").agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("p"))
    of = lambda k: one.select(F.col("snp").alias(f"snp_{k}"), F.col("s").alias(f"s{k}"), F.col("q").alias(f"q{k}"))
    rows = both.join(of("a"), "snp_a").join(of("b"), "snp_b")
    n = float(n_people)
    cov, va, vb = n * F.col("p") - F.col("sa") * F.col("sb"), n * F.col("qa") - F.col("sa") * F.col("sa"), n * F.col("qb") - F.col("sb") * F.col("sb")
    return rows.select("snp_a", "snp_b", (cov * cov / (va * vb)).alias("r2"))


def _running(rows: DataFrame, block: str, order: list[str], value: str, out: str) -> DataFrame:
    """rows with the maximum of value over all rows before, in the order of blocks, then `order`: within blocks, and over the blocks' own."""
    inside = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(block).agg(F.max(value).alias("__top"))  # a row for each block
    ahead = tops.select(block, F.max("__top").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)).alias("__ahead"))
    return rows.join(F.broadcast(ahead), block).withColumn(out, F.greatest(F.max(value).over(inside), F.col("__ahead"))).drop("__ahead")


def window_prune(variants: DataFrame, edges: DataFrame, reach: int, least: float = 0.6) -> DataFrame:
    """snp of those kept by pruning in windows: of a pair in linkage the variant with the rarer allele goes, of equals the later.

    variants: (snp, minor), snp is a position, minor how often its rarer allele is there; edges: (snp_a, snp_b, r2). A window holds all
    within `reach` of its first variant and moves on by one variant at a time; in a window pairs are looked at by their first, then
    their second, and those of which one has gone are passed over. So a pair is settled in the first window that holds both.

    Stretches that no pair bridges are pruned by themselves, one after another within a task. Blocks of positions find them: the furthest
    end so far is handed from block to block by one number each. A stretch is as long as linkage goes without a gap.
    """
    span = max(1, reach)
    e = edges.filter(F.col("r2") > least).select(F.least("snp_a", "snp_b").alias("a"), F.greatest("snp_a", "snp_b").alias("b")).filter((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= reach)).distinct()
    own = variants.select("snp", "minor")
    block = F.floor(F.col("snp") / span)
    copies = own.select("snp", F.explode(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own")))).alias("c")).select("snp", "c.*")
    begins = copies.withColumn("begin", F.min("snp").over(Window.partitionBy("block").orderBy("snp").rangeBetween(-reach, 0))).filter("own").select(F.col("snp").alias("b"), "begin")
    of = lambda k: own.select(F.col("snp").alias(k), F.col("minor").alias(f"minor_{k}"))
    rows = written(e.join(of("a"), "a").join(of("b"), "b").join(begins, "b").withColumn("block", F.floor(F.col("a") / span)), "prune-edges")
    ended = _running(rows, "block", ["a", "b"], "b", "before")
    starts = ended.withColumn("start", F.when(F.col("before").isNull() | (F.col("a") > F.col("before")), F.col("a")))
    stretches = _running(starts, "block", ["a", "b"], "start", "earlier").withColumn("stretch", F.greatest("start", "earlier"))

    def sweep(f):
        gone: set[int] = set()
        for a, b, x, y in f.sort_values(["begin", "a", "b"])[["a", "b", "minor_a", "minor_b"]].itertuples(index=False):
            if a not in gone and b not in gone:
                gone.add(a if x < y else b)
        return pd.DataFrame({"snp": sorted(gone)}, dtype="int64")

    pruned = stretches.select("stretch", "begin", "a", "b", "minor_a", "minor_b").groupBy("stretch").applyInPandas(sweep, "snp long")
    return own.select("snp").join(pruned, "snp", "left_anti")


def best_partner(pairs: DataFrame, value: str = "n") -> DataFrame:
    """snp, best_snp and its value; the smaller partner wins ties."""
    both = pairs.select(F.col("snp_a").alias("snp"), F.col("snp_b").alias("other"), value).unionByName(pairs.select(F.col("snp_b").alias("snp"), F.col("snp_a").alias("other"), value))
    return both.groupBy("snp").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("other")).alias("o"))).alias("m")).select("snp", (-F.col("m.o")).alias("best_snp"), F.col("m.v").alias("best"))


def keep_people(genotype: DataFrame, keep: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    if keep is not None:
        genotype = genotype.join(keep.select("iid"), "iid", "left_semi")
    return genotype if remove is None else genotype.join(remove.select("iid"), "iid", "left_anti")


def merge_variants(parts: list[DataFrame], variants: DataFrame | None = None) -> DataFrame:
    """Chromosomes one below the other, restricted to the variants that passed elsewhere.

    A list of variants goes to the genotypes if it is short (it is counted): by variant, a common one's genotypes would all lie in one task.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if variants is None:
        return out
    names = variants.select("snp")
    few = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return out.join(F.broadcast(names) if few else names, "snp", "left_semi")


def tags(edges: DataFrame, least: float = 0.6) -> DataFrame:
    """(snp, n_tags, tags): every variant's partners in linkage, in order."""
    e = edges.filter(F.col("r2") > least)
    both = e.select(F.col("snp_a").alias("snp"), F.col("snp_b").alias("tag")).unionByName(e.select(F.col("snp_b").alias("snp"), F.col("snp_a").alias("tag")))
    return both.groupBy("snp").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"), F.count_distinct("tag").alias("n_tags"))


def simulate(people: DataFrame, n_snps: int, carriers: float, seed: str = "1") -> DataFrame:
    """(iid, snp, dosage) of made-up genotypes: two alleles for each person and variant, each there with the same chance, by a hash."""

    def allele(k: int):
        key = F.concat_ws("-", F.lit(seed), F.col("iid").cast("string"), F.col("snp").cast("string"), F.lit(str(k)))
        return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") < int(carriers * (1 << 32))).cast("long")

    rows = people.select("iid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_snps - 1).cast("long"))).alias("snp"))
    return rows.withColumn("dosage", allele(0) + allele(1)).filter("dosage > 0")
