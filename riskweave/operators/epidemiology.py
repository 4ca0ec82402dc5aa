"""Prevalence, odds ratios, confusion counts and attribution, all from counts of one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if, odds_ci, odds_ratio, ratio, wilson
from .binning import quantiles


def is_case() -> Column:
    return F.col("phenotype") == 2


def top_percent_tables(binned: DataFrame, percents: list[int], n_bins: int = 100, by: str = "model", of: int = 100) -> DataFrame:
    """Cells a, b (cases and controls in the top p per cent, or p of so many), c, d (the rest), odds ratio and its bounds.

    A histogram over bins is made once; each p is a suffix sum of it.
    """
    histogram = binned.groupBy(by, "bin").agg(count_if(is_case()).alias("cases"), count_if(~is_case()).alias("controls"))
    cuts = F.explode(F.array(*map(F.lit, percents))).alias("p")
    high = F.col("bin") * of > (of - F.col("p")) * n_bins
    cells = histogram.select("*", cuts).groupBy(by, "p").agg(
        F.sum(F.when(high, F.col("cases")).otherwise(0)).alias("a"), F.sum(F.when(high, F.col("controls")).otherwise(0)).alias("b"),
        F.sum(F.when(~high, F.col("cases")).otherwise(0)).alias("c"), F.sum(F.when(~high, F.col("controls")).otherwise(0)).alias("d"),
    )
    a, b, c, d = map(F.col, "abcd")
    low, up = odds_ci(a, b, c, d)
    return cells.select(by, F.col("p").cast("int").alias("p"), "a", "b", "c", "d", odds_ratio(a, b, c, d).alias("odds_ratio"), low.alias("ci_low"), up.alias("ci_high"))


def confusion(scores: DataFrame, value: str, quantile: float = 0.8, by: str = "model") -> DataFrame:
    """Counts with 'high' at or above the quantile of its model; precision, recall and specificity, zero where undefined."""
    cut = quantiles(scores, value, [quantile], [by]).select(by, F.col("q")[0].alias("cut"))
    high = F.col(value) >= F.col("cut")
    cells = scores.join(F.broadcast(cut), by).groupBy(by).agg(
        count_if(high & is_case()).alias("tp"), count_if(high & ~is_case()).alias("fp"), count_if(~high & ~is_case()).alias("tn"), count_if(~high & is_case()).alias("fn")
    )
    or_zero = lambda x, y: F.coalesce(ratio(F.col(x), F.col(x) + F.col(y)), F.lit(0.0))
    return cells.select(by, "tp", "fp", "tn", "fn", or_zero("tp", "fp").alias("precision"), or_zero("tp", "fn").alias("recall"), or_zero("tn", "fp").alias("specificity"))


def exclusive_cases(flags: DataFrame, base: str) -> DataFrame:
    """By model, of cases: high here; high here and not in base; high here and nowhere else; the per cent of base's number.

    flags: (iid, phenotype, model, high). One aggregate per person replaces comparing lists of ids.
    """
    cases = flags.filter(is_case() & F.col("high"))
    per = cases.groupBy("iid").agg(F.count("*").alias("models"), F.max((F.col("model") == base).cast("int")).alias("in_base"))
    counts = cases.join(per, "iid").groupBy("model").agg(F.count("*").alias("high_cases"), count_if(F.col("in_base") == 0).alias("extra"), count_if(F.col("models") == 1).alias("only_here"))
    n_base = counts.filter(F.col("model") == base).agg(F.max("high_cases").alias("n_base"))
    return counts.join(F.broadcast(n_base)).withColumn("extra_percent", F.coalesce(ratio(F.col("extra") * 100, F.col("n_base")), F.lit(0.0))).drop("n_base")


def wilson_prevalence(binned: DataFrame, groups: int, n_bins: int, by: str = "model") -> DataFrame:
    """Prevalence with Wilson bounds on bins regrouped into fewer."""
    grouped = binned.withColumn("grp", F.ceil(F.col("bin") * groups / F.lit(n_bins)).cast("int"))
    n = grouped.groupBy(by, "grp").agg(F.count("*").alias("n"), count_if(is_case()).alias("cases"))
    low, up = wilson(F.col("cases"), F.col("n"))
    return n.select(by, "grp", "n", "cases", ratio(F.col("cases"), F.col("n")).alias("prevalence"), low.alias("ci_low"), up.alias("ci_high"))


def binomial_prevalence(binned: DataFrame, groups: int, n_bins: int, by: str = "model", z: float = 1.96) -> DataFrame:
    """Prevalence with bounds by the normal approximation of the binomial, within [0, 1], on bins regrouped into fewer."""
    grouped = binned.withColumn("grp", F.ceil(F.col("bin") * groups / F.lit(n_bins)).cast("int"))
    n = grouped.groupBy(by, "grp").agg(F.count("*").alias("n"), count_if(is_case()).alias("cases"))
    p = ratio(F.col("cases"), F.col("n"))
    half = z * F.sqrt(p * (1 - p) / F.col("n"))
    return n.select(by, "grp", "n", "cases", p.alias("prevalence"), F.greatest(p - half, F.lit(0.0)).alias("ci_low"), F.least(p + half, F.lit(1.0)).alias("ci_high"))


def group_columns(flags: DataFrame, models: list[str]) -> DataFrame:
    """iid and one 0/1 column for each model: whether the person is high there."""
    wide = flags.groupBy("iid").pivot("model", models).agg(F.max(F.col("high").cast("int")))
    return wide.select("iid", *(F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(f"in_{m.replace('+', '_')}") for m in models))


def range_prevalence(stats: DataFrame, ranges: dict[str, tuple[int, int]], by: str = "model") -> DataFrame:
    """Prevalence in overlapping inclusive ranges of bins; the ranges are a literal table, joined to bins, not people."""
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for k, (a, b) in ranges.items())))
    rows = stats.withColumn("r", named).filter(F.col("bin").between(F.col("r.lo"), F.col("r.hi")))
    sums = rows.groupBy(by, F.col("r.name").alias("range")).agg(F.sum("cases").alias("cases"), F.sum("total").alias("n"))
    return sums.withColumn("prevalence", ratio(F.col("cases"), F.col("n")))


def mean_bin_prevalence(binned: DataFrame, by: str = "model") -> DataFrame:
    """Mean and deviation over bins of the bins' prevalence."""
    per = binned.groupBy(by, "bin").agg(F.avg(is_case().cast("double")).alias("rate"))
    return per.groupBy(by).agg(F.avg("rate").alias("mean_rate"), F.stddev_samp("rate").alias("sd_rate"), F.count("*").alias("bins"))


def first_flagged(order: list[str]) -> Column:
    """The first model in order whose flag is set, of a map model -> flag in column flags."""
    return F.coalesce(*(F.when(F.col("flags")[m], F.lit(m)) for m in order), F.lit("none"))


def attribute(flags: DataFrame, order: list[str]) -> DataFrame:
    """(iid, phenotype, source): each person is attributed once, in order of priority."""
    wide = flags.groupBy("iid", "phenotype").agg(F.map_from_entries(F.collect_list(F.struct("model", "high"))).alias("flags"))
    return wide.select("iid", "phenotype", first_flagged(order).alias("source"))


def sankey(flags: DataFrame, markers: DataFrame, order: list[str]) -> DataFrame:
    """(source, target, value): of cases whose clinical flag is 0, the model that finds them first, or none."""
    missed = flags.filter(is_case()).join(markers.filter("flag = 0").select("iid"), "iid", "left_semi")
    return attribute(missed, order).groupBy("source").agg(F.count("*").alias("value")).select(F.lit("clinical_low").alias("source"), F.col("source").alias("target"), "value")


def crosstab(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Counts with margins; the margins are 'all'."""
    total = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c).cast("string")).alias(c)
    return frame.cube(a, b).agg(F.count("*").alias("n"), total(a).alias("x"), total(b).alias("y")).select(F.col("x").alias(a), F.col("y").alias(b), "n")


def marker_by_bin(frame: DataFrame, marker: str, by: list[str]) -> DataFrame:
    m = F.col(marker)
    return frame.groupBy(*by).agg(F.avg(m).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"), F.stddev_samp(m).alias("sd"), F.count(m).alias("n"))


def venn(sets: DataFrame, names: list[str]) -> DataFrame:
    """(mask, n): how many features are in just these sets; bit i stands for names[i]."""
    bit = F.element_at(F.create_map(*(x for i, s in enumerate(names) for x in (F.lit(s), F.lit(1 << i)))), F.col("model"))
    return sets.filter(F.col("model").isin(names)).groupBy("feature").agg(F.bit_or(bit).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def with_total(counts: DataFrame, label: str, value: str) -> DataFrame:
    """counts and a last row 'total'."""
    return counts.unionByName(counts.agg(F.sum(value).alias(value)).withColumn(label, F.lit("total")))


def cumulative_share(frame: DataFrame, order: str, value: str) -> DataFrame:
    """Running share of value along order, over a table of the size of a histogram."""
    w = Window.orderBy(order)
    return frame.withColumn("share", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy()))


def flagged_models(flags: DataFrame) -> DataFrame:
    """(iid, n_models): in how many models a person is high."""
    return flags.groupBy("iid").agg(count_if(F.col("high")).alias("n_models"))


def top_model(scores: DataFrame, order: list[str], value: str) -> DataFrame:
    """(iid, model): the model with a person's highest value; the first in order wins ties."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return scores.groupBy("iid").agg(F.max_by("model", F.struct(F.col(value).alias("v"), (-place).alias("p"))).alias("model"))


def attributed_prevalence(people: DataFrame, by: str = "bin") -> DataFrame:
    """By bin: people, cases, prevalence, and the shares of cases with a high score, a high marker, or neither.

    people: (bin, phenotype, high, flag).
    """
    case, high, flag = is_case(), F.col("high"), F.coalesce(F.col("flag") == 1, F.lit(False))
    n = people.groupBy(by).agg(F.count("*").alias("n"), count_if(case).alias("cases"), count_if(case & high).alias("by_score"), count_if(case & ~high & flag).alias("by_marker"), count_if(case & ~high & ~flag).alias("by_neither"))
    return n.withColumn("prevalence", ratio(F.col("cases"), F.col("n")))
