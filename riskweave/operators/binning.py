"""Quantile bins with trained edges, statistics of bins, and their transfer to other people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if, ratio
from .evaluation import below

#: Edges are searched in blocks of so many.
_STEP = 32


def quantiles(rows: DataFrame, value: str, points: list[float] | int, by: list[str]) -> DataFrame:
    """by, q: exact quantiles at the points (or at 0, 1/n .. 1 for a number n), interpolated between neighbours, nulls left out.

    From the counts of distinct values, summed in ranges, so no task orders all values of a group.
    """
    keys = by or ["__all"]
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    v = (F.col(value).cast("double") + F.lit(0.0)).alias("value")  # -0.0 is 0.0
    ranked = below(rows.filter(F.col(value).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("n")), keys, ["n"])
    start, stop, last = F.col("n_below"), F.col("n_below") + F.col("n"), F.col("n_all") - 1
    if isinstance(points, int):  # the few that may lie here
        at = lambda i: F.floor(i * points / F.greatest(last, F.lit(1)))
        near, point = F.sequence(F.greatest(at(start - 1) - 1, F.lit(0)), F.least(at(stop) + 1, F.lit(points))), lambda i: i / F.lit(float(points))
    else:
        near, point = F.array(*(F.lit(i).cast("long") for i in range(len(points)))), lambda i: F.element_at(F.array(*map(F.lit, points)), (i + 1).cast("int"))
    here = lambda x: (x >= start) & (x < stop)
    met = ranked.select(*keys, "value", "n_all", "n_below", "n", F.explode(F.filter(near, lambda i: here(F.floor(point(i) * last)) | here(F.ceil(point(i) * last)))).alias("i"))
    x = point(F.col("i")) * last
    side = lambda c: F.max(F.when(here(c), F.col("value")))
    ends = met.groupBy(*keys, "i", "n_all").agg(side(F.floor(x)).alias("lo"), side(F.ceil(x)).alias("hi"))
    equal = F.col("lo") == F.col("hi")  # their weighted sum might be a bit less or more, and an edge miss the rows that it equals
    q = F.when((F.floor(x) == F.ceil(x)) | equal, F.col("lo")).otherwise((F.ceil(x) - x) * F.col("lo") + (x - F.floor(x)) * F.col("hi"))
    got = ends.select(*keys, F.struct("i", q.alias("q")).alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("ps"))  # one short list for each group
    return got.select(*by, F.col("ps.q").alias("q"))


def quantile_edges(scores: DataFrame, value: str, n: int, by: list[str]) -> DataFrame:
    """by, edges: inner quantiles that bins end at. The outermost take part when equal edges are merged, then fall away."""
    all_edges = quantiles(scores, value, n, by).select(*by, F.array_sort(F.array_distinct("q")).alias("e"))
    return all_edges.select(*by, F.expr("filter(e, x -> x > e[0] and x < e[size(e) - 1])").alias("edges"), F.col("e")[0].alias("low"), F.element_at("e", -1).alias("high"))


def bin_of(value: Column, edges: Column) -> Column:
    """1 + the number of edges below the value; what lies outside goes to the first or last bin. Two short searches."""
    v = value.cast("double") + F.lit(0.0)  # -0.0 is 0.0
    below = F.size(F.filter(edges, lambda e, i: (i % _STEP == 0) & (e < v)))
    start = F.greatest(below - 1, F.lit(0)) * _STEP
    return (1 + start + F.size(F.filter(F.slice(edges, start + 1, F.lit(_STEP)), lambda e: e < v))).cast("int")


def qcut(scores: DataFrame, value: str, n: int, by: list[str], out: str = "bin") -> DataFrame:
    """Right-closed quantile bins 1 to n. The edges, one row for each `by`, are joined back."""
    return transfer(scores, quantile_edges(scores, value, n, by), value, by, out)


def transfer(scores: DataFrame, edges: DataFrame, value: str, by: list[str], out: str = "bin") -> DataFrame:
    """Bins of other people by trained edges. Edges are one short row for each `by` (a model), so they go to the scores."""
    return scores.join(F.broadcast(edges.select(*by, "edges")), by).withColumn(out, bin_of(F.col(value), F.col("edges"))).drop("edges")


def prevalence(binned: DataFrame, by: list[str]) -> DataFrame:
    """Share of cases in each bin."""
    case = (F.col("phenotype") == 2).cast("long")
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum(case).alias("cases"), (F.sum(case).cast("double") / F.count("*")).alias("prevalence"))


def bin_statistics(binned: DataFrame, value: str, n_bins: int, by: str = "model") -> DataFrame:
    """Every bin of 1 to n_bins, also empty ones: ends and mean of the score, cases, controls, rate, odds against all, percentiles."""
    case = F.col("phenotype") == 2
    stats = binned.groupBy(by, "bin").agg(F.min(value).alias("min_score"), F.max(value).alias("max_score"), F.avg(F.col(value).cast("double")).alias("mean_score"), count_if(case).alias("cases"), count_if(~case).alias("controls"), F.count("*").alias("total"))
    overall = binned.groupBy(by).agg(F.avg(case.cast("double")).alias("overall"))
    every = overall.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n_bins))))
    full = every.join(stats, [by, "bin"], "left").fillna(0, ["cases", "controls", "total"])
    rate = ratio(F.col("cases"), F.col("total"))
    inside = (F.col("rate") > 0) & (F.col("rate") < 1) & (F.col("overall") > 0) & (F.col("overall") < 1)
    odds = F.col("rate") / (1 - F.col("rate")) / (F.col("overall") / (1 - F.col("overall")))
    return full.withColumn("rate", rate).select(
        by, "bin", "min_score", "max_score", "mean_score", "cases", "controls", "total", "rate", F.when(inside, odds).alias("or_bin"),
        (F.col("bin") / F.lit(float(n_bins)) * 100).alias("percentile_min"), F.col("overall"),
    )


def flag_bins(people: DataFrame, stats: DataFrame, high: int, by: str = "model") -> DataFrame:
    """case_bin: the bin's rate is above the overall one; high_risk: the bin is at or above `high`."""
    rates = stats.select(by, "bin", (F.coalesce(F.col("rate") > F.col("overall"), F.lit(False))).alias("case_bin"))
    return people.join(F.broadcast(rates), [by, "bin"], "left").withColumn("case_bin", F.coalesce("case_bin", F.lit(False))).withColumn("high_risk", F.col("bin") >= high)


def composite(flagged: DataFrame, order: list[str], value: str, high: int, share: float = 0.6) -> DataFrame:
    """One bin for each person out of several models: the highest if any is high-risk or over `share` are case bins, else the lowest.

    The score is that of the model chosen; the first in `order` wins ties. A person without any bin has nulls.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    pick = F.struct("bin", (-place).alias("place"), "model", F.col(value).alias("value"))
    low = F.struct("bin", place.alias("place"), "model", F.col(value).alias("value"))
    known = F.col("bin").isNotNull()
    agg = flagged.filter(F.col("model").isin(order)).groupBy("iid", "phenotype").agg(
        F.max(F.when(known, pick)).alias("top"), F.min(F.when(known, low)).alias("bottom"), F.max("high_risk").alias("any_high"), F.avg(F.when(known, F.col("case_bin").cast("double"))).alias("cases")
    )
    up = F.col("any_high") | (F.col("cases") > share)
    part = lambda f: F.when(up, F.col(f"top.{f}")).otherwise(F.col(f"bottom.{f}"))
    return agg.select("iid", "phenotype", part("bin").alias("bin"), part("model").alias("model"), part("value").alias("value"), (part("bin") >= high).alias("combined_high"))


def limits(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, bin, lo, hi (one decimal) of each bin of trained edges."""
    all_edges = F.concat(F.array("low"), F.col("edges"), F.array("high"))
    rows = edges.select(*by, all_edges.alias("e"), F.posexplode(F.slice(all_edges, F.lit(1), F.size(all_edges) - 1)).alias("i", "lo"))
    return rows.select(*by, (F.col("i") + 1).alias("bin"), F.round("lo", 1).alias("lo"), F.round(F.expr("e[i + 1]"), 1).alias("hi"))


def rank_bins(scores: DataFrame, value: str, n: int, by: list[str], out: str = "bin") -> DataFrame:
    """n bins by rank, ties by id: for scores with fewer distinct values than bins. Counts of distinct values stand for a sort of all rows."""
    counts = below(scores.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n")), by, ["n"])
    counts = counts.select(*by, F.col("value").alias(value), F.col("n_below").alias("__before"), F.col("n_all").alias("__n"))
    inside = F.row_number().over(Window.partitionBy(*by, value).orderBy("iid"))
    ranked = scores.join(counts, [*by, value]).withColumn("__r", F.col("__before") + inside)
    return ranked.withColumn(out, F.ceil(F.col("__r") * n / F.col("__n")).cast("int")).drop("__before", "__n", "__r")
