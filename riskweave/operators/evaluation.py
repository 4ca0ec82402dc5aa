"""Model evaluation: ROC, rank AUC, DeLong, agreement, reclassification, calibration, pseudo R-squared, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import count_if, ratio, wilson


def histogram(scores: DataFrame, value: str, by: list[str], y: str = "y") -> DataFrame:
    """by, value, cases, controls: all that rank statistics need, however many rows tie."""
    return scores.groupBy(*by, F.col(value).alias("value")).agg(F.sum(F.col(y).cast("long")).alias("cases"), F.sum(1 - F.col(y).cast("long")).alias("controls"))


def below(h: DataFrame, by: list[str], counts: list[str], ranges: int = 256) -> DataFrame:
    """h (by, value, counts) with <count>_below: sums over smaller values, and <count>_all.

    Values are dealt to even ranges; sums run within a range, and over the ranges' totals, so no task orders a whole group.
    """
    ends = h.groupBy(*by).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"), *(F.sum(c).alias(f"{c}_all") for c in counts))
    slot = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (ranges - 1))).otherwise(0).cast("int")
    dealt = h.join(F.broadcast(ends), by).withColumn("__slot", slot).drop("__lo", "__hi")
    totals = dealt.groupBy(*by, "__slot").agg(*(F.sum(c).alias(f"__{c}") for c in counts))
    order = Window.partitionBy(*by).orderBy("__slot")
    totals = totals.select(*by, "__slot", *((F.sum(f"__{c}").over(order) - F.col(f"__{c}")).alias(f"__{c}") for c in counts))
    inside = Window.partitionBy(*by, "__slot").orderBy("value")
    rows = dealt.join(F.broadcast(totals), [*by, "__slot"])
    return rows.withColumns({f"{c}_below": F.col(f"__{c}") + F.sum(c).over(inside) - F.col(c) for c in counts}).drop("__slot", *(f"__{c}" for c in counts))


def rank_auc(scores: DataFrame, value: str, by: list[str], y: str = "y") -> DataFrame:
    """AUC by counts below, half of ties: sums over the ordered histogram of distinct scores."""
    h = below(histogram(scores, value, by, y), by, ["controls"])
    h = h.withColumn("wins", F.col("cases") * (F.col("controls_below") + F.col("controls") / 2))
    return h.groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("cases").alias("p"), F.sum("controls").alias("q")).select(*by, ratio(F.col("wins"), F.col("p") * F.col("q")).alias("auc"))


def roc_sweep(scores: DataFrame, value: str, steps: int, by: str = "model", y: str = "y") -> DataFrame:
    """(by, step, tpr, fpr, youden): steps even thresholds between the ends of the score; a row is positive above the threshold."""
    v = F.col(value).cast("double")
    ends = scores.groupBy(by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    # number of thresholds lo + (hi - lo) * k / steps, k = 0 .. steps - 1, below the value
    share = F.when(F.col("hi") > F.col("lo"), F.ceil(F.round((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * steps, 9))).otherwise(0)
    counts = scores.join(F.broadcast(ends), by).withColumn("below", share.cast("int")).groupBy(by, "below").agg(F.sum(F.col(y).cast("long")).alias("cases"), F.sum(1 - F.col(y).cast("long")).alias("controls"))
    every = counts.select(by).distinct().withColumn("below", F.explode(F.sequence(F.lit(1), F.lit(steps)))).join(counts, [by, "below"], "full").fillna(0, ["cases", "controls"])
    down = Window.partitionBy(by).orderBy(F.desc("below")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    tpr = F.sum("cases").over(down).cast("double") / F.sum("cases").over(whole)
    fpr = F.sum("controls").over(down).cast("double") / F.sum("controls").over(whole)
    rates = every.withColumn("tpr", tpr).withColumn("fpr", fpr).filter("below > 0")
    return rates.select(by, F.col("below").alias("step"), "tpr", "fpr", (F.col("tpr") - F.col("fpr")).alias("youden"))


def placements(scores: DataFrame, value: str, y: str = "y") -> DataFrame:
    """(iid, model, y, placement): the share of the other class that a row beats, ties half, from counts of distinct scores."""
    h = below(histogram(scores, value, ["model"], y), ["model"], ["cases", "controls"])
    low = lambda c: (F.col(f"{c}_below") + F.col(c) / 2) / F.col(f"{c}_all")
    h = h.select("model", "value", low("controls").alias("beats_controls"), (1 - low("cases")).alias("beaten_by"))
    rows = scores.select("iid", "model", F.col(y).alias("y"), F.col(value).alias("value")).join(h, ["model", "value"])
    return rows.select("iid", "model", "y", F.when(F.col("y") == 1, F.col("beats_controls")).otherwise(F.col("beaten_by")).alias("placement"))


def delong(scores: DataFrame, value: str, pairs: list[tuple[str, str]], y: str = "y") -> DataFrame:
    """(model1, model2, auc1, auc2, var1, var2, cov, z) of each pair, by midranks; variances divide by n - 1."""
    models = sorted({m for p in pairs for m in p})
    wide = placements(scores, value, y).groupBy("iid", "y").pivot("model", models).agg(F.first("placement"))
    named = F.explode(F.array(*(F.struct(F.lit(a).alias("model1"), F.lit(b).alias("model2"), F.col(f"`{a}`").alias("v1"), F.col(f"`{b}`").alias("v2")) for a, b in pairs)))
    rows = wide.select("y", named.alias("r")).select("y", "r.*")
    per = rows.groupBy("model1", "model2", "y").agg(F.count("*").alias("n"), F.avg("v1").alias("m1"), F.avg("v2").alias("m2"), F.var_samp("v1").alias("s1"), F.var_samp("v2").alias("s2"), F.covar_samp("v1", "v2").alias("c"))
    pick = lambda c, k: F.max(F.when(F.col("y") == k, F.col(c)))
    both = lambda c: pick(c, 1) / pick("n", 1) + pick(c, 0) / pick("n", 0)
    out = per.groupBy("model1", "model2").agg(pick("m1", 1).alias("auc1"), pick("m2", 1).alias("auc2"), both("s1").alias("var1"), both("s2").alias("var2"), both("c").alias("cov"))
    spread = F.col("var1") + F.col("var2") - 2 * F.col("cov")
    return out.withColumn("z", F.when(spread > 1e-15, (F.col("auc1") - F.col("auc2")) / F.sqrt(spread)))


def auc_bounds(scores: DataFrame, value: str, y: str = "y", z: float = 1.96) -> DataFrame:
    """(model, auc, ci_low, ci_high) by DeLong's variance, bounds within [0, 1]."""
    per = placements(scores, value, y).groupBy("model", "y").agg(F.avg("placement").alias("m"), F.var_samp("placement").alias("s"), F.count("*").alias("n"))
    both = per.groupBy("model").agg(F.max(F.when(F.col("y") == 1, F.col("m"))).alias("auc"), F.sum(F.col("s") / F.col("n")).alias("var"))
    half = z * F.sqrt("var")
    return both.select("model", "auc", F.greatest(F.col("auc") - half, F.lit(0.0)).alias("ci_low"), F.least(F.col("auc") + half, F.lit(1.0)).alias("ci_high"))


def all_tests(tests: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(model1, model2, test, value): the named statistics of several comparisons of the same pairs, one below the other."""
    out = None
    for name, (frame, column) in tests.items():
        rows = frame.select("model1", "model2", F.lit(name).alias("test"), F.col(column).cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_p(frame: DataFrame, name: str, columns: list[str], fn) -> DataFrame:
    """A p-value column from a Python function, for frames of one row per comparison."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f[name] = [None if any(x is None or isinstance(x, float) and math.isnan(x) for x in v) else fn(*v) for v in f[columns].itertuples(index=False)]
            yield f

    return frame.mapInPandas(rows, ", ".join(f"`{c}` {t}" for c, t in frame.dtypes) + f", `{name}` double")


def classification(probs: DataFrame, p: str = "p", y: str = "y", by: str = "model", cut: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy, F1, MCC, Jaccard, Hamming loss and log-loss in one pass."""
    yes, case = F.col(p) > cut, F.col(y) == 1
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    c = probs.groupBy(by).agg(
        count_if(yes & case).alias("tp"), count_if(yes & ~case).alias("fp"), count_if(~yes & ~case).alias("tn"), count_if(~yes & case).alias("fn"),
        F.avg(-F.when(case, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
    )
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.select(
        by, "tp", "fp", "tn", "fn", ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), ((zero(ratio(tp, tp + fn)) + zero(ratio(tn, tn + fp))) / 2).alias("balanced_accuracy"),
        zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), zero(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"),
        zero(ratio(tp, tp + fp + fn)).alias("jaccard"), ((fp + fn) / (tp + fp + tn + fn)).alias("hamming"), "log_loss",
    )


def paired_tables(flags: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(model1, model2, a, b, c, d): people high in both, only the first, only the second, neither. flags: (iid, model, high)."""
    models = sorted({m for p in pairs for m in p})
    wide = flags.groupBy("iid").pivot("model", models).agg(F.max(F.col("high").cast("int")))
    named = F.explode(F.array(*(F.struct(F.lit(a).alias("model1"), F.lit(b).alias("model2"), F.col(f"`{a}`").alias("h1"), F.col(f"`{b}`").alias("h2")) for a, b in pairs)))
    rows = wide.select(named.alias("r")).select("r.*")
    h1, h2 = F.col("h1") == 1, F.col("h2") == 1
    return rows.groupBy("model1", "model2").agg(count_if(h1 & h2).alias("a"), count_if(h1 & ~h2).alias("b"), count_if(~h1 & h2).alias("c"), count_if(~h1 & ~h2).alias("d"))


def mcnemar(tables: DataFrame) -> DataFrame:
    """chi2 with continuity correction; zero where no pair disagrees."""
    b, c = F.col("b"), F.col("c")
    return tables.withColumn("chi2", F.coalesce(ratio((F.abs(b - c) - 1) * (F.abs(b - c) - 1), b + c), F.lit(0.0)))


def agreement(tables: DataFrame) -> DataFrame:
    """Cohen's kappa, Jaccard, discordance and its Wilson bounds."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    po, pe = (a + d) / n, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    low, up = wilson(b + c, n)
    return tables.withColumns({"kappa": ratio(po - pe, 1 - pe), "jaccard": F.coalesce(ratio(a, a + b + c), F.lit(0.0)), "discordance": (b + c) / n, "ci_low": low, "ci_high": up})


def chi2_yates(tables: DataFrame) -> DataFrame:
    """Independence with Yates's correction, that never overshoots."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return tables.withColumn("chi2", ratio(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d)))


def midranks(frame: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """frame with a column of ranks of value, ties averaged, from the counts of distinct values."""
    counts = below(frame.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n")), by, ["n"])
    ranks = counts.select(*by, F.col("value").alias(value), (F.col("n_below") + (F.col("n") + 1) / 2).alias(out))
    return frame.join(ranks, [*by, value])


def paired_scores(frame: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson with Fisher bounds, Spearman, and paired t, by group. Groups are comparisons of people high in either model."""
    ranked = midranks(midranks(frame, x, by, "rx"), y, by, "ry")
    d = F.col(x) - F.col(y)
    s = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.avg(d).alias("md"), F.stddev_samp(d).alias("sd"))
    r, z = F.col("pearson"), 1.96 / F.sqrt(F.col("n") - 3)
    inside = (F.col("n") > 3) & (F.abs(r) < 1)
    return s.select(*by, "n", "pearson", F.when(inside, F.tanh(F.atanh(r) - z)).alias("ci_low"), F.when(inside, F.tanh(F.atanh(r) + z)).alias("ci_high"), "spearman", F.when(F.col("sd") > 0, F.col("md") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def paired(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(phenotype, model1, model2, h1, h2, s1, s2) of each person and pair: by one sum over a person's models, not by joining people with themselves.

    scores: (iid, phenotype, model, high, scaled_prs).
    """
    models = sorted({m for p in pairs for m in p})
    wide = scores.groupBy("iid", "phenotype").pivot("model", models).agg(F.max("high").alias("h"), F.max("scaled_prs").alias("s"))
    named = F.explode(F.array(*(F.struct(F.lit(a).alias("model1"), F.lit(b).alias("model2"), F.col(f"`{a}_h`").alias("h1"), F.col(f"`{b}_h`").alias("h2"), F.col(f"`{a}_s`").alias("s1"), F.col(f"`{b}_s`").alias("s2")) for a, b in pairs)))
    return wide.select("phenotype", named.alias("r")).select("phenotype", "r.*")


def reclassification(flags: DataFrame, scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Net reclassification from model1 to model2 among cases and controls, its standard error, and integrated discrimination.

    The error divides by n twice, as the published tables do; see the README.
    """
    r = paired(flags.join(scores.select("iid", "model", "scaled_prs"), ["iid", "model"]), pairs)
    case = F.col("phenotype") == 2
    up, down = F.col("h2") > F.col("h1"), F.col("h2") < F.col("h1")
    mean = lambda c, k: F.avg(F.when(k, F.col(c)))
    g = r.groupBy("model1", "model2").agg(
        count_if(case & up).alias("case_up"), count_if(case & down).alias("case_down"), count_if(~case & up).alias("control_up"), count_if(~case & down).alias("control_down"),
        count_if(case).alias("n1"), count_if(~case).alias("n0"), (mean("s2", case) - mean("s2", ~case) - mean("s1", case) + mean("s1", ~case)).alias("idi"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    events, others = (F.col("case_up") - F.col("case_down")) / n1, (F.col("control_down") - F.col("control_up")) / n0
    se = F.sqrt((F.col("case_up") + F.col("case_down")) / n1 / n1 + (F.col("control_up") + F.col("control_down")) / n0 / n0)
    return g.select("model1", "model2", "case_up", "case_down", "control_up", "control_down", events.alias("nri_cases"), others.alias("nri_controls"), (events + others).alias("nri"), se.alias("se"), "idi")


def nri_attribution(sources: DataFrame, markers: DataFrame, flags: DataFrame) -> DataFrame:
    """Cases a clinical flag misses but a model finds, by the first model that does; controls freed from the clinical flag.

    sources: (iid, phenotype, source); markers: (iid, flag); flags: (iid, high) for the combined score.
    """
    rows = sources.join(markers.filter("flag is not null").select("iid", "flag"), "iid").join(flags.select("iid", "high"), "iid")
    case = F.col("phenotype") == 2
    totals = rows.agg(count_if(case).alias("n1"), count_if(~case).alias("n0"), count_if(~case & (F.col("flag") == 1) & ~F.col("high")).alias("freed"))
    by = rows.groupBy("source").agg(count_if(case & (F.col("flag") == 0) & F.col("high")).alias("found"), count_if(F.col("high")).alias("high"))
    whole = Window.partitionBy()
    return by.join(F.broadcast(totals)).select(
        "source", "found", ratio(F.col("found"), F.col("n1")).alias("nri_plus"),
        (ratio(F.col("freed"), F.col("n0")) * ratio(F.col("high"), F.sum("high").over(whole))).alias("nri_minus"),
    )


def calibration(probs: DataFrame, edges: DataFrame, by: str = "model") -> DataFrame:
    """Observed and expected by bins of the probability, Brier score and Hosmer-Lemeshow terms. edges: trained inner edges."""
    from .binning import transfer

    binned = transfer(probs, edges, "p", [by])
    return binned.groupBy(by, "bin").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("observed"), F.sum("p").alias("expected"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def hosmer_lemeshow(bins: DataFrame, by: str = "model") -> DataFrame:
    o, e, n = F.col("observed"), F.col("expected"), F.col("n").cast("double")
    term = ratio((o - e) * (o - e), e * (1 - e / n))
    return bins.groupBy(by).agg(F.sum(term).alias("chi2"), (F.count("*") - 2).alias("df"), (F.sum(F.col("brier") * n) / F.sum(n)).alias("brier"))


def pseudo_r2(probs: DataFrame, by: str = "model") -> DataFrame:
    """McFadden, Cox-Snell, Nagelkerke and Tjur from one pass; probabilities are clipped at 1e-15."""
    q = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    case = F.col("y") == 1
    s = probs.groupBy(by).agg(
        F.sum(F.when(case, F.log(q)).otherwise(F.log(1 - q))).alias("ll"), F.count("*").cast("double").alias("n"), F.avg(F.col("y").cast("double")).alias("r"),
        (F.avg(F.when(case, F.col("p"))) - F.avg(F.when(~case, F.col("p")))).alias("tjur"),
    )
    n, r = F.col("n"), F.col("r")
    s = s.withColumn("ll0", n * (r * F.log(r) + (1 - r) * F.log(1 - r)))
    cox = 1 - F.exp(2 * (F.col("ll0") - F.col("ll")) / n)
    return s.select(by, (1 - F.col("ll") / F.col("ll0")).alias("mcfadden"), cox.alias("cox_snell"), (cox / (1 - F.exp(2 * F.col("ll0") / n))).alias("nagelkerke"), "tjur")


def fisher_p(tables: DataFrame) -> DataFrame:
    return with_p(tables, "fisher_p", ["a", "b", "c", "d"], lambda *v: stats.fisher_exact(*map(int, v)))


def overlap_p(tables: DataFrame) -> DataFrame:
    """Observed over expected overlap, and the chance of one no larger."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    rated = tables.withColumn("overlap_ratio", ratio(a * n, (a + b) * (a + c)))
    return with_p(rated, "overlap_p", ["a", "b", "c", "d"], lambda a, b, c, d: stats.hypergeom_cdf(int(a), int(a + b + c + d), int(a + c), int(a + b)))


def tjur_gaps(probs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(model1, model2, tjur1, tjur2, gap): Tjur's R-squared of two models, from one pass over the probabilities."""
    per = probs.groupBy("model").agg((F.avg(F.when(F.col("y") == 1, F.col("p"))) - F.avg(F.when(F.col("y") == 0, F.col("p")))).alias("tjur"))
    wide = per.agg(F.map_from_entries(F.collect_list(F.struct("model", "tjur"))).alias("t"))  # a row for each model
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("model1"), F.lit(b).alias("model2"), F.col("t")[a].alias("tjur1"), F.col("t")[b].alias("tjur2")) for a, b in pairs))).alias("r")
    return wide.select(each).select("r.*").withColumn("gap", F.col("tjur1") - F.col("tjur2"))


def nri_by_measure(measures: DataFrame, flags: DataFrame, by: str, value: str, quantile: float = 0.8) -> DataFrame:
    """For each measure, net reclassification from its own flag (above the quantile) to another's. flags: (iid, phenotype, high)."""
    from .binning import quantiles

    cuts = quantiles(measures, value, [quantile], [by]).select(by, F.col("q")[0].alias("cut"))  # a row for each measure
    rows = measures.join(F.broadcast(cuts), by).join(flags, "iid")
    case, flag, high = F.col("phenotype") == 2, F.col(value) > F.col("cut"), F.col("high")
    g = rows.groupBy(by).agg(
        count_if(case & high & ~flag).alias("case_up"), count_if(case & flag & ~high).alias("case_down"), count_if(~case & high & ~flag).alias("control_up"), count_if(~case & flag & ~high).alias("control_down"),
        count_if(case).alias("n1"), count_if(~case).alias("n0"),
    )
    cases, controls = ratio(F.col("case_up") - F.col("case_down"), F.col("n1")), ratio(F.col("control_down") - F.col("control_up"), F.col("n0"))
    return g.select(by, "case_up", "case_down", "control_up", "control_down", cases.alias("nri_cases"), controls.alias("nri_controls"), (cases + controls).alias("nri"))


def any_of(flags: DataFrame, models: list[str], name: str) -> DataFrame:
    """flags and one more model, high where any of the listed ones is."""
    more = flags.filter(F.col("model").isin(models)).groupBy("iid", "phenotype").agg(F.max("high").alias("high")).withColumn("model", F.lit(name))
    return flags.select("iid", "phenotype", "model", "high").unionByName(more)


def nri_proportions(tables: DataFrame) -> DataFrame:
    """Net reclassification by shares that move up and down: (model1, model2, phenotype, up, down, n) to events and non-events."""
    share = (F.col("up") - F.col("down")).cast("double") / F.col("n")
    out = tables.groupBy("model1", "model2").agg(F.max(F.when(F.col("phenotype") == 2, share)).alias("events"), F.max(F.when(F.col("phenotype") == 1, -share)).alias("non_events"))
    return out.withColumn("nri", F.col("events") + F.col("non_events"))


def moves(flags: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(model1, model2, phenotype, up, down, n): how many of a class the second model newly finds or loses."""
    models = sorted({m for p in pairs for m in p})
    wide = flags.groupBy("iid", "phenotype").pivot("model", models).agg(F.max(F.col("high").cast("int")))
    named = F.explode(F.array(*(F.struct(F.lit(a).alias("model1"), F.lit(b).alias("model2"), (F.col(f"`{b}`") - F.col(f"`{a}`")).alias("move")) for a, b in pairs)))
    rows = wide.select("phenotype", named.alias("r")).select("phenotype", "r.*")
    return rows.groupBy("model1", "model2", "phenotype").agg(count_if(F.col("move") > 0).alias("up"), count_if(F.col("move") < 0).alias("down"), F.count("*").alias("n"))
