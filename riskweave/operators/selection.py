"""Feature selection: ranks, thresholds, linkage pruning, non-additivity, annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import members, pair_key


def first_pairs(pairs: DataFrame) -> DataFrame:
    """(line, snp1, snp2) that are the first of their unordered pair, by line."""
    key = pair_key(F.col("snp1"), F.col("snp2"))
    return pairs.groupBy(key.alias("key")).agg(F.min_by(F.struct("line", "snp1", "snp2"), "line").alias("r")).select("r.*")


def reversed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose reverse is there too."""
    other = pairs.select(F.col("snp1").alias("snp2"), F.col("snp2").alias("snp1")).distinct()
    return pairs.join(other, ["snp1", "snp2"], "left_semi")


def rank_shap(contributions: DataFrame, threshold: float | None = None, value: str = "shap") -> DataFrame:
    """feature, mean_shap, shap_zscore: means over rows, features without any effect dropped, z over features (population)."""
    means = contributions.groupBy("feature").agg(F.avg(value).alias("mean_shap"), F.max(F.abs(value)).alias("most")).filter("most > 0").drop("most")
    z = means.agg(F.avg("mean_shap").alias("m"), F.stddev_pop("mean_shap").alias("s"))
    out = means.join(F.broadcast(z)).withColumn("shap_zscore", (F.col("mean_shap") - F.col("m")) / F.col("s")).drop("m", "s")
    return out.filter(F.abs("shap_zscore") > threshold) if threshold is not None else out


def two_sided(frame: DataFrame, column: str, threshold: float) -> DataFrame:
    return frame.filter((F.col(column) > threshold) | (F.col(column) < -threshold))


def linear_shap(rows: DataFrame, weights: DataFrame, means: DataFrame) -> DataFrame:
    """Exact contributions of a linear model: coefficient times (value less mean)."""
    return rows.join(weights, "feature").join(means, "feature").withColumn("shap", F.col("coef") * (F.col("x") - F.col("mean")))


def label_interactions(scores: DataFrame, threshold: float) -> DataFrame:
    """main_e (0, 1 at an end of the ranking, 2 beyond the threshold) and epistatic, within each environment.

    scores: (env_type, name, z, genetic); an environment's own row has a null genetic, a gene's row its own name. A row
    with a genetic part is epistatic where it outranks that part, or where that part doesn't outrank the environment.
    """
    w = Window.partitionBy("env_type").orderBy(F.desc("z"), "name")
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("env_type")))
    env = ranked.filter("genetic is null").select("env_type", F.col("rank").alias("env_rank"))
    genes = ranked.filter("genetic = name").select("env_type", F.col("name").alias("genetic"), F.col("rank").alias("genetic_rank"))
    both = ranked.join(genes, ["env_type", "genetic"], "left").join(env, "env_type", "left")
    main = F.when(F.col("genetic").isNotNull(), 0).when(F.abs("z") > threshold, 2).when((F.col("rank") == 1) | (F.col("rank") == F.col("n")), 1).otherwise(0)
    pair = F.col("genetic").isNotNull() & (F.col("genetic") != F.col("name"))
    epistatic = pair & F.coalesce((F.col("rank") < F.col("genetic_rank")) | (F.col("genetic_rank") >= F.col("env_rank")), F.lit(False))
    return both.select("env_type", "name", "z", "genetic", F.coalesce(main, F.lit(0)).alias("main_e"), epistatic.cast("int").alias("epistatic"))


def rank_gxe(labelled: DataFrame, threshold: float) -> DataFrame:
    """Averages of repeats; interactions need |z| above the threshold, main effects stay; rows without a genetic key are main."""
    kept = labelled.filter("main_e in (0, 1)")
    means = kept.filter("genetic is not null").groupBy("name", "env_type", "epistatic", "main_e").agg(F.avg("z").alias("z"))
    mains = kept.filter("genetic is null").groupBy("name", "env_type", "epistatic", "main_e").agg(F.avg("z").alias("z"))
    return two_sided(means, "z", threshold).unionByName(mains.filter("main_e = 1"))


def symmetric(edges: DataFrame, least: float = 0.6) -> DataFrame:
    e = edges.filter(F.col("r2") > least)
    return e.select("snp_a", "snp_b").unionByName(e.select(F.col("snp_b").alias("snp_a"), F.col("snp_a").alias("snp_b"))).distinct()


def ld_prune(features: DataFrame, edges: DataFrame, score: str, least: float = 0.6, by_abs: bool = False) -> DataFrame:
    """Features to drop: around each anchor its partners in linkage form a star, of which only the best score stays."""
    e = edges.filter(F.col("r2") > least).select("snp_a", "snp_b").distinct()
    e = e.join(features.select(F.col("feature").alias("snp_a")), "snp_a", "left_semi").join(features.select(F.col("feature").alias("snp_b")), "snp_b", "left_semi")
    stars = e.select("snp_a", F.col("snp_b").alias("feature")).unionByName(e.select("snp_a", F.col("snp_a").alias("feature"))).distinct()
    s = F.abs(score) if by_abs else F.col(score)
    best = Window.partitionBy("snp_a").orderBy(F.desc("s"), "feature")
    ranked = stars.join(features.select("feature", s.alias("s")), "feature").withColumn("rank", F.row_number().over(best))
    return ranked.filter("rank > 1").select("feature").distinct()


def ld_prune_pairs(pairs: DataFrame, edges: DataFrame, score: str, least: float = 0.6) -> DataFrame:
    """Pairs to drop: another pair has a better score (first name on ties) and all four cross combinations are in linkage."""
    e = symmetric(edges, least)
    parts = pairs.select("feature", F.col(score).alias("s"), F.explode(members(F.col("feature"))).alias("m"))
    crossed = parts.alias("x").join(e, F.col("x.m") == F.col("snp_a")).join(parts.alias("y"), F.col("y.m") == F.col("snp_b"))
    full = crossed.filter("x.feature <> y.feature").groupBy(F.col("x.feature").alias("feature"), F.col("x.s").alias("s"), F.col("y.feature").alias("other"), F.col("y.s").alias("t")).agg(F.count("*").alias("n")).filter("n = 4")
    return full.filter("t > s or (t = s and other < feature)").select("feature").distinct()


def non_additive(scores: DataFrame) -> DataFrame:
    """Names of environment interactions to drop: not further out, on the same side, than all of the pair's own coefficients.

    scores: (model, feature, coefs). Interactions are those of model cardio; the pair's name is what follows the first comma.
    """
    cut = F.expr("substring(feature, instr(feature, ',') + 1)")
    own = scores.filter(F.col("model") == "cardio").select("feature", F.col("coefs").alias("e"), cut.alias("pair"))
    genetic = scores.filter(F.col("model").isin("main", "epi", "epi+main")).groupBy(F.col("feature").alias("pair")).agg(F.max("coefs").alias("hi"), F.min("coefs").alias("lo"))
    e, hi, lo = F.col("e"), F.col("hi"), F.col("lo")
    drop = F.when(e > 0, (hi <= 0) | (e <= hi)).otherwise((lo >= 0) | (e >= lo))
    return own.join(genetic, "pair").filter(drop).select("feature").distinct()


def opposite_sign(z: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(cohort, feature, z): above the threshold in its own cohort, below zero in every other, of which there is one at least."""
    w = Window.partitionBy("feature")
    n = z.withColumn("cohorts", F.count("*").over(w)).withColumn("negative", F.sum((F.col("z") < 0).cast("int")).over(w))
    return n.filter((F.col("z") > threshold) & (F.col("cohorts") > 1) & (F.col("negative") == F.col("cohorts") - 1)).select("cohort", "feature", "z")


def dropped_models(comparisons: DataFrame, level: float = 0.05, always: str = "epi+main") -> DataFrame:
    """Models to leave out: of pairs that don't differ (p above level), the named one, else the lower AUC."""
    same = comparisons.filter(F.col("p") > level)
    loser = F.when((F.col("model1") == always) | (F.col("model2") == always), F.lit(always)).when(F.col("auc1") < F.col("auc2"), F.col("model1")).otherwise(F.col("model2"))
    return same.select(loser.alias("model")).distinct()


#: What a fitted model has beside its features. Fixed values of the format.
COVARIATES = ["(Intercept)", "age", "SEX", *(f"PC{i}" for i in range(1, 11))]


def without_covariates(scores: DataFrame, models: list[str] | None = None, covariates: list[str] = COVARIATES) -> DataFrame:
    """Coefficients of features proper: no intercept, no covariates, and only of the models named."""
    kept = scores.filter(~F.col("feature").isin(covariates))
    return kept if models is None else kept.filter(F.col("model").isin(models))


def cascade(features: DataFrame, gene_map: DataFrame, known: DataFrame) -> DataFrame:
    """(feature, gene, level, trait): known associations by name, then by locus for what is left, then by gene."""
    mapped = features.join(gene_map, "feature", "left")
    found, rest = None, mapped
    for level, key in (("snp", "feature"), ("locus", "locus"), ("gene", "gene")):
        hits = known.filter(F.col("level") == level).select(F.col("name").alias(key), "level", "trait")
        now = rest.join(hits, key).select("feature", "gene", "level", "trait")
        rest = rest.join(hits.select(key), key, "left_anti")
        found = now if found is None else found.unionByName(now)
    none = rest.select("feature", "gene", F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("trait"))
    return found.unionByName(none).distinct()


def log_odds_table(theta: DataFrame) -> DataFrame:
    """(feature, lp0, lp1) to odds_yes and odds_no, by the ratio of log-probabilities over that of their negated exponentials."""
    yes = (F.col("lp1") / F.col("lp0")) / (F.exp(-F.col("lp1")) / F.exp(-F.col("lp0")))
    no = (F.col("lp0") / F.col("lp1")) / (F.exp(-F.col("lp0")) / F.exp(-F.col("lp1")))
    return theta.withColumn("odds_yes", yes).withColumn("odds_no", no)
