"""Queries of feature assembly, filters, set operations, and of drivers over several comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import assembly as J
from .operators import binning as B
from .operators import clean as C
from .operators import clusters as K
from .operators import epidemiology as A
from .operators import evaluation as V
from .operators import features as X
from .operators import genomics as G
from .operators import models as M
from .operators import plots as D
from .operators import prs as R
from .operators import resampling as Z
from .operators import selection as S
from .queries import PAIRS, SQL, _binned, _bins, _flags, chi2_independence, delong_p_values, delong_pairs, kappa_jaccard_discordance, mcnemar_pairs, nri_idi, overlap_hypergeometric, pearson_spearman_ttest, query, rounded
from .sources.shared import folder, written
from .streaming.scoring import score_pieces, score_stream

# Assembly.


@query("""
    SELECT iid, CAST(snp AS VARCHAR) AS feature, CAST(dosage AS DOUBLE) AS x FROM genotype
    UNION ALL SELECT iid, allele, CAST(CASE WHEN raw < 0.7 THEN 0 WHEN raw < 1.7 THEN 1 ELSE 2 END AS DOUBLE) FROM hla WHERE raw IS NOT NULL AND iid IN (SELECT iid FROM genotype)""")
def dosage_with_hla(v):
    return J.with_alleles(v.genotype, v.hla.select("iid", "allele", C.hard_call(F.col("raw")).alias("call")))


@query("SELECT iid, phenotype, age, sex, round(pc1, 6) AS pc1 FROM participant LEFT JOIN (SELECT * FROM covar WHERE iid % 3 <> 0) c USING (iid)")
def phenotype_covariates(v):
    return rounded(J.with_covariates(v.participant, v.covar.filter("iid % 3 <> 0")).select("iid", "phenotype", "age", "sex", "pc1"), "pc1")


def _parts(v) -> dict[str, DataFrame]:
    return {
        "pair": v.pair_rows, "env": v.env.select("iid", F.col("env_feature").alias("feature"), F.col("value").alias("x")),
        "hla": v.hla.select("iid", F.col("allele").alias("feature"), C.hard_call(F.col("raw")).alias("x")),
    }


_PARTS = """
    SELECT iid, 'pair' AS source, feature, CAST(x AS DOUBLE) AS x FROM pair_rows UNION ALL SELECT iid, 'env', env_feature, value FROM env
    UNION ALL SELECT iid, 'hla', allele, CAST(CASE WHEN raw < 0.7 THEN 0 WHEN raw < 1.7 THEN 1 WHEN raw >= 1.7 THEN 2 END AS DOUBLE) FROM hla"""


@query(f"SELECT iid, split, source, feature, round(x, 6) AS x FROM ({_PARTS}) JOIN split USING (iid)")
def assembled_by_split(v):
    return rounded(J.star(v.split, _parts(v)), "x")


@query(f"""
    SELECT split, source, count(*) AS n, round(sum(x), 3) AS total FROM ({_PARTS} UNION ALL SELECT iid, 'main', CAST(snp AS VARCHAR), CAST(dosage AS DOUBLE) FROM genotype
        UNION ALL SELECT iid, 'gxe', feature, CAST(x AS DOUBLE) FROM gxe_rows UNION ALL SELECT iid, 'covariate', 'age', age FROM covar UNION ALL SELECT iid, 'covariate', 'sex', sex FROM covar
        UNION ALL SELECT iid, 'clinical', 'acctbal', marker FROM clinical) JOIN split USING (iid) GROUP BY split, source""")
def star_of_features(v):
    clinical = v.clinical.select("iid", F.lit("acctbal").alias("feature"), F.col("marker").alias("x"))
    covariates = v.covar.select("iid", "age", "sex").unpivot("iid", ["age", "sex"], "feature", "x")
    rows = J.star(v.split, _parts(v) | {"main": v.main_rows, "gxe": v.gxe_rows, "covariate": covariates, "clinical": clinical})
    return rows.groupBy("split", "source").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total"))


@query("SELECT s.iid, s.split, f.env_feature, round(e.value, 6) AS value FROM split s CROSS JOIN (SELECT DISTINCT env_feature FROM env) f LEFT JOIN env e ON e.iid = s.iid AND e.env_feature = f.env_feature")
def environment_reindexed(v):
    return rounded(J.reindexed(v.split, v.env, "env_feature"), "value")


@query("SELECT iid, phenotype FROM (SELECT DISTINCT iid FROM genotype) JOIN participant USING (iid)")
def strict_labels(v):
    return J.strict_labels(v.genotype.select("iid").distinct(), v.participant)


@query(f"""
    WITH {_bins(10)}, p AS (SELECT model, bin, count(*) AS n, round(CAST(sum(phenotype - 1) AS DOUBLE) / count(*), 6) AS prevalence FROM binned GROUP BY model, bin),
    full_edges AS (SELECT model, list_concat(list_concat([low], edges), [high]) AS e FROM edges)
    SELECT p.model, p.bin, n, prevalence, round(e[p.bin], 1) AS lo, round(e[p.bin + 1], 1) AS hi FROM p JOIN full_edges USING (model)""")
def prevalence_with_limits(v):
    edges = B.quantile_edges(v.prs, "prs100", 10, ["model"])
    shares = B.prevalence(B.transfer(v.prs, edges, "prs100", ["model"]), ["model"]).select("model", "bin", "n", "prevalence")
    return rounded(J.beside(shares, B.limits(edges, ["model"]).withColumn("bin", F.col("bin").cast("int")), ["model", "bin"]), "prevalence")


@query("SELECT f.model, f.feature, f.coefs, s.shap_zscore FROM feature_scores f LEFT JOIN shap s USING (feature)")
def scores_with_shap(v):
    return J.beside(v.feature_scores, v.shap.select("feature", "shap_zscore"), ["feature"]).select("model", "feature", "coefs", "shap_zscore")


@query("SELECT i.feature, i.model, round(i.importance, 6) AS importance, w.coef100 FROM (SELECT feature, 'main' AS model, abs(shap_zscore) AS importance FROM shap) i LEFT JOIN weights w USING (feature, model)")
def importance_with_weights(v):
    importance = v.shap.select("feature", F.lit("main").alias("model"), F.abs("shap_zscore").alias("importance"))
    return rounded(J.beside(importance, v.weights, ["feature", "model"]).select("feature", "model", "importance", "coef100"), "importance")


_TOP = "SELECT iid, arg_max(model, prs100 * 10 - CASE model WHEN 'main' THEN 1 WHEN 'epi' THEN 2 ELSE 3 END) AS cohort FROM prs WHERE model IN ('main', 'epi', 'cardio') GROUP BY iid"


@query(f"SELECT cohort, feature, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM ({_TOP}) JOIN feature_rows USING (iid) GROUP BY cohort, feature")
def cohort_features(v):
    order = ["main", "epi", "cardio"]
    cohorts = A.top_model(v.prs.filter(F.col("model").isin(order)), order, "prs100").withColumnRenamed("model", "cohort")
    return cohorts.join(v.feature_rows, "iid").groupBy("cohort", "feature").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query("SELECT p.iid, p.model, p.prs100, CAST(c.age * 10 + c.sex * 5 AS BIGINT) AS prs100_other FROM prs p LEFT JOIN (SELECT * FROM covar WHERE iid % 7 <> 0) c USING (iid)")
def prs_with_covariate_prs(v):
    covariate = v.covar.filter("iid % 7 <> 0").select("iid", (F.col("age") * 10 + F.col("sex") * 5).cast("long").alias("prs100"))
    return J.beside(v.prs.select("iid", "model", "prs100"), covariate, ["iid"])


@query("SELECT a.iid, a.phenotype, a.prs100, b.prs100 AS prs100_other FROM prs a JOIN prs b ON b.iid = a.iid AND b.phenotype = a.phenotype AND b.model = 'epi' WHERE a.model = 'main'")
def methods_comparison(v):
    one, two = (v.prs.filter(F.col("model") == m).select("iid", "phenotype", "prs100") for m in ("main", "epi"))
    return J.beside(one, two, ["iid", "phenotype"], "inner")


# Filters and cleaning.


@query("SELECT model, feature, coefs FROM feature_scores WHERE feature NOT IN ('(Intercept)', 'age') AND model IN ('main', 'epi', 'cardio')")
def without_covariates(v):
    return S.without_covariates(v.feature_scores, ["main", "epi", "cardio"])


@query("""
    WITH m AS (SELECT quantile_cont(marker, 0.5) AS mid FROM clinical JOIN split USING (iid) WHERE split = 'train' AND marker IS NOT NULL)
    SELECT iid, round(coalesce(marker, mid), 6) AS marker FROM clinical JOIN split USING (iid), m WHERE split = 'test'""")
def median_impute_clinical(v):
    rows = v.clinical.join(v.split.select("iid", "split"), "iid").withColumn("key", F.lit("marker"))
    out = C.median_impute(rows.filter("split = 'test'"), rows.filter("split = 'train'"), ["key"], "marker")
    return rounded(out.select("iid", "marker"), "marker")


@query("WITH e AS (SELECT min(marker) AS lo, max(marker) AS hi FROM clinical) SELECT iid, round((marker - lo) / (hi - lo), 6) AS marker FROM clinical, e")
def min_max_clinical(v):
    return rounded(C.min_max(v.clinical, "marker").select("iid", "marker"), "marker")


@query("""
    SELECT iid, env_feature, CAST(value >= CASE env_feature WHEN 'acctbal' THEN 41 WHEN 'avg_qty' THEN 25 ELSE 12 END AS INTEGER) AS flag
    FROM env WHERE env_feature IN ('acctbal', 'avg_qty', 'n_orders')""")
def clinical_cutoffs(v):
    return C.clinical_flags(v.env, dict(zip(("acctbal", "avg_qty", "n_orders"), C.CUTOFFS.values(), strict=True)))


@query("""
    WITH fit AS (SELECT env_feature, avg(value) AS m FROM env JOIN split USING (iid) WHERE split = 'train' GROUP BY env_feature)
    SELECT iid, env_feature, round(value - m, 6) AS x FROM env JOIN split USING (iid) JOIN fit USING (env_feature) WHERE split <> 'train'""")
def centre_train_apply(v):
    rows = v.env.join(v.split.select("iid", "split"), "iid").withColumnRenamed("value", "x")
    fit = X.fit_scale(rows.filter("split = 'train'"), ["env_feature"])
    return rounded(X.apply_scale(rows.filter("split <> 'train'"), fit, ["env_feature"], centre_only=True).select("iid", "env_feature", "x"), "x")


_HIGH = _bins(10) + ", flags AS (SELECT iid, phenotype, model, prs100, bin > 8 AS high FROM binned)"
_IN = ", ".join(f"max(CASE WHEN model = '{m}' AND high THEN 1 ELSE 0 END) AS in_{m.replace('+', '_')}" for m in ("main", "epi", "cardio", "epi+main"))


@query(f"WITH {_HIGH} SELECT iid, {_IN} FROM flags GROUP BY iid")
def group_columns(v):
    return A.group_columns(_flags(v), ["main", "epi", "cardio", "epi+main"])


# Epidemiology and order.

_SWEEP = """
    t AS (SELECT model, CAST(p AS INTEGER) AS p, CAST(sum(CASE WHEN bin > {n} - p AND phenotype = 2 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN bin > {n} - p AND phenotype = 1 THEN 1 ELSE 0 END) AS BIGINT) AS b,
        CAST(sum(CASE WHEN bin <= {n} - p AND phenotype = 2 THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN bin <= {n} - p AND phenotype = 1 THEN 1 ELSE 0 END) AS BIGINT) AS d FROM binned, (SELECT unnest({p}) AS p) GROUP BY model, p)
    SELECT model, p, a, b, c, d, round(CASE WHEN b * c <> 0 THEN CAST(a * d AS DOUBLE) / (b * c) END, 6) AS odds_ratio FROM t"""


@query(f"WITH {_bins(100)}, {_SWEEP.format(n=100, p='range(1, 21)')}")
def odds_ratio_sweep(v):
    return rounded(A.top_percent_tables(_binned(v, 100), list(range(1, 21))).drop("ci_low", "ci_high"), "odds_ratio")


@query(f"WITH {_bins(1000)}, {_SWEEP.format(n=1000, p='[1, 2, 5, 10, 20, 50, 100, 200]')}")
def odds_ratio_per_mille(v):
    return rounded(A.top_percent_tables(_binned(v, 1000), [1, 2, 5, 10, 20, 50, 100, 200], 1000, of=1000).drop("ci_low", "ci_high"), "odds_ratio")


@query(f"""
    WITH {_bins(100)}, g AS (SELECT model, CAST(ceil(bin * 20 / 100.0) AS INTEGER) AS grp, count(*) AS n, CAST(sum(phenotype - 1) AS BIGINT) AS cases FROM binned GROUP BY 1, 2),
    p AS (SELECT *, CAST(cases AS DOUBLE) / n AS prevalence, 1.96 * sqrt(CAST(cases AS DOUBLE) / n * (1 - CAST(cases AS DOUBLE) / n) / n) AS half FROM g)
    SELECT model, grp, n, cases, round(prevalence, 6) AS prevalence, round(greatest(prevalence - half, 0), 6) AS ci_low, round(least(prevalence + half, 1), 6) AS ci_high FROM p""")
def binomial_prevalence(v):
    return rounded(A.binomial_prevalence(_binned(v, 100), 20, 100), "prevalence", "ci_low", "ci_high")


@query(f"WITH {_bins(5)} SELECT CAST(bin AS VARCHAR) AS bin, count(*) AS n FROM binned WHERE model = 'main' GROUP BY bin UNION ALL SELECT 'total', count(*) FROM binned WHERE model = 'main'")
def counts_with_total(v):
    counts = _binned(v, 5).filter("model = 'main'").groupBy(F.col("bin").cast("string").alias("bin")).agg(F.count("*").alias("n"))
    return A.with_total(counts, "bin", "n")


@query("SELECT model, count(DISTINCT feature) AS features, count(DISTINCT coef100) AS values, count(*) AS n FROM weights GROUP BY model")
def distinct_counts(v):
    return v.weights.groupBy("model").agg(F.count_distinct("feature").alias("features"), F.count_distinct("coef100").alias("values"), F.count("*").alias("n"))


@query("""
    SELECT model, 'head' AS part, feature, coef100, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY coef100 DESC, feature) AS rn FROM weights) WHERE rn <= 5
    UNION ALL SELECT model, 'tail', feature, coef100, CAST(rn AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY coef100, feature DESC) AS rn FROM weights) WHERE rn <= 5""")
def head_and_tail(v):
    ends = []
    for part, order in (("head", [F.desc("coef100"), F.col("feature")]), ("tail", [F.col("coef100"), F.desc("feature")])):
        w = Window.partitionBy("model").orderBy(*order)  # a catalogue of weights
        ends.append(v.weights.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("model", F.lit(part).alias("part"), "feature", "coef100", "place"))
    return ends[0].unionByName(ends[1])


@query("SELECT feature, shap_zscore, CAST(row_number() OVER (ORDER BY abs(shap_zscore) DESC, feature) AS BIGINT) AS place FROM shap QUALIFY place <= 12")
def limited_rows(v):
    first = v.shap.orderBy(F.desc(F.abs("shap_zscore")), "feature").limit(12).select("feature", "shap_zscore")
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("shap_zscore")), "feature")).cast("long"))  # a dozen rows


@query("SELECT feature, shap_zscore FROM shap ORDER BY feature OFFSET 5")
def offset_rows(v):
    return v.shap.orderBy("feature").offset(5).select("feature", "shap_zscore")


@query("SELECT feature FROM shap WHERE feature IN (SELECT feature FROM weights WHERE coef100 > 0)")
def intersect_features(v):
    return v.shap.select("feature").intersect(v.weights.filter("coef100 > 0").select("feature"))


@query("SELECT DISTINCT feature FROM weights WHERE feature NOT IN (SELECT feature FROM shap WHERE shap_zscore > 0)")
def except_features(v):
    return v.weights.select("feature").subtract(v.shap.filter("shap_zscore > 0").select("feature"))


_CLUSTERS = ["c1", "c2", "c3", "c4", "c5"]
_LONG = "SELECT gene_id, cohort, or_value, abs(ln(or_value)) AS effect, c AS cluster FROM (SELECT *, unnest([" + ", ".join(f"CASE WHEN {c} = 1 THEN '{c}' END" for c in _CLUSTERS) + "]) AS c FROM cluster_genes WHERE NOT contains(cohort, ',')) WHERE c IS NOT NULL"


@query(f"""
    SELECT cohort, cluster, CAST(rn AS INTEGER) AS place FROM (
        SELECT cohort, cluster, row_number() OVER (PARTITION BY cohort ORDER BY distinctiveness DESC, cluster) AS rn FROM ({SQL["cluster_distinctiveness"]})) WHERE rn <= 2""")
def signature_clusters(v):
    scored = K.cluster_scores(v.cluster_genes, _CLUSTERS)
    distinct = rounded(K.distinctiveness(scored), "distinctiveness")
    return K.signature(distinct, 2).select("cohort", "cluster", F.col("rn").alias("place"))


@query(f"""
    WITH l AS ({_LONG}), m AS (SELECT functional_cluster AS cluster, trim(unnest(string_split(subtype, ','))) AS subtype FROM cluster_subtype WHERE subtype <> 'UNKNOWN'),
    w AS (SELECT subtype, cohort, sum(CASE WHEN or_value > 1 THEN effect ELSE 0 END) AS weight FROM l JOIN m USING (cluster) GROUP BY 1, 2),
    g AS (SELECT cohort, cluster, count(*) AS genes FROM l GROUP BY 1, 2)
    SELECT m.subtype, m.cluster, c.cohort, round(coalesce(genes, 0) * coalesce(weight, 0), 6) AS contribution
    FROM (SELECT DISTINCT subtype, cluster FROM m WHERE cluster IN (SELECT cluster FROM l)) m CROSS JOIN (SELECT DISTINCT cohort FROM l) c
    LEFT JOIN g ON g.cohort = c.cohort AND g.cluster = m.cluster LEFT JOIN w ON w.cohort = c.cohort AND w.subtype = m.subtype""")
def subtype_contributions(v):
    rows, mapping = K.long_clusters(v.cluster_genes, _CLUSTERS), K.subtype_map(v.cluster_subtype)
    return rounded(K.contributions(rows, mapping, K.enrichment(rows, mapping)), "contribution")


# Variants.


@query("SELECT iid, snp, dosage FROM genotype WHERE iid % 2 = 0 AND iid NOT IN (SELECT iid FROM withdrawn)")
def keep_and_remove(v):
    return G.keep_people(v.genotype, v.participant.filter("iid % 2 = 0"), v.withdrawn)


@query("SELECT DISTINCT snp FROM genotype WHERE NOT (snp BETWEEN 20 AND 29)")
def outside_region(v):
    return G.outside_region(v.genotype.select("snp").distinct(), 20, 29)


@query("SELECT iid, snp, dosage FROM genotype WHERE snp IN (SELECT k FROM ks WHERE k % 3 <> 0)")
def merged_chromosomes(v):
    parts = [v.genotype.filter(F.col("snp") % 4 == k) for k in range(4)]
    return G.merge_variants(parts, v.ks.filter("k % 3 <> 0").select(F.col("k").alias("snp")))


_ALLELE = "CAST(CAST(('0x' || substr(md5('1-' || iid || '-' || snp || '-{0}'), 1, 8)) AS BIGINT) < 1288490188 AS BIGINT)"


@query(f"SELECT * FROM (SELECT iid, snp, {_ALLELE.format(0)} + {_ALLELE.format(1)} AS dosage FROM participant, (SELECT CAST(unnest(range(10)) AS BIGINT) AS snp)) WHERE dosage > 0")
def simulated_genotypes(v):
    return G.simulate(v.participant, 10, 0.3)


@query("""
    SELECT iid, phenotype, 'catalogue' AS model, CAST(coalesce(s, 0) AS BIGINT) AS prs100 FROM participant
    LEFT JOIN (SELECT g.iid, sum(g.dosage * ((k * 13) % 17 - 8)) AS s FROM genotype g JOIN ks ON k = snp GROUP BY g.iid) USING (iid)""")
def catalogue_scores(v):
    weights = v.ks.select(F.lit("catalogue").alias("model"), F.col("k").cast("string").alias("feature"), ((F.col("k") * 13) % 17 - 8).alias("coef100"))
    return R.score(v.main_rows, weights, v.participant)


# Models and their comparison.

_AUC = SQL["rank_auc"]


@query(f"SELECT w.model, w.feature, w.coef100 FROM weights w JOIN ({_AUC}) a ON a.model = w.model WHERE a.auc > 0.45")
def gated_features(v):
    return J.gated(rounded(V.rank_auc(v.prs.withColumn("y", F.col("phenotype") - 1), "prs100", ["model"]), "auc"), v.weights, 0.45)


@query(f"""
    WITH w AS ({SQL["delong_pairs"].replace("round(var1, 8)", "var1").replace("round(auc1, 6)", "auc1").replace("round(var2, 8)", "var2").replace("round(auc2, 6)", "auc2")}),
    d AS (SELECT model1 AS model, auc1 AS auc, var1 AS v FROM w UNION ALL SELECT model2, auc2, var2 FROM w)
    SELECT DISTINCT model, round(auc, 6) AS auc, round(greatest(auc - 1.96 * sqrt(v), 0), 6) AS ci_low, round(least(auc + 1.96 * sqrt(v), 1), 6) AS ci_high FROM d""")
def auc_bounds(v):
    rows = v.prs.withColumn("y", F.col("phenotype") - 1)
    return rounded(V.auc_bounds(rows, "prs100"), "auc", "ci_low", "ci_high")


@query(f"""
    SELECT model1, model2, 'mcnemar' AS test, chi2 AS value FROM ({SQL["mcnemar_pairs"]}) UNION ALL SELECT model1, model2, 'independence', chi2 FROM ({SQL["chi2_independence"]})
    UNION ALL SELECT model1, model2, 'kappa', kappa FROM ({SQL["kappa_jaccard_discordance"]}) UNION ALL SELECT model1, model2, 'jaccard', jaccard FROM ({SQL["kappa_jaccard_discordance"]})
    UNION ALL SELECT model1, model2, 'discordance', discordance FROM ({SQL["kappa_jaccard_discordance"]}) UNION ALL SELECT model1, model2, 'delong', z FROM ({SQL["delong_pairs"]})""")
def all_tests(v):
    agreed = kappa_jaccard_discordance(v)
    tests = {"mcnemar": (mcnemar_pairs(v), "chi2"), "independence": (chi2_independence(v), "chi2"), "kappa": (agreed, "kappa"), "jaccard": (agreed, "jaccard"), "discordance": (agreed, "discordance"), "delong": (delong_pairs(v), "z")}
    return V.all_tests(tests)


@query(f"""
    SELECT DISTINCT CASE WHEN model1 = 'epi+main' OR model2 = 'epi+main' THEN 'epi+main' WHEN auc1 < auc2 THEN model1 ELSE model2 END AS model
    FROM ({SQL["delong_p_values"]}) WHERE p > 0.05""")
def dropped_models(v):
    """Models that don't differ from a better one, by the p-values of their comparisons."""
    return S.dropped_models(delong_p_values(v))


@query(f"""
    SELECT * FROM ({SQL["all_tests"]}) UNION ALL SELECT model1, model2, 'overlap', overlap_ratio FROM ({SQL["overlap_hypergeometric"]}) UNION ALL SELECT model1, model2, 'hypergeometric', overlap_p FROM ({SQL["overlap_hypergeometric"]})
    UNION ALL SELECT model1, model2, 'pearson', pearson FROM ({SQL["pearson_spearman_ttest"]}) UNION ALL SELECT model1, model2, 'spearman', spearman FROM ({SQL["pearson_spearman_ttest"]}) UNION ALL SELECT model1, model2, 'paired t', t FROM ({SQL["pearson_spearman_ttest"]})
    UNION ALL SELECT model1, model2, 'nri', nri FROM ({SQL["nri_idi"]}) UNION ALL SELECT model1, model2, 'idi', idi FROM ({SQL["nri_idi"]})""")
def every_test(v):
    """The tests of all_tests, and overlap, correlations, paired t, net reclassification and integrated discrimination."""
    v.kept["flags"] = written(_flags(v), "flags")  # all but one of them start from these
    overlap, paired, moved = overlap_hypergeometric(v), written(pearson_spearman_ttest(v), "paired"), written(nri_idi(v), "moved")
    more = {"overlap": (overlap, "overlap_ratio"), "hypergeometric": (overlap, "overlap_p"), "pearson": (paired, "pearson"), "spearman": (paired, "spearman"), "paired t": (paired, "t"), "nri": (moved, "nri"), "idi": (moved, "idi")}
    return all_tests(v).unionByName(V.all_tests(more))


@query("""
    WITH z AS (SELECT iid, phenotype, model, (prs100 - avg(prs100) OVER w) / stddev_pop(prs100) OVER w AS s FROM prs WINDOW w AS (PARTITION BY model)),
    m AS (SELECT iid, phenotype, sum(s * CASE model WHEN 'main' THEN 0.5 WHEN 'epi' THEN 0.3 ELSE 0.2 END) AS x FROM z WHERE model IN ('main', 'epi', 'cardio') GROUP BY 1, 2)
    SELECT iid, phenotype, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS prs_cr FROM m""")
def mixed_scores(v):
    betas = v.spark.createDataFrame([("main", 0.5), ("epi", 0.3), ("cardio", 0.2)], "model string, beta double")
    return rounded(M.apply_mix(R.scale(v.prs), betas), "prs_cr")


@query("""
    WITH e AS (SELECT e.iid, env_feature, value, phenotype - 1 AS y FROM env e JOIN participant USING (iid)),
    r AS (SELECT env_feature, y, rank() OVER (PARTITION BY env_feature ORDER BY value) + (count(*) OVER (PARTITION BY env_feature, value) - 1) / 2.0 AS rk FROM e),
    s AS (SELECT env_feature, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS r1, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q FROM r GROUP BY env_feature)
    SELECT env_feature, round((r1 - p * (p + 1) / 2) / (p * q), 6) AS auc FROM s""")
def auc_by_measure(v):
    rows = v.env.join(v.participant, "iid").withColumn("y", F.col("phenotype") - 1)
    return rounded(V.rank_auc(rows, "value", ["env_feature"]), "auc")


_FEATURES = [str(k) for k in range(64)]


@query("""
    WITH s AS (SELECT k, CAST(coalesce(sum(CASE WHEN phenotype = 1 THEN dosage END), 0) AS DOUBLE) AS x0 FROM ks LEFT JOIN genotype ON snp = k LEFT JOIN participant USING (iid) GROUP BY k),
    b AS (SELECT CAST(k AS VARCHAR) AS feature, x0, (row_number() OVER (ORDER BY CAST(k AS VARCHAR)) - 1) // 20 AS batch FROM s)
    SELECT CAST(batch AS BIGINT) AS batch, feature, round(-ln((x0 + 1) / (sum(x0) OVER w + count(*) OVER w)), 6) AS coefs, 'ok' AS status FROM b WINDOW w AS (PARTITION BY batch)""")
def fitted_batches(v):
    """Feature weights of complement naive Bayes, batch by batch, for all variants."""
    catalogue = X.batches(v.ks.select(F.col("k").cast("string").alias("feature")), 20)
    rows = v.written("main_rows")
    return rounded(M.fit_batches(rows, v.participant, catalogue, lambda rows, people, names: M.complement_bayes(rows, people, names).select("feature", F.col("lp1").alias("coefs"))), "coefs")


@query()
def discrimination_gain(v):
    """Integrated discrimination of the joint score over the main one, with bootstrap bounds."""
    wide = v.probs.groupBy("iid", "y").pivot("model", ["main", "epi+main"]).agg(F.first("p")).toDF("iid", "y", "p1", "p2").withColumn("model", F.lit("main"))
    return Z.bootstrap(wide, Z.discrimination_gain("p1", "p2"), 1000)


@query("SELECT * FROM (" + SQL["subtype_enrichment"].replace("sum(effect) AS weight", "CAST(count(*) AS DOUBLE) AS weight").replace("THEN effect ELSE 0 END) AS risk_weight", "THEN 1 ELSE 0 END) AS risk_weight").replace("THEN 0 ELSE effect END) AS protective_weight", "THEN 0 ELSE 1 END) AS protective_weight") + ")")
def subtype_enrichment_equal(v):
    """Every gene weighs the same."""
    rows, mapping = K.long_clusters(v.cluster_genes, _CLUSTERS), K.subtype_map(v.cluster_subtype)
    return rounded(K.enrichment(rows, mapping, "equal"), "weight", "risk_weight", "protective_weight", "risk_percent")


_NINE = [*PAIRS, *(("covariate", m) for m in ("main", "epi", "cardio"))]
_WITH_COVARIATE = "SELECT iid, model, phenotype - 1 AS y, prs100 AS v FROM prs UNION ALL SELECT iid, 'covariate', phenotype - 1, CAST(age * 10 + sex * 5 AS BIGINT) FROM participant JOIN covar USING (iid)"


@query(f"""
    WITH p AS ({_WITH_COVARIATE}),
    r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model, y ORDER BY v) + (count(*) OVER (PARTITION BY model, y, v) - 1) / 2.0 AS ro,
        CAST(count(*) FILTER (WHERE y = 1) OVER (PARTITION BY model) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE y = 0) OVER (PARTITION BY model) AS DOUBLE) AS n0 FROM p),
    pl AS (SELECT iid, model, y, CASE WHEN y = 1 THEN (ra - ro) / n0 ELSE 1 - (ra - ro) / n1 END AS s FROM r),
    c AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _NINE)}) AS t(model1, model2)),
    g AS (SELECT c.model1, c.model2, a.y, avg(a.s) AS m1, avg(b.s) AS m2, var_samp(a.s) AS s1, var_samp(b.s) AS s2, covar_samp(a.s, b.s) AS cv, count(*) AS n FROM c JOIN pl a ON a.model = c.model1 JOIN pl b ON b.model = c.model2 AND b.iid = a.iid GROUP BY 1, 2, 3),
    d AS (SELECT model1, model2, max(m1) FILTER (WHERE y = 1) AS auc1, max(m2) FILTER (WHERE y = 1) AS auc2, sum(s1 / n) AS var1, sum(s2 / n) AS var2, sum(cv / n) AS cov FROM g GROUP BY 1, 2)
    SELECT model1, model2, round(auc1, 6) AS auc1, round(auc2, 6) AS auc2, round((auc1 - auc2) / sqrt(var1 + var2 - 2 * cov), 6) AS z FROM d""")
def delong_nine_pairs(v):
    """Scores against each other and against the covariates' own score."""
    covariate = v.covar.join(v.participant, "iid").select("iid", "phenotype", F.lit("covariate").alias("model"), (F.col("age") * 10 + F.col("sex") * 5).cast("long").alias("prs100"))
    rows = v.prs.unionByName(covariate).withColumn("y", F.col("phenotype") - 1)
    return rounded(V.delong(rows, "prs100", _NINE).select("model1", "model2", "auc1", "auc2", "z"), "auc1", "auc2", "z")


# Plot data.


@query("""
    WITH e AS (SELECT model, CAST(min(prs100) AS DOUBLE) AS lo, (max(prs100) - min(prs100)) / 20.0 AS width FROM prs GROUP BY model),
    s AS (SELECT p.*, lo, width, CASE WHEN width > 0 THEN least(floor((prs100 - lo) / width), 19) ELSE 0 END AS slot FROM prs p JOIN e USING (model))
    SELECT model, CAST(slot AS INTEGER) AS slot, round(lo + slot * width, 6) AS start, CAST(count(*) FILTER (WHERE phenotype = 2) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE phenotype = 1) AS BIGINT) AS controls FROM s GROUP BY model, slot, lo, width""")
def plot_histogram(v):
    return rounded(D.histogram(v.prs, "prs100", 20, ["model"]), "start")


@query("""
    SELECT model, phenotype, CAST(min(prs100) AS DOUBLE) AS min, round(quantile_cont(CAST(prs100 AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST(prs100 AS DOUBLE), 0.5), 6) AS median,
        round(quantile_cont(CAST(prs100 AS DOUBLE), 0.75), 6) AS q3, CAST(max(prs100) AS DOUBLE) AS max FROM prs GROUP BY model, phenotype""")
def plot_box(v):
    return rounded(D.box(v.prs, "prs100", ["model", "phenotype"]), "q1", "median", "q3")


@query(f"WITH {_HIGH} SELECT iid, CASE WHEN bool_or(high AND model = 'main') AND bool_or(high AND model = 'epi') THEN 'both' WHEN bool_or(high AND model = 'main') THEN 'main' WHEN bool_or(high AND model = 'epi') THEN 'epi' ELSE 'neither' END AS colour FROM flags GROUP BY iid")
def plot_agreement(v):
    return D.agreement_groups(_flags(v), "main", "epi")


@query("SELECT model, feature, coefs, round(exp(coefs), 6) AS odds, CASE WHEN coefs > 0.05 THEN 'risk' WHEN coefs < -0.05 THEN 'protect' ELSE 'none' END AS side FROM feature_scores")
def plot_volcano(v):
    return rounded(D.volcano(v.feature_scores, 0.05), "odds")


_CELL = "coalesce(max(CASE WHEN bin = {0} THEN prevalence END), 0)"


@query(f"""
    WITH {_bins(5)}, p AS (SELECT model, bin, round(CAST(sum(phenotype - 1) AS DOUBLE) / count(*), 6) AS prevalence FROM binned GROUP BY model, bin)
    SELECT model, {", ".join(f"{_CELL.format(k)} AS bin_{k}" for k in range(1, 6))} FROM p GROUP BY model""")
def plot_heatmap(v):
    shares = rounded(B.prevalence(_binned(v, 5), ["model"]), "prevalence")
    return D.heatmap(shares, "model", "bin", "prevalence", list(range(1, 6))).toDF("model", *(f"bin_{k}" for k in range(1, 6)))


@query("SELECT f.iid, w.model, CAST(sum(f.x * w.coef100) AS BIGINT) AS score FROM feature_rows f JOIN weights w USING (feature) GROUP BY f.iid, w.model")
def streamed_scores(v):
    """People who arrive in four files, scored by a stream that ends when all are read."""
    path = folder(v.spark, "stream")
    v.feature_rows.repartition(4, "iid").write.parquet(f"{path}/in")
    edges = B.quantile_edges(v.prs, "prs100", 10, ["model"])
    score_stream(v.spark, f"{path}/in", v.weights, edges, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{path}/out").select("iid", "model", "score")


@query("SELECT f.iid, w.model, CAST(sum(f.x * w.coef100) AS BIGINT) AS score, TRUE AS complete FROM feature_rows f JOIN weights w USING (feature) GROUP BY f.iid, w.model")
def streamed_pieces(v):
    """The same people in three pieces each, dealt over four folders of files, some of them twice."""
    path = folder(v.spark, "pieces")
    piece = F.pmod(F.xxhash64("feature"), F.lit(3)).cast("int")
    rows = v.feature_rows.withColumn("piece", piece).repartition("iid").groupBy("iid", "piece").agg(F.collect_list(F.struct("feature", "x")).alias("rows"))
    own = rows.groupBy("iid").agg(F.collect_list(F.struct("piece", "rows")).alias("own"))
    pieces = own.select("iid", F.size("own").alias("pieces"), F.explode("own").alias("p")).select("iid", "p.piece", "pieces", "p.rows")
    here = F.pmod(F.xxhash64("iid", "piece"), F.lit(4))
    files = F.when(F.col("iid") % 5 == 0, F.array(here, F.pmod(here + 3, F.lit(4)))).otherwise(F.array(here))
    pieces.withColumn("file", F.explode(files)).write.partitionBy("file").parquet(f"{path}/in")
    edges = B.quantile_edges(v.prs, "prs100", 10, ["model"])
    score_pieces(v.spark, f"{path}/in", v.weights, edges, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{path}/out").select("iid", "model", "score", "complete")


@query()
def iterative_clinical_imputation(v):
    """The clinical marker and other measures from each other, by forests of 100 trees in ten rounds."""
    wide = v.env.filter(F.col("env_feature").isin("avg_qty", "n_orders")).groupBy("iid").pivot("env_feature", ["avg_qty", "n_orders"]).agg(F.max("value"))
    rows = v.written("clinical").join(wide, "iid", "left").join(v.split.select("iid", "split"), "iid")
    rows = written(rows, "measures")
    return M.iterative_impute(rows.filter(F.col("split") == "train").drop("split"), rows.drop("split"), ["marker", "avg_qty", "n_orders"])
