"""Queries of sources and sinks: fixture rows are written in a format of the workflow's, and read back by the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import cohort as P
from .operators import selection as S
from .queries import query, rounded
from .sources import bed
from .sources import readers as IN
from .sources import sinks as OUT
from .sources.shared import folder


def _dosages(v) -> str:
    """The genotypes as a wide file of dosages."""
    path, snps = folder(v.spark, "dosages"), sorted(r["k"] for r in v.ks.collect())
    wide = v.genotype_missing.groupBy("iid").pivot("snp", snps).agg(F.max(F.coalesce(F.col("dosage").cast("string"), F.lit("NA"))))
    zero, iid = F.lit("0"), F.col("iid").cast("string")
    head = [iid.alias("FID"), iid.alias("IID"), zero.alias("PAT"), zero.alias("MAT"), (F.col("iid") % 2 + 1).alias("SEX"), F.col("phenotype").alias("PHENOTYPE")]
    rows = v.participant.join(wide, "iid", "left").select(*head, *(F.coalesce(F.col(str(k)), zero).alias(f"{k}_A") for k in snps))
    rows.write.option("sep", " ").option("header", True).csv(path)
    return path


@query("""
    SELECT g.iid, CAST(snp AS VARCHAR) AS feature, CAST(dosage AS BIGINT) AS dosage FROM genotype_missing g
    WHERE snp < 32 AND (dosage IS NULL OR dosage <> 0) AND g.iid NOT IN (SELECT iid FROM withdrawn)""")
def read_dosage_file(v):
    _, rows = IN.read_dosages(v.spark, _dosages(v), [str(k) for k in range(32)], v.withdrawn)
    return rows.select("iid", "feature", F.col("dosage").cast("long").alias("dosage"))


@query("SELECT iid, CAST(iid % 2 + 1 AS INTEGER) AS sex, CAST(phenotype AS INTEGER) AS phenotype FROM participant")
def read_dosage_people(v):
    return IN.read_dosages(v.spark, _dosages(v))[0]


@query("""
    SELECT CAST(position AS BIGINT) AS position, name FROM (VALUES (0, 'FID'), (1, 'IID'), (2, 'PAT'), (3, 'MAT'), (4, 'SEX'), (5, 'PHENOTYPE')) AS h(position, name)
    UNION ALL SELECT 6 + k, concat(CAST(k AS VARCHAR), '_A') FROM ks""")
def read_dosage_header(v):
    return v.spark.createDataFrame(list(enumerate(IN.header(v.spark, _dosages(v)))), "position long, name string")


@query("SELECT concat(CAST(k AS VARCHAR), '_A') AS name, true AS found FROM ks WHERE k % 5 = 0 UNION ALL SELECT 'rs1', false UNION ALL SELECT 'rs2', false")
def column_lookup(v):
    want = [f"{r['k']}_A" for r in v.ks.filter("k % 5 = 0").collect()]
    found, missing = IN.column_index([*want, "rs1", "rs2"], IN.header(v.spark, _dosages(v)))
    return v.spark.createDataFrame([*((c, True) for c in found), *((c, False) for c in missing)], "name string, found boolean")


@query("SELECT iid, allele, round(raw, 6) AS raw FROM hla WHERE raw IS NOT NULL")
def read_hla_file(v):
    path = folder(v.spark, "hla")
    v.hla.groupBy(F.col("iid").alias("Participant ID")).pivot("allele").agg(F.max("raw")).write.option("header", True).csv(path)
    return rounded(IN.read_hla(v.spark, path), "raw")


@query("SELECT iid, allele, round(raw, 6) AS raw FROM hla WHERE raw IS NOT NULL")
def read_packed_hla_file(v):
    path, names = folder(v.spark, "hla-packed"), [f"hla_{k}" for k in range(1, 8)]
    wide = v.hla.groupBy("iid").pivot("allele", names).agg(F.max("raw"))
    packed = F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)), ",")
    wide.select("iid", packed.alias("packed")).write.option("header", True).csv(path)
    return rounded(IN.read_packed_hla(v.spark, path, names), "raw")


@query("SELECT CAST(iid AS VARCHAR) AS iid, CAST(snp AS VARCHAR) AS snp, CAST(dosage AS INTEGER) AS dosage FROM genotype_missing WHERE dosage IS NULL OR dosage <> 0")
def read_bed_files(v):
    """Written as filesets by tasks, and read back."""
    path = folder(v.spark, "bed")
    bed.save(v.genotype_missing, v.participant.select("iid"), path, v.ks.select(F.col("k").alias("snp")))
    return v.spark.read.format("bed").load(path)


_PCS = ", ".join(f"round(pc{i}, 6) AS pc{i}" for i in range(1, 11))


@query(f"SELECT iid, CAST(sex AS INTEGER) AS sex, age, {_PCS} FROM covar")
def read_covariate_file(v):
    path = folder(v.spark, "covar")
    named = [F.col(f"pc{i}").alias(f"Genetic principal components | Array {i}" if i % 2 else f"PC{i}") for i in range(1, 11)]
    sex = F.when(F.col("sex") == 0, "Female").otherwise("Male").alias("Sex")
    v.covar.select(F.col("iid").alias("Participant ID"), sex, F.col("age").alias("Age at recruitment"), *named).write.option("header", True).csv(path)
    return rounded(IN.read_covariates(v.spark, path), *(f"pc{i}" for i in range(1, 11)))


@query("""
    SELECT CAST(iid AS VARCHAR) AS iid, coalesce(icd10, '') AS icd10, coalesce(self_report_0, '') AS self_report_0, coalesce(self_report_2, '') AS self_report_2, coalesce(date_first, '') AS date_first
    FROM participant_text""")
def read_participant_file(v):
    path = folder(v.spark, "participants")
    v.participant_text.withColumnRenamed("icd10", " icd10 ").write.option("header", True).csv(path)
    return IN.read_participants(v.spark, path).select("iid", "icd10", "self_report_0", "self_report_2", "date_first")


def _environment(v) -> DataFrame:
    path = folder(v.spark, "env")
    v.env.groupBy(F.col("iid").alias("Participant ID")).pivot("env_feature").agg(F.max("value")).write.option("header", True).csv(path)
    return IN.read_environment(v.spark, path)


@query("SELECT iid, env_feature, round(value, 6) AS value FROM env WHERE value IS NOT NULL")
def read_environment_file(v):
    return rounded(_environment(v), "value")


_MISSING = "SELECT env_feature FROM env GROUP BY env_feature HAVING 1 - CAST(count(value) AS DOUBLE) / (SELECT count(*) FROM participant) <= 0.4"


@query(f"SELECT env_feature FROM ({_MISSING}) WHERE env_feature IN ('acctbal', 'n_orders')")
def main_environment_marked(v):
    marked = v.spark.createDataFrame([("acctbal", 1), ("n_orders", 1), ("avg_qty", 0), ("unknown", 1)], "env_feature string, main_e int")
    return IN.main_environment(marked, _environment(v), v.participant, 0.4)


@query(f"SELECT env_feature FROM ({_MISSING}) WHERE env_feature <> 'avg_qty'")
def main_environment_fallback(v):
    marked = v.spark.createDataFrame([("acctbal", 0), ("n_orders", 2)], "env_feature string, main_e int")
    return IN.main_environment(marked, _environment(v), v.participant, 0.4, clinical=["avg_qty"])


@query("SELECT concat(snp1, ',', snp2) AS feature, snp1 AS snp, snp2 AS best_snp FROM epi_pairs")
def read_epistasis_file(v):
    path = folder(v.spark, "epistasis")
    lines = v.epi_pairs.select(F.format_string("  6  %s  12  3.5  6  %s", "snp1", "snp2").alias("value"))
    v.spark.createDataFrame([(" CHR  SNP  N_SIG  BEST_CHISQ  BEST_CHR  BEST_SNP",)], "value string").unionByName(lines).write.text(path)
    return IN.read_epistasis(v.spark, path)


@query("SELECT snp_a, snp_b, round(r2, 6) AS r2 FROM ld WHERE r2 > 0.6")
def read_ld_file(v):
    path = folder(v.spark, "ld")
    lines = v.ld.select(F.concat_ws("  ", F.lit(" 6"), F.lit("100"), "snp_a", F.lit("6"), F.lit("200"), "snp_b", F.col("r2").cast("string")).alias("value"))
    v.spark.createDataFrame([(" CHR_A BP_A SNP_A CHR_B BP_B SNP_B R2",)], "value string").unionByName(lines).write.text(path)
    return rounded(IN.read_ld(v.spark, path), "r2")


@query("SELECT iid FROM withdrawn")
def read_withdrawal_file(v):
    path = folder(v.spark, "withdrawn")
    OUT.write_ids(v.withdrawn, path, ["iid"])
    return IN.read_ids(v.spark, path)


@query("SELECT CAST(iid AS VARCHAR) AS fid, iid, CAST(iid % 2 + 1 AS INTEGER) AS sex, CAST(phenotype AS INTEGER) AS phenotype FROM participant")
def read_fam_file(v):
    path = folder(v.spark, "fam")
    rows = v.participant.select("iid", "phenotype", F.lit(0).alias("none"), (F.col("iid") % 2 + 1).alias("sex"))
    OUT.write_ids(rows, path, ["iid", "iid", "none", "none", "sex", "phenotype"])
    return IN.read_fam(v.spark, path).select("fid", "iid", "sex", "phenotype")


@query("SELECT iid, phenotype, prs100, model FROM prs WHERE model NOT IN ('epi', 'epi+main')")
def read_score_files(v):
    path = folder(v.spark, "scores")
    for model in ("main", "epi", "cardio", "epi+main"):
        OUT.write_csv(v.prs.filter(F.col("model") == model).drop("model"), f"{path}/{model}.scores")
    alike = v.spark.createDataFrame([("main", "epi", 0.61, 0.55, 0.4), ("main", "cardio", 0.61, 0.52, 0.01), ("main", "epi+main", 0.61, 0.62, 0.7)], "model1 string, model2 string, auc1 double, auc2 double, p double")
    rows = IN.read_scores(v.spark, f"{path}/*.scores", r"/([^/]+)\.scores/").withColumn("model", F.url_decode(F.replace("model", F.lit("+"), F.lit("%2B"))))
    kept = rows.join(S.dropped_models(alike), "model", "left_anti")
    return kept.select(F.col("iid").cast("long").alias("iid"), F.col("phenotype").cast("int").alias("phenotype"), F.col("prs100").cast("long").alias("prs100"), "model")


@query("SELECT CAST(k AS VARCHAR) AS snp, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS trait FROM ks WHERE k >= 8")
def read_association_files(v):
    path = folder(v.spark, "associations")
    for trait, rest in (("a", 0), ("b", 1)):
        rows = v.ks.filter(F.col("k") % 2 == rest).select(F.col("k").cast("string").alias("snp"), F.lit(trait).alias("trait"), F.concat(F.lit("4e-"), F.col("k").cast("string")).alias("p.value"))
        rows.write.option("header", True).option("sep", "\t").csv(f"{path}/{trait}")
    return IN.read_associations(v.spark, f"{path}/*").select("snp", "trait")


@query("""
    WITH c AS (SELECT CAST(k % 20 AS VARCHAR) AS snp, CAST(k AS DOUBLE) / 100 AS effect_weight, 1 + CAST((k * 7) % 30 AS DOUBLE) / 10 AS previous_or, CASE WHEN k < 32 THEN 'Lancet' ELSE 'Nature' END AS journal FROM ks)
    SELECT snp, round(effect_weight, 6) AS effect_weight, round(previous_or, 6) AS previous_or, journal FROM (
        SELECT *, row_number() OVER (PARTITION BY snp ORDER BY previous_or DESC, effect_weight DESC, journal DESC) AS rn FROM c) WHERE rn = 1""")
def read_catalogue_files(v):
    path = folder(v.spark, "catalogue")
    for journal, low, high in (("Lancet", 0, 32), ("Nature", 32, 64)):
        rows = v.ks.filter(F.col("k").between(low, high - 1))
        odds = (1 + ((F.col("k") * 7) % 30).cast("double") / 10).alias("OR")
        rows.select((F.col("k") % 20).cast("string").alias("rsID"), (F.col("k").cast("double") / 100).alias("effect_weight"), odds).write.option("header", True).option("sep", "\t").csv(f"{path}/{journal}_2025.txt")
    return rounded(IN.read_catalogue(v.spark, f"{path}/*.txt"), "effect_weight", "previous_or")


@query("""
    SELECT DISTINCT CASE WHEN contains(feature, ',') THEN 'pair' ELSE 'single' END AS list, feature FROM shap WHERE abs(shap_zscore) > 1.5""")
def important_feature_lists(v):
    path = folder(v.spark, "important")
    OUT.write_csv(v.shap.unionByName(v.shap.withColumn("shap_zscore", F.col("shap_zscore") / 2)), path)
    return IN.important_lists(IN.read_important(v.spark, path, 1.5))


@query("SELECT feature, shap_zscore, data_type FROM shap WHERE abs(shap_zscore) > 1.5")
def read_important_file(v):
    path = folder(v.spark, "important")
    OUT.write_csv(v.shap.unionByName(v.shap.withColumn("shap_zscore", F.col("shap_zscore") / 2)), path)
    return IN.read_important(v.spark, path, 1.5)


@query("""
    SELECT concat('AUC_', upper(env_feature)) AS key, CAST(count(*) AS VARCHAR) AS value FROM env GROUP BY env_feature UNION ALL SELECT 'PEOPLE', CAST(count(*) AS VARCHAR) FROM participant
    UNION ALL SELECT 'CASES', CAST(count(*) AS VARCHAR) FROM participant WHERE phenotype = 2""")
def config_upsert(v):
    """A configuration written from a table, with two of its lines set anew from another, read back as a table."""
    path = folder(v.spark, "config")
    counts = v.env.groupBy("env_feature").agg(F.count("*").alias("n"))
    lines = counts.select(F.concat(F.lit("export AUC_"), F.upper("env_feature"), F.lit("="), F.col("n").cast("string")).alias("value")).unionByName(v.spark.createDataFrame([("PEOPLE=0",)], "value string"))
    lines.coalesce(1).write.text(path)
    text = "\n".join(r["value"] for r in v.spark.read.text(path).collect())  # a configuration: a line for each measure
    n = v.participant.agg(F.count("*").alias("n"), F.count_if(F.col("phenotype") == 2).alias("c")).head()
    return v.spark.createDataFrame(sorted(IN.read_config(IN.upsert_config(text, PEOPLE=str(n["n"]), CASES=str(n["c"]))).items()), "key string, value string")


# Sinks.


@query("SELECT iid, model, prs100 FROM prs")
def csv_round_trip(v):
    path = folder(v.spark, "csv")
    for _ in range(2):  # the second write replaces the first
        OUT.write_csv(v.prs.select("iid", "model", "prs100"), path)
    return v.spark.read.option("header", True).schema("iid long, model string, prs100 long").csv(path)


@query("SELECT iid, model, prs100, model AS batch FROM prs WHERE model IN ('main', 'epi')")
def batch_appends(v):
    path = folder(v.spark, "batches")
    for model in ("main", "epi", "main"):  # a batch that runs again replaces its own rows
        OUT.write_batch(v.prs.filter(F.col("model") == model).select("iid", "model", "prs100"), path, model)
    return v.spark.read.parquet(path).select("iid", "model", "prs100", F.col("batch").cast("string").alias("batch"))


@query("SELECT concat(CAST(iid AS VARCHAR), ' ', CAST(iid AS VARCHAR), ' ', CAST(phenotype AS VARCHAR)) AS value FROM participant")
def id_lines(v):
    path = folder(v.spark, "ids")
    OUT.write_ids(v.participant, path, ["iid", "iid", "phenotype"])
    return v.spark.read.text(path)


@query("""
    SELECT concat(CAST(line AS VARCHAR), ' ', snp1, ' ', snp2) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY least(snp1, snp2), greatest(snp1, snp2) ORDER BY line) AS rn FROM epi_pairs) WHERE rn = 1""")
def filtered_lines(v):
    path = folder(v.spark, "lines")
    kept = S.first_pairs(v.epi_pairs)
    OUT.write_lines(kept.withColumn("value", F.concat_ws(" ", F.col("line").cast("string"), "snp1", "snp2")), path, order="line")
    return v.spark.read.text(path)


@query("SELECT 'cases' AS sheet, model, count(*) AS n FROM prs WHERE phenotype = 2 GROUP BY model UNION ALL SELECT 'all', model, count(*) FROM prs GROUP BY model")
def report_sheets(v):
    path = folder(v.spark, "sheets")
    OUT.write_sheets({"cases": v.prs.filter("phenotype = 2").groupBy("model").agg(F.count("*").alias("n")), "all": v.prs.groupBy("model").agg(F.count("*").alias("n"))}, path)
    sheet = lambda name: v.spark.read.option("header", True).schema("model string, n long").csv(f"{path}/{name}").select(F.lit(name).alias("sheet"), "model", "n")
    return sheet("cases").unionByName(sheet("all"))


@query("SELECT family, split, iid, feature, x FROM (SELECT 'pair' AS family, iid, feature, CAST(x AS BIGINT) AS x FROM pair_rows UNION ALL SELECT 'gxe', iid, feature, CAST(x AS BIGINT) FROM gxe_rows) r JOIN split USING (iid)")
def interaction_matrices(v):
    path = folder(v.spark, "matrices")
    split = v.split.select("iid", "split")
    of = lambda rows, family: rows.join(split, "iid").select("iid", "feature", F.col("x").cast("long").alias("x"), "split", F.lit(family).alias("family"))
    OUT.write_matrices(of(v.pair_rows, "pair").unionByName(of(v.gxe_rows, "gxe")), path)  # each joined where its rows lie
    return v.spark.read.parquet(path).select(F.col("family").cast("string").alias("family"), F.col("split").cast("string").alias("split"), "iid", "feature", "x")


@query("SELECT CAST(count(*) FILTER (WHERE phenotype = 2) AS BIGINT) AS cases FROM participant")
def case_count(v):
    return v.spark.createDataFrame([(P.validate_cases(v.participant),)], "cases long")
