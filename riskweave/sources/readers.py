"""Sources: text tables of the risk-score workflow as DataFrames with explicit types; wide files become long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading columns of a dosage file that aren't variants. Fixed values of the format.
DOSAGE_HEAD = ["FID", "IID", "PAT", "MAT", "SEX", "PHENOTYPE"]
#: Names that a covariate goes by in one file or another. Fixed values.
ALIASES = {
    "iid": ["IID", "iid", "Participant ID", "eid"],
    "sex": ["SEX", "Sex", "sex", "Gender"],
    "age": ["age", "Age", "AGE", "Age at recruitment"],
    **{f"pc{i}": [f"PC{i}", f"pc{i}", f"Genetic principal components | Array {i}"] for i in range(1, 11)},
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a tab or white-space file, from its first line only."""
    line = spark.read.text(path).limit(1).head()
    return (line[0].split("\t") if "\t" in line[0] else line[0].split()) if line else []


def column_index(want: list[str], have: list[str]) -> tuple[list[str], list[str]]:
    """Those of `want` that are there, in the file's order, and those that are missing."""
    wanted = set(want)
    return [c for c in have if c in wanted], sorted(wanted - set(have))


def _clean(name: str) -> str:
    """A variant's name without the allele that is appended to it."""
    return name.rpartition("_")[0] or name


def read_dosages(spark: SparkSession, path: str, features: list[str] | None = None, withdrawn: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(people, genotype) of a wide dosage file: (iid, sex, phenotype) and long (iid, feature, dosage); zeros have no row.

    Only the columns asked for are parsed. NA is null. People who withdrew are left out.
    """
    raw = spark.read.option("sep", " ").option("header", True).option("nullValue", "NA").csv(path)
    keep = [c for c in raw.columns if c not in DOSAGE_HEAD and (features is None or _clean(c) in set(features))]
    if withdrawn is not None:
        raw = raw.join(withdrawn.select(F.col("iid").cast("string").alias("IID")), "IID", "left_anti")
    people = raw.select(F.col("IID").cast("long").alias("iid"), F.col("SEX").cast("int").alias("sex"), F.col("PHENOTYPE").cast("int").alias("phenotype"))
    if not keep:
        return people, people.select("iid", F.lit("").alias("feature"), F.lit(None).cast("byte").alias("dosage")).limit(0)
    wide = raw.select(F.col("IID").cast("long").alias("iid"), *(F.col(quoted(c)).cast("byte").alias(_clean(c)) for c in keep))
    long = wide.unpivot("iid", [quoted(_clean(c)) for c in keep], "feature", "dosage")
    return people, long.filter("dosage is null or dosage <> 0")


def read_packed_hla(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(iid, allele, raw) of a file with one comma-joined string of numbers per person, in the order of names."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF("iid", "packed", *rows.columns[2:])
    labels = F.array(*map(F.lit, names))
    long = rows.select(F.col("iid").cast("long").alias("iid"), F.posexplode(F.split("packed", ",")).alias("i", "v"))
    return long.filter(F.col("i") < len(names)).select("iid", F.get(labels, F.col("i")).alias("allele"), F.expr("try_cast(v as double)").alias("raw")).filter("raw is not null")


def read_hla(spark: SparkSession, path: str, key: str = "Participant ID") -> DataFrame:
    """(iid, allele, raw) of a wide table of alleles whose id column has a long name; absent values have no row."""
    raw = spark.read.option("header", True).csv(path).withColumnRenamed(key, "iid")
    alleles = [c for c in raw.columns if c != "iid"]
    wide = raw.select(F.col("iid").cast("long").alias("iid"), *(F.expr(f"try_cast({quoted(c)} as double)").alias(c) for c in alleles))
    return wide.unpivot("iid", [quoted(c) for c in alleles], "allele", "raw").filter("raw is not null")


def read_covariates(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """iid, age, sex (0 for Female or 0), pc1 to pc10 by any of their names; rows without any value are left out."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    found = {k: next((n for n in names if n in raw.columns), None) for k, names in ALIASES.items()}
    if found["iid"] is None:
        raise ValueError(f"no id column among {raw.columns}")
    take = lambda k: F.col(quoted(found[k])) if found[k] else F.lit(None).cast("string")
    sex = F.when(F.lower(take("sex")).isin("female", "0"), 0).when(F.lower(take("sex")).isin("male", "1", "2"), 1)
    numbers = [F.expr(f"try_cast({quoted(found[k])} as double)").alias(k) if found[k] else F.lit(None).cast("double").alias(k) for k in ALIASES if k not in ("iid", "sex")]
    rows = raw.select(take("iid").cast("long").alias("iid"), sex.alias("sex"), *numbers)
    return rows.dropna("all", subset=[c for c in rows.columns if c != "iid"]).filter("iid is not null")


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings with null as '', names trimmed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*(c.strip() for c in raw.columns)).na.fill("")


def read_environment(spark: SparkSession, path: str, key: str = "Participant ID") -> DataFrame:
    """(iid, env_feature, value) of a wide file; what isn't a number has no row."""
    raw = spark.read.option("header", True).csv(path)
    columns = [c for c in raw.columns if c != key]
    wide = raw.select(F.col(quoted(key)).cast("long").alias("iid"), *(F.expr(f"try_cast({quoted(c)} as double)").alias(c) for c in columns))
    return wide.unpivot("iid", [quoted(c) for c in columns], "env_feature", "value").filter("value is not null and not isnan(value)")


def read_epistasis(spark: SparkSession, path: str) -> DataFrame:
    """(feature, snp, best_snp) of a summary table: the second and the last field of each line after the first."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(1)).alias("snp"), F.element_at(parts, -1).alias("best_snp")).filter("snp is not null and snp <> 'SNP'")
    return rows.select(F.concat_ws(",", "snp", "best_snp").alias("feature"), "snp", "best_snp")


def read_ld(spark: SparkSession, path: str, least: float = 0.6) -> DataFrame:
    """(snp_a, snp_b, r2) above the least."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").contains("SNP_A"))
    return rows.select(F.get(parts, F.lit(2)).alias("snp_a"), F.get(parts, F.lit(5)).alias("snp_b"), F.get(parts, F.lit(6)).cast("double").alias("r2")).filter(F.col("r2") > least)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """iid of a headerless list: the first field of each line."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"[\s,]+")[0].cast("long").alias("iid")).filter("iid is not null")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", " ").schema("fid string, iid long, pat string, mat string, sex int, phenotype int").csv(path)


def read_scores(spark: SparkSession, paths: str, name: str = r"([^/]+)\.[^.]+$") -> DataFrame:
    """Score files of several models, the model taken from the file's name."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(paths)
    return rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), name, 1))


def read_associations(spark: SparkSession, paths: str, p_column: str = "p.value", most: float = 5e-8) -> DataFrame:
    """Summary statistics of several files, significant rows only."""
    return spark.read.option("header", True).option("sep", "\t").csv(paths).withColumn("p", F.col(quoted(p_column)).cast("double")).filter(F.col("p") < most)


def read_catalogue(spark: SparkSession, paths: str) -> DataFrame:
    """(snp, effect_weight, previous_or, journal) of published weights, one file for each study; of a repeated name the largest odds ratio.

    The journal is what the file's or folder's name begins with, up to the first underscore.
    """
    rows = spark.read.option("header", True).option("sep", "\t").csv(paths)
    rows = rows.select(
        F.col("rsID").alias("snp"), F.col("effect_weight").cast("double").alias("effect_weight"), F.col("OR").cast("double").alias("previous_or"),
        F.regexp_extract(F.col("_metadata.file_path"), r"/([^/_]+)_[^/]*\.txt", 1).alias("journal"),
    )
    best = F.max_by(F.struct("effect_weight", "previous_or", "journal"), F.struct("previous_or", "effect_weight", "journal")).alias("best")
    return rows.groupBy("snp").agg(best).select("snp", "best.*")


def important_lists(rows: DataFrame) -> DataFrame:
    """(list, feature): single variants, pairs, and interactions with an environment, by the type of data they come from."""
    kind = F.when(F.col("data_type").contains("cardio"), "cardio").when(F.col("feature").contains(","), "pair").otherwise("single")
    return rows.select(kind.alias("list"), "feature").distinct()


def read_important(spark: SparkSession, path: str, threshold: float = 0.0) -> DataFrame:
    """(feature, shap_zscore, data_type) beyond the threshold; of a repeated feature the row furthest out, which a file sorted that way has first."""
    rows = spark.read.option("header", True).schema("feature string, shap_zscore double, data_type string").csv(path).filter(F.abs("shap_zscore") > threshold)
    best = F.max_by(F.struct("shap_zscore", "data_type"), F.struct(F.abs("shap_zscore"), "shap_zscore", "data_type")).alias("best")
    return rows.groupBy("feature").agg(best).select("feature", "best.*")


def main_environment(features: DataFrame, env: DataFrame, people: DataFrame, most_missing: float = 0.05, clinical: list[str] | None = None) -> DataFrame:
    """Environment features marked as main effects with few values missing; none marked: all but the clinical ones."""
    from ..operators.clean import missingness

    marked = features.filter("main_e = 1").select("env_feature").distinct()
    every = env.select("env_feature").distinct().filter(~F.col("env_feature").isin(clinical or []))
    wanted = every if marked.isEmpty() else marked
    return wanted.join(missingness(env, people, "env_feature", most_missing, strict=False).select("env_feature"), "env_feature", "left_semi")


def read_config(text: str) -> dict[str, str]:
    """key=value lines; later ones win, comments and blank lines are skipped."""
    pairs = (line.split("=", 1) for line in map(str.strip, text.splitlines()) if "=" in line and not line.startswith("#"))
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("'\"") for k, v in pairs}


def upsert_config(text: str, **values: str) -> str:
    """The lines of a configuration with the values set: a line that sets one is replaced, the others follow at the end."""
    left, out = dict(values), []
    for line in text.splitlines():
        key = line.split("=", 1)[0].strip().removeprefix("export ").strip() if "=" in line and not line.lstrip().startswith("#") else None
        if key not in values:
            out.append(line)
        elif key in left:
            out.append(f"{'export ' if line.lstrip().startswith('export ') else ''}{key}={left.pop(key)}")
    return "\n".join([*out, *(f"{k}={v}" for k, v in left.items())])
