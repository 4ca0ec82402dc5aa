"""From raw documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import columns_of, discard, free_name, materialise, scratch, text_of
from riskweave.llm.decontaminate import find_leaks
from riskweave.llm.exact_dedup import exact_dedup
from riskweave.llm.near_dedup import near_dedup
from riskweave.llm.packing import pack
from riskweave.llm.toxicity import keep_clean
from riskweave.ship import ship


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the name of its column; equal rows have their own. Written as they lie: no text is moved."""
    row = free_name(docs, "row")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def _without(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """Numbered rows less those whose numbers are among the dropped; rows that share an id, or have none, are told apart."""
    return rows.join(dropped.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return keep_clean(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays; rows that repeat an id with other texts are told apart."""
    own, gone_id, gone = (free_name(docs, name) for name in ("digest", "gone_id", "gone"))
    dropped = exact_dedup(docs).filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone)).distinct()
    match = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone))
    return docs.withColumn(own, F.sha2(text_of(), 256)).join(dropped, match, "left_anti").select(columns_of(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8), the row with the smallest id stays."""
    rows, row = _numbered(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2(text_of(), 256).alias("digest"))  # null ids last
    groups = near_dedup(rows, doc_id=row).select(F.col("doc_id").alias("member"), F.col("component_id").alias("component"))
    placed = rows.select(F.col(row).alias("member"), order.alias("order")).join(groups, "member")  # no texts
    stays = placed.groupBy("component").agg(F.min(F.struct("order", "member")).alias("first")).select("first.member")
    dropped = groups.join(stays, "member", "left_anti")  # by the row, so a large group meets nowhere
    return _without(rows, row, dropped.select(F.col("member").alias("doc_id"))).select(columns_of(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows, row = _numbered(docs)
    return _without(rows, row, find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=row)).select(columns_of(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 ids."""
    return pack(docs)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("packing", packing_stage)]

#: Models, retrieval and packing aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
