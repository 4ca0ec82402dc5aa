"""How tables are laid out: what a task holds doesn't grow with the input."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from riskweave import queries, queries_files
from riskweave.operators import genomics as G
from riskweave.operators import neighbours
from riskweave.operators import prs as R
from riskweave.plans import fixtures

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_genotypes_lie_by_person_in_as_many_slices_as_lines_ask_for(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "SLICE", 1000)
    rows = fixtures.frame(spark, SMALL, "genotype")
    assert rows.select(F.spark_partition_id()).distinct().count() == -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 1000) > spark.sparkContext.defaultParallelism
    assert rows.select("iid", F.spark_partition_id().alias("p")).distinct().count() == rows.select("iid").distinct().count()
    assert plan(rows.groupBy("iid").count()).count("Exchange") == plan(rows).count("Exchange")


def test_directed_score(spark):
    genotype = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (2, 8, 1), (3, 7, 1)], "iid long, snp long, dosage long")
    weights = spark.createDataFrame([("m", "risk", 7, 0, 5), ("m", "risk", 8, 1, 3), ("m", "protect", 8, 0, 0)], "model string, direction string, snp long, env int, c long")
    orders = spark.createDataFrame([(1, 4), (3, 9)], "iid long, n long")
    got = R.directed_score(genotype, weights, orders, "n", "s")
    assert sorted(map(tuple, got.collect())) == [(1, "m", "protect", 0), (1, "m", "risk", 22), (2, "m", "protect", 0), (3, "m", "risk", 5)]


def test_merged_variants_are_not_dealt_by_variant(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select("id", (F.col("id") % 4).alias("snp"))
        out = G.merge_variants([rows.filter("snp < 2"), rows.filter("snp >= 2")], spark.createDataFrame([(1,), (2,)], "snp long"))
        assert "hashpartitioning(snp" not in plan(out)
        assert out.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_task_ranks_a_whole_class_for_the_split(spark):
    sorted_in = [line for line in plan(fixtures.frame(spark, SMALL, "split")).splitlines() if "row_number()" in line and "Window [" in line]
    assert sorted_in and all(re.search(r"\[phenotype#\d+, slice#\d+\]", line) for line in sorted_in)


def test_interaction_rows_stay_where_they_lie(spark, monkeypatch):
    """Families are joined with the split before they are put together; both families' rows are exchanged once, as genotypes."""
    seen = []
    monkeypatch.setattr(queries_files.OUT, "write_matrices", lambda df, path: (seen.append(plan(df)), df.write.partitionBy("family", "split").parquet(path)))
    queries.QUERIES["interaction_matrices"](spark, SMALL)
    top = seen[0].split("Union", 1)[0]
    assert "Exchange" not in top


def test_correlations_join_nobody_with_themselves(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.V, "paired_scores", lambda rows, *a, f=queries.V.paired_scores: seen.append(plan(rows)) or f(rows, *a))
    queries.QUERIES["pearson_spearman_ttest"](spark, SMALL)
    assert "Join" not in seen[0] and seen[0].count("Scan parquet") == 1  # pairs are written once, ranks read them


def test_every_test_bins_people_once(spark, monkeypatch):
    times = []
    monkeypatch.setattr(queries, "_binned", lambda v, n, f=queries._binned: times.append(n) or f(v, n))
    queries.QUERIES["every_test"](spark, SMALL)
    assert times == [10]


def test_distances_to_pivots_are_laid_out_in_bounded_parts():
    frame = pd.DataFrame({"f0": np.arange(10_000.0)})
    parts = list(neighbours._parts(iter([frame, frame.head(3)]), neighbours.MOST_PIVOTS))
    assert max(len(p) for p in parts) * neighbours.MOST_PIVOTS <= neighbours.CELLS
    assert pd.concat(parts)["f0"].tolist() == [*frame["f0"], 0.0, 1.0, 2.0]


def test_each_pass_of_a_boosted_fit_reads_written_vectors(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    plans, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: plans.append(data._jdf.queryExecution().executedPlan().toString()) or fit(self, data))
    assert queries.QUERIES["tree_shap_rank"](spark, SMALL).count() > 0
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_pieces_are_dealt_and_scored_without_a_single_task_or_python(spark, monkeypatch):
    plans, put = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(plan(self._df)), put(self, *a, **b))[1])
    assert queries.QUERIES["streamed_pieces"](spark, SMALL).count() > 0
    assert len(plans) > 3 and not any("Coalesce 1" in p or "InPandas" in p for p in plans)
