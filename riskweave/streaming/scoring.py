"""Scoring people as they arrive, against frozen weights and bin edges: an extension.

score_stream: each micro-batch holds whole people (a file of long feature rows for a set of ids), so a stream-static join and a sum
within the batch give final scores, without state. score_pieces: people arrive in pieces, and what is known of each is kept.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.binning import bin_of


def score_batch(rows: DataFrame, weights: DataFrame, edges: DataFrame, coef: str = "coef100") -> DataFrame:
    """(iid, model, score, bin) of one batch of (iid, feature, x)."""
    scores = rows.join(weights, "feature").groupBy("iid", "model").agg(F.sum(F.col("x") * F.col(coef)).cast("long").alias("score"))
    return scores.join(edges.select("model", "edges"), "model").select("iid", "model", "score", bin_of(F.col("score"), F.col("edges")).alias("bin"))


def score_stream(spark: SparkSession, path: str, weights: DataFrame, edges: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parquet files that land in path are scored once each; a replayed batch overwrites its own part of the output."""
    rows = spark.readStream.schema("iid long, feature string, x long").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        score_batch(batch, weights, edges).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: How long a person waits for what is missing, in milliseconds.
PATIENCE = 3_600_000
_PIECE = "iid long, piece int, pieces int, rows array<struct<feature: string, x: long>>"
_KNOWN = "seen:array<int>, sums:map<string,bigint>, told:boolean, until:bigint"


def _piece_sums(batch: DataFrame, weights: DataFrame, models: list[str], coef: str) -> DataFrame:
    """(iid, piece, copy, pieces, s0, s1, ...): what each copy of a piece adds to each model; none where the piece has no feature of it."""
    each = batch.select("iid", "piece", "copy", "pieces", F.explode_outer("rows").alias("r")).select("iid", "piece", "copy", "pieces", "r.feature", "r.x")
    part = F.coalesce(F.col("x") * F.col(coef), F.lit(0)).cast("long")
    sums = [F.sum(F.when(F.col("model") == m, part)).alias(f"s{i}") for i, m in enumerate(models)]
    return each.join(F.broadcast(weights.select("feature", "model", coef)), "feature", "left").groupBy("iid", "piece", "copy", "pieces").agg(*sums)


def _known(sums: DataFrame, before: DataFrame | None, models: list[str], now: int, patience: int) -> DataFrame:
    """What is known of everybody after a batch, a row for each person; tell: the sums go out now, gone: nobody waits for the person any more."""
    places = [f"s{i}" for i in range(len(models))]
    rows = sums.select("iid", F.struct("piece", "copy", "pieces", *places).alias("came"), F.lit(None).cast(f"struct<{_KNOWN}>").alias("was"))
    if before is not None:
        rows = rows.unionByName(before.select("iid", F.lit(None).cast(rows.schema["came"].dataType).alias("came"), F.struct(*(x.split(":")[0] for x in _KNOWN.split(", "))).alias("was")))
    own = rows.groupBy("iid").agg(F.array_sort(F.collect_list("came")).alias("came"), F.first("was", ignorenulls=True).alias("was"))
    own = own.select("iid", "came", F.coalesce("was.seen", F.array().cast("array<int>")).alias("seen"), "was.sums", F.coalesce("was.told", F.lit(False)).alias("told"), "was.until")
    # A piece that came before doesn't count; of one that came twice at once, the first copy does, whole.
    fresh = F.filter("came", lambda x, i: ~F.array_contains("seen", x["piece"]) & ((i == 0) | ~F.get("came", i - 1)["piece"].eqNullSafe(x["piece"])))
    own = own.withColumn("fresh", fresh).withColumn("seen", F.concat("seen", F.transform("fresh", lambda x: x["piece"])))
    add = lambda s: lambda total, x: F.when(x[s].isNull(), total).otherwise(F.coalesce(total, F.lit(0)) + x[s])
    totals = [F.aggregate("fresh", F.col("sums")[m], add(s)) for s, m in zip(places, models, strict=True)]
    sums = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, models)), F.array(*totals)), lambda _, total: total.isNotNull()) if models else F.lit(None).cast("map<string,bigint>")
    due = F.array_max(F.transform("fresh", lambda x: x["pieces"]))
    whole = ~F.col("told") & F.coalesce((due > 0) & (due <= F.size("seen")), F.lit(False))
    gone = (F.size("came") == 0) & (F.col("until") < now)
    own = own.select("iid", "seen", sums.alias("sums"), "told", F.when(F.size("came") > 0, F.lit(now + patience)).otherwise(F.col("until")).alias("until"), whole.alias("complete"), gone.alias("gone"))
    tell = (F.col("complete") | (F.col("gone") & ~F.col("told"))) & (F.size("sums") > 0)
    return own.select("iid", "seen", "sums", (F.col("told") | F.col("complete")).alias("told"), "until", "complete", F.coalesce("gone", F.lit(False)).alias("gone"), F.coalesce(tell, F.lit(False)).alias("tell"))


def score_pieces(spark: SparkSession, path: str, weights: DataFrame, edges: DataFrame, out: str, checkpoint: str, coef: str = "coef100", patience: int = PATIENCE) -> StreamingQuery:
    """(iid, model, score, complete, bin) of people who arrive in pieces, in any order, some more than once.

    Parquet files in path hold pieces: (iid, piece, pieces, rows), rows a list of features with their values, piece a number of one of so many. What is
    known of a person is kept between batches, in `known` beside the checkpoint's own folders: the pieces that have come, and a sum for each model. Each batch
    reads that of the batch before and writes its own, so a batch costs as much as there are people known. A person without a piece for `patience`
    milliseconds is scored as far as known (complete is false) when the next data come, and forgotten. A replayed batch overwrites its own part of both.
    """
    copy = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("copy")
    pieces = spark.readStream.schema(_PIECE).parquet(path).select("iid", "piece", "pieces", copy, "rows")
    models = [r["model"] for r in weights.filter(F.col("model").isNotNull()).select("model").distinct().orderBy("model").collect()]  # a few
    at = lambda number: f"{checkpoint.rstrip('/')}/known/batch={number}"

    def write(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        before = here.read.parquet(at(number - 1)).filter(~F.col("gone")) if number else None
        _known(_piece_sums(batch, weights, models, coef), before, models, int(time.time() * 1000), patience).write.mode("overwrite").parquet(at(number))
        told = here.read.parquet(at(number)).filter("tell").select("iid", F.explode("sums").alias("model", "score"), "complete")
        binned = told.join(F.broadcast(edges.select("model", "edges")), "model").select("iid", "model", "score", "complete", bin_of(F.col("score"), F.col("edges")).alias("bin"))
        binned.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")
        if number > 1:  # the batch before was the last that could need it
            old = here._jvm.org.apache.hadoop.fs.Path(at(number - 2))
            old.getFileSystem(here._jsc.hadoopConfiguration()).delete(old, True)

    return pieces.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
