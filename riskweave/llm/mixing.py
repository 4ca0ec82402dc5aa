"""Mixing sources to target weights by thresholds on a hash: native DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, text_of, width

#: Bits of the hash of a record, and bits that one histogram resolves (so it has at most 4096 buckets for each source).
HASH_BITS, STEP_BITS = 60, 12
#: A table with a row for each source is broadcast up to so many; beyond it only the sources that could be hot are.
BROADCAST_SOURCES = 100_000
#: Shifts of (hash, row number) that give a record's bucket at each level; row numbers tell records with one hash apart.
LEVELS = [(s, 63) for s in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS)] + [(0, s) for s in (51, 39, 27, 15, 3, 0)]


def word_count(body: Column) -> Column:
    """How many stretches without white space a text has."""
    return F.length(F.translate(F.regexp_replace(body, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\f\r", "")).cast("long")


def _weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources with a column weight: the weights in turn, sources in the order of their code points, null last.

    Sources are dealt to ranges, numbered within each, and counts of the ranges before are added: no task orders them all.
    """
    order = F.col("source").asc_nulls_last()
    ranged = materialise(sources.repartitionByRange(width(sources.sparkSession), order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    ahead = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    return materialise(ranged.join(F.broadcast(ahead), "part").withColumn("weight", turn).drop("part", "ahead"), "mix-sources")


def _level(sources: DataFrame, budget: float, most: float) -> float:
    """The share of one unit of weight when sources stop at `most` times their size and the others share what that leaves."""
    cap, level, stopped = F.col("source_size") * F.lit(float(most)), float("-inf"), -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        got = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("caps"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"), F.sum(full.cast("long")).alias("n")).head()
        if not got["weights"] or got["n"] == stopped:
            return level if got["weights"] else float("inf")
        level, stopped = (budget - got["caps"]) / got["weights"], got["n"]


def _beside(rows: DataFrame, per_source: DataFrame, n_sources: int, n_rows: int) -> DataFrame:
    """rows joined to what is known of their sources: broadcast, where that is small; beyond it only sources with many rows are."""
    named = per_source.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(named), same).drop("of")
    hot = named.filter(F.col("n") * BROADCAST_SOURCES > n_rows)  # fewer than BROADCAST_SOURCES
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), same, "left")
    cold = marked.filter("hot is null").select(rows.columns).join(named.filter(F.col("n") * BROADCAST_SOURCES <= n_rows), same).drop("of")
    return marked.filter("hot").drop("hot", "of").unionByName(cold)


def _prefix(level: int) -> tuple[Column, Column]:
    """A record's bucket at a level; all records share that of level -1."""
    hash_shift, row_shift = LEVELS[level] if level >= 0 else (HASH_BITS, 63)
    return F.shiftright("hash", hash_shift), F.shiftright("row", row_shift)


def _thresholds(keyed: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, budget, at_hash, at_row, need, level): the bucket in which a source's words reach what is needed, and how many are missing there.

    Buckets before it are taken whole. Only the boundary bucket's records go to the next level, until it has one.
    """
    spark, left = keyed.sparkSession, keyed
    open_ = needs.select("source", "budget", F.lit(0).cast("long").alias("at_hash"), F.lit(0).cast("long").alias("at_row"), "need")
    for level in range(len(LEVELS)):
        before, here = _prefix(level - 1), _prefix(level)
        histogram = left.groupBy("source", before[0].alias("from_hash"), before[1].alias("from_row"), here[0].alias("to_hash"), here[1].alias("to_row")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        order = Window.partitionBy("source", "from_hash", "from_row").orderBy("to_hash", "to_row")  # 4096 buckets at most
        running = histogram.withColumn("ended", F.sum("words").over(order))
        o = open_.select(F.col("source").alias("of"), "budget", "at_hash", "at_row", "need")
        met = running.join(o, F.col("source").eqNullSafe(F.col("of")) & (F.col("from_hash") == F.col("at_hash")) & (F.col("from_row") == F.col("at_row")))
        met = met.filter((F.col("ended") - F.col("words") < F.col("need")) & (F.col("need") <= F.col("ended")))
        open_ = materialise(met.select("source", "budget", F.col("to_hash").alias("at_hash"), F.col("to_row").alias("at_row"), (F.col("need") - F.col("ended") + F.col("words")).alias("need"), "n"), "mix-cuts")
        most = open_.agg(F.max("n")).head()[0] or 0
        if most <= 1:
            break
        of = open_.select(F.col("source").alias("of"), "at_hash", "at_row").distinct()
        left = materialise(left.join(of, F.col("source").eqNullSafe(F.col("of")) & (here[0] == F.col("at_hash")) & (here[1] == F.col("at_row")), "left_semi"), "mix-left")
    return open_.drop("n").withColumn("level", F.lit(level))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budgets: tuple[float, ...] = (1.5,), most: float = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, nested: how many words of each document a mix takes, repeats counted.

    Sources, by code point and null last, weigh `weights` in turn and share the budget, a multiple of all words. No source
    gives more than `most` times its words; what it can't give goes to the others by weight, until none is above.
    A source gives all its documents as often as its target holds them whole, and once more those whose hash is
    below its threshold. The document at the threshold gives just the words that are missing, so each source meets its target to
    the word. Budgets ascend; `nested` has the words taken under each (a larger budget takes all that a smaller one does),
    `target` and `taken` are those of the last.

    The hash is of id and text, so reruns agree, whatever the order of rows. Null text has no words, a null source is a source, a
    null id is an id like others. Rows that repeat an id and its text are told apart by their place, so that they
    too can be cut; which of them is taken makes no difference to the result. An empty table gives an empty result. Other
    columns play no part.
    """
    with scratch(docs.sparkSession):
        return materialise(_mix(docs, weights, budgets, most, doc_id, text, source), "mix", keep=True)


def _mix(docs: DataFrame, weights: tuple[float, ...], budgets: tuple[float, ...], most: float, doc_id: str, text: str, source: str) -> DataFrame:
    body = text_of(text)
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))
    key = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(body).alias("size"), key.alias("hash"), F.monotonically_increasing_id().alias("row"))
    keyed = materialise(keyed, "mix-keys")  # some 50 bytes a record; the texts aren't read again
    sources = _weighted(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights)
    totals = sources.agg(F.sum("source_size").alias("words"), F.sum("n").alias("rows"), F.count("*").alias("n")).head()

    levels = [_level(sources, float(b) * (totals["words"] or 0), most) for b in budgets]
    cap = F.col("source_size") * F.lit(float(most))
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("budget"), F.least(cap, F.col("weight") * F.lit(x)).alias("target")) for i, x in enumerate(levels)))).alias("b")
    wanted = sources.select("source", "source_size", "n", every).select("source", "source_size", "n", "b.*").withColumn("want", F.round("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(0)
    wanted = wanted.withColumn("whole", whole).withColumn("need", F.col("want") - F.col("whole") * F.col("source_size"))

    cuts = _thresholds(keyed, wanted.filter("need > 0").select("source", "budget", "need")).withColumnRenamed("source", "of").withColumnRenamed("budget", "nth").withColumnRenamed("need", "missing")
    known = wanted.join(cuts, F.col("source").eqNullSafe(F.col("of")) & (F.col("budget") == F.col("nth")), "left")
    plan = F.struct("budget", "target", "whole", F.coalesce("at_hash", F.lit(-1)).alias("at_hash"), F.coalesce("at_row", F.lit(-1)).alias("at_row"), F.coalesce("missing", F.lit(0)).alias("missing"))
    per = known.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("n").alias("n"), F.max("level").alias("level"), F.array_sort(F.collect_list(plan)).alias("plans"))  # as many as there are budgets

    placed = _beside(keyed, per, totals["n"], totals["rows"] or 0)
    level = F.coalesce(F.col("level"), F.lit(0))
    shift = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in LEVELS)), level + 1)
    at = F.expr("shiftright(hash, hash_shift)"), F.expr("shiftright(row, row_shift)")
    placed = placed.withColumn("hash_shift", shift(0)).withColumn("row_shift", shift(1)).withColumn("in_hash", at[0]).withColumn("in_row", at[1])

    def taken(p: Column) -> Column:
        below = (F.col("in_hash") < p["at_hash"]) | (F.col("in_hash") == p["at_hash"]) & (F.col("in_row") < p["at_row"])
        there = (F.col("in_hash") == p["at_hash"]) & (F.col("in_row") == p["at_row"])
        return p["whole"] * F.col("size") + F.when(below, F.col("size")).when(there, p["missing"]).otherwise(0)

    out = placed.withColumn("nested", F.transform("plans", taken))
    return out.select("doc_id", "size", "source_size", F.element_at("plans", -1)["target"].alias("target"), F.element_at("nested", -1).alias("taken"), "source", "nested")
