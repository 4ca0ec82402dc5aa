"""Sharding by sampled splitters: native DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, text_of

#: Bytes that one range should hold, and the bounds of the number of ranges (with it the driver's share is bounded).
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 1 << 28, 256, 16_384
#: Sampled keys for each range.
OVERSAMPLE = 8


def _splitters(keyed: DataFrame, total: int, ranges: int) -> list:
    """Quantiles of a sample in which a row appears as often as its share of the bytes; at most ranges - 1 keys."""
    draws = F.col("size") * F.lit(ranges * OVERSAMPLE / max(total, 1))
    lot = F.pmod(F.xxhash64("spread", "hash", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(draws) + F.when(lot < draws - F.floor(draws), 1).otherwise(0)).cast("long")
    drawn = sorted((r["hash"], r["spread"], r["times"]) for r in keyed.select("hash", "spread", times.alias("times")).filter("times > 0").collect())
    weight, out, step = 0, [], sum(x[2] for x in drawn) / ranges
    for h, s, n in drawn:
        if weight + n > step * (len(out) + 1) and (not out or out[-1] != (h, s)) and len(out) < ranges - 1:
            out.append((h, s))
        weight += n
    return out


def _range_of(splitters: list):
    """The number of splitters at or below a row's key, by two short array searches instead of one long one."""
    if not splitters:
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    key = F.struct(F.col("hash").alias("h"), F.col("spread").alias("s"))
    lit = lambda rows: F.array(*(F.struct(F.lit(h).cast("long").alias("h"), F.lit(s).cast("long").alias("s")) for h, s in rows))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    at = F.size(F.filter(lit([b[0] for b in blocks]), lambda x: x <= key))
    inside = F.element_at(F.array(*map(lit, blocks)), F.greatest(at, F.lit(1)))
    return F.greatest(at - 1, F.lit(0)) * step + F.size(F.filter(inside, lambda x: x <= key))


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: records in shards of near equal bytes.

    Law `bytes`. The key of a record is the hash of its text, then of its id, so that equal texts lie side by side and
    a large group of them can still be cut. Splitters come from a sample drawn by size; ranges that hold over twice
    their share are subdivided by the hash of the id. Shards are cut from the ranges in order, so each ends within one
    record of an equal share. slot counts from 0 in every shard, in key order.

    Null text is empty (size 1). A record's own number, written with its key, tells records of one text and id apart, or
    of no id, so these are cut like others. Repeated rows are records of their own, in any order among
    themselves. An empty table gives an empty result. Other columns play no part.
    """
    with scratch(docs.sparkSession):
        return materialise(_shard(docs, shards, doc_id, text), "shards", keep=True)


def _shard(docs: DataFrame, shards: int, doc_id: str, text: str) -> DataFrame:
    body = text_of(text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(body).alias("hash"), F.monotonically_increasing_id().alias("row"))
    keyed = materialise(keyed.withColumn("spread", F.xxhash64("doc_id", "row")), "shard-keys")  # 50 bytes a record; the texts aren't read again
    total = keyed.agg(F.sum("size")).head()[0] or 0
    ranges = min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES))
    ranged = keyed.withColumn("part", _range_of(_splitters(keyed, total, ranges)))

    fair = max(1, total // ranges)
    sizes = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count("*").alias("n"))
    cuts = sizes.select("part", F.when((F.col("bytes") > 2 * fair) & (F.col("n") > 1), F.least(F.ceil(F.col("bytes") / fair), F.col("n"))).otherwise(1).cast("int").alias("cuts"))
    divided = ranged.join(F.broadcast(cuts), "part").withColumn("cut", F.pmod(F.xxhash64("spread", F.lit("cut")), F.col("cuts")).cast("int"))

    by = ["part", "cut"]
    order = Window.orderBy(*by)  # over the segments, at most a few for each range
    segments = divided.groupBy(*by).agg(F.sum("size").alias("bytes"))
    before = segments.select(*by, (F.sum("bytes").over(order) - F.col("bytes")).alias("before"))
    inside = Window.partitionBy(*by).orderBy("hash", "spread", "row")
    ended = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = ended - F.col("size") / 2
    placed = divided.join(F.broadcast(before), by).withColumn("nth", F.row_number().over(inside)).withColumn("middle", middle)
    placed = placed.withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))

    counts = placed.groupBy("shard", *by).agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy(*by)) - F.col("n")
    slots = counts.select("shard", *by, (ahead - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(slots), ["shard", *by]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
